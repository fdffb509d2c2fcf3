"""The manifest against a plain recomputation of every tree, proof and fold."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from spendcode.llm import merkle
from spendcode.llm.common import ascii_lower

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    steps = []
    for level in levels[:-1]:
        start = i - i % 16
        steps.append(("".join(level[start:i]), "".join(level[i + 1:start + 16])))
        i //= 16
    return steps


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            steps = path(trees[s], i) + path(top, at)
            start = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                start = leaf_of((*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in steps:
                start = h(a + start + b)
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], h("".join(a + b for a, b in steps)), start, start == top[-1][0]))
    return sorted(out, key=repr)


def audited(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars int, text string").repartition(parts)
    # names that the operator uses inside
    df = df.selectExpr("*", "1 AS tree", "2 AS idx", "'x' AS digest", "'y' AS leaf", "3 AS n", "'z' AS path", "'w' AS root", "4 AS part")
    out = merkle.audit(df, FIELDS, "doc_id", "source", ascii_lower(F.col("text")), "text")
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_trees_of_all_heights(spark):
    rows, key = [], 0
    for size in (1, 2, 15, 16, 17, 255, 256, 257, 300):
        for _ in range(size):
            key += 7
            rows.append((key, f"s{size}", "en", key % 50, f"Text {key} Of {size}"))
    got = audited(spark, rows)
    assert got == brute(rows)
    assert {v[-1] for v in got} == {True, False}


def test_tall_tree_in_subtrees_of_one_level(spark, monkeypatch):
    monkeypatch.setattr(merkle, "EVERY", 1)
    rows = [(i, "hot" if i % 3 else f"s{i % 40}", None, None, f"A{i}") for i in range(900)]
    assert audited(spark, rows) == brute(rows)


def test_nulls_ties_and_repeats(spark):
    rows = [(None, None, None, None, None), (None, None, "en", 1, ""), (1, None, "en", 0, ""), (1, None, "en", 0, ""), (1, "", "en", 0, "B"),
            (1, "", "en", 0, "A"), (2, "é", None, 3, "ÄÖ Ü"), (3, "z", "de", 1, "x" * 300_000), (10, "z", "a:b", -1, "5:AB"), (5, "Z", "en", 1, None),
            (10, "z", "a:b", -1, "5:AB")]
    assert audited(spark, rows) == brute(rows)


def test_tampering_is_caught_where_text_changes(spark):
    rows = [(i, f"s{i % 3}", "en", 1, "lower only" if i % 2 else "Upper") for i in range(400)]
    for r in audited(spark, rows):
        hit = zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[0] % 2 == 0
        assert r[-1] is (not hit)


def test_single_documents_and_empty_table(spark):
    assert audited(spark, [(7, "a", "en", 1, "T")]) == brute([(7, "a", "en", 1, "T")])
    rows = [(i, f"only{i}", "en", 1, "T") for i in range(40)]
    assert audited(spark, rows) == brute(rows)
    assert audited(spark, []) == []


@pytest.mark.parametrize("parts", [1, 40])
def test_hot_group_over_many_partitions(spark, parts):
    rows = [(i // 2, "hot", "en", 1, "same") for i in range(600)]
    assert audited(spark, rows, parts) == brute(rows)
