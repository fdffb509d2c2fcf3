"""Ranked search against scores of every document, and the stopping rule of the lists."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from spendcode.llm import lexical

RUN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return RUN.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    counts = [(i, Counter(cut(t)), len(cut(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for _, _, n in counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counts:
            score = 0
            for t in cut(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // n_terms)))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def searched(spark, docs_frame, docs, items, **options):
    rows = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS item", "'x' AS term", "2 AS score", "3 AS rank")
    return sorted((tuple(r) for r in lexical.search(docs_frame(docs), rows, **options).collect()), key=repr)


def corpus(seed, n, words=60, size=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(size)))) for i in range(n)]


@pytest.mark.parametrize("shard", [lexical.SHARD, 300])
def test_random_corpus(spark, docs_frame, shard):
    docs, items = corpus(1, 400), corpus(2, 30, size=12)
    assert searched(spark, docs_frame, docs, items, k=5, shard=shard, block=7) == brute(docs, items, 5)


def test_ties_repeats_nulls_and_empty(spark, docs_frame):
    docs = [(9, "alpha beta"), (3, "Alpha BETA"), (3, "alpha beta"), (None, "alpha beta"), (1, None), (2, ""), (4, "...!"), (5, "Ärger ÄRGER x_y"),
            (6, "alpha " * 5000 + "gamma"), (-7, "alpha beta")] + [(i, "alpha beta delta") for i in range(100, 140)]
    items = [(1, "alpha beta beta"), (1, "alpha beta beta"), (None, "gamma"), (2, None), (3, ""), (4, "unknown"), (5, "ärger x"), (6, "ÄRGER"), (7, "beta-alpha")]
    assert searched(spark, docs_frame, docs, items, k=4) == brute(docs, items, 4)
    assert searched(spark, docs_frame, docs, items, k=4, shard=20, block=2) == brute(docs, items, 4)


def test_term_that_all_documents_hold_and_small_tables(spark, docs_frame):
    assert searched(spark, docs_frame, [(1, "a"), (2, "a a")], [(1, "a")]) == brute([(1, "a"), (2, "a a")], [(1, "a")], 10)
    assert searched(spark, docs_frame, [], [(1, "a")]) == []
    assert searched(spark, docs_frame, [(1, "a")], []) == []
    assert searched(spark, docs_frame, [(1, "...")], [(1, "a")]) == []


def test_large_group_of_copies(spark, docs_frame):
    docs = [(i, "common words of a copied text") for i in range(500)] + corpus(3, 100)
    items = [(1, "copied text w1 w7"), (2, "common")]
    assert searched(spark, docs_frame, docs, items, k=10, shard=200) == brute(docs, items, 10)


def lists_of(columns):
    """One list a term from ``{doc: impact}`` dictionaries."""
    flat = [(t, d, v) for t, c in enumerate(columns) for d, v in c.items()]
    return lexical.ImpactLists(*(np.array(x, dtype=np.int64) for x in zip(*flat)), len(columns))


def test_stops_below_the_kth_score_and_not_at_it(monkeypatch):
    monkeypatch.setattr(lexical, "RUN", 1)
    # two lists of 1000 documents: documents 0 and 1 lead both, the others come in opposite orders far below
    high = {0: 900, 1: 800}
    a = {d: 400 - d // 5 for d in range(2, 1000)} | high
    b = {d: 200 + d // 5 for d in range(2, 1000)} | high
    found, scores, read = lexical.best_positions(lists_of([a, b]), [(0, 1), (1, 1)], 1000, 2)
    assert read <= 3 and sorted(scores)[-2:] == [1600, 1800]
    # every document scores 100: a bound equal to the k-th score must not end the search
    flat = [{d: 60 for d in range(50)}, {d: 40 for d in range(50)}]
    found, scores, read = lexical.best_positions(lists_of(flat), [(0, 1), (1, 1)], 50, 5)
    assert sorted(found) == list(range(50)) and set(scores) == {100}


def test_places_seen_by_direct_access_stop_earlier_than_last_reads(monkeypatch):
    monkeypatch.setattr(lexical, "RUN", 1)
    # the first six places of list 1 hold the documents of the first six of list 0, reversed: reading
    # three of each sees six of both, so the bound uses place six, not place three
    a = {d: v for d, v in zip((0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (50, 49, 48, 47, 46, 45, 9, 8, 7, 6))}
    b = {d: v for d, v in zip((5, 4, 3, 2, 1, 0, 9, 8, 7, 6), (50, 49, 48, 47, 46, 45, 9, 8, 7, 6))}
    _, scores, read = lexical.best_positions(lists_of([a, b]), [(0, 1), (1, 1)], 10, 6)
    assert read == 3 and sorted(scores) == [95] * 6


def test_random_lists_agree_with_all_scores():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 200)
        columns = [{d: rng.randrange(1, 30) ** 2 for d in range(n) if rng.random() < rng.random()} for _ in range(rng.randrange(1, 6))]
        if not any(columns):
            continue
        terms, k = [(t, rng.randrange(1, 4)) for t in range(len(columns))], rng.randrange(1, 12)
        found, scores, _ = lexical.best_positions(lists_of(columns), terms, n, k)
        got = sorted(zip((-scores).tolist(), found.tolist()))[:k]
        full = sorted((-sum(c * columns[t].get(d, 0) for t, c in terms), d) for d in range(n))
        assert got == [x for x in full if x[0]][:k]
