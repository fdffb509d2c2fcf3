"""SimHash near-dedup and exact dedup against brute force."""

import random
import re

import numpy as np
import xxhash

from spendcode.llm import block_naming, simhash


def brute_print(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, bits):
    labels = list(range(len(ids)))
    near = [[j for j in range(len(ids)) if (prints[i] ^ prints[j]).bit_count() <= bits] for i in range(len(ids))]
    for _ in ids:
        labels = [min(labels[j] for j in near[i]) for i in range(len(ids))]
    out = {}
    for i, label in zip(ids, labels, strict=True):
        out.setdefault(label, []).append(i)
    return [min((x for x in out[label] if x is not None), default=None) for label in labels]


def test_components_match_brute_force(docs_frame):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    rows, nr = [], 0
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(1, 220))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((nr, " ".join(copy).upper() if rng.random() < 0.2 else " \t\n".join(copy)))
            nr += 1
    rows += [(900, None), (901, ""), (902, "  \n"), (903, "Éa\u00a0b"), (903, "Éa\u00a0b"), (None, rows[0][1]), (None, "alone indeed here")]
    got = simhash.simhash_components(docs_frame(rows)).collect()
    prints = [brute_print(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], prints, 3)
    key = lambda x: (str(x[0]), x[1], str(x[2]))
    assert sorted(((r[0], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=key) == sorted(
        zip([i for i, _ in rows], prints, want, strict=True), key=key)


def test_every_mask_set_meets_close_pairs():
    rng = random.Random(1)
    for bits in (1, 2, 3, 5):
        masks = simhash.block_masks(bits)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for p in rng.sample(range(64), bits):
                b ^= 1 << p
            assert any(a & m == b & m for m in masks)


def test_large_buckets_are_split_without_losing_a_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)
    rng = random.Random(5)
    fps = {rng.getrandbits(20) << 3 | 5 << 40 for _ in range(60)} | {(7 << 50) + i for i in range(40)}
    fps = sorted(fps)
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    edges = [tuple(r) for r in simhash.links(rows).collect()]
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        parent[find(a % (1 << 64))] = find(b % (1 << 64))
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                assert find(a) == find(b)


def test_components_of_a_long_chain(spark):
    nodes = list(range(1, 60))
    random.Random(2).shuffle(nodes)
    edges = spark.createDataFrame(list(zip(nodes, nodes[1:], strict=False)) + [(100, 101), (101, 102)], "a bigint, b bigint")
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert all(roots[n] == 1 for n in nodes if n != 1) and roots[101] == roots[102] == 100


def test_long_text_in_blocks():
    text = " ".join(f"a{i % 977}" for i in range(150_000))
    words = text.split()
    bits = np.zeros(64, dtype=int)
    for i in range(len(words) - 2):
        h = xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), seed=42)
        bits += [(h >> b) & 1 for b in range(64)]
    want = sum(1 << b for b in range(64) if 2 * bits[b] > len(words) - 2)
    assert simhash.fingerprint(text) == want


def test_empty_tables(docs_frame):
    assert simhash.simhash_components(docs_frame([])).count() == 0
    assert block_naming.exact_groups(docs_frame([])).count() == 0


def test_exact_groups_match_brute_force(docs_frame, monkeypatch):
    monkeypatch.setattr(block_naming, "BLOCK", 8)
    monkeypatch.setattr(block_naming, "SALTS", 4)
    monkeypatch.setattr(block_naming, "HOT", 50)
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab \n\té") for _ in range(rng.randint(0, 70))) for _ in range(60)]
    texts += [t.replace(" ", "\t \n") for t in texts[:25]] + ["abababab" * 9] * 40 + ["abababab" * 8, None, "", " ", "\n\n"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[5]), (None, "nobody else")]
    got = block_naming.exact_groups(docs_frame(rows)).collect()
    groups = {}
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    import hashlib
    sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == len(rows)
    for r in got:
        ids = sha[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == min((i for i in ids if i is not None), default=None)
    for h, ids in sha.items():
        kept = [r["doc_id"] for r in got if r["text_sha256"] == h and r["kept"]]
        assert kept == [min((i for i in ids if i is not None), default=None)]
