"""BPE encoding and packing against the tokenizers library and counting bounds."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from spendcode.llm import bpe, packing, tokens
from spendcode.llm.queries import tokenizer_path

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")

ODD = ["", " ", "\n", "  a", "a  ", "a \n b", "a\n\n\nb c", "tab\tx y", "don't we'll I'M 's", "x<|endoftext|> y <|startoftext|>z",
       "İstanbul ΣΑΣ ς", "é café àb", " nb sp  em", "\x1c\x1d a\x85b", "日本語 テキスト 12 ½ ²", "👍🏽 ok 👍",
       "a" * 700, "ab " * 900, "12345 67", "᠎ x", "﻿bom", "# $$ %% ... !!", "x­y", "ÀÉÎ ñ Œuvre ſ", " \t lead", "a\r\nb \r\n c"]


def random_texts(seed, n=60):
    rng = random.Random(seed)
    syllables = ["the", "ing", "ou", "é", "Ñ", "tion", "be", "x", "9", "'s", ",", ".", "!", "ß", "中", "́"]
    make = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 5)))
    return ["".join(make() + rng.choice([" ", " ", " ", "\n", "  ", " \n"]) for _ in range(rng.randint(0, 300))) for _ in range(n)]


@pytest.mark.parametrize("path, encoder", [(BYTE, tokens.byte_encoder), (WORD, tokens.word_encoder)])
def test_ids_equal_the_library(path, encoder, monkeypatch):
    monkeypatch.setattr(tokens, "PARTS", 50)  # parts are forgotten and learned again
    library, own = Tokenizer.from_file(path), encoder.__wrapped__(path)
    texts = ODD + random_texts(1)
    kind = getattr(own, "kind", "<u4")
    for _ in range(2):
        got = [np.frombuffer(b, dtype=kind).tolist() for b in own.encode(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_cuts_depend_on_content_alone():
    rng = random.Random(2)
    text = " ".join(f"{rng.random()}" for _ in range(3000)).encode()
    ends = lambda data: {data[max(0, p - 40):p] for p in bpe.cut_places(data)[2:]}
    a, b = ends(b"some other beginning " + text), ends(text)
    assert len(b) > 20 and len(a & b) > 0.8 * len(b)


def test_documents_are_encoded_as_by_the_library(docs_frame, monkeypatch):
    rng = random.Random(3)
    passages = [t for t in random_texts(4, 30) if len(t) > 400]
    texts = ODD + random_texts(5, 40) + [a + "\n" + rng.choice(passages) + " " + b
                                         for a, b in zip(random_texts(6, 40), random_texts(7, 40), strict=True)]
    texts += texts[-20:] + [passages[0] * 30, "z" * 5000 + passages[1] + "q" * 3000]
    rows = [*enumerate(texts), (None, passages[2] * 2), (5, passages[3]), (5000, None)]
    library = Tokenizer.from_file(WORD)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = bpe.encode_documents(docs_frame(rows), WORD, bpe.digests, "n bigint, a string, b string",
                               [pa.int64(), pa.string(), pa.string()])
    assert sorted((str(r["doc_id"]), r["n"], r["a"], r["b"]) for r in got.collect()) == sorted(want)
    # every document by way of the join, as when the bitmap is full
    monkeypatch.setattr(bpe, "_has", lambda bitmap, key: True)
    again = bpe.encode_documents(docs_frame(rows), WORD, bpe.digests, "n bigint, a string, b string",
                                 [pa.int64(), pa.string(), pa.string()])
    assert sorted((str(r["doc_id"]), r["n"], r["a"], r["b"]) for r in again.collect()) == sorted(want)


def test_round_trip_and_empty(docs_frame):
    rows = [(1, "Hello  world, don't"), (2, None)]
    out = {r["doc_id"]: r["decoded"] for r in bpe.decode(bpe.encode(docs_frame(rows), WORD), WORD).collect()}
    library = Tokenizer.from_file(WORD)
    assert out == {1: library.decode(library.encode(rows[0][1], add_special_tokens=False).ids, skip_special_tokens=False), 2: ""}
    assert bpe.encode(docs_frame([]), WORD).count() == 0


def check_packing(rows, got, capacity):
    library = Tokenizer.from_file(BYTE)
    want, total = [], 0
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        total += len(ids)
        k = -(-len(ids) // capacity)
        ends = [len(ids) - capacity * (k - 1 - j) for j in range(k)]
        want += [(str(i), j, a, b - a, zlib.crc32(ids[a:b].tobytes())) for j, (a, b) in enumerate(zip([0, *ends], ends, strict=False))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-total // capacity)


def test_packing_of_documents(docs_frame):
    rows = [*enumerate(ODD + random_texts(9, 60)), (0, ODD[5]), (0, ODD[5]), (None, "no id"), (99, " ".join(random_texts(10, 30)))]
    got = packing.pack_documents(docs_frame(rows), BYTE, capacity=512).collect()
    used, least = check_packing(rows, got, 512)
    assert used <= least + 1
    assert packing.pack_documents(docs_frame([]), BYTE).count() == 0


def test_shards_and_rounds(docs_frame, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 60)
    rows = list(enumerate(random_texts(11, 300)))
    used, least = check_packing(rows, packing.pack_documents(docs_frame(rows), BYTE, capacity=1024).collect(), 1024)
    assert used <= 1.03 * least + 1


@pytest.mark.parametrize("lengths, least", [
    ([700] * 1500, 750),                                # two fill 68 %
    ([1500] * 1500, 1500),                              # one a bin
    ([1500] * 1200 + [1400, 1100, 900, 300] * 100, 1400),  # 900 + 1100 fill a bin, a 300 goes to a 1500 or 1400
])
def test_pieces_that_cannot_fill_a_sequence(spark, monkeypatch, lengths, least):
    monkeypatch.setattr(packing, "SHARD", 500)
    turns = []
    packer = packing._shard_packer
    monkeypatch.setattr(packing, "_shard_packer", lambda *a: turns.append(a) or (packer(*a) if len(turns) < 12 else 1 / 0))
    rows = [(i, 0, 0, n, 0, i) for i, n in enumerate(lengths)]
    got = packing.pack_pieces(spark.createDataFrame(rows, packing._PIECES)).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == list(enumerate(lengths))
    fills = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == fills.get(r["sequence_id"], 0)
        fills[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fills.values()) <= 2048 and len(fills) <= least + 2


def test_local_search_empties_bins():
    for seed in range(5):
        lengths = np.random.default_rng(seed).integers(300, 1100, 400)
        start, fills = packing.best_fit(lengths, 2048)
        bins, fill = start.copy(), np.array(fills)
        packing.local_search(lengths, bins, fill, 2048)
        assert (np.bincount(bins, lengths, minlength=len(fill)) == fill).all() and fill.max() <= 2048
        assert (fill.astype(float) ** 2).sum() >= (np.array(fills, dtype=float) ** 2).sum()
        assert (fill > 0).sum() <= len(fills)
    # 6 + 4, 6 + 4, 5 + 5 in bins of 10 cannot be found by best fit decreasing from a bad start
    lengths = np.array([6, 5, 4, 6, 5, 4])
    bins, fill = np.array([0, 1, 1, 2, 3, 3]), np.array([6, 9, 6, 9])
    packing.local_search(lengths, bins, fill, 10)
    assert (fill > 0).sum() == 3


def mixes():
    import numpy as np
    rng = np.random.default_rng(1)
    for lo, hi, n in ((300, 1100, 6000), (500, 1000, 6000), (400, 500, 6000), (680, 760, 6000), (1, 2048, 3000), (700, 701, 3000), (1025, 1945, 3000), (20, 60, 3000)):
        yield (lo, hi), rng.integers(lo, hi, n)


def test_search_saves_sequences_and_squares_grow():
    import numpy as np
    from spendcode.llm import packing
    saved = {}
    for name, lengths in mixes():
        bins, fills = packing.best_fit(lengths, 2048)
        fills = np.array(fills, dtype=np.int64)
        before, squares = np.count_nonzero(fills), int((fills ** 2).sum())
        steps = packing.local_search(lengths, bins, fills, 2048)
        after = np.count_nonzero(fills)
        real = np.bincount(bins, weights=lengths, minlength=len(fills)).astype(np.int64)
        assert (real == fills).all() and fills.max() <= 2048
        assert int((fills ** 2).sum()) > squares if steps else int((fills ** 2).sum()) == squares
        assert packing.least_bins(lengths, 2048) <= after <= before
        saved[name] = before - after
    # best fit alone needs more in these mixes; in the others a bound or equal lengths leave nothing to save
    assert all(saved[m] > 0 for m in ((300, 1100), (500, 1000), (400, 500), (680, 760)))
    assert not saved[700, 701] and not saved[1025, 1945]


def fewest(lengths, capacity):
    """Bins of an optimal packing, by trying all."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins[k] not in bins[:k]:
                place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1:]])
        place(i + 1, [*bins, lengths[i]])
    place(0, [])
    return best[0]


def test_bound_and_search_against_optimal_packings():
    import numpy as np
    from spendcode.llm import packing
    rng, hits = np.random.default_rng(2), 0
    for _ in range(300):
        lengths = rng.integers(1, rng.integers(3, 31), rng.integers(1, 10))
        best = fewest(lengths.tolist(), 30)
        bins = packing.pack_shard(lengths, 30)
        used = len(set(bins.tolist()))
        assert packing.least_bins(lengths, 30) <= best <= used <= best + 1
        hits += used == best
    assert hits >= 290
    assert packing.least_bins(np.array([], dtype=np.int64), 30) == 0


def test_two_for_one_empties_a_bin():
    import numpy as np
    from spendcode.llm import packing
    # 6 | 5 | 4 3: only two for one (4 + 3 against 6 in a bin of 7), and back, fills bins of 12
    lengths, bins = np.array([6, 5, 4, 3, 6]), np.array([0, 0, 1, 1, 2])
    fills = np.array([11, 7, 6])
    assert packing.local_search(lengths, bins, fills, 12) > 0
    assert np.count_nonzero(fills) == 2 and fills.max() <= 12
