"""Best catalogue entry for each text (fuzzy match), exact and distributed.

Semantics: every catalogue row with a description is scored against the text; the
highest integer score wins, ties go to the earliest catalogue row, a best score of 0 is
no match, and with a ``cutoff`` a best score below it is no match.  A blank text is no
match.

Texts and descriptions are lower-cased and, for the token-sort scorer, normalised; texts are
de-duplicated on that key, catalogue rows too (keeping the earliest row, lossless for the
argmax).  Both sides stay DataFrames; the catalogue is an index of blocks:

1. **Blocks.**  The distance behind the score, insertions plus deletions, is a metric.  About
   the square root of the entries, ``PIVOTS`` at most, serve as pivots (a bounded sample);
   every entry goes to the block of its nearest pivot.  A block is known by the ranges of its
   entries' distances to that pivot and to ``REFERENCES`` others, its lengths and its earliest row.
2. **Bounds.**  A text's distances to the pivots bound, by the triangle inequality and the
   lengths, the score that any entry of a block can reach.  No bound ever hides a winner.
3. **Seeds.**  Equal keys are joined first.  All other texts meet the block with the best bound and
   those of the nearest pivots, which gives each a score to beat.
4. **Rest.**  A text meets every other block whose bound still beats its score (or ties with an
   earlier row).  Pairs of (text, block) are the only rows that are formed: the number of
   blocks a text meets follows from the bounds, with no cap.
5. Within a block, texts and entries are co-grouped and scored by bit-parallel LCS, candidates in
   the order of their own bounds (``best_in_chunk``).  Blocks of more than ``max_rows`` entries are
   split into parts and a block's texts into slices, so no group grows with the data.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendcode.functions import fuzzy as FZ
from spendcode.functions.text import is_blank
from spendcode.operators.boundary import settle
from spendcode.session import ship_package

VECTOR_MAX_TEXT = 256
BAG_CHARS = 63      # characters with their own column in the bag bound (+1 "other")
MASK_CHARS = 96     # largest block alphabet for which uint64 position masks are built
WORD_BITS = 63      # positions in one word of a mask, whose last bit takes the carry
MASK_WORDS = 4      # words of the longest entry that has masks
PAIRS_AT_ONCE = 8192  # pairs of (text, entry) whose LCS is run side by side: their state stays in the cache
BOUNDS_AT_ONCE = 1 << 19  # pairs whose bounds are held at once
ROUNDS = (8, 64)    # best bounds of a text that are scored before all the others that are left
PIVOTS = 1024       # blocks, at most
PIVOT_CHARS = 62    # a pivot is the start of an entry: any string may be one
REFERENCES = 32     # pivots that every block keeps its range of distances to
PART_ROWS = 4096    # entries of one part of a block
SEEDS = 4           # blocks that a text visits first
SLICE_TEXTS = 10_000  # texts that one task scores against a part, on average at most

_FOUND_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("m_ordinal", T.LongType()),
    T.StructField("m_code", T.StringType()),
    T.StructField("m_description", T.StringType()),
    T.StructField("m_score", T.IntegerType()),
])
_MATCH_SCHEMA = T.StructType([T.StructField("k", T.StringType()), *_FOUND_SCHEMA.fields[1:]])
_PAIR = "id bigint, k string, floor int, block int, part int"


def match_key(c, scorer: str):
    low = F.lower(F.col(c) if isinstance(c, str) else c)
    return FZ.token_sort_key(low) if scorer == "token_sort" else low


class _Catalogue:
    """Entries of one part of a block, earliest first, prepared once a task: lengths, per-entry
    character counts over their alphabet, and bit masks of each character's positions for entries of
    at most ``MASK_WORDS * WORD_BITS`` characters (some uint64 words per entry)."""

    def __init__(self, entries):
        import numpy as np

        self.entries = entries  # (key, ordinal, code, description), earliest first
        self.keys = [e[0] for e in entries]
        self.ordinals = np.array([e[1] for e in entries], dtype=np.int64)
        self.lens = np.array([len(k) for k in self.keys], dtype=np.int64)
        n = len(entries)
        flat = np.frombuffer("".join(self.keys).encode("utf-32-le"), dtype=np.uint32)
        codes, freq = np.unique(flat, return_counts=True)
        owner = np.repeat(np.arange(n), self.lens)
        starts = np.repeat(np.cumsum(self.lens) - self.lens, self.lens)
        pos = np.arange(flat.size) - starts
        ci = np.searchsorted(codes, flat)
        # Character-bag bound over the most frequent characters plus one "other" bucket:
        # merging characters only loosens the bound, so it stays an upper bound.
        top = np.argsort(-freq, kind="stable")[:BAG_CHARS]
        # one place more than there are characters, for those of a text that no entry has
        self.codes, self.bucket = codes, np.full(len(codes) + 1, len(top), dtype=np.int64)
        self.bucket[top] = np.arange(len(top))
        self.bag_index = {chr(int(codes[i])): int(self.bucket[i]) for i in range(len(codes))}
        count_type = np.uint16 if (self.lens.max(initial=0) < 65536) else np.int32
        self.counts = np.zeros((n, len(top) + 1), dtype=count_type)
        np.add.at(self.counts, (owner, self.bucket[ci]), 1)
        # Bit masks for the vectorised LCS need every character; built for small alphabets.
        self.vector_ok = len(codes) <= MASK_CHARS
        self.short = self.lens <= (MASK_WORDS * WORD_BITS if self.vector_ok else -1)  # all others take the exact scalar path
        words = -(-int(self.lens[self.short].max(initial=0)) // WORD_BITS)
        self.masks = np.zeros((words, len(codes) + 1, n), dtype=np.uint64)
        sel = self.short[owner]
        np.bitwise_or.at(self.masks, (pos[sel] // WORD_BITS, ci[sel], owner[sel]),
                         np.left_shift(np.uint64(1), (pos[sel] % WORD_BITS).astype(np.uint64)))
        self.full = np.bitwise_or.reduce(self.masks, axis=1)
        self._masks_py: dict[int, dict] = {}

    def score(self, lp, lcs, idx=None):
        """Vectorised ratio from LCS lengths (same float steps as the scalar helper)."""
        import numpy as np
        total = (self.lens if idx is None else self.lens[idx]) + lp
        with np.errstate(divide="ignore", invalid="ignore"):
            r = (total - (total - 2 * lcs)) / total
        return np.round(100 * r)

    def places(self, text: str):
        """Place of each character of ``text`` in the alphabet, ``len(codes)`` for those that no entry has."""
        import numpy as np
        chars = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        at = np.searchsorted(self.codes, chars)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == chars, at, len(self.codes)) if len(self.codes) else np.zeros(len(chars), dtype=np.int64)

    def lcs_pairs(self, texts, rows, idx):
        """Exact LCS of the texts ``rows`` (places of their characters, filled up behind the end with
        ``len(codes)``) with the short entries ``idx``, pair by pair and all pairs side by side."""
        import numpy as np
        out = np.empty(len(rows), dtype=np.int64)
        n = len(self.keys)
        for start in range(0, len(rows), PAIRS_AT_ONCE):
            r, j = rows[start:start + PAIRS_AT_ONCE], idx[start:start + PAIRS_AT_ONCE]
            words = max(1, -(-int(self.lens[j].max()) // WORD_BITS))
            full = [f[j] for f in self.full[:words]]
            masks = [m.ravel() for m in self.masks[:words]]
            v = [f.copy() for f in full]
            some = texts[r]
            some = some[:, (some != len(self.codes)).any(axis=0)]
            for at in np.ascontiguousarray(some.T):
                at = at * n + j
                carry = None
                for w in range(words):
                    u = masks[w].take(at)
                    u &= v[w]
                    total = v[w] + u
                    if carry is not None:
                        total += carry
                    if w + 1 < words:
                        carry = total >> np.uint64(WORD_BITS)
                    v[w] -= u
                    v[w] |= total
                    v[w] &= full[w]
            left = sum(np.bitwise_count(x).astype(np.int64) for x in v)
            out[start:start + PAIRS_AT_ONCE] = self.lens[j] - left
        return out

    def lcs_one(self, text: str, j: int, text_masks) -> int:
        key = self.keys[j]
        if len(text) >= len(key):
            # a long text often holds all characters of a short entry in their order
            return len(key) if FZ.is_subsequence(key, text) else FZ.lcs_with_masks(text_masks(), len(text), key)
        m = self._masks_py.get(j)
        if m is None:
            m = self._masks_py[j] = FZ.char_masks(key)
        return FZ.lcs_with_masks(m, len(key), text)


def best_in_chunk(cat: "_Catalogue", text: str, floor: int):
    """(index, score) of the best entry scoring at least ``floor`` (ties: earliest row),
    or None.  Exact: candidates are visited by decreasing upper bound (length and
    character-bag bounds) and skipped only when the bound proves they cannot win."""
    import numpy as np

    lp = len(text)
    if lp == 0:  # only an empty entry can score (100); others score 0
        hits = np.flatnonzero(cat.lens == 0)
        return (int(hits[np.argmin(cat.ordinals[hits])]), 100) if hits.size and floor <= 100 else None
    tc = np.bincount(cat.bucket[cat.places(text)], minlength=cat.counts.shape[1])
    bag = np.minimum(cat.counts, tc).sum(axis=1)
    ub = cat.score(lp, np.minimum(bag, np.minimum(cat.lens, lp)))
    ub = np.where(cat.lens == 0, 0, ub)
    cand = np.flatnonzero(ub >= floor)
    if cand.size == 0:
        return None
    cand = cand[np.lexsort((cat.ordinals[cand], -ub[cand]))]
    best, best_j = floor - 1, -1
    masks_box = []

    def text_masks():
        if not masks_box:
            masks_box.append(FZ.char_masks(text) if lp <= 64 else FZ.char_masks_np(text, cat.bag_index))
        return masks_box[0]

    for j in cand:
        # by falling bounds, then by row: what follows cannot win either
        if ub[j] < best or (ub[j] == best and best_j >= 0 and cat.ordinals[j] > cat.ordinals[best_j]):
            break
        sc = 100 if cat.keys[j] == text else FZ.score_from_lcs(lp, int(cat.lens[j]), cat.lcs_one(text, j, text_masks))
        if sc > best or (sc == best and best_j >= 0 and cat.ordinals[j] < cat.ordinals[best_j]):
            best, best_j = sc, int(j)
    return (best_j, best) if best_j >= 0 else None


def best_in_slice(cat: "_Catalogue", texts: list[str], floors: list[int]) -> list:
    """``best_in_chunk`` for each text.  Short texts go side by side: the bounds of all their pairs first, then the
    exact scores of the pairs with the best bounds, then of all others that can still win."""
    hits = [None] * len(texts)
    together = [i for i, t in enumerate(texts) if cat.vector_ok and 0 < len(t) <= VECTOR_MAX_TEXT]
    together.sort(key=lambda i: len(texts[i]))
    size = max(1, BOUNDS_AT_ONCE // len(cat.keys))
    for start in range(0, len(together), size):
        some = together[start:start + size]
        for i, hit in zip(some, _best_of_short(cat, [texts[i] for i in some], [floors[i] for i in some])):
            hits[i] = hit
    for i in set(range(len(texts))).difference(together):
        hits[i] = best_in_chunk(cat, texts[i], floors[i])
    return hits


def _best_of_short(cat: "_Catalogue", texts: list[str], floors: list[int]) -> list:
    import numpy as np

    n, lp = len(cat.keys), np.array([len(t) for t in texts], dtype=np.int64)
    places = np.full((len(texts), int(lp.max())), len(cat.codes), dtype=np.int64)
    for i, t in enumerate(texts):
        places[i, :len(t)] = cat.places(t)
    # the bound of every pair: shared characters, "other" ones merged
    known, bags = places < len(cat.codes), cat.counts.shape[1]
    tc = np.bincount((cat.bucket[places] + np.arange(len(texts))[:, None] * bags)[known], minlength=len(texts) * bags)
    tc = tc.reshape(len(texts), bags).astype(cat.counts.dtype)
    bag = np.zeros((len(texts), n), dtype=cat.counts.dtype)
    for c in np.flatnonzero(tc.any(axis=0)):
        bag += np.minimum(tc[:, c, None], cat.counts[:, c])
    ub = np.where(cat.lens == 0, 0, cat.score(lp[:, None], bag.astype(np.int64)))
    # one number for score and row: a higher one wins
    rank = n - 1 - np.arange(n)
    bound = ub.astype(np.int64) * n + rank
    best = np.array(floors, dtype=np.int64) * n - 1

    def score(rows, idx):
        lcs = np.empty(len(rows), dtype=np.int64)
        short = cat.short[idx]
        lcs[short] = cat.lcs_pairs(places, rows[short], idx[short])
        for x in np.flatnonzero(~short):
            text = texts[rows[x]]
            lcs[x] = cat.lcs_one(text, int(idx[x]), lambda: FZ.char_masks(text))
        np.maximum.at(best, rows, cat.score(lp[rows], lcs, idx).astype(np.int64) * n + rank[idx])
        bound[rows, idx] = -1

    for k in ROUNDS:
        if k < n:
            idx = np.argpartition(bound, n - k, axis=1)[:, n - k:]
            rows, at = np.nonzero(np.take_along_axis(bound, idx, axis=1) > best[:, None])
            score(rows, idx[rows, at])
    score(*np.nonzero(bound > best[:, None]))
    return [(int(n - 1 - b % n), int(b // n)) if b >= f * n else None for b, f in zip(best.tolist(), floors)]


class _Pivots:
    """Distances of a text to all pivots, and what they say about the blocks."""

    def __init__(self, pivots: list[str], blocks=None):
        import numpy as np

        self.pivots = pivots
        self.lens = np.array([len(p) for p in pivots], dtype=np.int64)
        self.full = (np.uint64(1) << self.lens.astype(np.uint64)) - np.uint64(1)
        self.masks: dict[str, object] = {}
        for i, p in enumerate(pivots):
            for j, ch in enumerate(p):
                if ch not in self.masks:
                    self.masks[ch] = np.zeros(len(pivots), dtype=np.uint64)
                self.masks[ch][i] |= np.uint64(1 << j)
        if blocks:
            # one row a block: pivot, shortest and longest entry, earliest row, parts, and least and largest
            # distance to the own pivot and to each reference
            self.block, self.short, self.long, self.first, self.parts, near, far = (
                np.array(x, dtype=np.int64) for x in zip(*blocks))
            self.near, self.far = near.T, far.T
            self.to = np.vstack([self.block, *[np.full(len(blocks), r) for r in range(near.shape[1] - 1)]])

    def distances(self, text: str):
        import numpy as np

        if len(text) <= VECTOR_MAX_TEXT:
            v = self.full.copy()
            for ch in text:
                m = self.masks.get(ch)
                if m is not None:
                    u = v & m
                    v = ((v + u) | (v - u)) & self.full
            lcs = self.lens - np.bitwise_count(v).astype(np.int64)
        else:  # bits over the text, one pivot after the other, but for those whose characters it holds in order
            lcs = self.lens.copy()
            apart = [i for i, p in enumerate(self.pivots) if not FZ.is_subsequence(p, text)]
            masks = FZ.char_masks_np(text, self.masks) if apart else {}
            for i in apart:
                lcs[i] = FZ.lcs_with_masks(masks, len(text), self.pivots[i])
        return len(text) + self.lens - 2 * lcs

    def bounds(self, text: str, distances=None):
        """Best score that an unequal entry of each block can reach, and how far away it must be."""
        import numpy as np

        la = len(text)
        d = (self.distances(text) if distances is None else distances)[self.to]
        low = np.maximum(np.maximum(d - self.far, self.near - d).max(axis=0), 1)
        # the score rises with the entry's length up to la + low and falls from there
        lb = np.clip(la + low, self.short, self.long)
        need = np.maximum(low, np.abs(la - lb))
        with np.errstate(divide="ignore", invalid="ignore"):
            ub = np.rint(100 * (la + lb - need) / (la + lb) + 1e-9)
        return np.where((la == 0) | (lb == 0) | (need > la + lb), 0, ub).astype(np.int64), low


def _assign_fn(pivots: list[str]):
    """Adds each entry's block, the nearest pivot, and its distances to that one and to the references."""

    def run(batches):
        import numpy as np

        index = _Pivots(pivots)
        for pdf in batches:
            block, distances = [], []
            for k in pdf["k"]:
                d = index.distances(k)
                at = int(np.argmin(d))
                block.append(at)
                distances.append([int(d[at]), *d[:REFERENCES].tolist()])
            yield pdf.assign(block=block, distances=distances)

    return run


def _seeds(index: _Pivots, text: str, distances, ub, low) -> list[tuple[int, int]]:
    """Places (block, part) that a text visits first: the best bounds, by distance and by row, and the blocks
    around the nearest pivots."""
    import numpy as np

    d = distances[index.block]
    order = [np.lexsort((low, -ub))[0], np.lexsort((index.first, -ub))[0], *np.argsort(d, kind="stable")[:SEEDS - 2]]
    return list(dict.fromkeys((int(at), len(text) % int(index.parts[at])) for at in order))


def _seed_fn(pivots: list[str], blocks: list[tuple], floor: int):
    """For each text the parts that it visits first."""

    def run(batches):
        import pandas as pd

        index = _Pivots(pivots, blocks)
        for pdf in batches:
            out = []
            for i, k in zip(pdf["id"], pdf["k"]):
                d = index.distances(k)
                ub, low = index.bounds(k, d)
                out += [(i, k, floor, int(index.block[at]), part) for at, part in _seeds(index, k, d, ub, low) if ub[at] >= floor]
            yield pd.DataFrame(out, columns=["id", "k", "floor", "block", "part"])

    return run


def _rest_fn(pivots: list[str], blocks: list[tuple], floor: int):
    """All parts that can still win against the score found so far, but for those that were visited."""

    def run(batches):
        import numpy as np
        import pandas as pd

        index = _Pivots(pivots, blocks)
        for pdf in batches:
            out = []
            for i, k, score, ordinal, equal in zip(pdf["id"], pdf["k"], pdf["m_score"], pdf["m_ordinal"], pdf["equal"]):
                d = index.distances(k)
                ub, low = index.bounds(k, d)
                done = set() if equal else set(_seeds(index, k, d, ub, low))
                for at in np.flatnonzero((ub > score) | ((ub == score) & (index.first < ordinal))):
                    out += [(i, k, max(score, floor), int(index.block[at]), part) for part in range(int(index.parts[at])) if (at, part) not in done]
            yield pd.DataFrame(out, columns=["id", "k", "floor", "block", "part"])

    return run


def _score_group(left, right):
    """The texts of a slice against the entries of a part: the best entry that reaches each text's floor."""
    import pandas as pd

    out = []
    if len(left) and len(right):
        right = right.sort_values("ordinal")
        cat = _Catalogue(list(zip(right["k"], right["ordinal"], right["code"], right["description"])))
        texts, floors = left["k"].tolist(), left["floor"].astype(int).tolist()
        for i, hit in zip(left["id"], best_in_slice(cat, texts, floors)):
            if hit is not None:
                e = cat.entries[hit[0]]
                out.append((i, int(e[1]), e[2], e[3], hit[1]))
    return pd.DataFrame(out, columns=_FOUND_SCHEMA.names)


def prepare_catalogue(catalogue: DataFrame, scorer: str) -> DataFrame:
    """``k, ordinal, code, description``: one row (the earliest) per match key."""
    cat = catalogue.where(F.col("description").isNotNull()).select(
        match_key("description", scorer).alias("k"), "ordinal",
        F.col("code").cast("string").alias("code"), "description")
    first = F.min_by(F.struct("ordinal", "code", "description"), F.col("ordinal"))
    return cat.groupBy("k").agg(first.alias("f")).select("k", "f.*")


def _scored(pairs: DataFrame, entries: DataFrame, slices: int) -> DataFrame:
    """``pairs`` (``id, k, floor, block, part``) scored: one row each where the floor is reached."""
    key = ["block", "part", "slice"]
    pairs = settle(pairs.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")), "match-pairs")
    # a part is copied once for each slice that asks for it
    asked = entries.join(pairs.select(*key).distinct().toDF(*key), ["block", "part"])
    return pairs.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_score_group, _FOUND_SCHEMA)


def _winners(found: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("m_ordinal", "m_code", "m_description", "m_score"), F.struct(F.col("m_score"), -F.col("m_ordinal")))
    return found.groupBy("id").agg(best.alias("w")).select("id", "w.*")


def best_matches(keys: DataFrame, catalogue: DataFrame, scorer: str = "token_sort",
                 cutoff: int | None = None, max_rows: int = PART_ROWS, pivots: int | None = None) -> DataFrame:
    """For distinct match keys ``k``: ``k, m_ordinal, m_code, m_description, m_score``
    (keys without a match are absent)."""
    spark = keys.sparkSession
    ship_package(spark)
    floor = 1 if cutoff is None else max(1, cutoff)
    # numbers stand for the texts from here on, so that texts move only to where they are scored
    keys = settle(keys.select("k", F.monotonically_increasing_id().alias("id")), "match-texts")
    entries = settle(prepare_catalogue(catalogue, scorer), "match-entries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], _MATCH_SCHEMA)
    # a bounded sample: at most PIVOTS strings of at most PIVOT_CHARS characters
    wanted = pivots or min(PIVOTS, math.ceil(math.sqrt(n)))
    starts = entries.select(F.substring("k", 1, PIVOT_CHARS).alias("p")).distinct()
    chosen = [r["p"] for r in starts.orderBy(F.xxhash64("p"), "p").limit(wanted).collect()]
    fields = "k string, ordinal bigint, code string, description string, block int, distances array<bigint>"
    placed = entries.select("k", F.col("ordinal").cast("bigint"), "code", "description").mapInPandas(_assign_fn(chosen), fields)
    placed = settle(placed, "match-placed")
    known = [F.get("distances", F.lit(i)) for i in range(min(REFERENCES, len(chosen)) + 1)]
    summary = placed.groupBy("block").agg(
        F.min(F.length("k")), F.max(F.length("k")), F.min("ordinal"), F.ceil(F.count(F.lit(1)) / max_rows).cast("int"),
        F.array(*[F.min(d) for d in known]), F.array(*[F.max(d) for d in known]))
    blocks = sorted(tuple(r) for r in summary.collect())  # a row a block
    parts = spark.createDataFrame([(b[0], b[4]) for b in blocks], "block int, parts int")
    entries = placed.join(F.broadcast(parts), "block").select(
        "k", "ordinal", "code", "description", "block", F.pmod(F.xxhash64("k", F.lit("part")), F.col("parts")).cast("int").alias("part"))
    slices = max(1, math.ceil(keys.count() / SLICE_TEXTS))

    placed = placed.drop("distances")
    equal = keys.join(placed, "k").select("id", F.col("ordinal").alias("m_ordinal"), F.col("code").alias("m_code"),
                                          F.col("description").alias("m_description"), F.lit(100).alias("m_score"))
    equal = settle(equal, "match-equal")
    # by merge joins: few bytes on disk may be many texts in memory
    seeds = keys.join(equal.select("id").hint("merge"), "id", "left_anti").mapInPandas(_seed_fn(chosen, blocks, floor), _PAIR)
    first = settle(_winners(equal.unionByName(_scored(seeds, entries, slices))), "match-first")
    # a text without a score so far has everything that reaches the floor to beat
    state = keys.join(first.select("id", "m_score", "m_ordinal").hint("merge"), "id", "left").fillna({"m_score": floor - 1, "m_ordinal": 0})
    state = state.join(equal.select("id", F.lit(True).alias("equal")).hint("merge"), "id", "left").fillna({"equal": False})
    rest = _scored(state.mapInPandas(_rest_fn(chosen, blocks, floor), _PAIR), entries, slices)
    return keys.join(_winners(first.unionByName(rest)).hint("merge"), "id").drop("id")


def attach_best_match(df: DataFrame, text: str, catalogue: DataFrame, scorer: str = "token_sort",
                      cutoff: int | None = None, prefix: str = "match", **kw) -> DataFrame:
    """Add ``{prefix}_code``, ``{prefix}_description``, ``{prefix}_score`` (null, null, 0
    when there is no match) to every row of ``df``."""
    keyed = df.withColumn("_k", F.when(~is_blank(text), match_key(text, scorer)))
    # not by the key, which the filter would compute a second time
    keys = df.where(~is_blank(text)).select(match_key(text, scorer).alias("k")).distinct()
    best = best_matches(keys, catalogue, scorer, cutoff, **kw)
    # rows without a key match nothing: the second column deals them to many tasks
    keyed = keyed.withColumn("_deal", F.when(F.col("_k").isNull(), F.spark_partition_id()).otherwise(0))
    best = best.withColumnRenamed("k", "_k").withColumn("_deal", F.lit(0))
    joined = keyed.join(best, ["_k", "_deal"], "left")
    return joined.select(
        *df.columns,
        F.col("m_code").alias(f"{prefix}_code"),
        F.col("m_description").alias(f"{prefix}_description"),
        F.coalesce(F.col("m_score"), F.lit(0)).alias(f"{prefix}_score"),
    )
