"""SimHash near-dedup by pigeonhole blocks.

Fingerprints that differ in at most ``max_bits`` bits, cut into ``max_bits + 3`` blocks, agree on at
least three blocks.  Every fingerprint is therefore filed under each choice of three blocks (a mask
of the 64 bits and the masked value); two close fingerprints meet in at least one bucket, and there
the Hamming distance is verified.

* Equal fingerprints are merged first: a group of copies is one row, whatever its size.
* A bucket hands on a star for each of its connected parts, never its pairs.
* A bucket of more than ``BUCKET`` different fingerprints is split: the bits outside its mask are cut
  into ``max_bits + 1`` parts, of which close pairs agree on one, and the rows are filed anew under
  the longer masks.  A mask that leaves ``r`` bits free holds at most ``2 ** r`` different
  fingerprints, so splitting ends by itself and no pair is lost.
* Connected components are found by alternating large-star and small-star rounds on Spark tables.

Edge cases: a null text counts as empty; a text without words has fingerprint zero, linked like any
other; a row without id takes part but never names a component (the component of rows that all lack
an id is null); repeated rows get the same values; extra columns are ignored by ``simhash_components``;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendcode.llm.common import python_tasks, stable_digest, stored

BITS = 64
#: Different fingerprints that one task may compare at once; larger buckets are split exactly.
BUCKET = 4096
_FREE_MIN = 12  # with so few bits free a bucket has at most BUCKET members


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII case and white space
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts[:len(words) - shingle + 1].tolist(),
                                                         ends[shingle - 1:].tolist(), strict=True)]
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        block = np.array(hashes[at:at + 65536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
            row_col: str | None = None) -> DataFrame:
    """``(id, fp)`` of every row; with ``row_col``, a bigint that tells rows of one id apart, also ``row``."""
    python_tasks(docs.sparkSession)
    kept = {"id": id_col} | ({"row": row_col} if row_col else {})

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(len(kept)).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(fps.view(np.int64))], [*kept, "fp"])

    columns = [F.col(c).cast("bigint").alias(n) for n, c in kept.items()]
    return docs.select(*columns, F.col(text_col).alias("text")).mapInArrow(
        prints, ", ".join(f"{n} bigint" for n in [*kept, "fp"]))


def _cut(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` runs of the given bit positions, as even as possible."""
    return [sum(1 << b for b in run.tolist()) for run in np.array_split(np.array(bits, dtype=object), parts)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def block_masks(max_bits: int) -> list[int]:
    blocks = _cut(list(range(BITS)), max_bits + 3)
    return [sum(c) for c in combinations(blocks, 3)]


def _parts(fps: np.ndarray, max_bits: int) -> list[np.ndarray]:
    """Positions of each connected part of a bucket, found breadth first."""
    left, parts = np.arange(len(fps)), []
    while len(left):
        part, todo, left = [left[0]], [left[0]], left[1:]
        while todo and len(left):
            close = np.bitwise_count(fps[left] ^ fps[todo.pop()]) <= max_bits
            todo += (found := left[close].tolist())
            part += found
            left = left[~close]
        parts.append(np.array(part))
    return parts


def _stars(max_bits: int):
    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a: list[int] = []
            out_b: list[int] = []
            for members in batch.column(0).to_pylist():
                fps = np.array(members, dtype=np.int64)
                for part in _parts(fps.view(np.uint64), max_bits):
                    out_a += [int(fps[part[0]])] * (len(part) - 1)
                    out_b += fps[part[1:]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])
    return stars


def links(nodes: DataFrame, max_bits: int = 3) -> DataFrame:
    """Edges ``(a, b)`` whose closure links all fingerprints within ``max_bits`` of each other.

    ``fp`` must not repeat.
    """
    spark = nodes.sparkSession
    masks = block_masks(max_bits)
    rows = nodes.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    edges = None
    while masks:
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        counts = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        met = stored(rows.join(counts, ["mask", "key"]), "simhash-buckets")
        small = (F.col("n") <= BUCKET) | (F.bit_count("mask") >= BITS - _FREE_MIN)
        groups = met.where(small).groupBy("mask", "key").agg(
            F.collect_list("fp").alias("members")).select("members")
        found = stored(groups.mapInArrow(_stars(max_bits), "a bigint, b bigint").distinct(), "simhash-links")
        edges = found if edges is None else edges.union(found)
        large = met.where(~small).select("fp", "mask")
        hot = {r["mask"] for r in large.select("mask").distinct().collect()}  # at most len(masks) values
        finer = []
        for m in masks:
            free = [b for b in range(BITS) if not m >> b & 1]
            if _signed(m) in hot:
                finer += [(_signed(m), _signed(m | part)) for part in _cut(free, max_bits + 1)]
        if not finer:
            break
        table = spark.createDataFrame(finer, "mask bigint, finer bigint")  # a few masks, whatever the data
        rows = large.join(F.broadcast(table), "mask").select("fp", F.col("finer").alias("mask")).distinct()
        masks = sorted({m % (1 << BITS) for _, m in finer})
    return edges


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of an edge; the root is the smallest node of its component."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "cc")
    seen = stable_digest(edges, "u", "v")
    while True:
        # large star: neighbours above a node move to the smallest of its neighbourhood
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .where("u > v").distinct(), "cc")
        # small star: a node and its smaller neighbours move to the smallest of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                              F.col("m").alias("v"))
        edges = stored(moved.where("u > v").distinct(), "cc")
        now = stable_digest(edges, "u", "v")
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def _rooted(prints: DataFrame, max_bits: int) -> DataFrame:
    """``(fp, least_id, root)`` of every fingerprint; the root names its component."""
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("least_id")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), max_bits))
    return stored(nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")), "simhash-rooted")


def simhash_roots(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text",
                  shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``(id, row, fp, root)`` for every row of ``docs``: the root tells components apart that one id names."""
    prints = stored(simhash(docs, id_col, text_col, shingle, row_col), "simhash")
    return prints.join(_rooted(prints, max_bits).select("fp", "root"), "fp").select("id", "row", "fp", "root")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``(id_col, fp, component_id)`` for every row of ``docs``."""
    prints = stored(simhash(docs, id_col, text_col, shingle), "simhash")
    rooted = _rooted(prints, max_bits)
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = stored(rooted.join(named, "root").select("fp", "component_id"), "simhash-known")
    return prints.join(known, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def fingerprint_hex(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
