"""Large CSV files read by many tasks.

A CSV file whose quoted fields hold line breaks cannot be cut at any line: whether a line starts a record
depends on the number of quotes before it.  Two passes over the splittable text source settle that:

1. every block of a file (Spark's own split) reports the parity of its quotes and how many records start
   in it, for either state that it may begin in: one row a block;
2. running sums over a file's blocks give each block's state and its first record's number;
3. every block assembles its records.  What a record has in other blocks is sent as fragments, which are
   put together by record number: a block has two fragments at most, so nearly no text is shuffled.

Quotes must stand as RFC 4180 and pandas' writer have them: around fields, doubled inside.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendcode.operators.boundary import settle
from spendcode.session import ship_package

_BLOCKS = "file string, block bigint, odd int, starts_even bigint, starts_odd bigint"
_RECORDS = "file string, record bigint, block bigint, text string, whole boolean"


def _runs(batches) -> Iterator[tuple]:
    """Lines of an Arrow stream by block: ``(file, block, first row, lines, quotes)``, in the order read."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        if not b.num_rows:
            continue
        quotes = pc.count_substring(b.column("value"), '"').to_numpy(zero_copy_only=False)
        lines, files, blocks = b.column("value").to_pylist(), b.column("file").to_pylist(), b.column("block").to_numpy()
        cuts = [0, *[i for i in range(1, len(lines)) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1]], len(lines)]
        for lo, hi in zip(cuts, cuts[1:]):
            yield files[lo], int(blocks[lo]), lo, lines[lo:hi], np.asarray(quotes[lo:hi])


def _blank(line: str) -> bool:
    return line in ("", "\r")


def _count_blocks(batches):
    """Pass 1: parity and record starts of each block; blank lines between records are none."""
    import numpy as np
    import pyarrow as pa

    totals: dict[tuple, list[int]] = {}
    for file, block, _, lines, quotes in _runs(batches):
        t = totals.setdefault((file, block), [0, 0, 0])
        before = (t[0] + np.concatenate([[0], np.cumsum(quotes[:-1])])) % 2
        text = np.array([not _blank(x) for x in lines])
        t[1] += int((text & (before == 0)).sum())
        t[2] += int((text & (before == 1)).sum())
        t[0] = int((t[0] + quotes.sum()) % 2)
    rows = [(f, b, *t) for (f, b), t in totals.items()]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(
        zip(*rows) if rows else [[]] * 5, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["file", "block", "odd", "starts_even", "starts_odd"])


def _assemble(batches):
    """Pass 3: the records of each block; ``whole`` is false for what belongs to a record of several blocks."""
    import pyarrow as pa

    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)],
                                          ["file", "record", "block", "text", "whole"])

    at, part, open_, first, record = None, [], False, False, 0
    infos = {}

    def states(stream):
        for b in stream:
            if b.num_rows:
                for f, k, s, r in zip(*(b.column(c).to_pylist() for c in ("file", "block", "inside", "first"))):
                    infos.setdefault((f, k), (s, r))
            yield b

    for file, block, _, lines, quotes in _runs(states(batches)):
        out = []
        if (file, block) != at:
            if part:  # the block before ended inside a record
                out.append((at[0], record, at[1], "\n".join(part), False))
            at, part = (file, block), []
            inside, record = infos.pop(at)
            # ``record``: number of the record that is open, or else of the next one
            open_, first = bool(inside), bool(inside)
            record -= open_
        for line, n in zip(lines, quotes):
            if not open_ and not part and _blank(line):
                continue
            part.append(line)
            open_ ^= bool(n % 2)
            if not open_:
                out.append((file, record, block, "\n".join(part), not first))
                part, first, record = [], False, record + 1
        yield batch(out)
    yield batch([(at[0], record, at[1], "\n".join(part), False)] if part else [])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, record, text``: every record as written, numbered from 0 within its file (0 is the header)."""
    ship_package(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    blocks = settle(lines.mapInArrow(_count_blocks, _BLOCKS), "csv-blocks")
    # a row a block: windows of a file are as long as it has blocks
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int")
    known = blocks.withColumn("inside", inside)
    starts = F.when(F.col("inside") == 0, F.col("starts_even")).otherwise(F.col("starts_odd"))
    known = known.withColumn("starts", starts).select("file", "block", "inside", F.coalesce(F.sum("starts").over(before), F.lit(0)).alias("first"))
    # 100 bytes for each block of 128 MB of input
    records = settle(lines.join(F.broadcast(known), ["file", "block"]).select("value", "file", "block", "inside", "first").mapInArrow(
        _assemble, _RECORDS), "csv-records")
    parts = F.sort_array(F.collect_list(F.struct("block", "text")))
    joined = records.where(~F.col("whole")).groupBy("file", "record").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
    return records.where("whole").select("file", "record", "text").unionByName(joined.select("file", "record", "text"))
