"""Approximate nearest neighbours (largest inner product) by collision counting.

Vectors are lifted by one coordinate so that all have the largest norm of the table; then the nearest
in Euclidean distance are those of the largest inner product.  Each of ``PROJECTIONS`` random lines
gives a sorted array of the projected vectors.  Around a query's own projection a window is opened on
every line; a vector that lies in the windows of at least ``SHARE`` of the lines is a candidate and is
verified exactly.  Windows grow by the factor ``GROWTH`` (virtual rehashing: the same arrays serve every
radius) until ``10 * k + BETA * rows`` vectors of the block are verified.

The table is dealt to blocks of about ``BLOCK`` rows, the queries to blocks of about ``QUERIES``; each
pair of blocks is one bounded task, whose results (at most k a query) are merged by rank.  Every row is
indexed; recall is measured against brute force in the tests.

Edge cases: vectors that are null, empty, zero, or hold a null or a component that is not finite take
no part, nor do vectors of another than the most frequent length, or without an id; a query never
meets rows of its own id; repeated rows are candidates as often as they occur, and the least of several
vectors of one query id is the query; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendcode.llm.common import python_tasks, stored

BLOCK = 8192
QUERIES = 2048
PROJECTIONS = 65
SHARE = 0.55
GROWTH = 1.15
FIRST = 0.9   # first window, half width in units of the largest norm over the root of the dimension
BETA = 0.2


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, norm: float, k: int,
                 projections: int = PROJECTIONS, seed: int = 11) -> list[tuple[int, int, float]]:
    """``(query, id, score)`` of the at most k nearest found in one block of rows, for each query."""
    n, d = x.shape
    extra = np.sqrt(np.maximum(0.0, norm ** 2 - (x ** 2).sum(1)))
    lines = np.random.default_rng(seed).normal(size=(d + 1, projections))
    if projections <= d + 1:
        lines = np.linalg.qr(lines)[0] * math.sqrt(d + 1)
    placed = (x @ lines[:d] + extra[:, None] * lines[d]).T
    order = np.argsort(placed, axis=1, kind="stable")
    placed = np.take_along_axis(placed, order, axis=1)
    # a window is a run of a line's sorted array, so a vector lies in it if its rank there does
    kind = np.uint16 if n < 1 << 16 else np.uint32
    ranks = np.empty((projections, n), dtype=kind)
    np.put_along_axis(ranks, order, np.broadcast_to(np.arange(n, dtype=kind), order.shape), axis=1)
    tally = np.uint8 if projections < 256 else np.uint32
    centres = q @ lines[:d]
    least, enough = SHARE * projections, min(n, 10 * k + math.ceil(BETA * n))
    out: list[tuple[int, int, float]] = []
    half, todo = FIRST * norm, np.arange(len(q))
    while len(todo):
        low = np.stack([np.searchsorted(line, centres[todo, j] - half) for j, line in enumerate(placed)], axis=1)
        high = np.stack([np.searchsorted(line, centres[todo, j] + half, side="right") for j, line in enumerate(placed)], axis=1)
        still = []
        for i, a, width in zip(todo.tolist(), low.astype(kind), high - low, strict=True):
            inside = (ranks - a[:, None]) < width.astype(kind)[:, None]  # wraps below the window
            hits = np.add.reduce(inside.view(np.uint8), axis=0, dtype=tally)
            found = np.flatnonzero(hits >= least)
            if len(found) < enough and width.sum() < n * projections:
                still.append(i)
                continue
            found = found[ids[found] != query_ids[i]]
            scores = (x[found] * q[i]).sum(axis=1)
            if len(found) > k:  # ties stay until they are ordered by id
                edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                found, scores = found[scores >= edge], scores[scores >= edge]
            best = np.lexsort((ids[found], -scores))[:k]
            out += [(int(query_ids[i]), int(ids[found[m]]), float(scores[m])) for m in best]
        todo, half = np.array(still, dtype=np.int64), half * GROWTH
    return out


def nearest(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, id_col, score)``: the k nearest found of every row that ``is_query`` selects."""
    spark = table.sparkSession
    python_tasks(spark)
    rows = table.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("x"),
        is_query.alias("asks"), F.monotonically_increasing_id().alias("nr"))
    size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = stored(rows.where(F.size("x") == (size["d"] if size else 0)), "ann-rows")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(F.aggregate(
        "x", F.lit(0.0), lambda a, b: a + b * b))).alias("norm")).first()
    queries = stored(rows.where("asks").groupBy("id").agg(F.min("x").alias("x")), "ann-queries")
    blocks, norm = max(1, math.ceil(facts["n"] / BLOCK)), facts["norm"] or 1.0
    parts = max(1, math.ceil(queries.count() / QUERIES))
    deal = lambda df, by, n, name: df.withColumn(name, F.pmod(F.xxhash64(by), F.lit(n)).cast("int"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = deal(rows, "nr", blocks, "b").select("b", spread(parts).alias("p"), "id", "x")
    right = deal(queries, "id", parts, "p").select(spread(blocks).alias("b"), "p", "id", "x")

    def search(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found: list = []
        if len(data) and len(asked):
            data = data.sort_values("id", kind="stable")
            found = search_block(data["id"].to_numpy(), np.array(data["x"].tolist()), asked["id"].to_numpy(),
                                 np.array(asked["x"].tolist()), norm, k)
        return pd.DataFrame(found, columns=["query_id", "id", "score"])

    near = left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInPandas(search, "query_id bigint, id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id_col), "score")
