"""Helpers shared by the training-data operators: stored intermediates and small expressions."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendcode.session import shared_dir, ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of one Arrow batch handed to a Python task; with texts of a few KB a batch stays a few MB.
ARROW_ROWS = 1000


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    This cuts lineage: a lost executor costs a re-read of the table, never a recomputation,
    and a frame that several branches use is computed once.
    """
    spark = df.sparkSession
    path = shared_dir(spark, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing reads any more."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now: its cleaner follows the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def python_tasks(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Make the package importable in Python workers and bound the Arrow batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_lower(text: Column) -> Column:
    """Only A-Z change; every other character stays."""
    return F.translate(text, UPPER, UPPER.lower())


def stable_digest(df: DataFrame, *cols: str) -> tuple[int, int]:
    """Row count and an order-independent checksum, to see whether an iteration changed anything."""
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 F.expr("bit_xor(xxhash64(" + ", ".join(cols) + "))").alias("x")).first()
    return row["n"], row["x"] or 0
