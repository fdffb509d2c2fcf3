"""Tables written in the shared folder where a job's lineage is to be cut."""

from __future__ import annotations

import contextlib
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from spendcode.session import shared_dir


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back.

    Branches that use it share one computation, and a lost executor costs a re-read."""
    path = shared_dir(df.sparkSession, f"tables/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)  # whole texts: a third less to write and read than by default
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``settle`` that nothing reads any more."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.settled_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now: its cleaner follows the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def few_a_batch(spark: SparkSession, rows: int):
    """Hand Python tasks that run meanwhile ``rows`` rows at a time, for rows of some MB each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
