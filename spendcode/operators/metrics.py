"""Report tables: confidence histogram, code hierarchy rollup, elapsed-time text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendcode.functions.text import format_elapsed


def confidence_histogram(df: DataFrame, column: str, bins: int = 20, width: int = 5) -> DataFrame:
    """Counts per fixed-width bin over 0..bins*width, and one more row (``hi`` null) for values
    from there on, which are not clamped upstream.  Empty bins are present with count 0."""
    spark = df.sparkSession
    b = F.least(F.floor(F.col(column) / F.lit(width)), F.lit(bins)).cast("int")
    counts = (df.where(F.col(column).isNotNull())
              .groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    # ``bins + 1`` rows: the join below is a broadcast hash join on the bin number.
    grid = spark.range(bins + 1).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(F.broadcast(counts), "bin", "left")
            .select("bin", (F.col("bin") * width).alias("lo"),
                    F.when(F.col("bin") < bins, (F.col("bin") + 1) * width).alias("hi"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def hierarchy_rollup(df: DataFrame, code: str = "code") -> DataFrame:
    """Segment / family / class (first 2 / 4 / 6 digits) counts with subtotals."""
    c = F.col(code)
    return (df.where(c.isNotNull())
            .select(F.substring(c, 1, 2).alias("segment"), F.substring(c, 1, 4).alias("family"),
                    F.substring(c, 1, 6).alias("class_code"))
            .rollup("segment", "family", "class_code")
            .agg(F.count(F.lit(1)).alias("n")))


def elapsed_by_group(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Span of ``ts`` per group in seconds and as ``timedelta`` text (forward and reversed)."""
    # timestamp_diff works on wall-clock (NTZ) values without a time-zone conversion, so the
    # span does not depend on the session zone or its daylight-saving changes
    span = F.timestamp_diff("MICROSECOND", F.min(ts), F.max(ts)) / F.lit(1_000_000)
    return (df.groupBy(*keys).agg(span.alias("seconds"))
            .select(*keys, "seconds", format_elapsed("seconds").alias("elapsed"),
                    format_elapsed(-F.col("seconds")).alias("elapsed_reversed")))
