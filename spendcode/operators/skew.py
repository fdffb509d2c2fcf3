"""Equi-joins whose left side may have hot keys.

An answer table has one row a key, but a key (an account, a common text) may stand on any share of the
lines.  A plain join sends all lines of a key to one task.  ``spread_join`` counts the lines of each key
first (a partial aggregate: one row a key and task moves); keys of more than ``HEAVY`` lines are *heavy*:
their lines are dealt to as many salts as they have times ``HEAVY`` lines, and their answer is copied to
each salt.  All other keys have the one salt 0, so the rest of the join is as it was.  No line is lost or
doubled, whatever the counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of one key that one task may get.
HEAVY = 200_000


def heavy_keys(left: DataFrame, key: str, heavy: int) -> DataFrame:
    """``key, salts`` of the keys on more than ``heavy`` rows."""
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("lines"))
    return counts.where(F.col("lines") > heavy).select(key, F.ceil(F.col("lines") / heavy).cast("int").alias("salts"))


def spread_join(left: DataFrame, right: DataFrame, key: str, row_key: str, how: str = "inner", heavy: int | None = None) -> DataFrame:
    """``left`` joined (``inner`` or ``left``) with ``right``, which has one row a ``key``.

    ``row_key`` tells the left rows apart and deals those of a heavy key.  Left rows without a key meet
    nothing; they are dealt by ``row_key`` too."""
    heavy = heavy or HEAVY
    hot = heavy_keys(left, key, heavy)
    hot_rows = hot.collect()  # at most one key for each HEAVY lines of the input: 5,000 keys in a billion lines
    salt = "_salt"
    none = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(row_key), F.lit(1 << 20)).cast("int"))
    if not hot_rows:
        if how == "inner":
            return left.join(right, key, how)
        dealt = left.withColumn(salt, none.otherwise(F.lit(0)))
        return dealt.join(right.withColumn(salt, F.lit(0)), [key, salt], how).drop(salt)
    hot = F.broadcast(left.sparkSession.createDataFrame(hot_rows, hot.schema))
    dealt = left.join(hot, key, "left").withColumn(
        salt, none.otherwise(F.coalesce(F.pmod(F.xxhash64(row_key), F.col("salts")).cast("int"), F.lit(0)))).drop("salts")
    copied = right.join(hot, key, "left").withColumn(
        salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))).drop("salts")
    return dealt.join(copied, [key, salt], how).drop(salt)
