"""Catalogue preparation: code and description cleaning, first-row dedupe, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendcode.functions import text as T


def clean_catalogue(raw: DataFrame) -> DataFrame:
    """ordinal, code (double, nullable), description (cleaned, never null)."""
    return raw.select(
        "ordinal",
        T.code_for_cleaning("code").alias("code"),
        T.clean_description("description").alias("description"),
    )


def dedupe_first(df: DataFrame, key: str = "description", order: str = "ordinal") -> DataFrame:
    """Keep the first row (lowest ``order``) per ``key``.

    ``dropDuplicates`` keeps an arbitrary row, so the first row is chosen with ``min_by``;
    it is a declarative aggregate, so Spark combines map-side and a hot key (for example
    every blank description) is reduced before the shuffle.
    """
    others = [c for c in df.columns if c not in (key,)]
    first = F.min_by(F.struct(*others), F.col(order)).alias("_first")
    return df.groupBy(key).agg(first).select(key, "_first.*")


def catalogue_stats(cleaned: DataFrame) -> DataFrame:
    """Rows read, rows kept by the dedupe and distinct cleaned descriptions.

    The reference prints the kept count as its 'original' count; both are reported.  The
    dedupe keeps exactly one row per (never null) cleaned description, so one aggregate
    over the cleaned rows gives all three numbers.
    """
    n_distinct = F.count_distinct("description")
    return cleaned.agg(F.count(F.lit(1)).alias("rows_in"), n_distinct.alias("rows_out"),
                       n_distinct.alias("distinct_descriptions"))


def preview(df: DataFrame, n: int = 5, order: str = "ordinal") -> DataFrame:
    """First ``n`` rows in file order (top-k, no global sort)."""
    return df.orderBy(order).limit(n)


def embedding_records(raw: DataFrame) -> DataFrame:
    """Rows with a code and a description; code text without '.0'; ``code - description``."""
    kept = raw.na.drop(subset=["code", "description"])
    code = T.code_for_embedding("code")
    return kept.select("ordinal", code.alias("code"), "description",
                       T.embed_text(code, F.col("description")).alias("text"))
