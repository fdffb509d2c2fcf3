"""Confidence gates: accepted results are written, rejected ones keep the defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gate(result: Column, threshold: int, prefix: str) -> list[Column]:
    """Columns ``{prefix}_code``, ``{prefix}_description``, ``{prefix}_confidence``.

    A result whose confidence reaches ``threshold`` is written as is (at threshold 0 a
    failed result passes and writes nulls); otherwise ``''``, ``''``, ``0``.
    """
    ok = result["confidence"] >= F.lit(threshold)
    return [
        F.when(ok, result["code"]).otherwise(F.lit("")).alias(f"{prefix}_code"),
        F.when(ok, result["description"]).otherwise(F.lit("")).alias(f"{prefix}_description"),
        F.when(ok, result["confidence"]).otherwise(F.lit(0)).alias(f"{prefix}_confidence"),
    ]
