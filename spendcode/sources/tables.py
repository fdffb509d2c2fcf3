"""Driver tables and the purchase-line / catalogue views derived from them.

The driver ships TPC-H-like Parquet tables.  The procurement data model maps onto them:
the product catalogue is ``part`` (``p_partkey`` is both file order and code, ``p_name``
the description) and purchase lines are ``documents`` (``text`` is the line description,
``source`` the account text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def catalogue_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw catalogue: ordinal, code (text), description."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ordinal"),
        F.col("p_partkey").cast("string").alias("code"),
        F.col("p_name").alias("description"),
    )


def lines_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase lines with the reference's column names plus a stable ordinal."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ordinal"),
        F.col("text").alias("procurement_description"),
        F.col("source").alias("account"),
    )
