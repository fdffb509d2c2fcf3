"""Catalogue jobs: cleaning (read -> code/description cleaning -> first-row dedupe ->
write -> statistics -> preview) and embedding (read -> drop incomplete rows -> text ->
embed -> vector records -> upsert into the vector table)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendcode.operators import catalog as C
from spendcode.operators.vectors import VectorTable, embed, vector_records
from spendcode.sources.csv_io import read_catalogue, write_csv


@dataclass
class CleanResult:
    cleaned: DataFrame
    stats: DataFrame
    preview: DataFrame


def clean_catalogue_job(spark: SparkSession, input_path: str, output_path: str,
                        output_format: str = "parquet") -> CleanResult:
    raw = read_catalogue(spark, input_path)
    cleaned_rows = C.clean_catalogue(raw.select("ordinal", "code", "description"))
    deduped = C.dedupe_first(cleaned_rows).select("ordinal", "code", "description")
    if output_format == "csv":
        # floats as Python prints them: 51142018.0, not Java's 5.1142018E7
        c = F.col("code")
        code_txt = (F.when(c.isNull(), F.lit(None).cast("string"))
                    .when((c == F.floor(c)) & (F.abs(c) < F.lit(1e16)), F.format_string("%.1f", c))
                    .otherwise(c.cast("string")))
        write_csv(deduped.orderBy("ordinal").select(code_txt.alias("code"), "description"), output_path)
        written = spark.read.options(header=True, inferSchema=False, multiLine=True, escape='"').csv(output_path)
    else:
        deduped.write.mode("overwrite").parquet(output_path)
        written = spark.read.parquet(output_path)
    return CleanResult(written, C.catalogue_stats(cleaned_rows), C.preview(deduped))


def embed_catalogue_job(spark: SparkSession, input_path: str, table: VectorTable,
                        encoder: Callable | None = None, factory: Callable[[], Callable] | None = None) -> str:
    """Embed the catalogue into ``table``; returns the folder with the rewritten buckets."""
    raw = read_catalogue(spark, input_path)
    recs = C.embedding_records(raw)
    vectors = embed(recs, "text", encoder=encoder, dimension=table.dimension, factory=factory)
    return table.upsert(vector_records(vectors, "code", "vector", "description", "ordinal"))
