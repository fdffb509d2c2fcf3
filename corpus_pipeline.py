"""Corpus preparation: quality, line dedup, near-dedup, packing; each stage reads what the last one kept.

Every stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame; all but the last have the columns of
``documents``.  ``run`` writes each stage as a table in the shared folder and reads it back for the next.

Edge cases, besides those that the operators state: a document whose lines all repeat keeps an empty
text, and near-dedup keeps one empty document; rows without an id are never merged away by
near-dedup, and a document that occurs repeatedly under one id stays once; ``n_chars`` follows the text;
an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendcode.llm.common import stored
from spendcode.llm.line_dedup import dedup_lines
from spendcode.llm.packing import pack_documents
from spendcode.llm.quality import score_quality, train_quality
from spendcode.llm.queries import tokenizer_path
from spendcode.llm.simhash import simhash_roots
from spendcode.sources.tables import table


def _aside(docs: DataFrame, *outputs: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns named like an operator's ``outputs`` renamed, and what restores their names."""
    names = {c: f"_input_{c}" for c in docs.columns if c.lower() in outputs}
    return docs.withColumnsRenamed(names), [F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    docs, back = _aside(docs, "score", "predicted")
    return score_quality(docs, model).where("predicted = 1").select(back)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line matches."""
    docs, back = _aside(docs, "lines_removed")
    out = dedup_lines(docs)
    kind = dict(docs.dtypes).get("n_chars")
    if kind:
        out = out.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of linked fingerprints; of those without an id, one too.

    Rows are told apart by a hash of all their values, so rows of one id with different texts are
    judged each by its own group.
    """
    row = F.xxhash64(F.col("doc_id").isNull(), *[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    keyed = docs.withColumns({"_near_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), "_near_row": row})
    found = simhash_roots(keyed.select("doc_id", "text", "_near_row"), "_near_row", shingle=3, max_bits=3)
    first = found.groupBy(F.col("id").isNull(), "root").agg(F.min(F.struct("id", "row", "fp")).alias("first"))
    keep = stored(first.select("first.*"), "pipeline-keep")
    # texts without words are one group, so this is one row at most
    empty = keep.where("fp = 0 and id is not null")
    named = keep.where("fp <> 0").join(F.broadcast(empty.select("id")), "id", "left_semi").select("id")
    empty = empty.join(named, "id", "left_anti")
    keep = keep.where("fp <> 0 or id is null").unionByName(empty).select(
        F.coalesce("id", F.lit(0)).alias("_near_id"), F.col("row").alias("_near_row"))
    key = ["_near_id", "_near_row"]
    return keyed.join(keep, key, "left_semi").dropDuplicates(key).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]

ORACLE_SQL = None  # a trained classifier and tokenisation are not SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
