"""One registered query for each operator: thin, over whole tables, with production parameters."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendcode.llm import bpe
from spendcode.llm.ann import nearest
from spendcode.llm.block_naming import exact_groups
from spendcode.llm.common import ascii_lower
from spendcode.llm.lexical import search
from spendcode.llm.license_scan import license_scan
from spendcode.llm.line_dedup import dedup_lines
from spendcode.llm.merkle import audit
from spendcode.llm.packing import pack_documents
from spendcode.llm.quality import held_out, score_quality, train_quality
from spendcode.llm.quality_rules import quality_rules
from spendcode.llm.simhash import fingerprint_hex, simhash_components
from spendcode.llm.url_filter import Rule, url_filter
from spendcode.llm.warc import page_number, read_warc, write_warc
from spendcode.session import shared_dir
from spendcode.sources.tables import table

URL_RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"),
             Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; ``SPENDCODE_TOKENIZERS`` names another folder."""
    folder = os.environ.get("SPENDCODE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return found.select("doc_id", fingerprint_hex().alias("fingerprint"), "component_id")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema, types = "n_tokens bigint, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()]
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), bpe.digests, schema, types)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, f"llm/warc-{uuid.uuid4().hex}")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select(
        page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_number("refers_to").alias("refers_to"), "segments", "status")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' texts without later matches, and how many lines went."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0, k=20)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return audit(docs, ["doc_id", "source", "lang", "n_chars", "text"], key="doc_id", group="source",
                 altered=ascii_lower(F.col("text")), altered_field="text")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {f.__name__: f for f in (
    op1_simhash_dedup, op2_bpe, op3_warc, op4_exact_dedup, op5_quality, op6_url_filter, op7_line_dedup,
    op8_license_scan, op9_packing, op10_nearest, op11_merkle_manifest,
    op12_quality_rules, op13_lexical_search)}
