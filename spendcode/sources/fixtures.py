"""Inputs for the driver queries, derived from the driver tables with Spark.

The driver tables hold clean TPC-H-like values, so a few columns are *decorated*
deterministically by key (``CASE key % k``) to make the edge cases of the cleaning and
parsing rules occur.  Every row of the source table is kept; the oracle SQL applies the
identical decoration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendcode.sources.tables import table

# SQL text shared by the Spark fixture and the DuckDB oracle (valid in both dialects).
RAW_CODE_SQL = """CASE p_partkey % 7
    WHEN 0 THEN CAST(p_partkey AS VARCHAR) || '.0'
    WHEN 1 THEN 'n/a'
    WHEN 2 THEN CAST(p_partkey AS VARCHAR) || '.05'
    WHEN 3 THEN NULL
    WHEN 4 THEN 'abc' || CAST(p_partkey AS VARCHAR)
    WHEN 5 THEN CAST(p_partkey AS VARCHAR) || 'D'
    ELSE CAST(p_partkey AS VARCHAR) END"""

RAW_DESCRIPTION_SQL = """CASE WHEN p_partkey % 97 = 5 THEN NULL
    WHEN p_partkey % 89 = 7 THEN '  '
    ELSE CASE p_partkey % 6
    WHEN 0 THEN 'The ' || p_name
    WHEN 1 THEN p_name || ', Inc.'
    WHEN 2 THEN upper(p_name) || ' (1L)'
    WHEN 3 THEN 'Ab  mjólk ' || p_name || ' Co.'
    WHEN 4 THEN 'A an ' || p_name || '_x & Co'
    ELSE p_name END END"""


def raw_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, code (raw text), description (raw text) from ``part``."""
    from spendcode.functions.text import na_to_null

    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ordinal"),
        na_to_null(F.expr(RAW_CODE_SQL.replace("VARCHAR", "STRING"))).alias("code"),
        F.expr(RAW_DESCRIPTION_SQL).alias("description"),
    )


def _answer_sql(label: str, code: str, short_code: str) -> str:
    """Answer text for one ``part`` row; ``p_partkey % 11`` picks one of the edge shapes
    (exact format, no percent, decimal percent, long code, short code, two-line
    description, no description, no confidence, refusal/empty/null, no space after the
    colon, confidence over 100)."""
    nl = "chr(10)"
    conf = "CAST(50 + p_partkey % 51 AS VARCHAR)"
    desc = "p_name"
    head = f"'{label} Code: ' || {code}"

    def body(c=head, d=f"'{label} Description: ' || {desc}", f=f"'Confidence: ' || {conf} || '%'"):
        parts = [p for p in (c, d, f) if p]
        return f" || {nl} || ".join(parts)

    return f"""CASE p_partkey % 11
    WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN {nl} || '  ' || {body()} || ' ' || chr(9) ELSE {body()} END
    WHEN 1 THEN {body(f=f"'Confidence: ' || {conf}")}
    WHEN 2 THEN {body(f=f"'Confidence: ' || {conf} || '.5%'")}
    WHEN 3 THEN {body(c=f"'{label} Code: ' || {short_code}")}
    WHEN 4 THEN {body(c=f"'{label} Code: 7'")}
    WHEN 5 THEN {body(d=f"'{label} Description: ' || replace({desc}, ' ', {nl})")}
    WHEN 6 THEN {body(d=None)}
    WHEN 7 THEN {body(f=None)}
    WHEN 8 THEN CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'I cannot classify this.' END
    WHEN 9 THEN {body(c=f"'{label} Code:' || {code}")}
    ELSE {body(f="'Confidence: 250%'")} END"""


NAICS_CODE_SQL = "CAST(100000 + (p_partkey * 7919) % 900000 AS VARCHAR)"
UNSPSC_CODE_SQL = "CAST(10000000 + (p_partkey * 7919) % 90000000 AS VARCHAR)"
NAICS_ANSWER_SQL = _answer_sql("NAICS", NAICS_CODE_SQL, f"{NAICS_CODE_SQL} || '78'")
UNSPSC_ANSWER_SQL = _answer_sql("UNSPSC", UNSPSC_CODE_SQL, f"substr({UNSPSC_CODE_SQL}, 1, 6)")


def spark_sql(sql: str) -> str:
    return sql.replace("VARCHAR", "STRING")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, p_type, naics_answer, unspsc_answer: recorded answers of both stages."""
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_type",
        F.expr(spark_sql(NAICS_ANSWER_SQL)).alias("naics_answer"),
        F.expr(spark_sql(UNSPSC_ANSWER_SQL)).alias("unspsc_answer"),
    )


RAW_ACCOUNT_SQL = """CASE c_custkey % 4
    WHEN 0 THEN c_name
    WHEN 1 THEN '2345 ' || c_mktsegment
    WHEN 2 THEN CAST(c_custkey AS VARCHAR) || '  ' || c_mktsegment || ' 34 ' || chr(9) || ' B'
    ELSE CAST(c_custkey AS VARCHAR) END"""

CODE_CANDIDATE_SQL = """CASE p_partkey % 8
    WHEN 0 THEN ''
    WHEN 1 THEN NULL
    WHEN 2 THEN 'x' || CAST(p_partkey AS VARCHAR)
    WHEN 3 THEN CAST(p_partkey AS VARCHAR) || chr(10)
    WHEN 4 THEN ' ' || CAST(p_partkey AS VARCHAR)
    ELSE substr(CAST(p_partkey * 7919 AS VARCHAR), 1, CAST(p_partkey % 9 AS INTEGER)) END"""

# Texts to match against the part catalogue: names with swapped tokens, changed case,
# punctuation, plural and article, a cut first letter, and texts that are blank or that
# normalise to nothing.
PROBE_SQL = """CASE WHEN p_partkey % 101 = 3 THEN '?!'
    WHEN p_partkey % 103 = 4 THEN '   '
    ELSE CASE p_partkey % 5
    WHEN 0 THEN p_name
    WHEN 1 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)
    WHEN 2 THEN upper(p_name) || '!'
    WHEN 3 THEN 'the ' || p_name || 's'
    ELSE substr(p_name, 2) END END"""


# A catalogue that grows with the scale factor: nearly every part has its own description, some have none.
WIDE_DESCRIPTION_SQL = """CASE WHEN p_partkey % 211 = 17 THEN NULL
    ELSE p_name || ' ' || lower(p_type) || ' size ' || CAST(p_size AS VARCHAR) || ' ' || p_brand END"""

# One purchase text for each supplier: a part's description, more or less distorted, or none.
PURCHASE_SQL = """CASE s_suppkey % 8
    WHEN 0 THEN p_brand || ', ' || p_name || ' size ' || CAST(p_size AS VARCHAR) || ' ' || p_type
    WHEN 1 THEN replace(replace(p_name, 'e', 'a'), 'l', '') || ' ' || lower(p_type) || ' sz ' || CAST(p_size AS VARCHAR) || ' ' || p_brand
    WHEN 2 THEN upper(p_name) || ' ' || p_type || ' SIZE ' || CAST(p_size AS VARCHAR) || ' ' || p_brand
    WHEN 3 THEN s_name
    WHEN 4 THEN p_name || ' (' || p_brand || ')'
    WHEN 5 THEN 'ten ' || p_name || 's of ' || lower(p_type) || ' size, ' || s_name
    WHEN 6 THEN CASE WHEN s_suppkey % 16 = 6 THEN NULL ELSE '  ' END
    ELSE p_name || ' ' || lower(p_type) || ' size ' || CAST(p_size + 1 AS VARCHAR) || ' ' || p_brand END"""


def wide_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, code, description with about as many descriptions as parts."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ordinal"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("code"),
        F.expr(spark_sql(WIDE_DESCRIPTION_SQL)).alias("description"))


def purchase_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s_suppkey, purchase: the text of the part that has the supplier's number, distorted."""
    s, p = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    return s.join(p, s["s_suppkey"] == p["p_partkey"], "left").select("s_suppkey", F.expr(spark_sql(PURCHASE_SQL)).alias("purchase"))


# Benchmark texts of 60 to 400 characters, each with a distorted copy of itself and with the next one.
LONG_COPY_SQL = """CASE item_id % 4
    WHEN 0 THEN replace(text, 'e', 'ea')
    WHEN 1 THEN upper(text)
    WHEN 2 THEN replace(replace(text, 'th', ''), 'n', 'mm')
    ELSE text || ' ' || text END"""


def long_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, a, b (the distorted text), c (the next item's text or null), all in lower case."""
    t = table(spark, sf_dir, "benchmark")
    nxt = t.select((F.col("item_id") - 1).alias("item_id"), F.lower("text").alias("c"))
    return t.select("item_id", F.lower("text").alias("a"), F.lower(F.expr(spark_sql(LONG_COPY_SQL))).alias("b")).join(nxt, "item_id", "left")
