"""CSV sources and sinks with the quoting rules of pandas' reader and writer.

Purchase-line and catalogue files are UTF-8 CSV with a header row; fields may contain
doubled quotes and newlines inside quotes.  Spark only parses those like pandas with
``multiLine`` and ``escape='"'``, where each file is one task; ``split`` reads large files by many
(``csv_split``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendcode.functions.text import na_to_null

PURCHASE_COLUMNS = ("procurement_description", "account")
PURCHASE_COLUMNS_P2 = ("description", "account")
CATALOGUE_COLUMNS = ("code", "description")
# Fixed value: the misspelt header the application accepts for the description column.
MISSPELT = {"procurment_description": "procurement_description"}

READ_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"',
                "encoding": "UTF-8", "inferSchema": "false", "mode": "PERMISSIVE"}
_RECORD = "_csv_record"
WRITE_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "emptyValue": "", "nullValue": "",
                 "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
                 "encoding": "UTF-8"}


class MissingColumns(ValueError):
    pass


def require_columns(df: DataFrame, required, name_all: bool = False) -> DataFrame:
    """Raise before any action when required columns are absent (the application names
    the missing ones; the modular variant names all required ones)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        listed = ", ".join(required if name_all else missing)
        raise MissingColumns(f"columns missing from the CSV input: {listed}")
    return df


def _fields(record):
    """Number of fields of a CSV record: commas outside quotes, and one."""
    bare = F.regexp_replace(record, r'"(?:[^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def _parsed(spark: SparkSession, path: str, split: bool = False) -> tuple[DataFrame, list[str]]:
    """All columns as strings, ``_file``, ``_at`` (which orders a file's rows) and, where a record's fields
    are not as many as the header's, the record as written."""
    names = spark.read.options(**READ_OPTIONS).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, _RECORD]])
    if split:
        from spendcode.sources.csv_split import csv_records
        options = {"quote": '"', "escape": '"', "columnNameOfCorruptRecord": _RECORD, "mode": "PERMISSIVE"}
        records = csv_records(spark, path).where("record > 0")
        ddl = ", ".join(f"`{c}` string" for c in [*names, _RECORD])
        fields = F.from_csv(F.regexp_replace("text", "\\r$", ""), ddl, options)
        raw = records.select(fields.alias("r"), F.col("file").alias("_file"), (F.col("record") - 1).alias("_at"))
        return raw.select(*[F.col(f"r.`{c}`").alias(c) for c in [*names, _RECORD]], "_file", "_at"), names
    # every field is split, also of columns nobody reads, or surplus ones would go unseen
    raw = spark.read.options(**READ_OPTIONS, columnNameOfCorruptRecord=_RECORD, columnPruning="false").schema(schema).csv(path)
    # Spark refuses to read the record alone, so it comes with (nothing of) the first column
    record = F.concat(F.col(_RECORD), F.substring(F.coalesce(F.col(f"`{names[0]}`"), F.lit("")), 1, 0))
    return raw.select(*[F.col(f"`{c}`") for c in names], record.alias(_RECORD), F.col("_metadata.file_path").alias("_file"),
                      F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), names


def surplus_rows(spark: SparkSession, path: str) -> DataFrame:
    """``file, record, fields`` of the records with more fields than the header."""
    raw, names = _parsed(spark, path)
    return raw.select(F.col("_file").alias("file"), F.col(_RECORD).alias("record"), _fields(F.col(_RECORD)).alias("fields")).where(
        F.col("fields") > len(names))


def read_csv(spark: SparkSession, path: str, partitions: int | None = None, on_surplus: str = "raise", split: bool = False) -> DataFrame:
    """All columns as strings, pandas' missing-value tokens as null, plus ``ordinal``.

    ``ordinal`` follows the file names, then the order within a file, however Spark packs the files.  A file
    is one task; with ``split`` it is read by as many as it has blocks (``csv_split``; the same rows and
    order).  A row shorter than the header is filled with nulls.  A row with more fields fails the
    job and is named in the error, as pandas does; ``on_surplus="skip"`` leaves such rows out
    (``surplus_rows`` lists them), which keeps the others' ordinals.
    """
    raw, names = _parsed(spark, path, split)
    surplus = F.coalesce(_fields(F.col(_RECORD)) > len(names), F.lit(False))
    if on_surplus == "raise":
        told = F.concat(F.lit(f"expected {len(names)} fields, saw "), _fields(F.col(_RECORD)).cast("string"), F.lit(": "), F.col(_RECORD),
                        F.lit(" in "), F.col("_file"))
        keep = F.when(surplus, F.raise_error(told).cast("boolean")).otherwise(F.lit(True))
    else:
        keep = ~surplus
    df = raw.select(*[na_to_null(F.col(f"`{c}`")).alias(c) for c in names], "_file", "_at", keep.alias("_keep")).where("_keep").drop("_keep")
    # one row a file; the window sees file names only
    files = df.select("_file").distinct().select("_file", F.row_number().over(Window.orderBy("_file")).alias("_nr"))
    df = df.join(files, "_file").withColumn("ordinal", (F.col("_nr") - 1) * F.lit(1 << 33) + F.col("_at")).drop("_file", "_at", "_nr")
    return df.repartition(partitions) if partitions else df


def read_purchase_lines(spark: SparkSession, path: str, dialect: str = "p1",
                        partitions: int | None = None, split: bool = False) -> DataFrame:
    df = read_csv(spark, path, partitions, split=split)
    if dialect == "p1":
        for wrong, right in MISSPELT.items():
            if wrong in df.columns and right not in df.columns:
                df = df.withColumnRenamed(wrong, right)
        return require_columns(df, PURCHASE_COLUMNS)
    return require_columns(df, PURCHASE_COLUMNS_P2, name_all=True)


def read_catalogue(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """Raw catalogue ``ordinal, code, description`` (+ other columns)."""
    return require_columns(read_csv(spark, path, split=split), CATALOGUE_COLUMNS)


def read_cleaned_catalogue(spark: SparkSession, path: str, input_format: str = "parquet") -> DataFrame:
    """What the cleaning job wrote: ``ordinal`` (where kept), ``code`` as a number, ``description``
    (an empty CSV field is the empty description)."""
    if input_format == "parquet":
        return require_columns(spark.read.parquet(path), CATALOGUE_COLUMNS)
    df = require_columns(read_csv(spark, path), CATALOGUE_COLUMNS)
    return df.select("ordinal", F.col("code").try_cast("double").alias("code"), F.coalesce("description", F.lit("")).alias("description"))


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> None:
    """Header row, no index, quotes doubled, null and '' both written as an empty field."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).options(**WRITE_OPTIONS).csv(path)
