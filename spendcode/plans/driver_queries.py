"""The registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each reads whole driver tables (or data Spark derives from them) and aliases every
computed column so the names match the DuckDB oracle in ``spendcode.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendcode.functions import parsers as P
from spendcode.functions import text as T
from spendcode.operators import catalog as C
from spendcode.operators import metrics as M
from spendcode.operators.gates import gate
from spendcode.operators.replay import replay_responder
from spendcode.sources import fixtures as X
from spendcode.sources.tables import table


# --- catalogue (C1, C2, A1, A2, T1, R3, E1, E2) ---------------------------------------

def catalog_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = X.raw_catalogue(spark, sf_dir)
    from spendcode.functions.text import code_for_cleaning
    return raw.select("ordinal", F.col("code").alias("code_raw"),
                      code_for_cleaning("code").alias("code"))


def clean_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = X.raw_catalogue(spark, sf_dir)
    from spendcode.functions.text import clean_description as clean
    return raw.select("ordinal", F.col("description").alias("description_raw"),
                      clean("description").alias("description"))


def catalog_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = C.clean_catalogue(X.raw_catalogue(spark, sf_dir))
    return C.dedupe_first(cleaned).select("ordinal", "code", "description")


def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.catalogue_stats(C.clean_catalogue(X.raw_catalogue(spark, sf_dir)))


def catalog_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.preview(catalog_dedupe(spark, sf_dir))


def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.embedding_records(X.raw_catalogue(spark, sf_dir))


# --- text scalars (F3, F4, F5, R5, R6, F8) ---------------------------------------------

def is_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", T.is_english("text").alias("is_english"))


def lang_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (is_english(spark, sf_dir).groupBy("lang", "is_english")
            .agg(F.count(F.lit(1)).alias("n")))


def account_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    acct = F.expr(X.spark_sql(X.RAW_ACCOUNT_SQL))
    return c.select("c_custkey", acct.alias("account"), T.strip_digits(acct).alias("account_text"))


def input_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.combined_text(F.col("text"), T.strip_digits("source")).alias("input_text"))


def validate_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    cand = F.expr(X.spark_sql(X.CODE_CANDIDATE_SQL))
    blank = T.is_blank(cand)
    valid = T.valid_naics_code(cand)
    return (p.select("p_type", blank.alias("blank"), valid.alias("valid"))
            .groupBy("p_type")
            .agg(F.count_if(F.col("valid")).alias("n_valid"),
                 F.count_if(~F.col("valid") & ~F.col("blank")).alias("n_invalid"),
                 F.count_if(F.col("blank")).alias("n_blank")))


def elapsed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return M.elapsed_by_group(e, ["user_id", "event_type"])


# --- answer parsers (N1, N2, U1, U2, U3, U4) and gates (G1, G2) ------------------------

def _parsed(spark, sf_dir, column, parser) -> DataFrame:
    a = X.answers(spark, sf_dir)
    return a.select("p_partkey", parser(column).alias("r")).select("p_partkey", "r.*")


def naics_parse(spark, sf_dir):
    return _parsed(spark, sf_dir, "naics_answer", P.naics_p1)


def naics_parse_strict(spark, sf_dir):
    return _parsed(spark, sf_dir, "naics_answer", P.naics_p2)


def unspsc_parse(spark, sf_dir):
    return _parsed(spark, sf_dir, "unspsc_answer", P.unspsc_p1)


def unspsc_parse_strict(spark, sf_dir):
    return _parsed(spark, sf_dir, "unspsc_answer", P.unspsc_p2)


def unspsc_parse_generic(spark, sf_dir):
    return _parsed(spark, sf_dir, "unspsc_answer", P.unspsc_generic)


def unspsc_describe_parse(spark, sf_dir):
    a = X.answers(spark, sf_dir)
    return a.select("p_partkey", P.unspsc_describe("unspsc_answer").alias("description"))


def parse_report(spark, sf_dir):
    """Answers per parser and parse status."""
    a = X.answers(spark, sf_dir)
    frames = []
    for parser, col in (("naics_p1", "naics_answer"), ("naics_p2", "naics_answer"),
                        ("unspsc_p1", "unspsc_answer"), ("unspsc_p2", "unspsc_answer")):
        _, counts = P.parse_responses(a, col, parser)
        frames.append(counts.select(F.lit(parser).alias("parser"), "parse_status", "n"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def parse_outcomes(spark, sf_dir):
    """Answers per parser and finer outcome: malformed codes, stated 0 % and confidences above 100 apart."""
    a = X.answers(spark, sf_dir)
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("parser"), P.parse_outcome(f"{p.split('_')[0]}_answer", p).alias("outcome")) for p in P.PARSERS]))
    return a.select(each.alias("o")).groupBy("o.parser", "o.outcome").agg(F.count(F.lit(1)).alias("n"))


def threshold_gate(spark, sf_dir):
    a = X.answers(spark, sf_dir)
    parsed = a.select("p_partkey", P.naics_p1("naics_answer").alias("n"),
                      P.unspsc_p1("unspsc_answer").alias("u"))
    cols = []
    for t in (0, 85):
        cols += gate(F.col("n"), t, f"naics_t{t}") + gate(F.col("u"), t, f"unspsc_t{t}")
    return parsed.select("p_partkey", *cols)


def confidence_histogram(spark, sf_dir):
    a = X.answers(spark, sf_dir)
    parsed = a.select(P.naics_p1("naics_answer")["confidence"].alias("naics_confidence"),
                      P.unspsc_p1("unspsc_answer")["confidence"].alias("unspsc_confidence"))
    n = M.confidence_histogram(parsed, "naics_confidence").withColumn("column_name", F.lit("naics"))
    u = M.confidence_histogram(parsed, "unspsc_confidence").withColumn("column_name", F.lit("unspsc"))
    return n.unionByName(u)


def hierarchy_rollup(spark, sf_dir):
    return M.hierarchy_rollup(unspsc_parse(spark, sf_dir))


# --- model stages and pipelines (J3, L1-L5, G3, G4, G6, G7) ----------------------------

def _lines_p1(spark, sf_dir):
    from spendcode.sources.tables import lines_from_documents
    return lines_from_documents(spark, sf_dir)


def _lines_p2(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("ordinal"), F.col("text").alias("description"),
                    F.col("source").alias("account"))


def enrich(spark, sf_dir):
    from spendcode.plans.enrich import enrich as run
    return run(_lines_p1(spark, sf_dir), responder=replay_responder).result()


def process(spark, sf_dir):
    from spendcode.plans.enrich import process as run
    return run(_lines_p2(spark, sf_dir), responder=replay_responder).result()


def translate_gate(spark, sf_dir):
    from spendcode.plans.enrich import translate as run
    r = run(_lines_p1(spark, sf_dir), responder=replay_responder)
    return r.lines.select("ordinal", "procurement_description_en", "account_en")


def quarantine(spark, sf_dir):
    from spendcode.plans.enrich import enrich as run, quarantine as q
    return q(run(_lines_p1(spark, sf_dir), responder=replay_responder))


def stage_metrics(spark, sf_dir):
    from spendcode.plans.enrich import enrich as run, stage_metrics as m
    return m(run(_lines_p1(spark, sf_dir), responder=replay_responder)).drop("seconds")


def stored_responses(spark, sf_dir):
    """The lines enriched twice over one response store: rows that each run left in it, by stage.

    The second run asks for nothing that was answered, only for what had failed."""
    import uuid
    from spendcode.operators.responses import ResponseStore
    from spendcode.plans.enrich import enrich as run
    from spendcode.session import shared_dir
    store = ResponseStore(spark, shared_dir(spark, f"responses/{uuid.uuid4().hex}"))
    counts = []
    for _ in range(2):
        run(_lines_p1(spark, sf_dir), store=store, responder=replay_responder).release()
        rows = store.load().groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("request_key").alias("requests"),
                                                 F.count_if(F.col("response").isNotNull()).alias("answered"))
        counts.append({r["stage"]: (r["n"], r["requests"], r["answered"]) for r in rows.collect()})  # a row a stage
    out = [(stage, *counts[0][stage], counts[1][stage][0] - counts[0][stage][0], *counts[1][stage][1:]) for stage in counts[0]]
    return spark.createDataFrame(out, "stage string, first_asked bigint, requests bigint, answered bigint, again_asked bigint, "
                                      "again_requests bigint, again_answered bigint")


def describe_stage(spark, sf_dir):
    """Product description of each line from the model (L5 prompt, U4 parse); blank text
    or a failed request gives null."""
    from spendcode.functions.prompts import DEFAULT_MODEL, MISSING_TEXT
    from spendcode.operators.responses import ResponseStore
    from spendcode.plans.enrich import EnrichRun, _classify
    lines = _lines_p1(spark, sf_dir)
    run = EnrichRun(lines)
    text = F.coalesce(F.col("procurement_description"), F.lit(MISSING_TEXT))
    df = _classify(lines, "p1", "describe", DEFAULT_MODEL, ~T.is_blank("procurement_description"),
                   ResponseStore(spark), replay_responder, run, text=text)
    return df.select("ordinal", P.unspsc_describe("describe_response").alias("unspsc_description"))


def request_plan(spark, sf_dir):
    """Distinct requests of the first stages and how many line slots each one serves."""
    from spendcode.functions.prompts import DEFAULT_MODEL, MISSING_TEXT
    from spendcode.operators.responses import request_columns
    lines = _lines_p1(spark, sf_dir)
    slots = []
    for stage, col in (("detect", "procurement_description"), ("detect", "account"),
                       ("describe", "procurement_description")):
        text = F.coalesce(F.col(col), F.lit(MISSING_TEXT))
        rc = request_columns("p1", stage, DEFAULT_MODEL, text=text)
        slots.append(F.struct(rc[0], rc[1]))
    # one scan of the lines, three request slots per line
    u = lines.select(F.explode(F.array(*slots)).alias("r")).select("r.*")
    return u.groupBy("stage", "request_key").agg(F.count(F.lit(1)).alias("n_lines"))


# --- fuzzy scores and best match (F1, F2, J1, J2, R7, T2, T3, G5) -----------------------

def _pairs(spark, sf_dir):
    """Each part name paired with the decorated name of the next part (equi-join on key); a
    part without a next one is paired with null."""
    p = table(spark, sf_dir, "part")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"),
                   F.expr(X.PROBE_SQL).alias("b_raw"))
    return p.join(nxt, "p_partkey", "left").select("p_partkey", F.lower("p_name").alias("a"),
                                            F.lower("b_raw").alias("b"))


def fuzzy_ratio(spark, sf_dir):
    from spendcode.functions.fuzzy import with_ratio
    return with_ratio(_pairs(spark, sf_dir), "a", "b", "score").select("p_partkey", "score")


def fuzzy_token_sort(spark, sf_dir):
    from spendcode.functions.fuzzy import with_ratio
    return with_ratio(_pairs(spark, sf_dir), "a", "b", "score", token_sort=True).select("p_partkey", "score")


def _probes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(X.PROBE_SQL).alias("probe"))


def fuzzy_best(spark, sf_dir):
    from spendcode.operators.match import attach_best_match
    from spendcode.sources.tables import catalogue_from_part
    return attach_best_match(_probes(spark, sf_dir), "probe", catalogue_from_part(spark, sf_dir),
                             scorer="token_sort").drop("probe")


def fuzzy_best_cutoff(spark, sf_dir):
    from spendcode.operators.match import attach_best_match
    from spendcode.sources.tables import catalogue_from_part
    return attach_best_match(_probes(spark, sf_dir), "probe", catalogue_from_part(spark, sf_dir),
                             scorer="ratio", cutoff=70).drop("probe")


def fuzzy_best_documents(spark, sf_dir):
    """Whole document texts against the part catalogue (token-sort scorer)."""
    from spendcode.operators.match import attach_best_match
    from spendcode.sources.tables import catalogue_from_part
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return attach_best_match(d, "text", catalogue_from_part(spark, sf_dir)).drop("text")


def fuzzy_ratio_long(spark, sf_dir):
    """Both sides longer than one word of bits: plain and token-sort score, near and far pairs."""
    from spendcode.functions.fuzzy import with_ratio
    df = X.long_pairs(spark, sf_dir)
    for a, b, sort in (("a", "b", False), ("a", "b", True), ("a", "c", False), ("a", "c", True)):
        df = with_ratio(df, a, b, f"{'sorted' if sort else 'plain'}_{a}{b}", token_sort=sort)
    return df.drop("a", "b", "c")


def fuzzy_best_wide(spark, sf_dir):
    """Purchase texts against a catalogue that grows with the scale factor (J1)."""
    from spendcode.operators.match import attach_best_match
    return attach_best_match(X.purchase_texts(spark, sf_dir), "purchase", X.wide_catalogue(spark, sf_dir), scorer="token_sort").drop("purchase")


def fuzzy_best_wide_cutoff(spark, sf_dir):
    """The same with the plain scorer and a cut-off (J2)."""
    from spendcode.operators.match import attach_best_match
    return attach_best_match(X.purchase_texts(spark, sf_dir), "purchase", X.wide_catalogue(spark, sf_dir), scorer="ratio", cutoff=70).drop("purchase")


def fuzzy_enrich(spark, sf_dir):
    from spendcode.plans.fuzzy_enrich import fuzzy_enrich as run
    from spendcode.sources.tables import catalogue_from_part
    return run(_lines_p1(spark, sf_dir), catalogue_from_part(spark, sf_dir), responder=replay_responder)


def fuzzy_enrich_translated(spark, sf_dir):
    """The same on texts put into English first, with the English columns."""
    from spendcode.plans.fuzzy_enrich import fuzzy_enrich as run
    from spendcode.sources.tables import catalogue_from_part
    return run(_lines_p1(spark, sf_dir), catalogue_from_part(spark, sf_dir), responder=replay_responder, translated=True)


# --- vectors (E3, E5, E6, R4, S8, S9) ----------------------------------------------------

def hash_embed(spark, sf_dir):
    from spendcode.functions.vectors import hash_embedding_sparse
    recs = C.embedding_records(X.raw_catalogue(spark, sf_dir))
    return (recs.select("ordinal", F.explode(hash_embedding_sparse("text")).alias("e"))
            .select("ordinal", F.col("e.bucket").alias("bucket"),
                    F.round("e.weight", 6).alias("weight")))


def cosine_similarity(spark, sf_dir):
    from spendcode.functions.vectors import cosine
    e = table(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next_embedding"))
    return e.join(nxt, "vec_id", "left").select("vec_id", F.round(cosine("embedding", "next_embedding"), 6)
                                        .alias("similarity"))


def cosine_topk(spark, sf_dir):
    from spendcode.operators.vectors import nearest
    e = table(spark, sf_dir, "embeddings")
    probes = e.select(F.col("vec_id").alias("probe_id"), F.col("embedding").alias("vector"))
    index = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(probes, index, k=5).select("probe_id", "rank", "id",
                                              F.round("similarity", 6).alias("similarity"))


def vector_upsert(spark, sf_dir):
    """Rows with label 0 form the existing index, the others are upserted into it; ids
    repeat (three rows an id) so later writes replace earlier ones."""
    from spendcode.operators.vectors import upsert, vector_records
    e = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 3).alias("id"), "vec_id", "embedding", "label",
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("description"))
    recs = vector_records(e, "id", "embedding", "description", "vec_id").withColumn(
        "label", F.col("metadata")["description"])
    existing = recs.where(F.col("label") == "label 0").drop("label")
    batch = recs.where(F.col("label") != "label 0").drop("label")
    merged = upsert(existing, batch)
    vsum = F.aggregate(F.transform("vector", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return merged.select("id", F.col("seq"), F.size("vector").alias("dim"),
                         F.round(vsum, 6).alias("vsum"), F.col("metadata")["description"].alias("description"))


def vector_table(spark, sf_dir):
    """Two upserts into one stored vector table, and a read: all vectors, then those of label 1 again under
    another description, with new ids besides (S8, S9)."""
    import uuid
    from spendcode.operators.vectors import VectorTable, vector_records
    from spendcode.session import shared_dir
    e = table(spark, sf_dir, "embeddings")
    stored = VectorTable(spark, shared_dir(spark, f"vectors/{uuid.uuid4().hex}"), dimension=64)
    first = e.select(F.col("vec_id").alias("id"), "embedding", F.lit("first").alias("d"), "vec_id")
    again = e.where("label = 1").select(F.explode(F.array("vec_id", -F.col("vec_id") - 1)).alias("id"), "embedding", F.lit("second").alias("d"), "vec_id")
    for batch in (first, again):
        stored.upsert(vector_records(batch, "id", "embedding", "d", "vec_id"))
    vsum = F.aggregate(F.transform("vector", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return stored.read().select("id", "seq", F.size("vector").alias("dim"), F.round(vsum, 6).alias("vsum"), F.col("metadata")["description"].alias("description"))


def _catalogue_file(spark, sf_dir):
    """The raw catalogue written as CSV files whose names follow the rows' order; the folder."""
    import uuid
    from spendcode.session import shared_dir
    from spendcode.sources.csv_io import write_csv
    path = shared_dir(spark, f"catalogue/{uuid.uuid4().hex}")
    raw = X.raw_catalogue(spark, sf_dir)
    write_csv(raw.repartitionByRange(4, "ordinal").sortWithinPartitions("ordinal").select("code", "description"), path)
    return path


def embed_job(spark, sf_dir):
    """The embedding job from a CSV catalogue into a vector table, and a read (S3, S5, E4)."""
    import uuid
    from spendcode.operators.vectors import VectorTable
    from spendcode.plans.catalog_job import embed_catalogue_job
    from spendcode.session import shared_dir
    stored = VectorTable(spark, shared_dir(spark, f"vectors/{uuid.uuid4().hex}"))
    embed_catalogue_job(spark, _catalogue_file(spark, sf_dir), stored)
    vsum = F.aggregate(F.transform("vector", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return stored.read().select("id", F.size("vector").alias("dim"), F.round(vsum, 5).alias("vsum"), F.col("metadata")["description"].alias("description"))


def _clean_job(spark, sf_dir, kind):
    import uuid
    from spendcode.plans.catalog_job import clean_catalogue_job
    from spendcode.session import shared_dir
    from spendcode.sources.csv_io import read_cleaned_catalogue
    out = shared_dir(spark, f"cleaned/{uuid.uuid4().hex}")
    clean_catalogue_job(spark, _catalogue_file(spark, sf_dir), out, output_format=kind)
    return read_cleaned_catalogue(spark, out, input_format=kind).select("code", "description")


def clean_job(spark, sf_dir):
    """The cleaning job from a CSV catalogue to Parquet, and what its reader finds there (S3, C3, S4)."""
    return _clean_job(spark, sf_dir, "parquet")


def clean_job_csv(spark, sf_dir):
    """The same to CSV, as the reference writes it (S7)."""
    return _clean_job(spark, sf_dir, "csv")


# --- CSV sink and source (S6, S7, S1, S2, R1) -------------------------------------------

def csv_roundtrip(spark, sf_dir):
    """The enriched lines written as CSV (multi-line quoted texts, header spelt the
    misspelt way) and read back; every field comes back as text, '' as null."""
    import uuid
    from spendcode.session import shared_dir
    from spendcode.sources.csv_io import read_purchase_lines, write_csv
    path = shared_dir(spark, f"csv-roundtrip-{uuid.uuid4().hex[:12]}")
    enriched = (enrich(spark, sf_dir).withColumnRenamed("ordinal", "line_no")
                .withColumnRenamed("procurement_description", "procurment_description"))
    write_csv(enriched, path)
    return read_purchase_lines(spark, path).drop("ordinal")


QUERIES = {
    "catalog_code": catalog_code,
    "clean_description": clean_description,
    "catalog_dedupe": catalog_dedupe,
    "catalog_stats": catalog_stats,
    "catalog_preview": catalog_preview,
    "embed_text": embed_text,
    "is_english": is_english,
    "lang_confusion": lang_confusion,
    "account_strip": account_strip,
    "input_text": input_text,
    "validate_code": validate_code,
    "elapsed_text": elapsed_text,
    "naics_parse": naics_parse,
    "naics_parse_strict": naics_parse_strict,
    "unspsc_parse": unspsc_parse,
    "unspsc_parse_strict": unspsc_parse_strict,
    "unspsc_parse_generic": unspsc_parse_generic,
    "unspsc_describe_parse": unspsc_describe_parse,
    "threshold_gate": threshold_gate,
    "parse_report": parse_report,
    "parse_outcomes": parse_outcomes,
    "confidence_histogram": confidence_histogram,
    "hierarchy_rollup": hierarchy_rollup,
    "request_plan": request_plan,
    "describe_stage": describe_stage,
    "translate_gate": translate_gate,
    "enrich": enrich,
    "process": process,
    "quarantine": quarantine,
    "stage_metrics": stage_metrics,
    "stored_responses": stored_responses,
    "fuzzy_ratio": fuzzy_ratio,
    "fuzzy_token_sort": fuzzy_token_sort,
    "fuzzy_best": fuzzy_best,
    "fuzzy_best_cutoff": fuzzy_best_cutoff,
    "fuzzy_best_documents": fuzzy_best_documents,
    "fuzzy_ratio_long": fuzzy_ratio_long,
    "fuzzy_best_wide": fuzzy_best_wide,
    "fuzzy_best_wide_cutoff": fuzzy_best_wide_cutoff,
    "fuzzy_enrich": fuzzy_enrich,
    "fuzzy_enrich_translated": fuzzy_enrich_translated,
    "hash_embed": hash_embed,
    "cosine_similarity": cosine_similarity,
    "cosine_topk": cosine_topk,
    "vector_upsert": vector_upsert,
    "vector_table": vector_table,
    "embed_job": embed_job,
    "clean_job": clean_job,
    "clean_job_csv": clean_job_csv,
    "csv_roundtrip": csv_roundtrip,
}
