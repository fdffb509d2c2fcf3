"""End-to-end coding of purchase lines.

``enrich`` is the application pipeline: translate description and account (detect, then
translate only non-English text), combine them, ask for the industry code, gate it, ask
for the product code with the *gated* industry description as context, gate it.
``process`` is the modular variant: the translated description alone is classified, its
parsers are stricter, and nothing is gated.

Model calls are request rows resolved through a :class:`ResponseStore`; each stage asks
only distinct requests and joins the answers back by request key.  Texts are translated
once per distinct text even when they appear in both columns or on many lines.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spendcode.functions import parsers as P
from spendcode.functions import prompts as PR
from spendcode.functions import text as T
from spendcode.operators.boundary import forget, settle
from spendcode.operators.gates import gate
from spendcode.operators.responses import (
    ResponseStore, Responder, request_columns, request_constants, slot_text, stage_name)
from spendcode.operators.skew import spread_join
from spendcode.session import shared_dir

KEY = "_line"  # key of a line inside the job


@dataclass(frozen=True)
class Settings:
    translation_model: str = PR.DEFAULT_MODEL
    classification_model: str = PR.DEFAULT_MODEL
    unspsc_model: str = PR.DEFAULT_MODEL
    confidence_threshold: int = PR.DEFAULT_THRESHOLD
    unspsc_confidence_threshold: int = PR.DEFAULT_THRESHOLD


@dataclass
class EnrichRun:
    """The enriched lines plus, per stage, the resolved distinct requests."""
    lines: DataFrame
    stages: dict[str, DataFrame] = field(default_factory=dict)
    error_columns: dict[str, str] = field(default_factory=dict)
    # stage -> (line slots that asked the stage, line slots whose answer passed the gate)
    line_metrics: dict[str, tuple] = field(default_factory=dict)
    output_columns: list[str] = field(default_factory=list)
    results: DataFrame | None = None  # per-line results, keyed by KEY
    persisted: list[DataFrame] = field(default_factory=list)
    # "tables": write each stage boundary to the shared folder and observe its counts while it is
    # written.  "persist": cache boundaries (executor memory and local disk; lost blocks are
    # recomputed from lineage).  "checkpoint": Spark's reliable checkpoint of each boundary.
    materialize: str = "tables"
    # seconds spent on the eager boundaries ("tables" and "checkpoint") of each stage: the stopwatch
    timings: dict = field(default_factory=dict)
    # what the boundaries counted while they were written ("tables")
    observed: dict = field(default_factory=dict)

    def result(self) -> DataFrame:
        return self.lines.select(*self.output_columns)

    def keep(self, df: DataFrame, name: str = "boundary", counts: dict[str, Column] | None = None) -> DataFrame:
        """Stage boundary.  The next stage both derives its requests from ``df`` and joins the
        answers back to it; a boundary makes the two branches share one computation instead of
        doubling the lineage at every stage.  ``counts`` are aggregates that a written boundary
        collects on the way, so no metric runs a stage again."""
        t0 = time.perf_counter()
        if self.materialize == "tables":
            seen = Observation()
            if counts:
                df = df.observe(seen, *[c.alias(k) for k, c in counts.items()])
            df = settle(df, "enrich")
            self.observed.update(seen.get if counts else {})
            self.persisted.append(df)
        elif self.materialize == "checkpoint":
            from spendcode.session import ensure_checkpoint_dir
            ensure_checkpoint_dir(df.sparkSession)
            df = df.checkpoint(eager=True)
        else:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
            self.persisted.append(df)
            return df
        self.timings[name] = self.timings.get(name, 0.0) + time.perf_counter() - t0
        return df

    def release(self) -> None:
        """Give up the boundaries; afterwards only a result that was written before can be read."""
        for df in self.persisted:
            forget(df) if self.materialize == "tables" else df.unpersist()
        self.persisted.clear()


def _asked_counts(stage: str) -> dict[str, Column]:
    """Requests of a stage: how many, how many answered, how many failed."""
    return {f"{stage}__requests": F.count(F.lit(1)), f"{stage}__answered": F.count("response"), f"{stage}__failed": F.count("error")}


def _line_counts(run: EnrichRun, *stages: str) -> dict[str, Column]:
    """Line slots that asked these stages, and those whose answer passed the gate."""
    out = {}
    for s in stages:
        rows_in, accepted = run.line_metrics[s]
        out[f"{s}__in"] = F.coalesce(F.sum(rows_in), F.lit(0)).cast("long")
        out[f"{s}__accepted"] = F.coalesce(F.sum(accepted), F.lit(0)).cast("long") if accepted is not None else F.max(F.lit(None).cast("long"))
    return out


def with_line_key(lines: DataFrame, order: str = "ordinal") -> DataFrame:
    """``lines`` plus the unique, never null key ``_line``.

    A unique ``order`` column is the key itself.  Where it repeats or is null, rows are
    numbered instead, and written once to the shared folder before the key is used, so
    every later read sees the same numbers.
    """
    if order in lines.columns:
        bad = lines.groupBy(order).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(order).isNull())
        if bad.isEmpty():
            return lines.withColumn(KEY, F.col(order))
    spark = lines.sparkSession
    path = shared_dir(spark, f"lines/{uuid.uuid4().hex}")
    numbered = lines.withColumn(KEY, F.monotonically_increasing_id())
    numbered.write.parquet(path)
    return spark.read.schema(numbered.schema).parquet(path)


def _require(responder: Responder | None) -> Responder:
    if responder is None:
        raise ValueError("a responder (the model client) is required")
    return responder


def _key(dialect: str, stage: str, model: str, **slots: Column) -> Column:
    return request_columns(dialect, stage, model, **slots)[1]


def _ask(df: DataFrame, dialect: str, stage: str, model: str, slots: dict[str, Column], store: ResponseStore,
         responder: Responder, run: EnrichRun, carry: tuple[str, ...] = (), unique: bool = False, **derived: Column) -> DataFrame:
    """The distinct requests of a stage, resolved; of the request columns only key and user prompt move."""
    columns = request_columns(dialect, stage, model, **slots)
    out = store.resolve(df.select(columns[1], columns[-1], *carry), responder, stage_name(dialect, stage), carry,
                        request_constants(dialect, stage, model), derived, unique)
    run.stages[stage_name(dialect, stage)] = out
    return out


def translation_table(texts: DataFrame, dialect: str, model: str, store: ResponseStore,
                      responder: Responder, run: EnrichRun) -> DataFrame:
    """``dk, translated, detect_error, translate_error, translate_asked`` per distinct text column ``t``.

    ``dk`` is the detection request key of the text, so lines find their translation by recomputing it.
    ``translated`` is null where the text stays as it is: it is English, or a request failed.  Only texts
    that are translated are written and moved."""
    # In the application dialect the user prompt *is* the text; the modular dialect frames the text, and its
    # responder gets it as ``payload`` beside the prompt.
    text = {s: slot_text(dialect, s, F.col("user")) for s in ("detect", "translate")}
    payload = {s: {} if dialect == "p1" else {"payload": t} for s, t in text.items()}
    det = _ask(texts, dialect, "detect", model, {"text": F.col("t")}, store, responder, run, **payload["detect"])
    answer = PR.P1_ENGLISH_ANSWER if dialect == "p1" else PR.P2_ENGLISH_ANSWER
    english = F.coalesce(F.lower(T.py_strip("response")) == F.lit(answer), F.lit(False))
    asked = F.col("response").isNotNull() & ~english
    det2 = det.select(F.col("request_key").alias("dk"), F.when(asked, text["detect"]).alias("t"), asked.alias("translate_asked"),
                      F.col("error").alias("detect_error"), "response", "error")
    det2 = run.keep(det2, stage_name(dialect, "detect"), _asked_counts(stage_name(dialect, "detect"))).drop("response", "error")
    # a text and its two requests are one to one, so each row has one detection
    dk = _key(dialect, "detect", model, text=text["translate"])
    tr = _ask(det2.where("translate_asked"), dialect, "translate", model, {"text": F.col("t")}, store, responder, run,
              ("detect_error",), dk=dk, **payload["translate"])
    # the translations are joined twice (two columns), their counts observed once
    tr = run.keep(tr.select("dk", "detect_error", "response", "error"), stage_name(dialect, "translate"),
                  _asked_counts(stage_name(dialect, "translate")))
    none = F.lit(None).cast("string")
    return tr.select("dk", T.py_strip("response").alias("translated"), "detect_error", F.col("error").alias("translate_error"),
                     F.lit(True).alias("translate_asked")).unionByName(
        det2.where(~F.col("translate_asked")).select("dk", none.alias("translated"), "detect_error", none.alias("translate_error"),
                                                     "translate_asked"))


def _translate_narrow(lines: DataFrame, columns: dict[str, str], dialect: str, settings: Settings,
                      store: ResponseStore, responder: Responder, run: EnrichRun,
                      key: str = "ordinal") -> DataFrame:
    """Translations per line as a frame keyed (and hash-partitioned) by ``key``: ``key, {out}_translated,
    {out}_detect_error, {out}_translate_error, {out}_translate_asked``; :func:`_in_english` puts them into the lines.

    Only narrow ``(key, detection key)`` pairs meet the translation table, and of the texts only the
    translated ones move.  The wide line rows are not moved."""
    model = settings.translation_model
    rendered = {src: F.coalesce(F.col(src), F.lit(PR.MISSING_TEXT)) for src in columns}
    texts = lines.select(F.explode(F.array(*[rendered[src] for src in columns])).alias("t"))
    trans = translation_table(texts, dialect, model, store, responder, run)
    keys = lines.select(key, *[_key(dialect, "detect", model, text=rendered[src]).alias(f"_dk_{out}")
                               for src, out in columns.items()])
    # hot keys are counted, and every column is joined, over this narrow table
    keys = run.keep(keys, stage_name(dialect, "detect"))
    parts = []
    for out in columns.values():
        t = trans.select(F.col("dk").alias(f"_dk_{out}"), F.col("translated").alias(f"{out}_translated"),
                         F.col("detect_error").alias(f"{out}_detect_error"),
                         F.col("translate_error").alias(f"{out}_translate_error"),
                         F.col("translate_asked").alias(f"{out}_translate_asked"))
        parts.append(spread_join(keys.select(key, f"_dk_{out}"), t, f"_dk_{out}", key, "left").drop(f"_dk_{out}"))
        run.error_columns[f"detect_{dialect}:{out}"] = f"{out}_detect_error"
        run.error_columns[f"translate_{dialect}:{out}"] = f"{out}_translate_error"
    out_df = parts[0]
    for part in parts[1:]:
        out_df = out_df.join(part, key, "inner")
    run.line_metrics[stage_name(dialect, "detect")] = (F.lit(len(columns)), None)
    run.line_metrics[stage_name(dialect, "translate")] = (
        sum(F.col(f"{o}_translate_asked").cast("int") for o in columns.values()), None)
    return out_df


def _in_english(df: DataFrame, columns: dict[str, str], dialect: str) -> DataFrame:
    """Lines that have met their translations: adds the texts in English."""
    for src, out in columns.items():
        english = F.coalesce(F.col(f"{out}_translated"), F.col(src), F.lit(PR.MISSING_TEXT))
        if dialect == "p2":
            # the modular code returns the original value unless a translation came back,
            # so a missing text stays missing (the application casts to text first)
            came = F.col(f"{out}_translate_asked") & F.col(f"{out}_translate_error").isNull()
            english = F.when(F.col(src).isNull() & ~came, F.lit(None)).otherwise(english)
        df = df.withColumn(out, english)
    return df


def _classify_lines(per_line: DataFrame, dialect: str, settings: Settings, text: Column, guard: Column | None, context: Column,
                    store: ResponseStore, responder: Responder, run: EnrichRun, key: str = "ordinal") -> DataFrame:
    """Industry and product answers of each line, ``per_line`` without its texts: ``{stage}_response``,
    ``{stage}_error``, ``{stage}_asked``.

    A line's product request follows from its industry request and that one's answer (``context`` is the
    industry text from ``naics_response``).  So it is made on the distinct industry requests: their texts move
    once, for the industry stage, and lines meet both answers as narrow ``(key, request key)`` pairs."""
    k = _key(dialect, "naics", settings.classification_model, text=text)
    texts = [f.name for f in per_line.schema.fields if f.name.endswith(("_translated", "_error", "_asked"))]
    per_line = per_line.select(key, *texts, F.when(guard, text).otherwise(F.lit(None)).alias("_text") if guard is not None else text.alias("_text"),
                               (F.when(guard, k) if guard is not None else k).alias("_naics_key"))
    per_line = run.keep(per_line, stage_name(dialect, "naics"), _line_counts(run, *[m for m in run.line_metrics if f"{m}__in" not in run.observed]))
    asked = per_line.where(F.col("_naics_key").isNotNull())
    ans = _ask(asked, dialect, "naics", settings.classification_model, {"text": F.col("_text")}, store, responder, run)
    ans = ans.select("request_key", "response", "error", slot_text(dialect, "naics", F.col("user")).alias("_text"),
                     F.col("response").alias("naics_response"))
    slots = {"description": F.col("_text"), "naics": F.col("_context")}
    ans = ans.select("request_key", "response", "error", "_text", context.alias("_context")).withColumn(
        "_unspsc_key", _key(dialect, "unspsc", settings.unspsc_model, **slots))
    ans = run.keep(ans, stage_name(dialect, "naics"), _asked_counts(stage_name(dialect, "naics")))
    # distinct industry requests hardly ever give one product request; if none does, their texts stay where they are
    repeated = ans.groupBy("_unspsc_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    product = _ask(ans, dialect, "unspsc", settings.unspsc_model, slots, store, responder, run, unique=repeated.isEmpty())
    product = run.keep(product.select("request_key", "response", "error"), stage_name(dialect, "unspsc"),
                       _asked_counts(stage_name(dialect, "unspsc")))
    both = ans.select(F.col("request_key").alias("_naics_key"), F.col("response").alias("naics_response"), F.col("error").alias("naics_error"),
                      "_unspsc_key").join(
        product.select(F.col("request_key").alias("_unspsc_key"), F.col("response").alias("unspsc_response"),
                       F.col("error").alias("unspsc_error")), "_unspsc_key", "left").drop("_unspsc_key")
    got = spread_join(asked.select(key, "_naics_key"), both, "_naics_key", key).drop("_naics_key")
    for stage in ("naics", "unspsc"):
        run.error_columns[stage_name(dialect, stage)] = f"{stage}_error"
        run.line_metrics[stage_name(dialect, stage)] = (F.col(f"{stage}_asked").cast("int"), None)
    answered = F.col("_naics_key").isNotNull()
    return per_line.drop("_text").join(got, key, "left").select(
        "*", answered.alias("naics_asked"), answered.alias("unspsc_asked")).drop("_naics_key")


def _classify(lines: DataFrame, dialect: str, stage: str, model: str, guard: Column | None,
              store: ResponseStore, responder: Responder, run: EnrichRun, **slots: Column) -> DataFrame:
    """Attach ``{stage}_response`` / ``{stage}_error`` for the stage's request of each line."""
    return _classify_stages(lines, [(dialect, stage, model, guard, slots)], store, responder, run)


def _classify_stages(lines: DataFrame, specs: list, store: ResponseStore, responder: Responder,
                     run: EnrichRun) -> DataFrame:
    """Several independent stages over one stage boundary: every request key is computed
    on one persisted frame, each stage is resolved, and the answers are joined back."""
    cols = []
    for dialect, stage, model, guard, slots in specs:
        key = _key(dialect, stage, model, **slots)
        cols.append((F.when(guard, key) if guard is not None else key).alias(f"_{stage}_key"))
    lines = run.keep(lines.select("*", *cols), "+".join(stage_name(d, st) for d, st, *_ in specs))
    answers = []
    for dialect, stage, model, guard, slots in specs:
        k = f"_{stage}_key"
        req = lines.where(F.col(k).isNotNull()).select(*request_columns(dialect, stage, model, **slots))
        ans = store.resolve(req, responder, stage_name(dialect, stage))
        run.stages[stage_name(dialect, stage)] = ans
        run.error_columns[stage_name(dialect, stage)] = f"{stage}_error"
        run.line_metrics[stage_name(dialect, stage)] = (F.col(k).isNotNull().cast("int"), None)
        answers.append((k, stage, ans.select(F.col("request_key").alias(k),
                                             F.col("response").alias(f"{stage}_response"),
                                             F.col("error").alias(f"{stage}_error"))))
    for k, stage, ans in answers:
        # lines that ask nothing do not meet in the task of the null key
        asked = lines.where(F.col(k).isNotNull()).join(ans, k, "left").withColumn(f"{stage}_asked", F.lit(True))
        silent = lines.where(F.col(k).isNull()).select(
            "*", F.lit(None).cast("string").alias(f"{stage}_response"), F.lit(None).cast("string").alias(f"{stage}_error"),
            F.lit(False).alias(f"{stage}_asked"))
        lines = asked.unionByName(silent).drop(k)
    return lines


_CODES = ["naics_code", "naics_description", "naics_confidence", "unspsc_code", "unspsc_description", "unspsc_confidence"]
ENRICHED = ["procurement_description_en", "account_en", "input_text", *_CODES]
PROCESSED = ["description_en", "account_en", *_CODES]


def translate(lines: DataFrame, settings: Settings = Settings(), store: ResponseStore | None = None,
              responder: Responder | None = None, materialize: str = "tables") -> EnrichRun:
    """The translation stages alone: both texts in English."""
    responder = _require(responder)
    store = store or ResponseStore(lines.sparkSession)
    columns = {"procurement_description": "procurement_description_en", "account": "account_en"}
    lines = with_line_key(lines.drop(*columns.values()))
    run = EnrichRun(lines, materialize=materialize)
    df = _translate_narrow(lines, columns, "p1", settings, store, responder, run, KEY)
    run.output_columns = [c for c in lines.columns if c != KEY] + [*columns.values()]
    run.lines = _in_english(lines.join(df, KEY, "left"), columns, "p1")
    return run


def enrich(lines: DataFrame, settings: Settings = Settings(), store: ResponseStore | None = None,
           responder: Responder | None = None, materialize: str = "tables") -> EnrichRun:
    """Application pipeline over ``procurement_description`` and ``account`` (plus any
    pass-through columns)."""
    responder = _require(responder)
    store = store or ResponseStore(lines.sparkSession)
    lines = with_line_key(lines.drop(*ENRICHED))  # a column that the job makes is replaced
    run = EnrichRun(lines, materialize=materialize)
    passthrough = [c for c in lines.columns if c != KEY]
    key = KEY
    columns = {"procurement_description": "procurement_description_en", "account": "account_en"}
    df = _translate_narrow(lines, columns, "p1", settings, store, responder, run, key)

    def with_texts(df: DataFrame) -> DataFrame:
        return _in_english(df, columns, "p1").withColumn("input_text", T.combined_text(
            F.col("procurement_description_en"), T.strip_digits("account_en")))

    # the two texts of a line and their translations meet by the line's key, once here and once in the assembly
    df = with_texts(lines.select(key, *columns).join(df, key, "left"))
    df = _classify_lines(df, "p1", settings, F.col("input_text"), ~T.is_blank("input_text"),
                         F.coalesce(gate(P.naics_p1("naics_response"), settings.confidence_threshold, "naics")[1],
                                    F.lit(PR.MISSING_OBJECT)), store, responder, run, key)
    df = df.select("*", *gate(P.naics_p1("naics_response"), settings.confidence_threshold, "naics"))
    run.line_metrics["naics_p1"] = (F.col("naics_asked").cast("int"),
                                    (F.col("naics_confidence") >= settings.confidence_threshold).cast("int"))
    df = df.select("*", *gate(P.unspsc_p1("unspsc_response"), settings.unspsc_confidence_threshold,
                              "unspsc"))
    run.line_metrics["unspsc_p1"] = (F.col("unspsc_asked").cast("int"),
                                     (F.col("unspsc_confidence") >= settings.unspsc_confidence_threshold).cast("int"))
    # the results hold the translated texts only; all others are the lines' own
    run.lines = with_texts(lines.join(_finished(df, run), key, "left"))
    run.output_columns = passthrough + ENRICHED
    return run


def process(lines: DataFrame, settings: Settings = Settings(), store: ResponseStore | None = None,
            responder: Responder | None = None, materialize: str = "tables") -> EnrichRun:
    """Modular pipeline over ``description`` and ``account``: no blank guard, strict
    parsers, 8-digit product codes, no gates."""
    responder = _require(responder)
    store = store or ResponseStore(lines.sparkSession)
    lines = with_line_key(lines.drop(*PROCESSED))
    run = EnrichRun(lines, materialize=materialize)
    passthrough = [c for c in lines.columns if c != KEY]
    key = KEY
    columns = {"description": "description_en", "account": "account_en"}
    df = _translate_narrow(lines, columns, "p2", settings, store, responder, run, key)
    df = _in_english(lines.select(key, *columns).join(df, key, "left"), columns, "p2")
    df = _classify_lines(df, "p2", settings, F.coalesce(F.col("description_en"), F.lit(PR.MISSING_TEXT)), None,
                         F.coalesce(P.naics_p2("naics_response")["description"], F.lit(PR.MISSING_OBJECT)),
                         store, responder, run, key)
    df = df.withColumn("_n", P.naics_p2("naics_response")).select(
        "*", F.col("_n.code").alias("naics_code"), F.col("_n.description").alias("naics_description"),
        F.col("_n.confidence").alias("naics_confidence")).drop("_n")
    df = df.withColumn("_u", P.unspsc_p2("unspsc_response")).select(
        "*", F.col("_u.code").alias("unspsc_code"), F.col("_u.description").alias("unspsc_description"),
        F.col("_u.confidence").alias("unspsc_confidence")).drop("_u")
    run.lines = _in_english(lines.join(_finished(df, run), key, "left"), columns, "p2")
    run.output_columns = passthrough + PROCESSED
    return run


def _finished(df: DataFrame, run: EnrichRun) -> DataFrame:
    """The per-line results as the last boundary: assembly, quarantine and metrics only read it."""
    run.results = run.keep(df.drop(*[c for c in df.columns if c.endswith("_response")]), list(run.stages)[-1],
                           _line_counts(run, *[m for m in run.line_metrics if f"{m}__in" not in run.observed]))
    return run.results


def quarantine(run: EnrichRun, key: str = "ordinal") -> DataFrame:
    """One row per line and failed request: ``ordinal, stage, error``."""
    pairs = [F.struct(F.lit(stage).alias("stage"), F.col(col).alias("error"))
             for stage, col in run.error_columns.items()]
    return (run.lines.select(key, F.explode(F.array(*pairs)).alias("q"))
            .where(F.col("q.error").isNotNull())
            .select(key, "q.stage", "q.error"))


def stage_metrics(run: EnrichRun) -> DataFrame:
    """Per stage: line slots that asked it, distinct requests, answered, failed, line slots whose
    answer passed the gate (gated stages only), and the seconds of its boundary.

    A run over written boundaries has counted all this on the way; otherwise the stages are
    aggregated here, and the seconds are those of eager boundaries or null."""
    seconds = run.timings
    spark = run.lines.sparkSession
    if all(f"{s}__requests" in run.observed and f"{s}__in" in run.observed for s in run.stages):
        rows = [(s, *[run.observed[f"{s}__{c}"] for c in ("in", "requests", "answered", "failed", "accepted")], seconds.get(s)) for s in run.stages]
        return spark.createDataFrame(rows, "stage string, rows_in bigint, requests bigint, answered bigint, failed bigint, "
                                           "accepted bigint, seconds double")
    frames = []
    for stage, df in run.stages.items():
        frames.append(df.agg(F.count(F.lit(1)).alias("requests"),
                             F.count("response").alias("answered"),
                             F.count("error").alias("failed"))
                      .select(F.lit(stage).alias("stage"), "*"))
    per_request = frames[0]
    for f in frames[1:]:
        per_request = per_request.unionByName(f)
    # One pass over the lines for every stage's line counts, then one row per stage.
    aggs = []
    for stage, (rows_in, accepted) in run.line_metrics.items():
        aggs.append(F.sum(rows_in).cast("long").alias(f"{stage}__in"))
        aggs.append((F.sum(accepted).cast("long") if accepted is not None else F.lit(None).cast("long"))
                    .alias(f"{stage}__acc"))
    wide = run.lines.agg(*aggs)
    per_line = wide.select(F.explode(F.array(*[
        F.struct(F.lit(stage).alias("stage"), F.col(f"{stage}__in").alias("rows_in"),
                 F.col(f"{stage}__acc").alias("accepted")) for stage in run.line_metrics])).alias("m")
    ).select("m.*")
    timed = F.create_map(*[F.lit(x) for item in seconds.items() for x in item]) if seconds else F.lit(None).cast("map<string,double>")
    return per_line.join(per_request, "stage", "inner").select(
        "stage", "rows_in", "requests", "answered", "failed", "accepted", F.try_element_at(timed, F.col("stage")).alias("seconds"))


def stage_timings(run: EnrichRun) -> DataFrame:
    """Seconds per eager boundary and the same as ``H:MM:SS`` text."""
    spark = run.lines.sparkSession
    rows = [(i, name, float(sec)) for i, (name, sec) in enumerate(run.timings.items())]
    df = spark.createDataFrame(rows, "step int, boundary string, seconds double")
    return df.select("step", "boundary", "seconds", T.format_elapsed("seconds").alias("elapsed"))
