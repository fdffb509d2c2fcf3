"""Catalogue-matching variant of the enrich job.

The industry code comes from the model and is gated by its threshold; the product is
the catalogue entry that best matches the model's product *description* of the line
(token-sort score, which is also reported as the product confidence).  Product columns
are filled exactly when the industry columns are.  With ``translated`` both texts are put into
English first, the English description is what is classified and described, and both English
texts are returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendcode.functions import parsers as P
from spendcode.functions import prompts as PR
from spendcode.functions.text import is_blank
from spendcode.operators.gates import gate
from spendcode.operators.match import attach_best_match
from spendcode.operators.responses import ResponseStore, Responder
from spendcode.plans.enrich import EnrichRun, Settings, _classify_stages, _require, translate


def fuzzy_enrich(lines: DataFrame, catalogue: DataFrame, settings: Settings = Settings(),
                 store: ResponseStore | None = None, responder: Responder | None = None,
                 translated: bool = False, run: EnrichRun | None = None) -> DataFrame:
    """The coded lines.  A caller that passes ``run`` can read its boundaries' seconds and ``release`` them."""
    responder = _require(responder)
    store = store or ResponseStore(lines.sparkSession)
    run = run or EnrichRun(lines)
    english, source = [], "procurement_description"
    if translated:
        first = translate(lines, settings, store, responder, run.materialize)
        run.persisted += first.persisted
        run.timings.update(first.timings)
        lines, english = first.result(), ["procurement_description_en", "account_en"]
        source = english[0]
    text = F.coalesce(F.col(source), F.lit(PR.MISSING_TEXT))
    guard = ~is_blank(source)
    # both requests depend only on the line text: one stage boundary for the two stages
    df = _classify_stages(lines, [("p1", "naics", settings.classification_model, guard, {"text": text}),
                                  ("p1", "describe", settings.unspsc_model, guard, {"text": text})],
                          store, responder, run)
    df = df.select("*", *gate(P.naics_p1("naics_response"), settings.confidence_threshold, "naics"))
    df = df.withColumn("product_text", P.unspsc_describe("describe_response"))
    df = attach_best_match(df, "product_text", catalogue, scorer="token_sort", prefix="m")
    filled = F.col("naics_confidence") >= F.lit(settings.confidence_threshold)
    return df.select(
        "ordinal", *english, "naics_code", "naics_description", "naics_confidence",
        F.when(filled, F.col("m_code")).otherwise(F.lit("")).alias("unspsc_code"),
        F.when(filled, F.col("m_description")).otherwise(F.lit("")).alias("unspsc_description"),
        F.when(filled, F.col("m_score")).otherwise(F.lit(0)).alias("unspsc_confidence"))
