"""Enrich / process end to end: the JVM stand-in model and a Python model behind
``mapInPandas`` + a persisted response store give the same lines."""

import re

from pyspark.sql import functions as F

from spendcode.functions.text import NON_ENGLISH_CLASS
from spendcode.operators.replay import FAILURE_MODULUS, FAILURE_TEXT, INDUSTRIES, PRODUCTS, replay_responder
from spendcode.operators.responses import ResponseStore, pandas_responder
from spendcode.plans.enrich import Settings, enrich, quarantine, stage_metrics

from pyspark import cloudpickle
import sys
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINES = [(0, "Whole Earth límonaði", "2345 Matur á kaffistofu"),
         (1, "Office paper", "2346 Office supplies"),
         (2, "", ""),
         (3, None, "77"),
         (4, "Office paper", "2346 Office supplies"),
         (5, "   ", "Kaffi")]


def python_model(pdf):
    """The stand-in answer rule, re-written in Python (P1 stages)."""
    import pandas as pd
    out_r, out_e = [], []
    for stage, key, user in zip(pdf["stage"], pdf["request_key"], pdf["user"]):
        v = int(key[:8], 16)
        if v % FAILURE_MODULUS == 7:
            out_r.append(None), out_e.append(FAILURE_TEXT)
            continue
        kind = stage.rsplit("_", 1)[0]
        if kind == "detect":
            english = not re.search(NON_ENGLISH_CLASS, user.lower())
            r = ["True", " true\n", "TRUE"][v % 3] if english else "False"
        elif kind == "translate":
            r = re.sub(NON_ENGLISH_CLASS, "", user.lower())
        else:
            label = "NAICS" if kind == "naics" else "UNSPSC"
            code = str(100000 + v % 900000) if kind == "naics" else str(10000000 + v % 90000000)
            desc = (INDUSTRIES if kind == "naics" else PRODUCTS)[v % 8]
            conf = str(40 + (v // 7) % 61)
            shape = (v // 3) % 6
            head = f"{label} Code: {code}\n{label} Description: {desc}"
            r = head if shape == 4 else "I cannot classify this." if shape == 5 else f"{head}\nConfidence: {conf}%"
        out_r.append(r), out_e.append(None)
    return pd.DataFrame({"response": out_r, "error": out_e})


def lines(spark):
    return spark.createDataFrame(LINES, "ordinal long, procurement_description string, account string")


def test_python_model_through_store_equals_stand_in(spark, tmp_shared):
    a = enrich(lines(spark), responder=replay_responder).result()
    store = ResponseStore(spark, tmp_shared + "/responses")
    b = enrich(lines(spark), store=store, responder=pandas_responder(python_model, partitions=2)).result()
    ra = sorted(tuple(r) for r in a.collect())
    rb = sorted(tuple(r) for r in b.collect())
    assert ra == rb
    # the stored answers are reused: a third run over the same lines asks only what failed
    answered = store.load().where("response is not null").count()
    enrich(lines(spark), store=store, responder=pandas_responder(python_model)).result().collect()
    assert store.load().where("response is not null").count() == answered


def test_enrich_semantics(spark):
    run = enrich(lines(spark), Settings(confidence_threshold=0, unspsc_confidence_threshold=101), responder=replay_responder)
    got = {r["ordinal"]: r for r in run.result().collect()}
    # identical lines get identical answers (asked once)
    assert [got[1][c] for c in got[1].__fields__[1:]] == [got[4][c] for c in got[4].__fields__[1:]]
    # blank combined text: no request, defaults pass a threshold of 0 as nulls
    assert got[2]["input_text"] == " "
    assert (got[2]["naics_code"], got[2]["naics_confidence"]) == (None, 0)
    # a missing description is sent as the text 'nan'
    assert got[3]["procurement_description_en"] == "nan" and got[3]["account_en"] == "77"
    assert got[3]["input_text"] == "nan "
    # a threshold above 100 rejects every product
    assert all(r["unspsc_code"] == "" and r["unspsc_confidence"] == 0 for r in got.values())
    m = {r["stage"]: r for r in stage_metrics(run).collect()}
    assert m["detect_p1"]["requests"] == len({t for _, d, a in LINES for t in ((d or "nan"), a)})
    q = quarantine(run).collect()
    assert all(r["error"] == FAILURE_TEXT for r in q)


def test_line_keys_are_made_when_needed(spark):
    import pytest
    rows = [(0, "Paper", "1", "old"), (0, "Lamp", "2", "old"), (None, "Kaffi ó", "3", "old")]
    df = spark.createDataFrame(rows, "ordinal long, procurement_description string, account string, account_en string")
    got = enrich(df, responder=replay_responder).result().collect()
    assert len(got) == 3 and sorted(r["procurement_description"] for r in got) == ["Kaffi ó", "Lamp", "Paper"]
    assert {r["account_en"] for r in got} <= {"1", "2", "3"}  # the job's column replaces the line's
    with pytest.raises(ValueError, match="responder"):
        enrich(df)


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "naics_code" in df.columns


def test_process_keeps_missing_text_missing(spark):
    from spendcode.plans.enrich import process
    df = spark.createDataFrame([(0, None, "Office"), (1, "Paper", None)],
                               "ordinal long, description string, account string")
    got = {r["ordinal"]: r for r in process(df, responder=replay_responder).result().collect()}
    # 'nan' is English to the stand-in detector, so nothing is translated and null stays null
    assert got[0]["description_en"] is None and got[1]["account_en"] is None
    assert got[1]["description_en"] == "Paper"


def test_checkpoint_boundaries_give_same_lines(spark):
    a = sorted(map(tuple, enrich(lines(spark), responder=replay_responder).result().collect()))
    b = sorted(map(tuple, enrich(lines(spark), responder=replay_responder, materialize="checkpoint").result().collect()))
    assert a == b


def test_stage_timings_in_checkpoint_mode(spark):
    from spendcode.plans.enrich import stage_timings
    run = enrich(lines(spark), responder=replay_responder, materialize="checkpoint")
    t = stage_timings(run).collect()
    assert [r["boundary"] for r in t] == ["detect_p1", "translate_p1", "naics_p1", "unspsc_p1"]
    assert all(r["seconds"] >= 0 and r["elapsed"].count(":") == 2 for r in t)


def test_metrics_of_one_run_equal_those_of_recomputed_stages(spark):
    tables = enrich(lines(spark), responder=replay_responder)
    cached = enrich(lines(spark), responder=replay_responder, materialize="persist")
    a, b = (sorted(tuple(r)[:-1] for r in stage_metrics(run).collect()) for run in (tables, cached))
    assert a == b and len(a) == 4
    assert all(r["seconds"] > 0 for r in stage_metrics(tables).collect())
    assert all(r["seconds"] is None for r in stage_metrics(cached).collect())
    empty = enrich(lines(spark).limit(0), responder=replay_responder)
    assert {tuple(r)[1:5] for r in stage_metrics(empty).collect()} == {(0, 0, 0, 0)}


def test_written_boundaries_are_deleted_on_release(spark):
    import os
    run = enrich(lines(spark), responder=replay_responder)
    paths = [df.settled_at for df in run.persisted]
    assert len(paths) >= 5 and all(os.path.isdir(p) for p in paths)
    # the assembly reads the input and the results, nothing else
    plan = run.result()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 2 and "InMemoryTableScan" not in plan
    run.release()
    assert not any(os.path.isdir(p) for p in paths)


def test_boundaries_hold_each_text_of_a_line_twice_at_most(spark):
    import os
    import random
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20_000)), "Paper") for i in range(40)]
    df = spark.createDataFrame(rows, "ordinal long, procurement_description string, account string")
    run = enrich(df, responder=replay_responder)
    written = sum(os.path.getsize(os.path.join(p.settled_at, f)) for p in run.persisted for f in os.listdir(p.settled_at) if f.endswith(".parquet"))
    # English texts: the requests' boundary and the industry answers' hold them, nothing else does
    assert written < 2.5 * sum(len(t) for _, t, _ in rows)
    got = {r["ordinal"]: r for r in run.result().collect()}
    assert all(got[i]["procurement_description_en"] == t and got[i]["input_text"] == f"{t} Paper" for i, t, _ in rows)


def test_product_requests_that_two_industry_requests_share_are_asked_once(spark, tmp_shared):
    frame = "\n        NAICS Classification: X"
    df = spark.createDataFrame([(0, "Lamp", ""), (1, f"Lamp{frame}", "")], "ordinal long, procurement_description string, account string")

    def fixed(requests, stage):
        # the shorter text's industry is such that both product prompts are the same
        answer = {"detect_p1": F.lit("True"), "naics_p1": F.when(F.col("user").contains("NAICS Classification"), F.lit("NAICS Code: 111111\nNAICS Description: Y\nConfidence: 99%"))
                  .otherwise(F.lit("NAICS Code: 111111\nNAICS Description: X \n        NAICS Classification: Y\nConfidence: 99%"))}
        return requests.select("*", answer.get(stage, F.lit("none")).alias("response"), F.lit(None).cast("string").alias("error"))

    for store in (None, ResponseStore(spark, tmp_shared + "/shared")):
        run = enrich(df, responder=fixed, store=store)
        keys = [r["request_key"] for r in run.stages["unspsc_p1"].select("request_key").collect()]
        assert len(keys) == len(set(keys)) and run.result().count() == 2


def test_fuzzy_enrich_hands_its_run_to_the_caller(spark):
    from spendcode.plans.enrich import EnrichRun
    from spendcode.plans.fuzzy_enrich import fuzzy_enrich
    cat = spark.createDataFrame([(0, "c0", "Paper clips")], "ordinal long, code string, description string")
    for translated in (False, True):
        run = EnrichRun(lines(spark))
        out = fuzzy_enrich(lines(spark), cat, responder=replay_responder, run=run, translated=translated)
        assert out.count() == len(LINES) and run.persisted and ("account_en" in out.columns) is translated
        run.release()
        assert not run.persisted
