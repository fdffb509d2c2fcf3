"""Response store: distinct requests only, nothing asked twice, failures isolated."""

import pytest
from pyspark.sql import functions as F

from spendcode.operators.responses import ResponseStore, pandas_responder, request_columns


from pyspark import cloudpickle
import sys
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def counting_responder(spark, fail_on=None):
    acc = spark.sparkContext.accumulator(0)

    def call(pdf):
        import pandas as pd
        acc.add(len(pdf))
        if fail_on is not None and pdf["user"].str.contains(fail_on).any():
            raise RuntimeError("model unavailable")
        return pd.DataFrame({"response": ["True"] * len(pdf), "error": [None] * len(pdf)})

    return pandas_responder(call, partitions=2), acc


def requests(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return df.select(*request_columns("p1", "detect", "classifier", text=F.col("t")))


def test_distinct_and_exactly_once(spark, tmp_shared):
    store = ResponseStore(spark, tmp_shared + "/store")
    responder, calls = counting_responder(spark)
    got = store.resolve(requests(spark, ["a", "b", "a", "a"]), responder, "detect_p1").collect()
    assert calls.value == 2 and len(got) == 2
    # second run: everything is in the store, the model is not asked again
    again = store.resolve(requests(spark, ["a", "b", "c"]), responder, "detect_p1").collect()
    assert calls.value == 3 and len(again) == 3
    assert store.load("detect_p1").count() == 3


def test_failures_are_rows_not_job_failures(spark, tmp_shared):
    store = ResponseStore(spark, tmp_shared + "/store")
    responder, _ = counting_responder(spark, fail_on="boom")
    got = store.resolve(requests(spark, ["boom"]), responder, "detect_p1").collect()
    assert got[0]["response"] is None and "model unavailable" in got[0]["error"]


def test_failures_are_asked_again_and_isolated(spark, tmp_shared):
    store = ResponseStore(spark, tmp_shared + "/store")
    down, _ = counting_responder(spark, fail_on="")
    failed = store.resolve(requests(spark, list("abcde")), down, "detect_p1").collect()
    assert all(r["response"] is None for r in failed)
    one_bad, _ = counting_responder(spark, fail_on="c")
    got = {r["user"]: r["response"] for r in store.resolve(requests(spark, list("abcde")), one_bad, "detect_p1").collect()}
    assert got == {"a": "True", "b": "True", "c": None, "d": "True", "e": "True"}
    healthy, calls = counting_responder(spark)
    got = store.resolve(requests(spark, list("abcde")), healthy, "detect_p1").collect()
    assert calls.value == 1 and all(r["response"] == "True" and r["error"] is None for r in got)


def test_request_key_depends_on_model_and_prompt(spark):
    df = spark.createDataFrame([("x",)], "t string")
    k1 = df.select(request_columns("p1", "detect", "m1", text=F.col("t"))[1]).first()[0]
    k2 = df.select(request_columns("p1", "detect", "m2", text=F.col("t"))[1]).first()[0]
    k3 = df.select(request_columns("p1", "translate", "m1", text=F.col("t"))[1]).first()[0]
    assert len({k1, k2, k3}) == 3


def test_prompt_rendering(spark):
    from spendcode.functions import prompts as PR
    from spendcode.operators.responses import render
    df = spark.createDataFrame([("lamp", "Lighting")], "d string, n string")
    got = df.select(render(PR.P1_UNSPSC_USER, description=F.col("d"), naics=F.col("n"))).first()[0]
    assert got == PR.P1_UNSPSC_USER.format(description="lamp", naics="Lighting")


def test_model_client_requires_a_store_path(spark):
    responder, _ = counting_responder(spark)
    with pytest.raises(ValueError, match="ResponseStore with a path"):
        ResponseStore(spark).resolve(requests(spark, ["a"]), responder, "detect_p1")


def test_stored_answers_are_not_shuffled_and_compaction_keeps_them(spark, tmp_shared):
    store = ResponseStore(spark, tmp_shared + "/store", buckets=4)
    down, _ = counting_responder(spark, fail_on="c")
    for texts in ("abc", "bcdef", "cgh"):
        store.resolve(requests(spark, texts), down, "detect_p1").collect()
    assert store.load("detect_p1").count() == 10  # the failed one three times
    again = ResponseStore(spark, tmp_shared + "/store")  # the folder knows its buckets
    healthy, calls = counting_responder(spark)
    again.resolve(requests(spark, "abcdefghi"), healthy, "detect_p1").collect()
    assert calls.value == 2 and again.buckets == 4
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        known = again.load("detect_p1").where("response is not null").select("request_key").distinct()
        asked = requests(spark, "xyz").repartition(4, "request_key")
        for plan in (asked.join(known, "request_key", "left_anti"), asked.join(again.answers("detect_p1"), "request_key")):
            text = plan._jdf.queryExecution().executedPlan().toString()
            # one exchange, that of the requests: the store is read where it lies
            assert text.count("Exchange hashpartitioning(request_key") == 1 and "Bucketed: true" in text, text
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    before = sorted(map(tuple, again.answers("detect_p1").collect()))
    again.compact("detect_p1")
    assert sorted(map(tuple, again.answers("detect_p1").collect())) == before
    assert again.load("detect_p1").count() == 9
    import os
    files = [f for f in os.listdir(tmp_shared + "/store/detect_p1/v000001") if f.startswith("part-")]
    assert 0 < len(files) <= 4 and not os.path.isdir(tmp_shared + "/store/detect_p1/v000000")
    fresh, calls = counting_responder(spark)
    assert ResponseStore(spark, tmp_shared + "/store").resolve(requests(spark, "ai"), fresh, "detect_p1").count() == 2 and calls.value == 0


def test_a_version_without_its_mark_does_not_count(spark, tmp_shared):
    import os
    store = ResponseStore(spark, tmp_shared + "/store", buckets=2)
    responder, calls = counting_responder(spark)
    store.resolve(requests(spark, "ab"), responder, "detect_p1").collect()
    os.makedirs(tmp_shared + "/store/detect_p1/v000001")  # a compaction that died
    store.resolve(requests(spark, "abc"), responder, "detect_p1").collect()
    assert calls.value == 3 and store.load().count() == 3


def test_constants_and_derived_columns_join_the_distinct_requests(spark, tmp_shared):
    from spendcode.operators.replay import replay_responder
    from spendcode.operators.responses import request_constants, slot_text
    df = spark.createDataFrame([("a",), ("b",), ("a",), ("c d",)], "t string")
    columns = request_columns("p2", "detect", "m", text=F.col("t"))
    whole = sorted(map(tuple, ResponseStore(spark).resolve(df.select(*columns, F.col("t").alias("payload")), replay_responder, "detect_p2", ("payload",)).collect()))
    for store in (ResponseStore(spark), ResponseStore(spark, tmp_shared + "/store")):
        for _ in range(2):
            got = store.resolve(df.select(columns[1], columns[-1]), replay_responder, "detect_p2", constants=request_constants("p2", "detect", "m"),
                                derived={"payload": slot_text("p2", "detect", F.col("user"))})
            assert sorted(map(tuple, got.collect())) == whole and len(whole) == 3
