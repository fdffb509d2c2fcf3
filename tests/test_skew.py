"""Joins with hot keys: same rows as a plain join, and even tasks."""

import statistics

from pyspark.sql import functions as F

from spendcode.operators.skew import spread_join


def tables(spark, n=20_000):
    # nine of ten lines carry one account, some carry none, the rest are spread
    left = spark.range(n).select(F.col("id").alias("line"), F.when(F.col("id") % 10 < 9, F.lit("hot")).when(F.col("id") % 50 == 19, F.lit(None))
                                 .otherwise(F.concat(F.lit("a"), (F.col("id") % 997).cast("string"))).alias("account"))
    right = left.where("account is not null and account <> 'a19'").select("account").distinct().withColumn("answer", F.upper("account"))
    return left, right


def test_rows_equal_a_plain_join(spark):
    left, right = tables(spark)
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right, "account", how).select("line", "account", "answer").collect()))
        for heavy in (100, 500, 10**9):
            got = spread_join(left, right, "account", "line", how, heavy=heavy)
            assert got.columns == ["account", "line", "answer"]
            assert sorted(map(str, got.select("line", "account", "answer").collect())) == want, (how, heavy)


def test_no_task_gets_the_hot_account(spark):
    left, right = tables(spark)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "20"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        def sizes(df):
            return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        plain = sizes(left.join(right, "account", "inner"))
        spread = sizes(spread_join(left, right, "account", "line", "left", heavy=100))
        assert max(plain) > 15_000
        assert sum(spread) == 20_000 and len(spread) == 20 and max(spread) < 3 * statistics.median(spread)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_enrich_with_a_hot_account(spark, monkeypatch):
    from spendcode.operators import skew
    from spendcode.operators.replay import replay_responder
    from spendcode.plans.enrich import enrich
    rows = [(i, f"Paper {i % 37}", "9 Kaffistofa ó" if i % 10 else f"{i} Office") for i in range(400)] + [(900, None, None)]
    lines = spark.createDataFrame(rows, "ordinal long, procurement_description string, account string")
    want = sorted(map(str, enrich(lines, responder=replay_responder).result().collect()))
    monkeypatch.setattr(skew, "HEAVY", 20)
    assert sorted(map(str, enrich(lines, responder=replay_responder).result().collect())) == want
