import os

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def test_incremental_enrich_matches_batch(spark, tmp_shared):
    from spendcode.operators.replay import replay_responder
    from spendcode.plans.enrich import enrich
    from spendcode.sources.tables import lines_from_documents
    from spendcode.streaming.incremental import start_incremental_enrich
    src = tmp_shared + "/incoming"
    lines = lines_from_documents(spark, SF_SMALL)
    lines.where(F.col("ordinal") % 2 == 0).write.parquet(src + "/f1")
    q = start_incremental_enrich(spark, src + "/*", tmp_shared + "/out", tmp_shared + "/store", name="t1", responder=replay_responder)
    q.awaitTermination(300)
    lines.where(F.col("ordinal") % 2 == 1).write.parquet(src + "/f2")
    q = start_incremental_enrich(spark, src + "/*", tmp_shared + "/out", tmp_shared + "/store", name="t1", responder=replay_responder)
    q.awaitTermination(300)
    got = spark.read.parquet(tmp_shared + "/out").drop("batch_id")
    want = enrich(lines, responder=replay_responder).result()
    assert got.count() == lines.count()
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_clean_and_embed_jobs(spark, tmp_path, tmp_shared):
    from spendcode.operators.vectors import VectorTable
    from spendcode.plans.catalog_job import clean_catalogue_job, embed_catalogue_job
    src = str(tmp_path / "cat")
    os.makedirs(src)
    with open(src + "/c.csv", "w", encoding="utf-8") as f:
        f.write('code,description\n51142018.0,"The Acme, Inc."\n10.05,Acme\nabc,"Ab  mjólk (1L)"\n,\n7,\n')
    res = clean_catalogue_job(spark, src, tmp_shared + "/clean")
    rows = sorted((r["description"], r["code"]) for r in res.cleaned.collect())
    assert rows == [("", None), ("ab mjólk 1l", None), ("acme", 51142018.0)]
    assert tuple(res.stats.first()) == (5, 3, 3)
    path = embed_catalogue_job(spark, src, VectorTable(spark, tmp_shared + "/vec"))
    recs = {r["id"]: r for r in spark.read.parquet(path).collect()}
    assert set(recs) == {"51142018", "105", "abc"} and len(recs["105"]["vector"]) == 384
    assert recs["105"]["metadata"]["description"] == "Acme"


def test_clean_job_csv_output(spark, tmp_path, tmp_shared):
    import glob
    from spendcode.plans.catalog_job import clean_catalogue_job
    src = str(tmp_path / "cat2")
    os.makedirs(src)
    with open(src + "/c.csv", "w", encoding="utf-8") as f:
        f.write('code,description\n51142018.0,"Foo, ""Bar"" Inc."\n6,foo  bar\n7,Zed\n,\n')
    clean_catalogue_job(spark, src, tmp_shared + "/clean_csv", output_format="csv")
    text = "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(tmp_shared + "/clean_csv/*.csv")))
    assert text.splitlines()[0] == "code,description"
    assert sorted(text.splitlines()[1:]) == [",", "51142018.0,foo bar", "7.0,zed"]


def test_injected_encoder(spark):
    from pyspark import cloudpickle
    import sys
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    from spendcode.operators.vectors import embed
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id int, t string")

    def encoder(texts):
        return [[float(len(t)), 1.0] for t in texts]

    got = {r["id"]: r["vector"] for r in embed(df, "t", encoder=encoder, dimension=2).collect()}
    assert got == {1: [2.0, 1.0], 2: [0.0, 1.0]}
