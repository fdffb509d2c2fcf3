"""The pipeline and its stages on planted cases."""

import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, docs, SF), f"test-{name}")
        if name != "packing":
            assert docs.dtypes == before.dtypes
            ids = [r[0] for r in docs.select("doc_id").collect()]
            assert len(ids) == len(set(ids)) and 0.5 * n < len(ids) <= before.count()
    packed = docs.select("doc_id").distinct().count()
    assert packed == before.count()
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "packing"]


def test_near_dedup_keeps_one_of_each_group(spark):
    rng = random.Random(1)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
    base = [text() for _ in range(5)]
    rows = [(i, base[i % 5]) for i in range(20)] + [(100, base[0].upper()), (101, text()), (101, None), (None, base[1]), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == [0, 1, 2, 3, 4, 101]
    assert sum(r["doc_id"] is None for r in got) == 2


def test_near_dedup_judges_each_row_of_an_id(spark):
    rng = random.Random(2)
    a, b, c, d = (" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(4))
    rows = [(1, a), (7, a.upper()), (7, b), (8, c), (8, d), (8, d), (9, b), (None, c), (None, c.upper()), (None, c), (0, d + " ")]
    make = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                                              "doc_id bigint, text string, lang string, source string, n_chars bigint")
    runs = [sorted((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.near_dedup(spark, make(order), SF).collect())
            for order in (rows, rows[::-1])]
    assert runs[0] == runs[1]
    assert [(i, t.strip().lower()) for i, t in runs[0]] == sorted([("0", d), ("1", a), ("7", b), ("8", c), ("None", c)])


def test_columns_named_like_outputs_keep_their_values(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 0").selectExpr(
        "*", "concat('s', doc_id) AS Score", "concat('p', doc_id) AS predicted", "concat('l', doc_id) AS lines_removed")
    for stage in (corpus_pipeline.quality, corpus_pipeline.line_dedup):
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes
        rows = out.collect()
        assert rows and all((r["Score"], r["predicted"], r["lines_removed"]) == tuple(f"{x}{r['doc_id']}" for x in "spl") for r in rows)


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if "text" in out.columns else docs
