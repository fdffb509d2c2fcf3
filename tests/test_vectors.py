import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF_CHECK


def test_topk_equals_brute_force_with_chunks(spark):
    from spendcode.operators.vectors import nearest
    e = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet")
    rows = e.select("vec_id", "embedding").collect()
    ids = np.array([r[0] for r in rows])
    m = np.array([r[1] for r in rows], dtype=np.float64)
    u = m / np.linalg.norm(m, axis=1)[:, None]
    sims = u @ u.T
    want = {}
    for i, pid in enumerate(ids):
        order = sorted(range(len(ids)), key=lambda j: (-sims[i, j], ids[j]))[:3]
        want[pid] = [int(ids[j]) for j in order]
    probes = e.select(F.col("vec_id").alias("probe_id"), F.col("embedding").alias("vector"))
    index = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    for max_rows in (10**6, 97):
        got = {}
        for r in nearest(probes, index, k=3, max_rows=max_rows).orderBy("probe_id", "rank").collect():
            got.setdefault(r["probe_id"], []).append(r["id"])
        assert got == want


def test_upsert_latest_wins(spark):
    from spendcode.operators.vectors import upsert, vector_records
    old = spark.createDataFrame([("a", [1.0], "old a", 1), ("b", [2.0], "old b", 2)], "id string, v array<double>, d string, s long")
    new = spark.createDataFrame([("b", [3.0], "new b1", 3), ("b", [4.0], "new b2", 5), ("c", [5.0], "c", 4)],
                                "id string, v array<double>, d string, s long")
    merged = upsert(vector_records(old, "id", "v", "d", "s"), vector_records(new, "id", "v", "d", "s"))
    got = {r["id"]: (r["vector"][0], r["metadata"]["description"]) for r in merged.collect()}
    assert got == {"a": (1.0, "old a"), "b": (4.0, "new b2"), "c": (5.0, "c")}


def test_vector_table_dimension_and_versions(spark, tmp_shared):
    import pytest
    from spendcode.operators.vectors import VectorTable, vector_records
    t = VectorTable(spark, tmp_shared + "/vectors", dimension=2)
    batch = vector_records(spark.createDataFrame([("x", [1.0, 2.0], "d", 1)], "id string, v array<double>, d string, s long"),
                           "id", "v", "d", "s")
    path = t.upsert(batch)
    assert spark.read.parquet(path).count() == 1
    bad = vector_records(spark.createDataFrame([("y", [1.0], "d", 2)], "id string, v array<double>, d string, s long"),
                         "id", "v", "d", "s")
    with pytest.raises(Exception):
        t.upsert(bad)
    # the failed upsert changed nothing; later ones build on the version before
    record = lambda i, v, s: vector_records(spark.createDataFrame([(i, v, "d", s)], "id string, v array<double>, d string, s long"),
                                            "id", "v", "d", "s")
    t.upsert(record("abc3", [0.0, 1.0], 3))
    t.upsert(record("x", [1.0, 0.0], 4))
    again = VectorTable(spark, tmp_shared + "/vectors", dimension=2)
    assert {r["id"]: r["vector"] for r in again.read().collect()} == {"x": [1.0, 0.0], "abc3": [0.0, 1.0]}
    from spendcode.operators.vectors import nearest
    probes = spark.createDataFrame([(1, [0.0, 2.0]), (2, None)], "probe_id long, vector array<float>")
    got = nearest(probes, again.read(), k=1).collect()
    assert [(r["probe_id"], r["id"], r["similarity"]) for r in got] == [(1, "abc3", 1.0)]
    assert nearest(probes, again.read().limit(0), k=1).count() == 0
    with pytest.raises(ValueError):
        VectorTable(spark, tmp_shared + "/vectors", dimension=3)


def test_small_dimensions_keep_every_token(spark):
    from spendcode.functions.vectors import hash_embedding
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(50)),)], "t string")
    for dimension in (8, 64, 384, 1000):
        v = df.select(hash_embedding("t", dimension)).first()[0]
        assert len(v) == dimension and abs(sum(x * x for x in v) - 1.0) < 1e-12


def test_hash_embedding_is_unit_length(spark):
    from spendcode.functions.vectors import hash_embedding
    df = spark.createDataFrame([("alpha beta beta",), ("",)], "t string")
    v = [r[0] for r in df.select(hash_embedding("t")).collect()]
    assert abs(sum(x * x for x in v[0]) - 1.0) < 1e-12 and sum(v[1]) == 0
    assert sorted(x for x in v[0] if x)[-1] > sorted(x for x in v[0] if x)[0]  # beta counted twice


def records(spark, rows):
    from spendcode.operators.vectors import vector_records
    return vector_records(spark.createDataFrame(rows, "id string, v array<double>, d string, s long"), "id", "v", "d", "s")


def test_upsert_rewrites_touched_buckets_only(spark, tmp_shared):
    import os
    import pytest
    from spendcode.operators.vectors import VectorTable
    t = VectorTable(spark, tmp_shared + "/vectors", dimension=1, buckets=8)
    t.upsert(records(spark, [(f"i{n}", [float(n)], "old", n) for n in range(200)] + [(None, [7.0], "none", 1)]))
    before = t.manifest()
    assert len(before) == 8
    t.upsert(records(spark, [("i5", [500.0], "new", 1), ("fresh", [1.0], "new", 2)]))
    after = t.manifest()
    assert 0 < sum(before[b] != after[b] for b in before) <= 2
    got = {r["id"]: r["vector"][0] for r in t.read().collect()}
    assert len(got) == 202 and got["i5"] == 500.0 and got["i6"] == 6.0 and got["fresh"] == 1.0
    assert t.read(1).count() == 201 and t.versions() == [1, 2]
    # a second writer that saw the first state cannot commit over the second
    with pytest.raises(RuntimeError, match="another upsert"):
        t._commit(before, 2)
    assert t.manifest() == after
    # upserts that died leave files that no manifest names
    os.makedirs(tmp_shared + "/vectors/data/00000003-dead")
    t.vacuum()
    assert t.versions() == [2] and t.read().count() == 202 and not os.path.exists(tmp_shared + "/vectors/data/00000003-dead")
    t.upsert(records(spark, []))
    assert t.versions() == [2, 3] and t.read().count() == 202


def test_encoder_is_built_once_a_worker(spark, tmp_path):
    import os
    import sys
    from pyspark import cloudpickle
    from spendcode.operators.vectors import embed
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    log = str(tmp_path)

    def factory():
        with open(f"{log}/{os.getpid()}", "a") as f:
            f.write("x")
        return lambda texts: [[float(len(t)), 1.0, 2.0] for t in texts]

    df = spark.range(4000).selectExpr("id", "IF(id % 7 = 0, NULL, repeat('a', int(id % 5))) AS t").repartition(40)
    got = embed(df, "t", factory=factory, dimension=3).collect()
    assert len(got) == 4000 and all(r["vector"] == [float(len(r["t"] or "")), 1.0, 2.0] for r in got)
    builds = [open(f"{log}/{f}").read() for f in os.listdir(log)]
    assert builds and all(b == "x" for b in builds)  # 40 tasks, one build in each worker process
    import pytest
    with pytest.raises(Exception, match="dimension"):
        embed(df, "t", factory=factory, dimension=4).collect()


def brute_nearest(probes, index, k):
    """All similarities, unrounded: vectors of one direction but other lengths may differ in the last bits."""
    unit = lambda rows: (lambda m: m / np.linalg.norm(m, axis=1)[:, None])(np.array(rows, dtype=np.float64))
    index = [(i, v) for i, v in index if i is not None and v is not None and any(v)]
    probes = [(i, v) for i, v in probes if v is not None and any(v)]
    ids, vectors = np.array([i for i, _ in index]), unit([v for _, v in index])
    out = []
    for (pid, _), p in zip(probes, unit([v for _, v in probes])):
        s = (vectors * p).sum(axis=1)
        out += [(pid, r + 1, int(ids[j]), round(float(s[j]), 9)) for r, j in enumerate(np.lexsort((ids, -s))[:k])]
    return sorted(out)


def test_search_over_blocks_equals_brute_force(spark, monkeypatch):
    import spendcode.operators.vectors as V
    monkeypatch.setattr(V, "SLICE_PROBES", 7)
    rng = np.random.default_rng(3)
    index = [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(150)] + [(None, [1.0, 0.0, 0.0]), (900, None), (901, [0.0, 0.0, 0.0])]
    index += [(500 + i, [1.0, 1.0, 0.0]) for i in range(30)]  # many equal vectors: ties by id
    probes = [(i % 20, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(25)] + [(77, None), (78, [0.0] * 3), (79, [2.0, 2.0, 0.0])]
    a = spark.createDataFrame(probes, "probe_id long, vector array<float>")
    b = spark.createDataFrame(index, "id long, vector array<float>")
    for rows, pivots, k in ((V.PART_ROWS, None, 4), (3, 9, 4), (20, 1, 1), (5, 40, 400)):
        got = sorted((r["probe_id"], r["rank"], r["id"], round(r["similarity"], 9)) for r in V.nearest(a, b, k=k, max_rows=rows, pivots=pivots).collect())
        assert got == brute_nearest(probes, index, k), (rows, pivots, k)


def test_search_in_clusters_visits_few_blocks(spark, monkeypatch):
    import spendcode.operators.vectors as V
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    points = [(i, (centres[i % 20] + rng.normal(scale=0.05, size=16)).tolist()) for i in range(2000)]
    seen, settle = [], V.settle
    monkeypatch.setattr(V, "settle", lambda df, name: (seen.append(settle(df, name)) or seen[-1]) if name == "nearest-pairs" else settle(df, name))
    index = spark.createDataFrame(points, "id long, vector array<double>")
    probes = spark.createDataFrame(points[:200], "probe_id long, vector array<double>")
    got = V.nearest(probes, index, k=5, pivots=40).collect()
    assert sorted((r["probe_id"], r["rank"], r["id"], round(r["similarity"], 9)) for r in got) == brute_nearest(points[:200], points, 5)
    visits = sum(p.count() for p in seen)
    assert visits <= 0.2 * 200 * 40, visits


def test_the_search_sends_no_probes_or_pairs_through_the_driver(spark):
    from spendcode.operators.vectors import nearest
    rows = [(i, [float(i % 7 + 1), float(i % 3), 1.0]) for i in range(400)]
    found = nearest(spark.createDataFrame(rows, "probe_id long, vector array<double>"),
                    spark.createDataFrame(rows, "id long, vector array<double>"), k=3, max_rows=50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # small files are no reason: what they hold may be large in memory; only the table of blocks and parts is sent
    assert plan.count("BroadcastHashJoin") == plan.count("BroadcastHashJoin [block#") and "SortMergeJoin [probe#" in plan, plan
    assert found.count() == 3 * 400


def settled_by(V, monkeypatch):
    """The tables that a search writes, by name; they stay, so that a test can count them."""
    seen, settle = {}, V.settle

    def kept(df, name):
        seen[name] = settle(df, name)
        return seen[name]

    monkeypatch.setattr(V, "settle", kept)
    monkeypatch.setattr(V, "forget", lambda *tables: None, raising=False)
    return seen


def test_what_the_search_writes_grows_with_the_input_not_with_its_pairs(spark, monkeypatch):
    import spendcode.operators.vectors as V
    rng = np.random.default_rng(5)
    points = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 16)).astype(np.float32))]
    seen = settled_by(V, monkeypatch)
    index = spark.createDataFrame(points, "id long, vector array<float>")
    probes = spark.createDataFrame(points, "probe_id long, vector array<float>")
    got = V.nearest(probes, index, k=5, pivots=30)
    assert sorted((r["probe_id"], r["rank"], r["id"], round(r["similarity"], 9)) for r in got.collect()) == brute_nearest(points, points, 5)
    # vectors without clusters: a row for each probe and block would be 45,000
    rows = {name: table.count() for name, table in seen.items()}
    assert sum(rows.values()) <= 2 * 1500 + 5 * 1500 + 3 * 100, rows
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "FlatMapCoGroups" not in plan, plan  # the scores are made once, before


def test_search_over_ranges_and_tiles_equals_brute_force(spark, monkeypatch):
    import spendcode.operators.vectors as V
    for name, value in (("RANGE_BYTES", 2000), ("TILE_CELLS", 50), ("BLOCK_CELLS", 64), ("PLACE_ROWS", 16), ("SLICE_PROBES", 20), ("PAIRS_A_BATCH", 2)):
        monkeypatch.setattr(V, name, value, raising=False)
    rng = np.random.default_rng(6)
    vectors = rng.integers(-3, 4, (400, 8)).astype(float)
    index = [(i % 390, v.tolist()) for i, v in enumerate(vectors)]  # ten ids come twice
    index += [(1000 - i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]) for i in range(60)] + [(7, [3.0] * 8)] * 6
    odd = [(2000, [float("nan")] + [1.0] * 7), (2001, [None] + [1.0] * 7), (2002, [float("inf")] + [1.0] * 7)]
    probes = [(i, v.tolist()) for i, v in enumerate(vectors[:60])] + [(900, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]), (901, [1.0] * 8)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for kind in ("float", "double"):
        found = V.nearest(spark.createDataFrame(probes + odd, f"probe_id long, vector array<{kind}>"),
                          spark.createDataFrame(index + odd, "id long, vector array<float>"), k=4, max_rows=25, pivots=12)
        assert sorted((r["probe_id"], r["rank"], r["id"], round(r["similarity"], 9)) for r in found.collect()) == brute_nearest(probes, index, 4)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    named = V.nearest(spark.createDataFrame([(None, [1.0, 2.0] + [0.0] * 5 + [1.0])], "probe_id int, vector array<double>"),
                      spark.createDataFrame([(str(i), v) for i, v in index], "id string, vector array<double>"), k=3, pivots=12)
    assert [(r["probe_id"], r["rank"], r["id"]) for r in named.orderBy("rank").collect()] == [(None, 1, "1000"), (None, 2, "941"), (None, 3, "942")]


def test_slices_in_clusters_visit_few_blocks(spark, monkeypatch):
    import spendcode.operators.vectors as V
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    points = [(i, (centres[i % 20] + rng.normal(scale=0.05, size=16)).tolist()) for i in range(2000)]
    seen = settled_by(V, monkeypatch)
    index = spark.createDataFrame(points, "id long, vector array<double>")
    probes = spark.createDataFrame(points[:200], "probe_id long, vector array<double>")
    got = V.nearest(probes, index, k=5, pivots=40).collect()
    assert sorted((r["probe_id"], r["rank"], r["id"], round(r["similarity"], 9)) for r in got) == brute_nearest(points[:200], points, 5)
    visits = seen["nearest-pairs"].agg(F.count(F.lit(1)), F.sum(F.size("visits")), F.max(F.size("visits"))).first()
    assert 10 <= visits[0] <= 40 and visits[1] <= 0.2 * visits[0] * 40, visits
