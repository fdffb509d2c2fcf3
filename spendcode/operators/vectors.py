"""Vector table: records, latest-wins upsert, exact top-k cosine search.

The reference pushes ``(code, vector, {"description": ...})`` records to a hosted index
(cosine metric) in batches of 100 and never queries it.  Here the index is a *vector
table*: Parquet files in buckets by id under a manifest.  An upsert merges and rewrites only
the buckets that its batch falls into.  The read side is an exact top-k search over blocks.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendcode.functions.vectors import DIMENSION, hash_embedding
from spendcode.operators.boundary import few_a_batch, forget, release, settle
from spendcode.session import ship_package

PIVOTS = 1024        # blocks of the search, at most
PART_ROWS = 4096     # vectors of one part of a block, on average at most
SLICE_PROBES = 4096  # probes of one slice of a block, on average at most
RANGE_BYTES = 128 * 1024 * 1024  # parts that one task reads, about
PAIRS_A_BATCH = 8    # pairs of a slice and a part that go to Python at a time, some MB each
TILE_CELLS = 1_000_000   # similarities at a time inside a task (4 MB, single precision)
PLACE_ROWS = 2048    # vectors held against all pivots at a time
BLOCK_CELLS = 4_000_000  # vector components at a time inside a task (32 MB of doubles)
SLACK = 1e-9         # bounds and products are floating point
ANGLE_SLACK = 1e-7   # near 0 an angle is known to half the digits of its cosine

RECORD_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("seq", T.LongType()),
])


def vector_records(df: DataFrame, id_col: str, vector_col: str, description_col: str,
                   order_col: str) -> DataFrame:
    """``id, vector, metadata{description}, seq`` (``seq`` orders writes of one id)."""
    return df.select(F.col(id_col).cast("string").alias("id"),
                     F.col(vector_col).cast("array<float>").alias("vector"),
                     F.create_map(F.lit("description"), F.col(description_col).cast("string"))
                     .alias("metadata"),
                     F.col(order_col).cast("long").alias("seq"))


def latest_per_id(records: DataFrame) -> DataFrame:
    """The last write of each id (an upsert overwrites earlier writes of the same id)."""
    last = F.max_by(F.struct("vector", "metadata", "seq"), F.coalesce("seq", F.lit(-(1 << 63))))
    return records.groupBy("id").agg(last.alias("r")).select("id", "r.*")


def upsert(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Merge ``batch`` into ``existing``: rows whose id is written again are replaced."""
    new = latest_per_id(batch)
    kept = latest_per_id(existing).join(new.select("id"), "id", "left_anti")
    return kept.unionByName(new)


def check_dimension(records: DataFrame, dimension: int) -> DataFrame:
    """Keep the table's declared dimension: rows of another size raise at write time."""
    bad = F.size("vector") != F.lit(dimension)
    return records.withColumn(
        "vector", F.when(bad, F.raise_error(F.concat(F.lit("vector dimension != "), F.lit(str(dimension)))))
        .otherwise(F.col("vector")))


class VectorTable:
    """A vector table: create if absent, upsert, read the last committed state.

    ``path`` holds ``meta`` (name, dimension, metric, buckets), ``data`` with a folder for each upsert
    and ``manifest`` with a file for each committed state, which says for every bucket of ids in which
    folder its rows lie.  An upsert reads and writes the buckets of its batch only and commits by
    creating the next manifest, one file, under a name that must not exist yet: a job that fails before
    leaves the state as it was, and of two that commit at once one raises.
    """

    def __init__(self, spark: SparkSession, path: str, dimension: int = DIMENSION, name: str = "catalogue",
                 metric: str = "cosine", buckets: int = 16):
        self.spark, self.path, self.dimension, self.name, self.metric = spark, path.rstrip("/"), dimension, name, metric
        self.buckets = buckets
        if self._exists(f"{self.path}/meta/_SUCCESS"):
            stored = self.spark.read.json(f"{self.path}/meta").first()
            if stored["dimension"] != dimension or stored["metric"] != metric:
                raise ValueError(f"{self.path} holds {stored['metric']} vectors of dimension {stored['dimension']}")
            self.name, self.buckets = stored["name"], stored["buckets"]

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def versions(self) -> list[int]:
        """Numbers of the committed states, oldest first."""
        p, fs = self._fs(f"{self.path}/manifest")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """Bucket -> folder of its rows, relative to ``path``; the last state unless ``version`` is given."""
        done = self.versions()
        if not done:
            return {}
        p, fs = self._fs(f"{self.path}/manifest/{version or done[-1]:08d}.json")
        stream = fs.open(p)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return {int(b): folder for b, folder in json.loads(text).items()}

    def _commit(self, manifest: dict[int, str], version: int) -> None:
        p, fs = self._fs(f"{self.path}/manifest/{version:08d}.json")
        draft, _ = self._fs(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if fs.exists(p) or not fs.rename(draft, p):
            fs.delete(draft, False)
            raise RuntimeError(f"{self.path}: state {version} was committed by another upsert")

    def exists(self) -> bool:
        return bool(self.versions())

    def _rows(self, manifest: dict[int, str]) -> DataFrame:
        if not manifest:
            return self.spark.createDataFrame([], RECORD_SCHEMA)
        return self.spark.read.schema(RECORD_SCHEMA).parquet(*[f"{self.path}/{f}" for f in manifest.values()])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the last state, or of an earlier one that was not vacuumed."""
        return self._rows(self.manifest(version))

    def upsert(self, batch: DataFrame) -> str:
        """Merge ``batch``, commit, and return the folder with the rewritten buckets."""
        if not self._exists(f"{self.path}/meta/_SUCCESS"):
            facts = [(self.name, self.dimension, self.metric, self.buckets)]
            self.spark.createDataFrame(facts, "name string, dimension int, metric string, buckets int").coalesce(1).write.mode(
                "overwrite").json(f"{self.path}/meta")
        version = (self.versions() or [0])[-1]
        manifest = self.manifest()
        bucket = F.pmod(F.crc32("id"), F.lit(self.buckets)).cast("int")
        new = settle(check_dimension(latest_per_id(batch), self.dimension).withColumn("bucket", F.coalesce(bucket, F.lit(0))), "vectors")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # a number a bucket
        old = self._rows({b: f for b, f in manifest.items() if b in touched})
        # the table's ids are unique; rows of other buckets are not read
        kept = old.join(new.select("id"), "id", "left_anti").withColumn("bucket", F.coalesce(bucket, F.lit(0)))
        folder = f"data/{version + 1:08d}-{uuid.uuid4().hex}"
        rows = kept.unionByName(new).repartition(max(1, len(touched)), "bucket")
        rows.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        self._commit({**manifest, **{b: f"{folder}/bucket={b}" for b in touched}}, version + 1)
        return f"{self.path}/{folder}"

    def vacuum(self) -> None:
        """Delete the data of earlier states that the last one does not use, and their manifests."""
        done = self.versions()
        used = {f.split("/bucket=")[0] for f in self.manifest().values()}
        p, fs = self._fs(f"{self.path}/data")
        for s in fs.listStatus(p) if fs.exists(p) else []:
            if f"data/{s.getPath().getName()}" not in used:
                fs.delete(s.getPath(), True)
        for v in done[:-1]:
            fs.delete(self._fs(f"{self.path}/manifest/{v:08d}.json")[0], False)


#: Encoders of this Python worker, by the run that asked for them.
_ENCODERS: dict[str, Callable] = {}


def embed(df: DataFrame, text_col: str, out: str = "vector", encoder: Callable | None = None,
          dimension: int = DIMENSION, factory: Callable[[], Callable] | None = None) -> DataFrame:
    """Add an embedding column.

    Without ``encoder`` and ``factory`` the native hashing encoder runs JVM-side.  A ``factory`` makes an
    ``encoder(list[str]) -> 2-D array``; it travels to the Python workers, is called once in each, and its
    encoder is kept there for all their tasks, so a model is loaded once a worker.  A ready
    ``encoder`` is sent along with each task; it suits small ones.  Texts come and vectors go as Arrow
    batches; a null text is encoded as an empty one."""
    if encoder is None and factory is None:
        return df.withColumn(out, hash_embedding(text_col, dimension).cast("array<float>"))
    ship_package(df.sparkSession)
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])
    names, run_id = df.columns, uuid.uuid4().hex

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from spendcode.operators import vectors

        if factory is None:
            encode = encoder
        else:
            if run_id not in vectors._ENCODERS:
                vectors._ENCODERS.clear()
                vectors._ENCODERS[run_id] = factory()
            encode = vectors._ENCODERS[run_id]
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(names.index(text_col)).to_pylist()]
            made = np.asarray(encode(texts), dtype=np.float32).reshape(len(texts), -1)
            if made.shape[1] != dimension and len(texts):
                raise ValueError(f"the encoder gave vectors of dimension {made.shape[1]}, not {dimension}")
            ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * made.shape[1] if len(texts) else [0], pa.int32())
            column = pa.ListArray.from_arrays(ends, pa.array(made.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*names, out])

    return df.mapInArrow(run, schema)


# --- exact search ------------------------------------------------------------------------

def _unit(vectors):
    import numpy as np

    m = np.asarray(vectors, dtype=np.float64)
    return m / np.linalg.norm(m, axis=1)[:, None]


def _angles(unit, pivots):
    import numpy as np

    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def _bounds(angles, near, far):
    """How similar vectors with angles to a pivot from ``near`` to ``far`` can be to probes at ``angles`` to it."""
    import numpy as np

    return np.cos(np.maximum(np.maximum(angles - far, near - angles), 0.0))


def _loose(dimension: int) -> float:
    """More than a product of unit vectors errs in single precision."""
    return (dimension + 8) * 2.0 ** -23


def _stacked(column, kind: str, dimension: int):
    """The vectors that a column holds as bytes, a row each."""
    import numpy as np

    held = b"".join(column.to_pylist())
    return (np.frombuffer(held, dtype=kind) if held else np.empty(0, kind)).reshape(-1, dimension)


def _place_fn(pivots, kind: str):
    """Each vector as bytes, its block, the nearest pivot, and the angle to it.

    Vectors of another dimension raise; those with a null or not finite component have no direction and take no part."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        d = pivots.shape[1]
        for batch in batches:
            for lo in range(0, batch.num_rows, PLACE_ROWS):
                some = batch.slice(lo, PLACE_ROWS)
                column = some.column("vector")
                if pc.any(pc.not_equal(pc.list_value_length(column), d)).as_py():
                    raise ValueError(f"not all vectors are of dimension {d}")
                raw = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).astype(kind)).reshape(-1, d)
                with np.errstate(all="ignore"):
                    unit = _unit(raw)
                    near = unit @ pivots.T
                at = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(at)), at], -1.0, 1.0))
                ends = np.arange(len(raw) + 1, dtype=np.int32) * np.int32(raw.itemsize * d)
                held = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
                others = [n for n in some.schema.names if n != "vector"]
                made = pa.RecordBatch.from_arrays([*(some.column(n) for n in others), held, pa.array(at, pa.int32()), pa.array(angle)],
                                                  names=[*others, "vector", "block", "angle"])
                yield made.filter(pa.array(np.isfinite(unit).all(axis=1)))

    return run


def _pack_fn(k: int, kind: str, dimension: int):
    """A part of a block as one row.

    Of equal vectors only those of the ``k`` smallest ids can be among the ``k`` nearest of any probe; a part keeps these."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        raw = _stacked(table["vector"], kind, dimension)
        _, same = np.unique(raw.view(np.dtype((np.void, raw.itemsize * dimension))).ravel(), return_inverse=True)
        order = np.lexsort((table["id"].to_numpy(), same))
        first = np.searchsorted(same[order], same[order])
        keep = np.sort(order[np.arange(len(order)) - first < k])
        angles = table["angle"].to_numpy()[keep]
        ids = table["id"].combine_chunks().take(pa.array(keep))
        return pa.table({
            "block": table["block"].slice(0, 1), "part": table["part"].slice(0, 1), "near": [angles.min() - ANGLE_SLACK], "far": [angles.max() + ANGLE_SLACK],
            "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "vectors": pa.array([raw[keep].tobytes()], pa.binary())})

    return run


def _ask_fn(pivots, blocks, k: int, kind: str, seed_kind: str):
    """A slice of probes as one row, with floors of their k-th similarities and the blocks that any of them visits.

    A floor is the k-th similarity to the slice's seeds, vectors near the same pivot; there is none if these are fewer.
    ``blocks``: block, least and largest angle to its pivot.  Vectors within these angles can come as near to
    a probe as the difference of the angles, not nearer."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        d = pivots.shape[1]
        unit, seeds = _unit(_stacked(left["vector"], kind, d)), _unit(_stacked(right["vectors"], seed_kind, d))
        floors = np.full(len(unit), -np.inf)
        if len(seeds) >= k:
            single, to = unit.astype(np.float32), seeds.astype(np.float32).T
            step = max(1, TILE_CELLS // len(seeds))
            for lo in range(0, len(unit), step):
                floors[lo:lo + step] = np.partition(single[lo:lo + step] @ to, len(seeds) - k, axis=1)[:, len(seeds) - k]
            floors -= _loose(d)
        block, near, far = (np.array(x) for x in zip(*blocks))
        go = np.zeros(len(block), dtype=bool)
        for lo in range(0, len(unit), PLACE_ROWS):
            go |= (_bounds(_angles(unit[lo:lo + PLACE_ROWS], pivots[block]), near, far) >= floors[lo:lo + PLACE_ROWS, None] - SLACK).any(axis=0)
        whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        number = (left["ask"][0].as_py() << 24 | left["slice"][0].as_py()) if len(unit) else 0
        return pa.table({
            "number": pa.array([number], pa.int64()), "probe_ids": whole(left["probe_id"].combine_chunks()), "vectors": pa.array([b"".join(left["vector"].to_pylist())], pa.binary()),
            "floors": pa.array([floors.tobytes()], pa.binary()), "visits": whole(pa.array(block[go], pa.int32()))}).slice(0, min(1, len(unit)))

    return run


class _Best:
    """The ``k`` nearest vectors so far of each probe of a slice, without those below its floor."""

    def __init__(self, unit, floors, k: int, ids):
        import numpy as np

        self.unit, self.single, self.floors = unit, unit.astype(np.float32), np.array(floors)
        self.k, self.sims = k, np.full((len(unit), k), -np.inf)
        self.ids = np.full((len(unit), k), ids[0], dtype=ids.dtype)
        self.room = np.empty(0, dtype=np.float32)

    def meet(self, who, unit, ids) -> None:
        """Hold the probes ``who`` against vectors: all in single precision, those that may win in double."""
        import numpy as np

        n, loose = len(unit), 2 * _loose(unit.shape[1])
        to, step, piece = unit.astype(np.float32).T, max(1, TILE_CELLS // n), max(1, BLOCK_CELLS // unit.shape[1])
        if len(self.room) < step * n:
            self.room = np.empty(step * n, dtype=np.float32)
        for lo in range(0, len(who), step):
            some = who[lo:lo + step]
            sims = np.matmul(self.single[some], to, out=self.room[:len(some) * n].reshape(-1, n))
            least = self.floors[some] - loose
            bare = np.flatnonzero(np.isneginf(least))
            if len(bare) and n > self.k:
                least[bare] = np.partition(sims[bare], n - self.k, axis=1)[:, n - self.k] - loose
            least = least.astype(np.float32)
            hit = np.flatnonzero(sims.max(axis=1) >= least)
            at, col = np.divmod(np.flatnonzero(sims[hit] >= least[hit, None]), n)
            for a in range(0, len(at), piece):
                self._take(some[hit[at[a:a + piece]]], unit, ids, col[a:a + piece])

    def _take(self, who, unit, ids, col) -> None:
        import numpy as np

        # summed in one fixed way, so equal vectors have equal similarities in every part
        exact = (unit[col] * self.unit[who]).sum(axis=1)
        good = exact >= self.floors[who]
        who, exact, new = who[good], exact[good], ids[col[good]]
        some = np.unique(who)
        who = np.concatenate([who, np.repeat(some, self.k)])
        exact, new = np.concatenate([exact, self.sims[some].ravel()]), np.concatenate([new, self.ids[some].ravel()])
        order = np.lexsort((new, -exact, who))
        who = who[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        keep = rank < self.k
        who, rank, order = who[keep], rank[keep], order[keep]
        self.sims[who, rank], self.ids[who, rank] = exact[order], new[order]
        self.floors[some] = np.maximum(self.floors[some], self.sims[some, self.k - 1])


def _score_fn(pivots, k: int, kind: str, part_kind: str):
    """The ``k`` nearest of each probe among the parts that its slice meets in this task, slice after slice."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        d, number, best, id_type = pivots.shape[1], None, None, None

        def found():
            at, rank = np.nonzero(best.sims > -np.inf)
            return pa.RecordBatch.from_arrays([pa.array((number << 20) + at), pa.array(best.ids[at, rank], type=id_type), pa.array(best.sims[at, rank])],
                                              names=["probe", "id", "similarity"])

        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for row in range(batch.num_rows):
                held = {name: batch.column(name)[row] for name in batch.schema.names}
                vectors = lambda name, as_kind: _unit(np.frombuffer(held[name].as_buffer(), dtype=as_kind).reshape(-1, d))  # noqa: E731, B023
                ids = held["ids"].values.to_numpy(zero_copy_only=False)
                if held["number"].as_py() != number:
                    if best is not None:
                        yield found()
                    number = held["number"].as_py()
                    best = _Best(vectors("vectors", kind), np.frombuffer(held["floors"].as_buffer()), k, ids)
                angles = _angles(best.unit, pivots[[held["block"].as_py()]])[:, 0]
                may = _bounds(angles, held["near"].as_py(), held["far"].as_py()) >= best.floors - SLACK
                if may.any():
                    best.meet(np.flatnonzero(may), vectors("part", part_kind), ids)
        if best is not None:
            yield found()

    return run


def nearest(probes: DataFrame, index: DataFrame, k: int = 5, max_rows: int = PART_ROWS, pivots: int | None = None) -> DataFrame:
    """Exact top-``k`` cosine neighbours: ``probe_id, rank, id, similarity`` (ties by id).

    The index is dealt to blocks: a quarter of the square root of its vectors, ``PIVOTS`` at most, are pivots
    (a bounded sample), and each vector goes to the nearest one by angle.  Parts of blocks are rows of bytes, and so
    are slices of probes near the same pivot.  The k-th similarity of a probe to a part near that pivot rules out
    every block whose least angle is larger; a slice visits the blocks that remain for any of its probes.
    A task reads some slices and a bounded range of the parts, without a copy of either on disk, and holds each
    slice against the parts that it visits; a probe's nearest of all ranges are ranked in the end.  So the work may
    grow with probes times vectors, but what is written grows with the input (and ``k`` rows a probe and range).
    Null ids and vectors that are null, zero or not finite take no part; repeated probes are answered each for itself."""
    from pyspark.sql.window import Window
    import numpy as np

    spark = probes.sparkSession
    ship_package(spark)
    id_type, probe_type = index.schema["id"].dataType.simpleString(), probes.schema["probe_id"].dataType.simpleString()
    real = F.exists("vector", lambda x: x != 0)

    def numbered(df: DataFrame, name: str, at: str) -> tuple[DataFrame, str]:
        """Vectors in single precision if they come so, and else in double, with a number for each row."""
        single = df.schema["vector"].dataType.elementType == T.FloatType()
        rows = df.where(real).select(name, F.col("vector").cast("array<float>" if single else "array<double>"))
        return settle(rows.withColumn("row", F.monotonically_increasing_id()), at), "<f4" if single else "<f8"

    index, kind = numbered(index.where(F.col("id").isNotNull()), "id", "nearest-index")
    n = index.count()
    empty = spark.createDataFrame([], f"probe_id {probe_type}, rank int, id {id_type}, similarity double")
    if not n:
        return empty
    wanted = pivots or min(PIVOTS, math.ceil(math.sqrt(n) / 4))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # false for not a number too
    sample = index.where(finite).orderBy(F.xxhash64("id"), "id").select("vector").limit(wanted).collect()  # at most PIVOTS vectors
    if not sample:
        return empty
    pivot = _unit(np.array([r["vector"] for r in sample]))
    dimension = pivot.shape[1]

    def placed(df: DataFrame, name: str, kind: str) -> DataFrame:
        return df.mapInArrow(_place_fn(pivot, kind), f"{name} {dict(df.dtypes)[name]}, row bigint, vector binary, block int, angle double")

    def dealt(df: DataFrame, sizes: list[tuple], name: str) -> DataFrame:
        """Rows of each block dealt to so many, by their numbers: equal ids and vectors need not go together."""
        table = spark.createDataFrame(sizes, "block int, pieces bigint")
        return df.join(F.broadcast(table), "block").withColumn(name, F.pmod(F.xxhash64("row"), "pieces").cast("int"))

    entries = placed(index, "id", kind)
    summary = entries.groupBy("block").agg(F.min("angle") - ANGLE_SLACK, F.max("angle") + ANGLE_SLACK, F.count(F.lit(1)))
    blocks = sorted(tuple(r) for r in summary.collect())  # a row a block
    sizes = [(b[0], math.ceil(b[3] / max_rows)) for b in blocks]
    parts = settle(dealt(entries, sizes, "part").groupBy("block", "part").applyInArrow(
        _pack_fn(k, kind, dimension), f"block int, part int, near double, far double, ids array<{id_type}>, vectors binary"), "nearest-parts")
    forget(index)

    probes, probe_kind = numbered(probes, "probe_id", "nearest-probes")
    asking = placed(probes, "probe_id", probe_kind)
    slices = [(r["block"], math.ceil(r["count"] / SLICE_PROBES)) for r in asking.groupBy("block").count().collect()]  # a row a block
    release(spark)  # a job's shuffle files can go some time after it has ended
    counts, pieces = np.array([b[3] for b in blocks]), np.array([s[1] for s in sizes])
    sure = np.where(pieces > 1, counts // (2 * pieces), counts)  # vectors of a block's first part, at least, as a rule
    order = np.argsort(-(pivot[[s[0] for s in slices]] @ pivot[[b[0] for b in blocks]].T), axis=1, kind="stable")
    seeds = [(blocks[b][0], ask, many) for (ask, many), near in zip(slices, order) for b in near[:np.searchsorted(np.cumsum(sure[near]), k) + 1].tolist()]
    seeds = spark.createDataFrame(seeds, "block int, ask int, many bigint").select("block", "ask", F.explode(F.sequence(F.lit(0), F.col("many").cast("int") - 1)).alias("slice"))
    seeds = parts.where("part = 0").join(F.broadcast(seeds), "block").select("ask", "slice", "vectors")
    asking = dealt(asking, slices, "slice").select(F.col("block").alias("ask"), "slice", "probe_id", "vector")
    asking = settle(asking.groupBy("ask", "slice").cogroup(seeds.groupBy("ask", "slice")).applyInArrow(
        _ask_fn(pivot, [b[:3] for b in blocks], k, probe_kind, kind),
        f"number bigint, probe_ids array<{probe_type}>, vectors binary, floors binary, visits array<int>"), "nearest-slices")
    forget(probes)
    pairs = settle(asking.select("number", "probe_ids", "visits"), "nearest-pairs")  # a row a slice, without vectors
    release(spark)

    # every slice with every part that it visits: tasks read both as they are, nothing is copied for the pairs
    tasks = max(1, min(sum(s[1] for s in slices), 4 * spark.sparkContext.defaultParallelism))
    ranges = math.ceil(n * (dimension * int(kind[-1]) + 16) / RANGE_BYTES)
    left = asking.select("number", "vectors", "floors", "visits").repartition(tasks)
    right = parts.select("block", "near", "far", "ids", F.col("vectors").alias("part")).coalesce(ranges)
    met = left.join(right.hint("shuffle_replicate_nl"), F.array_contains("visits", F.col("block"))).drop("visits")
    with few_a_batch(spark, PAIRS_A_BATCH):
        found = settle(met.mapInArrow(_score_fn(pivot, k, probe_kind, kind), f"probe bigint, id {id_type}, similarity double"), "nearest-found")
    forget(parts, asking)
    names = pairs.select("number", F.posexplode("probe_ids").alias("at", "probe_id")).select((F.shiftleft("number", 20) + F.col("at")).alias("probe"), "probe_id")
    best = Window.partitionBy("probe").orderBy(F.desc("similarity"), F.asc("id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(names.hint("merge"), "probe").select("probe_id", "rank", "id", "similarity")
