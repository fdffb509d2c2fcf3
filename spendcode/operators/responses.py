"""Model requests as data: prompt columns, request keys and a response store.

Every call to the (external, paid, non-deterministic) classification model is a *request
row*: ``stage, request_key, model, temperature, system, user``.  A stage is resolved as a
relational plan instead of a per-row call:

1. build the request columns for every line (pure expressions),
2. ``dropDuplicates`` on the request key (repeated texts are asked once; map-side
   partial dedupe collapses a hot text before the shuffle),
3. ``LEFT ANTI`` join against the stored answers, so nothing already answered is asked
   again,
4. answer the misses with an injected *responder*, append them to the store (a bucketed
   Parquet table a stage) and read them back, so a retried task or a second action does
   not call the model again,
5. equi-join the answers back to the lines by request key.

A responder is a function ``(DataFrame(requests), stage) -> DataFrame(requests +
response, error)``.  Production wraps a Python client with :func:`pandas_responder`
(``mapInPandas``, concurrency bounded by the partition count); tests and the registered
queries use the recorded stand-in in ``spendcode.operators.replay``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendcode.functions.prompts import SYSTEM, TEMPERATURE, USER, split_frame
from spendcode.session import ship_package

KEY_SEPARATOR = "\u0001"
REQUEST_COLUMNS = ["stage", "request_key", "model", "temperature", "system", "user"]
STORE_SCHEMA = T.StructType([
    T.StructField("stage", T.StringType()),
    T.StructField("request_key", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("temperature", T.StringType()),
    T.StructField("system", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("error", T.StringType()),
])

Responder = Callable[[DataFrame, str], DataFrame]


def stage_name(dialect: str, stage: str) -> str:
    return f"{stage}_{dialect}"


def render(frame: str, **slots: Column) -> Column:
    """Fill a user-prompt frame; every slot must be a non-null string column."""
    parts = [slots[p[1:-1]] if p.startswith("{") and p.endswith("}") else F.lit(p)
             for p in split_frame(frame)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def request_key(stage: str, model: str, temperature: str, system: Column, user: Column) -> Column:
    """sha-256 over everything that changes the answer."""
    return F.sha2(F.concat_ws(KEY_SEPARATOR, F.lit(stage), F.lit(model), F.lit(temperature),
                              system, user), 256)


def request_columns(dialect: str, stage: str, model: str, **slots: Column) -> list[Column]:
    """The request columns of one stage for the slot values of each row."""
    name = stage_name(dialect, stage)
    temperature = TEMPERATURE[(dialect, stage)]
    system = F.lit(SYSTEM[(dialect, stage)])
    user = render(USER[(dialect, stage)], **slots)
    return [F.lit(name).alias("stage"),
            request_key(name, model, temperature, system, user).alias("request_key"),
            F.lit(model).alias("model"), F.lit(temperature).alias("temperature"),
            system.alias("system"), user.alias("user")]


def request_constants(dialect: str, stage: str, model: str) -> dict[str, Column]:
    """The request columns that are the same in every request of a stage."""
    return {"stage": F.lit(stage_name(dialect, stage)), "model": F.lit(model), "temperature": F.lit(TEMPERATURE[(dialect, stage)]),
            "system": F.lit(SYSTEM[(dialect, stage)])}


def slot_text(dialect: str, stage: str, user: Column) -> Column:
    """The text that stands in the one slot of a stage's user prompt."""
    parts = split_frame(USER[(dialect, stage)])
    at = parts.index("{text}")
    before, after = len("".join(parts[:at])), len("".join(parts[at + 1:]))
    return F.substring(user, F.lit(before + 1), F.length(user) - F.lit(before + after)) if before + after else user


class ResponseStore:
    """Answers already obtained, keyed by request key.

    ``path`` is a folder on shared storage (for example under ``spark.checkpoint.dir``); without a
    path the store starts empty and answers live only in the plan.

    Each stage is a Parquet table clustered by request key into ``buckets`` (a number that the
    folder remembers from its first use).  An append adds one file a bucket; joins and aggregates by
    request key read the buckets where they lie, so stored answers are never shuffled, however many
    there are: only a run's own distinct requests move, to the buckets that they fall into.
    ``compact`` rewrites a stage as a new version, one file a bucket and one row a request.  A version
    counts once its ``_SUCCESS`` file is there, so a job that dies in between leaves the old one.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path.rstrip("/") if path else None
        self.buckets = buckets

    # --- files -------------------------------------------------------------------------

    def _at(self, path: str):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def _n_buckets(self) -> int:
        """The folder's bucket number; set by whoever uses the folder first."""
        for name in self._names(self.path):
            if m := re.fullmatch(r"_buckets-(\d+)", name):
                self.buckets = int(m[1])
                return self.buckets
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        fs, p = self._at(f"{self.path}/_buckets-{self.buckets}")
        fs.mkdirs(p)
        return self.buckets

    def _version(self, stage: str) -> int | None:
        done = [int(v[1:]) for v in self._names(f"{self.path}/{stage}")
                if re.fullmatch(r"v\d+", v) and "_SUCCESS" in self._names(f"{self.path}/{stage}/{v}")]
        return max(done, default=None)

    # --- tables ------------------------------------------------------------------------

    def _table(self, stage: str, version: int) -> str:
        """Name of the table over a version's folder, declared in this session if it is not yet."""
        folder = f"{self.path}/{stage}/v{version:06d}"
        name = f"responses_{hashlib.sha256(folder.encode()).hexdigest()[:16]}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in STORE_SCHEMA.fields)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (request_key) "
                       f"SORTED BY (request_key) INTO {self._n_buckets()} BUCKETS LOCATION '{folder}'")
        self.spark.catalog.refreshTable(name)
        return name

    def _write(self, answers: DataFrame, stage: str, version: int) -> None:
        name = self._table(stage, version)
        # dealt like the buckets, so each task writes one file
        answers.select(*[f.name for f in STORE_SCHEMA.fields]).repartition(self._n_buckets(), "request_key").write.insertInto(name)
        self.spark.catalog.refreshTable(name)

    def _stages(self) -> list[str]:
        return [n for n in self._names(self.path) if not n.startswith("_")] if self.path else []

    def load(self, stage: str | None = None) -> DataFrame:
        out = None
        for s in [stage] if stage else self._stages():
            version = self._version(s) if self.path else None
            if version is not None:
                df = self.spark.table(self._table(s, version))
                out = df if out is None else out.unionByName(df)
        return out if out is not None else self.spark.createDataFrame([], STORE_SCHEMA)

    def answers(self, stage: str, *columns: str) -> DataFrame:
        """``request_key, columns, response, error``: of several stored rows of a request one with an answer wins."""
        best = F.max_by(F.struct(*columns, "response", "error"), F.col("response").isNotNull())
        return self.load(stage).groupBy("request_key").agg(best.alias("a")).select("request_key", "a.*")

    def compact(self, stage: str) -> None:
        """Rewrite a stage as one row a request and one file a bucket; the old version is deleted."""
        old = self._version(stage)
        if old is None:
            return
        best = F.max_by(F.struct(*[f.name for f in STORE_SCHEMA.fields if f.name != "request_key"]), F.col("response").isNotNull())
        rows = self.load(stage).groupBy("request_key").agg(best.alias("a")).select("request_key", "a.*")
        self._write(rows, stage, old + 1)
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(stage, old)}")
        fs, p = self._at(f"{self.path}/{stage}/v{old:06d}")
        fs.delete(p, True)

    def resolve(self, requests: DataFrame, responder: Responder, stage: str, carry: tuple[str, ...] = (),
                constants: dict[str, Column] | None = None, derived: dict[str, Column] | None = None,
                unique: bool = False) -> DataFrame:
        """One row per distinct request: request columns, ``carry`` columns, ``response``,
        ``error``.  Only requests missing from the store reach the responder.

        Request columns in ``constants`` need not be in ``requests``: they are the same in every row and join
        the distinct requests, so no prompt text of a whole stage is sorted or shuffled.  ``derived`` are
        further carry columns that follow from ``user``, made there too.  ``unique`` says that no request key comes twice."""
        if getattr(responder, "needs_store", False) and not self.path:
            raise ValueError("a model client needs a ResponseStore with a path: answers must be "
                             "stored before they are joined back, or retries would ask again")
        constants, derived = constants or {}, derived or {}
        moved = [c for c in REQUEST_COLUMNS if c not in constants]

        def told(names: list[str]) -> DataFrame:
            """One row per distinct request; the store deals them like its buckets, so joins with it move nothing else."""
            df = requests.select(*names, *carry)
            df = df if unique else df.dropDuplicates(["request_key"])
            return df.repartition(self._n_buckets(), "request_key") if self.path else df

        def filled(df: DataFrame, *more: str) -> DataFrame:
            return df.select(*[constants.get(c, F.col(c)).alias(c) for c in REQUEST_COLUMNS], *carry,
                             *[d.alias(c) for c, d in derived.items()], *more)

        if not self.path:
            return responder(filled(told(moved)), stage).select(*REQUEST_COLUMNS, *carry, *derived, "response", "error")
        version = self._version(stage)
        misses = told(moved)
        if version is not None:
            # a stored failure is no answer: it is asked again
            known = self.load(stage).where(F.col("response").isNotNull()).select("request_key").distinct()
            misses = misses.join(known, "request_key", "left_anti")
        # Materialise before anything joins the answers back: a retried task or a second
        # action must read stored answers instead of asking the model again.
        self._write(responder(filled(misses), stage), stage, version or 0)
        # the store has the requests too: only their keys move once more
        asked = [c for c in moved if c != "request_key"]
        return filled(told(["request_key"]).join(self.answers(stage, *asked), "request_key", "inner"), "response", "error")


def pandas_responder(call: Callable, partitions: int | None = None) -> Responder:
    """Wrap ``call(pandas.DataFrame[request columns]) -> pandas.DataFrame[response, error]``.

    The batches run in Python workers via ``mapInPandas``; ``partitions`` bounds how many
    run at once (one open client per task).  When a batch raises, its rows are asked one by
    one, so only the rows that fail themselves are recorded with an ``error``.
    """
    out_schema = T.StructType(STORE_SCHEMA.fields)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            base = pdf[[f.name for f in STORE_SCHEMA.fields if f.name not in ("response", "error")]]
            try:
                got = call(base)
                resp, err = list(got["response"]), list(got["error"])
            except Exception:  # noqa: BLE001 - find the rows that fail
                resp, err = [], []
                for i in range(len(base)):
                    try:
                        one = call(base.iloc[i:i + 1])
                        resp.append(one["response"].iloc[0])
                        err.append(one["error"].iloc[0])
                    except Exception as e:  # noqa: BLE001 - row-level fault isolation
                        resp.append(None)
                        err.append(f"{type(e).__name__}: {e}")
            yield base.assign(response=resp, error=err)

    def responder(misses: DataFrame, stage: str) -> DataFrame:
        ship_package(misses.sparkSession)
        df = misses.repartition(partitions) if partitions else misses
        return df.mapInPandas(run, out_schema)

    responder.needs_store = True
    return responder
