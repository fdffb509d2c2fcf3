"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of good quality; everything else that is learned comes from
unlabelled web text.  The class prior is estimated from the two samples, then a small network is
trained on the non-negative unbiased risk

    prior * E_P[loss(+g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)])

whose second part estimates the risk on negatives.  Where that estimate falls below zero its gradient is
zero, so that the network cannot win by memorising the positives.

The network is fitted on at most ``SAMPLE`` positives and ``SAMPLE`` unlabelled documents (the parameter
``sample``; taken in hash order, so the choice is stable and independent of the layout; of an id's rows
one).  Means, scales and the shares that the prior is read from are aggregates over all unlabelled
rows.  Scoring reads every document once, in whole.  Inputs are style statistics of the text alone; id, labels, language and
source are none.

Edge cases: a null text counts as empty and is scored; labels that are null or of rows without a
document are not used; repeated labels count once; without any positive the score is the prior 0.5 for
every row; a null id is never held out; repeated rows are scored alike; ``score_quality`` keeps all columns
of its input (``score`` and ``predicted`` replace columns of these names); an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendcode.llm.common import discard, python_tasks, stored

SAMPLE = 10_000
THRESHOLD = 0.7
#: Deviations of the confidence bound on the class prior (one side, 99.9 %).
MARGIN = 3.0
_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32,), "line": (10, 13),
            "other white": (9, 11, 12), "sentence": b".,;:'\"()-", "mark": b"!?", "bar": b"|/\\<>{}[]=_~^`",
            "sign": b"#$%&*+@", "high": range(128, 256)}
_CLASS_OF = np.zeros(256, dtype=np.int64) + len(_CLASSES)
for _i, _members in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_members)] = _i
_TAIL = re.compile(rb"[!-/:-@\[-`{-~]{2,}$")


def style(text: str | None) -> list[float]:
    """Statistics of a text that do not depend on its language."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = max(1, len(words)), max(1, len(data))
    counts = np.bincount(_CLASS_OF[np.frombuffer(data, dtype=np.uint8)], minlength=len(_CLASSES) + 1)
    share = counts[:len(_CLASSES)] / max(1, counts.sum())
    often = Counter(words)
    top = often.most_common(1)[0][1] if often else 0
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1)
    lines = data.split(b"\n")
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    tails = sum(1 for w in often.elements() if _TAIL.search(w)) if len(often) < 50 else \
        sum(c for w, c in often.items() if _TAIL.search(w))
    letters = max(1, int(counts[0] + counts[1]))
    return [*np.sqrt(share).tolist(), counts[0] / letters, len(often) / n, top / n, repeats / n, tails / n,
            float(lengths.mean()) / 10, float(lengths.std()) / 10, float((lengths <= 3).mean()), float((lengths == 1).mean()),
            float((lengths > 20).mean()), len(set(lines)) / len(lines), float(np.log1p(n)) / 10, float(np.log1p(size / len(lines))) / 10]


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        if not self.weights:
            return np.full(len(x), self.prior)
        return _sigmoid(_forward(self.weights, (x - self.mean) / self.scale)[0])


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def _forward(w: tuple[np.ndarray, ...], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(np.clip(x, -8, 8) @ w[0] + w[1])
    return hidden @ w[2] + w[3][0], hidden


def _gradients(w, x, hidden, dg):
    dh = np.outer(dg, w[2]) * (1 - hidden ** 2)
    return [np.clip(x, -8, 8).T @ dh, dh.sum(0), hidden.T @ dg, np.array([dg.sum()])]


def _train(p: np.ndarray, u: np.ndarray, prior: float | None, seed: int, hidden: int = 16, epochs: int = 60,
           batch: int = 512, rate: float = 3e-3, decay: float = 1e-4) -> tuple[np.ndarray, ...]:
    """Adam on the non-negative risk; without a prior on plain discrimination of ``p`` from ``u``."""
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], hidden)), np.zeros(hidden),
         rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    first, second, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    rounds = max(1, -(-max(len(p), len(u)) // batch))
    for _ in range(epochs):
        for _ in range(rounds):
            xp, xu = p[rng.integers(len(p), size=min(batch, len(p)))], u[rng.integers(len(u), size=min(batch, len(u)))]
            gp, hp = _forward(w, xp)
            gu, hu = _forward(w, xu)
            sp, su = _sigmoid(gp), _sigmoid(gu)
            if prior is None:
                parts = [(xp, hp, (sp - 1) / len(xp)), (xu, hu, su / len(xu))]
            else:
                negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
                minus_u, minus_p = su / len(xu), -prior * sp / len(xp)
                if negative >= 0:
                    parts = [(xp, hp, prior * (sp - 1) / len(xp) + minus_p), (xu, hu, minus_u)]
                else:
                    parts = [(xp, hp, prior * (sp - 1) / len(xp))]
            grads = [sum(g) for g in zip(*(_gradients(w, *part) for part in parts), strict=True)]
            step += 1
            for i, g in enumerate(grads):
                g = g + decay * w[i]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                w[i] = w[i] - rate * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    return tuple(w)


def estimate_prior(p: np.ndarray, u: np.ndarray, seed: int = 1, above: Callable | None = None) -> float:
    """Share of positives among unlabelled rows.

    For any set of texts, the mass of ``u`` in it over the mass of ``p`` in it is at least the prior,
    and equal where the set holds no negatives; the sets are those above a score that tells ``p`` from
    ``u``, fitted on one half and measured on the other.  ``above(w, cuts)`` gives the shares of a larger
    unlabelled set above each cut, or None if it is empty.  Every ratio is raised to its upper confidence
    bound (``MARGIN`` deviations of the two shares) before the least is taken: the least of many unsure
    ratios would be far too small on small tables, and with it every score.
    """
    w = _train(p[::2], u[::2], None, seed, epochs=20)
    sp = np.sort(_forward(w, p[1::2])[0])
    if not len(sp):
        return 0.5
    cuts = np.quantile(sp, np.linspace(0.0, 0.7, 71))
    above_u = above(w, cuts) if above else _shares_above(_forward(w, u[1::2])[0], cuts)
    if above_u is None:
        return 0.5
    above_p = 1 - np.searchsorted(sp, cuts) / len(sp)
    # a larger unlabelled set is surer than this says, so the bound holds
    unsure = np.sqrt((1 - above_p) / (above_p * len(sp)) + (1 - above_u) / np.maximum(above_u * (len(u) // 2), 1))
    return float(np.clip((above_u / above_p * (1 + MARGIN * unsure)).min(), 0.05, 0.98))


def _shares_above(scores: np.ndarray, cuts: np.ndarray) -> np.ndarray | None:
    return 1 - np.searchsorted(np.sort(scores), cuts) / len(scores) if len(scores) else None


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 7, moments: tuple[np.ndarray, np.ndarray] | None = None,
        above: Callable | None = None) -> QualityModel:
    """Model of two samples; ``moments`` (mean and deviation) and ``above(mean, scale, w, cuts)`` may come from larger sets."""
    if not len(positive) or not len(unlabelled):
        return QualityModel(np.zeros(1), np.ones(1), (), 0.5)
    both = np.concatenate([positive, unlabelled])
    mean, deviation = moments or (both.mean(0), both.std(0))
    scale = deviation + 1e-3
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    prior = estimate_prior(p, u, above=above and partial(above, mean, scale))
    return QualityModel(mean, scale, _train(p, u, prior, seed), prior)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Fit on labelled good documents and on unlabelled ones, none of them held out."""
    spark = docs.sparkSession
    python_tasks(spark)
    usable = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))

    def chosen(ids: DataFrame, kind: int) -> DataFrame:
        ids = ids.where(usable).select("doc_id").distinct()
        return ids.orderBy(F.xxhash64("doc_id", F.lit(kind)), "doc_id").limit(sample).select("doc_id", F.lit(kind).alias("kind"))

    def styles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([style(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], ["doc_id", "x"])

    picks = chosen(labels.where("quality = 1"), 1).union(chosen(docs, 0))  # at most 2 * sample narrow rows
    every = stored(docs.where(usable).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        styles, "doc_id bigint, x array<double>"), "quality-styles")
    got = every.join(F.broadcast(picks), "doc_id").groupBy("kind", "doc_id").agg(F.min("x").alias("x")).toPandas()  # bounded by the sample
    got = got.sort_values(["kind", "doc_id"])
    part = lambda kind: np.array(got.loc[got["kind"] == kind, "x"].tolist(), dtype=np.float64)
    positive, unlabelled = part(1), part(0)
    if not len(positive) or not len(unlabelled):
        model = fit(positive, unlabelled)
    else:
        fitted = got.loc[got["kind"] == 0, "doc_id"].to_numpy()[::2]  # the half that ``estimate_prior`` trains on
        model = fit(positive, unlabelled, moments=_moments(every, unlabelled.shape[1]), above=partial(_counted_above, every, fitted))
    discard(every)
    return model


def _moments(every: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each statistic over all rows; rounded, as the order of a sum may change its last bits."""
    at = [F.col("x")[i] for i in range(width)]
    row = every.agg(*[F.avg(x) for x in at], *[F.stddev_pop(x) for x in at]).first()
    both = np.round(np.array(row, dtype=np.float64), 9)
    return both[:width], both[width:]


def _counted_above(every: DataFrame, fitted: np.ndarray, mean: np.ndarray, scale: np.ndarray,
                   w: tuple[np.ndarray, ...], cuts: np.ndarray) -> np.ndarray | None:
    """Shares of all rows but those of the ids ``fitted`` that score at least each cut; None without rows."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(cuts) + 1, dtype=np.int64)
        for batch in batches:
            other = ~np.isin(batch.column(0).to_numpy(), fitted)
            if other.any():
                x = batch.column(1).flatten().to_numpy().reshape(len(other), -1)[other]
                g = np.sort(_forward(w, (x - mean) / scale)[0])
                n += np.append(len(g) - np.searchsorted(g, cuts), len(g))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["at", "n"])

    summed = every.mapInArrow(counts, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    n = summed.sort_values("at")["n"].to_numpy()  # one number a cut and the rows
    return n[:-1] / n[-1] if len(n) and n[-1] else None


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted, in one pass without a shuffle."""
    python_tasks(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    names = [f.name for f in fields]

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index(text_col)).to_pylist()
            x = np.array([style(t) for t in texts], dtype=np.float64)
            score = model.score(x)
            cols = [*batch.columns, pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, [*names, "score", "predicted"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double", "predicted int"])
    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(scores, schema)
