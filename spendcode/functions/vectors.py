"""Vector expressions: cosine similarity and a feature-hashing text encoder.

The reference embeds catalogue texts with a sentence-embedding model (384 dimensions).
That model is injected (see ``spendcode.operators.vectors.embed``); the built-in
encoder used by tests and the registered queries is feature hashing -- explicitly *not*
the same embedding -- so the pipeline runs with no model files.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendcode.functions.text import WORD, let

DIMENSION = 384
TOKEN_PATTERN = f"[{WORD}]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double_array(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    prods = F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """dot / (|a| |b|) in double precision; null when a norm is zero or sizes differ."""
    a, b = _c(a), _c(b)
    d = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (d > 0), dot(a, b) / d)


def token_bucket(token, dimension: int = DIMENSION) -> Column:
    """Bucket of a token: first 28 bits of its md5, modulo the dimension."""
    return F.conv(F.substring(F.md5(_c(token)), 1, 7), 16, 10).cast("long") % F.lit(dimension)


def hash_embedding_sparse(text, dimension: int = DIMENSION) -> Column:
    """Non-zero entries of the hashed vector: ``array<struct<bucket int, weight double>>``
    sorted by bucket; weights are token counts divided by the vector's L2 norm."""
    tokens = F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_PATTERN), 0)

    def counted(buckets):
        entries = F.transform(F.array_sort(F.array_distinct(buckets)),
                              lambda b: F.struct(b.cast("int").alias("bucket"),
                                                 F.size(F.filter(buckets, lambda x: x == b))
                                                 .cast("double").alias("weight")))
        return let(entries, normalise)

    def normalise(entries):
        n = F.sqrt(F.aggregate(entries, F.lit(0.0), lambda s, e: s + e["weight"] * e["weight"]))
        return let(n, lambda nv: F.transform(
            entries, lambda e: F.struct(e["bucket"].alias("bucket"), (e["weight"] / nv).alias("weight"))))

    return let(F.transform(tokens, lambda t: token_bucket(t, dimension)), counted)


def hash_embedding(text, dimension: int = DIMENSION) -> Column:
    """Dense L2-normalised token-count vector (array<double>) of the lower-cased text."""
    def dense(entries):
        m = F.map_from_entries(entries)
        return let(m, lambda mv: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)),
                                             lambda i: F.coalesce(F.try_element_at(mv, i), F.lit(0.0))))

    return let(hash_embedding_sparse(text, dimension), dense)
