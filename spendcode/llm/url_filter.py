"""URL filters by a Bloom filter cascade (DataFrame functions only).

A rule is a host and a path; it fits its host and all subdomains of it if the path of the url
starts with the rule's path.  Every rule that could fit a url is one of the url's *candidate
keys*: a suffix of its host (whole labels) followed by a prefix of its path.  The listed keys and
the universe of candidate keys of the corpus are both known, so a cascade of Bloom filters gives
exact membership:

* level 1 encodes the listed keys; some unlisted keys of the universe pass it by accident;
* level 2 encodes these false positives; some listed keys pass it by accident;
* level 3 encodes those listed keys, and so on until a level has no accidental pass.

A key is listed if it fails at an even level or reaches an odd end.  Levels are arrays of bits in
the query plan: the first one is sized so that about as many false positives as listed keys are
expected (``listed * log2(universe / listed)`` bits), so each level grows with the rule list and
only logarithmically with the corpus.  Urls are judged by expressions alone, without a join.

Edge cases: a null url, or one without ``://``, has empty host and path and gets no rule unless a
rule has an empty host; of two fitting rules the one with the longer text wins, and of equal ones
the one with the longer host; repeated rows are judged alike; other columns are left alone (the
result columns replace columns of the same name).  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendcode.llm.common import ascii_lower, stored

_WORD = 32  # bits a word of a level


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    words: tuple[int, ...]

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.seed), F.lit(j), key), F.lit(self.bits)) for j in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        words = F.expr("array(" + ",".join(f"{w}L" for w in self.words) + ")")
        out = F.lit(True)
        for p in self.positions(key):
            word = F.get(words, F.floor(p / _WORD).cast("int"))
            out = out & (F.getbit(word, F.pmod(p, F.lit(_WORD)).cast("int")) == 1)
        return out


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def candidate_keys(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Host suffixes times path prefixes that have the shape of some rule, longest text first.

    Only label counts and path lengths that occur among the rules are taken: no other key can
    be listed.
    """
    depths = sorted({r.host.count(".") + 1 for r in rules}, reverse=True)
    lengths = sorted({len(r.path) for r in rules}, reverse=True)
    labels = F.split(host, r"\.")
    keys = []
    for d in depths:
        suffix = F.when(F.size(labels) >= d, F.array_join(F.slice(labels, -d, d), "."))
        for n in lengths:
            keys.append(F.when(F.length(path) >= n, F.struct(
                F.length(suffix).alias("h"), F.concat(suffix, F.substring(path, 1, n)).alias("key"))))
    some = F.filter(F.array(*keys), lambda k: k["key"].isNotNull())
    ordered = F.sort_array(F.transform(some, lambda k: F.struct(
        F.length(k["key"]).alias("n"), k["h"].alias("h"), k["key"].alias("key"))), asc=False)
    return F.transform(ordered, lambda k: k["key"])


def _encode(keys: DataFrame, n: int, share: float, seed: int) -> Level:
    """A level that holds the ``n`` keys and passes about ``share`` of the others."""
    hashes = max(1, math.ceil(math.log2(1 / share)))
    bits = max(_WORD, math.ceil(n * hashes / math.log(2)))
    bits += -bits % _WORD
    empty = Level(bits, hashes, seed, ())
    at = keys.select(F.explode(F.array(*empty.positions(F.col("key")))).alias("p"))
    found = at.groupBy(F.floor(F.col("p") / _WORD).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("p", F.lit(_WORD)).cast("int"))).alias("v"))
    words = [0] * (bits // _WORD)
    for row in found.collect():  # at most bits / 32 rows
        words[row["w"]] = row["v"]
    return Level(bits, hashes, seed, tuple(words))


def build_cascade(universe: DataFrame, listed: Sequence[str]) -> list[Level]:
    """Levels that decide membership in ``listed`` exactly for every ``key`` of ``universe``.

    ``universe`` has a column ``key`` without repeats or nulls.
    """
    spark = universe.sparkSession
    listed = sorted(set(listed))
    if not listed:
        return []
    inside = spark.createDataFrame([(k,) for k in listed], "key string")
    outside = universe.join(F.broadcast(inside), "key", "left_anti")  # as small as the rule list
    n_out = outside.count()
    levels: list[Level] = []
    sides, sizes, turn = [inside, outside], [len(listed), n_out], 0
    while sizes[turn]:
        share = min(0.5, sizes[0] / max(1, n_out)) if not levels else 0.5
        level = _encode(sides[turn], sizes[turn], share, len(levels) + 1)
        levels.append(level)
        turn = 1 - turn
        through = sides[turn].where(level.passes(F.col("key")))
        sides[turn] = stored(through, "url-cascade")
        sizes[turn] = sides[turn].count()
    return levels


def is_listed(levels: Sequence[Level], key: Column) -> Column:
    """Exact membership of a key of the universe that the levels were built over."""
    out = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        out = F.when(levels[k].passes(key), out).otherwise(F.lit(k % 2 == 1))
    return out


def url_filter(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule (text of the winning rule or null) and verdict to every row."""
    url = F.col(url_col)
    parts = pages.withColumns({"host": url_host(url), "path": url_path(url)})
    keys = candidate_keys(F.col("host"), F.col("path"), rules)
    universe = stored(parts.select(F.explode(keys).alias("key")).distinct(), "url-keys")
    lists = {v: build_cascade(universe, [r.text for r in rules if r.verdict == v]) for v in ("allow", "block")}
    hit = lambda v: (lambda k: is_listed(lists[v], k))
    best = lambda v: F.get(F.filter(keys, hit(v)), F.lit(0))
    ruled = parts.withColumns({"_allow": best("allow"), "_block": best("block")})
    n_allow = F.coalesce(F.length("_allow"), F.lit(-1))
    n_block = F.coalesce(F.length("_block"), F.lit(-1))
    host_of = lambda c: F.coalesce(F.length(F.substring_index(F.col(c), "/", 1)), F.lit(-1))
    allowed = (n_allow > n_block) | ((n_allow == n_block) & (host_of("_allow") >= host_of("_block")))
    return ruled.withColumns({
        "rule": F.when(allowed, F.col("_allow")).otherwise(F.col("_block")),
        "verdict": F.when((n_allow < 0) & (n_block < 0), F.lit(default))
                    .otherwise(F.when(allowed, F.lit("allow")).otherwise(F.lit("block")))}).drop("_allow", "_block")
