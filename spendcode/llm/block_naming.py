"""Exact dedup by deterministic block naming.

The normalised text (each run of white space is one space) is cut into blocks of ``BLOCK`` bytes.
Equal blocks get the same integer name, different ones different names, by sorting the blocks; then
adjacent names are paired and the pairs named in the same way, until each document is one integer.
Two documents have the same integer exactly if their texts are equal: no step hashes without
comparing the values themselves.

* Blocks are dealt to ``SHARES`` shares by a hash and sorted inside a share; the name is the share
  followed by the block's rank in it.  The text is shuffled once, for this sort.
* A block that makes up over ``1 / HOT`` of all blocks (at most ``HOT`` of them exist) is spread over
  ``SALTS`` shares and its names are united afterwards from one row a share.
* Names of pairs are counted and named from partial aggregates, and joined back (narrow rows; AQE
  splits a hot pair).

Edge cases: a null text counts as empty, an empty one is one empty block; a row without id is
compared like any other, and the smallest id is the smallest that is not null; of repeated rows of
the smallest id one stays; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendcode.llm.common import stored

BLOCK = 4096
HOT = 2000
SALTS = 64
SHARES = 1 << 20
_RANK_BITS = 40


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(row, id, pos, n, block, sha)``: one row a block; the digest goes with the first block."""
    data = F.encode("text", "UTF-8")
    count = F.greatest(F.lit(1), F.ceil(F.length("data") / BLOCK)).cast("int")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"),
                       normalised(F.col(text_col)).alias("text")).withColumn("data", data)
    cut = rows.select("row", "id", count.alias("n"), "data", F.explode(F.sequence(F.lit(0), count - 1)).alias("pos"))
    return cut.select("row", "id", "pos", "n",
                      F.substring(F.col("data"), F.col("pos") * BLOCK + 1, F.lit(BLOCK)).alias("block"),
                      F.when(F.col("pos") == 0, F.sha2("data", 256)).alias("sha"))


def _hot_hashes(blocks: DataFrame) -> list[int]:
    """Hashes of blocks that make up over ``1 / HOT`` of all: fewer than ``HOT`` values."""
    counts = stored(blocks.groupBy(F.xxhash64("block").alias("h")).agg(F.count(F.lit(1)).alias("c")), "naming-counts")
    total = counts.agg(F.sum("c")).first()[0] or 0
    return [r["h"] for r in counts.where((F.col("c") > total / HOT) & (F.col("c") > SALTS)).collect()]


def name_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, id, pos, n, sha, name)``: one row a block, equal blocks having equal names."""
    blocks = _blocks(docs, id_col, text_col)
    hot = _hot_hashes(blocks.select("block"))
    h = F.xxhash64("block")
    is_hot = h.isin(hot) if hot else F.lit(False)
    salt = F.when(is_hot, F.pmod(F.xxhash64("row"), F.lit(SALTS))).otherwise(F.lit(0))
    dealt = blocks.withColumns({"hot": is_hot, "share": F.pmod(F.xxhash64(h, salt), F.lit(SHARES))})
    order = Window.partitionBy("share").orderBy("block")
    ranked = dealt.withColumns({"rank": F.dense_rank().over(order), "last": F.lag("block").over(order)})
    name = F.shiftleft(F.col("share"), _RANK_BITS) + F.col("rank")
    head = F.col("hot") & (F.col("last").isNull() | (F.col("last") != F.col("block")))
    named = stored(ranked.select("row", "id", "pos", "n", "sha", name.alias("name"),
                                 F.when(head, F.col("block")).alias("head")), "naming-blocks")
    if not hot:
        return named.drop("head")
    heads = named.where(F.col("head").isNotNull()).select("name", "head")  # at most HOT * SALTS rows
    united = heads.join(heads.groupBy("head").agg(F.min("name").alias("one")), "head").select("name", "one")
    return named.join(F.broadcast(united), "name", "left").select(
        "row", "id", "pos", "n", "sha", F.coalesce("one", "name").alias("name"))


def _name_pairs(level: DataFrame) -> DataFrame:
    """The next level: adjacent names are paired, and equal pairs get equal names."""
    even = F.pmod("pos", F.lit(2)) == 0
    pairs = stored(level.groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
        F.max("id").alias("id"), F.max("n0").alias("n0"), F.max("sha").alias("sha"),
        F.ceil(F.max("n") / 2).cast("int").alias("n"), F.max(F.when(even, F.col("name"))).alias("a"),
        F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b")), "naming-pairs")
    share = F.pmod(F.xxhash64("a", "b"), F.lit(SHARES))
    names = pairs.select("a", "b").distinct().withColumn("share", share)
    rank = F.dense_rank().over(Window.partitionBy("share").orderBy("a", "b"))
    names = stored(names.select("a", "b", (F.shiftleft(F.col("share"), _RANK_BITS) + rank).alias("name")), "naming-names")
    return pairs.join(names, ["a", "b"]).select("row", "id", "pos", "n", "n0", "sha", "name")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, id, n0, name, sha)``: one row a document; ``(n0, name)`` is its collision-free identity.

    ``n0`` is its number of blocks: names of different levels are not compared.
    """
    cols = ["row", "id", "n0", "name", "sha"]
    level = stored(name_blocks(docs, id_col, text_col).withColumn("n0", F.col("n")), "naming-level")
    done = level.where("n = 1").select(*cols)
    while not (level := level.where("n > 1")).isEmpty():  # halves the longest document each time
        level = stored(_name_pairs(level), "naming-level")
        done = done.unionByName(level.where("n = 1").select(*cols))
    return done


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, keep_id, group_size, kept, text_sha256)`` for every row."""
    found = stored(identities(docs, id_col, text_col), "naming-identities")
    groups = found.groupBy("n0", "name").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("keep"),
        F.count(F.lit(1)).alias("group_size"))
    groups = stored(groups.select("n0", "name", F.col("keep.id").alias("keep_id"), F.col("keep.row").alias("keep_row"),
                                  "group_size"), "naming-groups")
    return found.join(groups, ["n0", "name"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("sha").alias("text_sha256"))
