"""Merkle manifest of a dataset: sparse checkpoints, and proofs whose inner nodes are recomputed.

Every row is a leaf, the rows of a group are the leaves of one 16-ary tree in key order, and the
groups' roots are the leaves of one more such tree, whose root names the dataset.

* **Checkpoints.**  Only every ``EVERY``-th level of a tree is stored (levels 0, 2, 4, ...).  A step
  gathers the nodes of an aligned subtree, ``16 ** EVERY`` of them at most, into one row, hashes the
  levels in between inside that row and stores nothing but the subtree's top.
* **Proofs.**  ``proofs`` goes down from the top: each aligned subtree hashes its missing levels again
  from its stored descendants, gives each of them its siblings followed by the subtree's own path
  (computed once for all its descendants), and drops the levels again.
* **Positions.**  Rows are dealt by ranges of (group, key, leaf, row number), so a group of any size is
  spread over tasks; a row's place in its group is its place in the sorted whole less that of the group's
  first row, from one count a partition and a group.

Shuffles move digests and keys, never texts.  Any number of groups, of any size, is possible: nothing
is collected but the size of the largest tree.

Edge cases: null fields are ``-``; a null key sorts first; equal keys go by leaf digest; equal rows have
equal leaves and take neighbouring places; a null group is a group of its own, before all others; a group
of one row has its leaf as root; an empty table gives no rows.  Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendcode.llm.common import discard, stored

FAN = 16
#: Levels from one stored level to the next; a subtree of ``FAN ** EVERY`` digests is one row.
EVERY = 2


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """Digest of fields: ``-`` for null, else their UTF-8 byte count, ``:`` and themselves."""
    def framed(c: Column) -> Column:
        s = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))
    return digest(F.concat(*[framed(c) for c in fields]))


def _placed(nodes: DataFrame, order: Sequence[str], name: str) -> tuple[DataFrame, DataFrame, int]:
    """``nodes`` with ``idx``, the place by ``order`` within ``tree``, and ``n``, the tree's size; the table read; the largest ``n``."""
    parts = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbered = nodes.withColumn("salt", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(parts, "tree", *order, "salt").sortWithinPartitions("tree", *order, "salt")
    # the row number is written down: later reads must see the places of this one sort
    rows = stored(dealt.drop("salt").withColumn("at", F.monotonically_increasing_id()), name)
    rows_at = rows.withColumn("part", F.shiftright("at", 33))
    runs = rows_at.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here"))
    tree = Window.partitionBy("tree")
    # one row a group and partition, so a window of a group has a row a partition at most
    before = F.sum("here").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("here").over(tree).alias("n"))
    # a hot group has a key for each of its partitions here
    placed = rows_at.join(runs, ["tree", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")
    return placed, rows, runs.agg(F.max("n")).first()[0] or 0


def _levels(subtrees: DataFrame) -> DataFrame:
    """Adds ``l1`` .. ``l{EVERY}``, the digests of each level above ``l0`` within a subtree; none above the root."""
    def up(below: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / FAN).cast("int"))
        return F.transform(runs, lambda r: digest(F.array_join(F.slice(below, r * FAN + 1, FAN), "")))

    for k in range(EVERY):
        subtrees = subtrees.withColumn(f"l{k + 1}", F.when(F.col("n") > FAN ** k, up(F.col(f"l{k}"))))
    return subtrees


def _subtrees(nodes: DataFrame, *payload: str) -> DataFrame:
    """One row an aligned subtree: ``tree``, ``top`` (its number), ``n``, ``nodes`` in order."""
    item = F.struct("idx", "digest", *payload)
    return (nodes.groupBy("tree", F.floor(F.col("idx") / FAN ** EVERY).alias("top"), "n")
            .agg(F.array_sort(F.collect_list(item)).alias("nodes")))


def _above(subtrees: DataFrame) -> DataFrame:
    """The next stored level: one node a subtree."""
    tops = _levels(subtrees.withColumn("l0", F.col("nodes.digest")))
    top = F.coalesce(*[F.col(f"l{k}") for k in range(EVERY, -1, -1)])
    return tops.select("tree", F.col("top").alias("idx"), F.ceil(F.col("n") / FAN ** EVERY).cast("bigint").alias("n"), top[0].alias("digest"))


def build(nodes: DataFrame, order: Sequence[str], name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Checkpoints of the trees over ``nodes`` (``tree``, ``digest``, ``order`` and more), and the tables they lie in.

    Checkpoint ``i`` has the nodes of level ``i * EVERY``; trees that end below it keep their root."""
    placed, rows, left = _placed(nodes, order, name)
    levels, tables = [placed], [rows]
    while left > 1:
        levels.append(stored(_above(_subtrees(levels[-1])), f"{name}-{len(levels) * EVERY}"))
        tables.append(levels[-1])
        left = -(-left // FAN ** EVERY)
    return levels, tables


def _paths(below: DataFrame, above: DataFrame, *payload: str) -> DataFrame:
    """Nodes of a stored level with ``path`` to the root: (left, right) siblings of each level on the way.

    ``above``: ``tree``, ``idx``, ``path`` and what else goes down to each descendant."""
    sub = _subtrees(below, *payload)
    down = [c for c in above.columns if c not in ("tree", "idx", "n", "digest", "path")]
    sub = sub.join(above.select("tree", F.col("idx").alias("top"), F.col("path").alias("rest"), *down), ["tree", "top"])
    sub = _levels(sub.withColumn("l0", F.col("nodes.digest")))
    kept = [f"l{k}" for k in range(EVERY)]
    each = sub.select("tree", "n", "rest", *down, *kept, F.posexplode("nodes").alias("i", "node"))
    steps = []
    for k in range(EVERY):
        i = F.floor(F.col("i") / FAN ** k).cast("int")
        inside = F.pmod(i, F.lit(FAN))
        left = F.array_join(F.slice(F.col(f"l{k}"), i - inside + 1, inside), "")
        right = F.array_join(F.slice(F.col(f"l{k}"), i + 2, F.lit(FAN - 1) - inside), "")
        steps.append(F.when(F.col("n") > FAN ** k, F.array(F.struct(left.alias("left"), right.alias("right"))))
                     .otherwise(F.array().cast("array<struct<left:string,right:string>>")))
    return each.select("tree", "n", *down, "node.*", F.concat(*steps, "rest").alias("path"))


def proofs(levels: list[DataFrame], top: DataFrame, *payload: str) -> DataFrame:
    """Leaves of the checkpoints ``levels`` with their paths, which end with those in ``top`` (a row a tree)."""
    above = top
    for i in range(len(levels) - 2, -1, -1):
        above = _paths(levels[i], above, *(payload if i == 0 else ()))
    if len(levels) == 1:  # every tree is a single leaf
        return levels[0].join(top.drop("idx"), "tree")
    return above


def fold(start: Column, path: Column) -> Column:
    """The root that ``start`` and the siblings of ``path`` give."""
    return F.aggregate(path, start, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def siblings(path: Column) -> Column:
    """All siblings of a path, left to right, level by level."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def tampered(key: Column) -> Column:
    """Whether the audit changes a row: a fifth of all, by the key's CRC."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(5)) == 0, F.lit(False))


def audit(docs: DataFrame, fields: Sequence[str], key: str, group: str, altered: Column, altered_field: str) -> DataFrame:
    """Manifest of ``docs`` and a check of every row against it.

    ``altered`` takes the place of ``altered_field`` in rows that ``tampered`` picks.  Returns a row a
    document: ``key``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``."""
    cols = [F.col(c) for c in fields]
    changed = [altered if c == altered_field else F.col(c) for c in fields]
    none = F.lit(None).cast("string")
    leaves = stored(docs.select(
        F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string"))).alias("tree"),
        F.col(key).alias("doc"), leaf(*cols).alias("digest"),
        F.when(tampered(F.col(key)), leaf(*changed)).otherwise(none).alias("other")), "merkle-leaves")
    levels, _ = build(leaves, ["doc", "digest"], "merkle")
    discard(leaves)
    subroots = levels[-1].select("tree", F.col("digest").alias("subroot"))
    # the groups' roots are leaves of one tree; their own key orders them, null first
    top_nodes = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("grp"), F.col("subroot").alias("digest"))
    top_levels, _ = build(top_nodes, ["grp"], "merkle-top")
    nothing = F.array().cast("array<struct<left:string,right:string>>").alias("path")
    root = top_levels[-1].select("tree", F.lit(0).cast("bigint").alias("idx"), F.col("digest").alias("root"), nothing)
    groups = proofs(top_levels, root, "grp").select(
        F.col("grp").alias("tree"), F.lit(0).cast("bigint").alias("idx"), F.col("digest").alias("subroot"), "root", "path")
    found = proofs(levels, groups, "doc", "other")
    out = found.select(
        F.col("doc").alias(key), F.col("digest").alias("leaf"), "subroot", "root",
        digest(siblings(F.col("path"))).alias("proof_sha256"),
        fold(F.coalesce("other", "digest"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
