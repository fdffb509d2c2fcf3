"""Ranked lexical search: the best position algorithm over impact lists, shard by shard.

Every item (a text) is a query of its terms; every document gets a score, the sum of its impacts for the
item's terms, and each item returns its ``k`` best documents.

1. Documents are cut into terms once.  A row keeps its length and those terms whose hash the items' terms
   set in a bitmap of 1 MB; what gets through by chance is dropped by the exact terms later.  Document
   counts and lengths are summed over this narrow table, so texts are read once and never shuffled.
2. Documents are dealt to shards of about ``SHARD`` postings; each meets the items' terms with their weights,
   in blocks of ``BLOCK`` items.
3. A shard has an impact list for each term (documents by falling impact) and, for direct access, each
   document's place in it.  For an item (``best_positions``) all its lists are read alike, a run of places at
   a time; a document met for the first time is looked up in all other lists, which scores it in full and
   marks its *places* as seen.  A list's best position is the last before its first unseen place, often far
   below the last place read, so the sum of the impacts there bounds every unseen document more tightly than
   the last reads would.  Reading stops when that bound is strictly below the k-th score: documents that
   tie with the k-th may have a smaller id and are always found.
4. Each shard gives ``k`` rows an item at most; a window merges them.

All numbers but the weights are 64-bit integers, so scores do not depend on shards or order.

Edge cases: a null or empty text has no terms; a document or item without any takes no part; repeated
documents and items are ranked each for itself; equal scores go by id, a null id after all others; fewer than
``k`` documents with a score above 0 give fewer rows; an empty table gives none.  Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendcode.llm.common import stored
from spendcode.session import ship_package

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bits of the items' bitmap, whatever their number (1 MB); 32,768 of them are a row of Spark's bitmaps.
BITS = 1 << 23
BITMAP_ROW = 1 << 15
#: Postings of one shard, some 60 MB in its task.
SHARD = 2_000_000
#: Items that a shard answers at a time.
BLOCK = 4096
#: Places read of each list in the first run; later runs double.
RUN = 32


def terms_of(text: str | None) -> list[str]:
    """Maximal runs of digits, letters and characters beyond ASCII; only A-Z are lower-cased."""
    return TERM.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``item, term, times`` of each item's distinct terms."""
    for b in batches:
        counted = [Counter(terms_of(t)) for t in b["text"].to_pylist()]
        sizes = [len(c) for c in counted]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(b["item"].to_numpy(zero_copy_only=False), sizes), pa.int64()),
            pa.array([t for c in counted for t in c], pa.string()),
            pa.array([n for c in counted for n in c.values()], pa.int64())], ["item", "term", "times"])


def _document_terms(bitmap: bytes):
    """``doc, n, terms, tfs``: a document's length, and the terms that the bitmap lets through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for b in batches:
            lengths, terms, tfs, sizes = [], [], [], []
            for text in b["text"].to_pylist():
                words = terms_of(text)
                lengths.append(len(words))
                before = len(terms)
                for term, tf in Counter(words).items():
                    hit = known.get(term)
                    if hit is None:
                        at = zlib.crc32(term.encode("utf-8", "surrogatepass")) % BITS
                        hit = known[term] = bool(bitmap[at >> 3] >> (at & 7) & 1)
                    if hit:
                        terms.append(term)
                        tfs.append(tf)
                sizes.append(len(terms) - before)
            if len(known) > 500_000:  # a cache of answers only
                known.clear()
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                b["doc"], pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.string())),
                pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], ["doc", "n", "terms", "tfs"])
    return run


def _bitmap(terms: DataFrame) -> bytes:
    """The hashes of all terms as one bitmap; its rows are built by Spark, 256 of 4 KB at most."""
    at = F.pmod(F.crc32("term"), F.lit(BITS)) + 1
    rows = (terms.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect())
    out = bytearray(BITS // 8)
    for r in rows:
        start = (r["bucket"] - 1) * (BITMAP_ROW // 8)
        out[start:start + len(r["bits"])] = r["bits"]
    return bytes(out)


class ImpactLists:
    """A shard's lists: for each term the documents by falling impact, and their places by document."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))
        place = np.arange(len(order)) - self.start[term[order]]
        back = np.lexsort((self.doc, term[order]))
        self.by_doc, self.place = self.doc[back], place[back]

    def size(self, term: int) -> int:
        return int(self.start[term + 1] - self.start[term])

    def read(self, term: int, first: int, last: int) -> np.ndarray:
        """Documents at places ``first`` .. ``last - 1``."""
        a, b = self.start[term], self.start[term + 1]
        return self.doc[min(a + first, b):min(a + last, b)]

    def at(self, term: int, place: int) -> int:
        return int(self.impact[self.start[term] + place])

    def look_up(self, term: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``docs`` (rising) the list has, and at which places."""
        a, b = self.start[term], self.start[term + 1]
        own = self.by_doc[a:b]
        i = np.minimum(np.searchsorted(own, docs), len(own) - 1)
        has = own[i] == docs
        return has, self.place[a:b][i[has]]


def best_positions(lists: ImpactLists, terms: list[tuple[int, int]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """All documents that may be among the ``k`` best for ``terms`` (term, times), their scores, and the places read."""
    terms = [(t, c) for t, c in terms if lists.size(t)]
    sizes = [lists.size(t) for t, _ in terms]
    seen = [np.zeros(s + 1, dtype=bool) for s in sizes]  # one place more, never seen
    best = [0] * len(terms)                              # places seen from the top without a gap
    met = np.zeros(n_docs, dtype=bool)
    docs, scores = [], []
    kth, depth, run, deepest = -1, 0, RUN, max(sizes, default=0)
    while depth < deepest:
        new = np.concatenate([lists.read(t, depth, depth + run) for t, _ in terms])
        new = np.unique(new[~met[new]])
        depth, run = depth + run, run * 2
        if len(new):
            met[new] = True
            score = np.zeros(len(new), dtype=np.int64)
            for j, (t, times) in enumerate(terms):
                has, places = lists.look_up(t, new)
                score[has] += times * lists.impact[lists.start[t] + places]
                seen[j][places] = True
            docs.append(new)
            scores.append(score)
            flat = np.concatenate(scores)
            if len(flat) >= k:
                kth = int(np.partition(flat, len(flat) - k)[len(flat) - k])
        bound = 0
        for j, (t, times) in enumerate(terms):
            best[j] += int(np.argmin(seen[j][best[j]:]))
            if best[j] < sizes[j]:  # a list seen to its end holds no unseen document
                bound += times * lists.at(t, max(best[j] - 1, 0))
        if bound < kth or not bound:
            break
    if not docs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), depth
    return np.concatenate(docs), np.concatenate(scores), depth


def _search(k: int):
    """One shard against one block of items: ``item, doc, row, score``, ``k`` an item at most."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            terms = right["term"].combine_chunks()
            known = pc.unique(terms)
            docs = pa.chunked_array(left["terms"]).combine_chunks()
            sizes = docs.value_lengths().to_numpy(zero_copy_only=False)
            term = pc.index_in(docs.flatten(), value_set=known)
            tf = pa.chunked_array(left["tfs"]).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(left.num_rows), sizes)
            real = term.is_valid().to_numpy(zero_copy_only=False)
            term, tf, doc = term.fill_null(0).to_numpy(zero_copy_only=False)[real], tf[real], doc[real]
            of_item = pc.index_in(terms, value_set=known).to_numpy(zero_copy_only=False)
            weight = np.zeros(len(known), dtype=np.int64)
            weight[of_item] = right["w"].to_numpy()
            m = left["m"].to_numpy()[doc]
            impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            some = impact > 0
            lists = ImpactLists(term[some], doc[some], impact[some], len(known))
            ids, rows = left["doc"].to_pylist(), left["row"].to_numpy()
            queries: dict[int, list] = {}
            for item, t, times in zip(right["item"].to_pylist(), of_item.tolist(), right["times"].to_pylist()):
                queries.setdefault(item, []).append((t, times))
            for item, query in queries.items():
                found, scores, _ = best_positions(lists, query, left.num_rows, k)
                if len(found) > k:  # all that tie with the k-th go on to the choice by id
                    near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                    found, scores = found[near], scores[near]
                ranked = sorted(zip(scores.tolist(), found.tolist()), key=lambda x: (-x[0], ids[x[1]] is None, ids[x[1]] or 0, rows[x[1]]))
                for score, d in ranked[:k]:
                    for column, value in zip(out, (item, ids[d], int(rows[d]), score)):
                        column.append(value)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], left.schema.field("doc").type),
                         pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], ["item", "doc", "row", "score"])
    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
           shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id, rank, doc_id, score``."""
    spark = docs.sparkSession
    ship_package(spark)
    named = stored(items.select(F.col(item_id).alias("name"), F.col(text).alias("text"))
                   .withColumn("item", F.monotonically_increasing_id()), "lexical-items")
    queries = stored(named.select("item", "text").mapInArrow(_item_terms, "item bigint, term string, times bigint"), "lexical-terms")
    kind = dict(docs.dtypes)[doc_id]
    counted = stored(docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
                     .mapInArrow(_document_terms(_bitmap(queries)), f"doc {kind}, n bigint, terms array<string>, tfs array<bigint>")
                     .where("n > 0").withColumn("row", F.monotonically_increasing_id()), "lexical-documents")
    totals = counted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(1)).alias("l"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")).first()
    n_docs, n_terms = totals["n"], totals["l"]
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1)))
    weighted = queries.join(held, "term").select("item", "term", "times", weight.alias("w")).where("w > 0")

    shards = -(-totals["postings"] // shard) or 1
    blocks = -(-named.count() // block) or 1
    left = counted.where(F.size("terms") > 0).select(
        F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        "doc", "row", (F.lit(25) + F.expr(f"(75 * n * {n_docs}L) div {n_terms}L")).alias("m"), "terms", "tfs")
    right = weighted.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")).select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"), "block", "item", "term", "times", "w")
    key = ["shard", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_search(k), f"item bigint, doc {kind}, row bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"), "row")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(named.select("item", F.col("name")), "item").select(
        F.col("name").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")
