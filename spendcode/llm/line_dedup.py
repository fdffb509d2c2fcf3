"""Line dedup by an exact set-similarity join (DataFrame functions only).

A line is removed if an earlier line, by document id and line number, has the same set of words or one
of Jaccard similarity ``threshold`` or more.  Lines without words stay.

* Equal sets are merged first, so a common line is one row from then on.
* A set's words are ordered by rarity (their count over the whole corpus, in a table of ``COUNTERS``
  counters that words share by hash, so it has a fixed size), rarest first.  Two sets of the wanted
  similarity share a word of both prefixes, ``|x| - ceil(t |x|) + 1`` words; they differ little in
  size (length filter); behind the first shared word there must be room for the overlap that the
  similarity needs (positional filter); and the words that two prefixes share, with all that may follow
  the prefix that ends first, must be enough for it too.
* A signature of 64 parities, 128 or 256 for long lines, carried along, drops most unlike lines inside the join.
* First each line is held against ``TRIES`` lines only: of the earliest lines (of each of some classes) of its
  ``HEADS`` rarest words, those whose signatures are nearest.  That settles most of a group of near copies in linear time.  Only lines that are not
  settled are joined with all earlier lines of their words.  No pair is lost, and a group of copies never
  makes all its pairs.
* Candidates are verified on the words themselves.  Their lines are read from the texts again; a
  bitmap of fixed size keeps all other lines out of that shuffle.

Edge cases: a null text stays null; rows that repeat id and text are one document and get the same
result; rows of one id with different texts are ordered by a hash of the text; rows without an id come
last; a text whose lines all go becomes empty; ties in rarity are ordered by the word's hash; all other
columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendcode.llm.common import discard, release, stored

THRESHOLD = 0.8
COUNTERS = 1 << 20
PASSES = 4           # parts of the words that are joined one after the other
LONG, VERY_LONG = 32, 48  # sizes above which a set's signature is 128, then 256 bits
CLASSES = 4          # classes of lines, the earliest of each of which stands for a word
SLACK = 2            # words by which a pair's prefixes are longer than it needs, so that it must share more than one
TRIES = 2            # of the lines met in that way, the nearest that are verified
HEADS = 5            # rarest words (of those that occur again) by which a line meets the line it is held against first
BITMAP_ROWS = 2048   # of 32768 bits each
_HASH_BITS = 53
_ADDRESS = ["d", "v", "n"]
_SIGNATURE = ["sig", "s2", "s3", "s4"]
_PAIR = [f"{x}_{c}" for x in "ab" for c in _ADDRESS]
_LAST = (1 << 63) - 1
_BLANKS = " \t\x0b\x0c\r"


def _plain(text: Column) -> Column:
    """``text`` with a space for each other white space within a line; few texts have any to replace."""
    odd = reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in _BLANKS[1:]])
    return F.when(odd, F.translate(text, _BLANKS[1:], " " * len(_BLANKS[1:]))).otherwise(text)


def words(line: Column) -> Column:
    """Words of a ``_plain`` line with repeats, possibly with empty ones."""
    return F.split(line, " ")


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the address ``_d, _v`` of the document: ``_v`` is 0 where the id alone names the text."""
    d = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST))
    repeated = docs.select(d.alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    v = F.lit(0).cast("bigint") if repeated.isEmpty() else F.xxhash64(text_col)
    return docs.withColumns({"_d": d, "_v": v})


def _lines(addressed: DataFrame, text_col: str) -> DataFrame:
    return addressed.select(F.col("_d").alias("d"), F.col("_v").alias("v"),
                            F.posexplode(F.split(_plain(F.col(text_col)), "\n")).alias("n", "line"))


def _counter(h: Column) -> Column:
    return h.bitwiseAND(F.lit(COUNTERS - 1)).cast("int")


def word_counts(lines: DataFrame) -> DataFrame:
    """One row with ``COUNTERS`` numbers: how often the words of each counter occur in all lines."""
    counted = lines.select(F.explode(words(F.col("line"))).alias("w")).groupBy(
        _counter(F.xxhash64("w")).alias("i")).agg(F.count(F.lit(1)).alias("c"))
    every = lines.sparkSession.range(COUNTERS).select(F.col("id").cast("int").alias("i"))
    # a class of 16 steps for each doubling: equal enough, and small
    level = F.coalesce(F.floor(F.log2("c") * 16), F.lit(0)).cast("int")
    full = every.join(counted, "i", "left").select("i", level.alias("level"))
    rows = full.groupBy(F.floor(F.col("i") / 1024).alias("b")).agg(F.sort_array(F.collect_list(F.struct("i", "level"))).alias("part"))
    one = rows.agg(F.sort_array(F.collect_list(F.struct("b", "part"))).alias("parts"))  # COUNTERS numbers
    return stored(one.select(F.flatten(F.transform("parts", lambda p: p["part"]["level"])).alias("counts")), "line-counts")


def _sets(lines: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """``d, v, n, size, k1, k2, sig, s2, s3, s4, prefix`` of every line that has words.

    ``k1`` and ``k2`` name the set: a hash of all words and its rarest word.  ``sig`` has the parity of
    the words in each of 64 classes.  In a long set most classes of any two sets differ, so it has
    ``s2``, the parities of the words of every other class of a second kind, and a very long one
    ``s3`` and ``s4``, by which 256 classes are told apart.
    """
    def code(h: Column) -> Column:  # rarity above, hash below; never null, so that longs are sorted as such
        level = F.coalesce(F.get("counts", _counter(h)), F.lit(0))
        return F.shiftleft(level.cast("bigint"), _HASH_BITS) + F.shiftrightunsigned(h, 64 - _HASH_BITS)

    # the lines without words go by their text: a filter on the codes would compute them a second time
    worded = lines.where(F.trim("line") != "").withColumn("counts", counts.scalar())
    # "counts" stands in one place only, or every row would carry a copy of it
    # lambdas are the dear part: each word is hashed once, and a word that repeats gets one code
    hashes = F.array_distinct(F.transform(F.array_remove(words(F.col("line")), ""), lambda w: F.xxhash64(w)))
    ranked = worded.select(*_ADDRESS, F.sort_array(F.transform(hashes, code)).alias("r")).withColumn("size", F.size("r"))
    size = F.col("size")
    keep = F.when(_needs_partner(size, threshold), size - F.ceil(threshold * size - 1e-9) + 1).otherwise(0).cast("int")
    # place and hash of each word of the prefix, 31 bits of which are enough to meet; a word that occurs once
    # in all texts (its counter says so, or more) meets none
    prefix = F.array_compact(F.transform(F.slice("r", F.lit(1), keep), lambda r, i: F.when(
        F.shiftright(r, _HASH_BITS) > 0, F.shiftleft(i.cast("bigint"), 31).bitwiseOR(r.bitwiseAND(F.lit(0x7FFFFFFF))))))
    sig = "aggregate({0}, 0L, (s, x) -> s ^ shiftleft(1L, cast(x & 63 as int)))"
    some = lambda bits: F.expr(sig.format(f"filter(r, x -> x & {bits} = {bits})"))
    return ranked.select(*_ADDRESS, "size", F.xxhash64("r").alias("k1"), F.element_at("r", 1).alias("k2"), F.expr(sig.format("r")).alias("sig"),
                         F.when(size > LONG, some(64)).alias("s2"), F.when(size > VERY_LONG, some(128)).alias("s3"),
                         F.when(size > VERY_LONG, some(192)).alias("s4"), prefix.alias("prefix"))


def _needs_partner(size: Column, threshold: float) -> Column:
    """Whether a set of this size can be similar to another set at all."""
    return F.floor(size / threshold + 1e-9) > size if threshold < 1 else F.lit(False)


def address_bitmap(addresses: DataFrame) -> DataFrame:
    """One row: bits of the hashed addresses, as ``BITMAP_ROWS`` binaries or null."""
    pos = F.pmod(F.xxhash64(*_ADDRESS), F.lit(BITMAP_ROWS * 32768))
    bits = addresses.select(pos.alias("p")).groupBy(F.floor(F.col("p") / 32768).cast("int").alias("b")).agg(
        F.bitmap_construct_agg(F.col("p") % 32768).alias("bits"))
    every = addresses.sparkSession.range(BITMAP_ROWS).select(F.col("id").cast("int").alias("b"))
    one = every.join(bits, "b", "left").agg(F.sort_array(F.collect_list(F.struct("b", "bits"))).alias("rows"))
    return stored(one.select(F.transform("rows", lambda r: r["bits"]).alias("bitmap")), "line-bitmap")


def _in_bitmap(bitmap: Column) -> Column:
    pos = F.pmod(F.xxhash64(*_ADDRESS), F.lit(BITMAP_ROWS * 32768))
    row = F.get(bitmap, F.floor(pos / 32768).cast("int"))
    byte = F.conv(F.hex(F.substring(row, F.floor((pos % 32768) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (pos % 8).cast("int")) == 1, F.lit(False))


def _settled(pairs: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """Addresses of the later lines of ``pairs`` that are similar to one of their earlier lines.

    Each line is verified with its earliest candidate first; only lines for which that fails are
    verified with all others, so words move about once a line however many partners it has.  The
    texts are read once for both.
    """
    b = [f"b_{c}" for c in _ADDRESS]
    pairs = stored(pairs, "line-pairs")
    held = _words_of(pairs, lines)
    first = pairs.groupBy(*b).agg(F.min(F.struct(*[f"a_{c}" for c in _ADDRESS])).alias("a")).select("a.*", *b)
    done = _alike(first, held, threshold)
    rest = pairs.join(done.select(*[F.col(c).alias(f"b_{c}") for c in _ADDRESS]), b, "left_anti").join(
        first, pairs.columns, "left_anti")
    out = done.union(_alike(rest, held, threshold))
    discard(pairs, held)
    release(out.sparkSession)
    return out


def _side(x: str) -> list[Column]:
    return [F.col(f"{x}_{c}").alias(c) for c in _ADDRESS]


def _words_of(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The words ``w`` of all lines in ``pairs``, read from the texts once."""
    asked = stored(pairs.select(*_side("a")).union(pairs.select(*_side("b"))).distinct(), "line-asked")
    bitmap = address_bitmap(asked)
    near = lines.withColumn("bitmap", bitmap.scalar()).where(_in_bitmap(F.col("bitmap")))
    text = near.select(*_ADDRESS, "line").join(asked, _ADDRESS, "left_semi").dropDuplicates(_ADDRESS)
    held = stored(text.select(*_ADDRESS, F.array_distinct(F.array_remove(words(F.col("line")), "")).alias("w")), "line-words")
    discard(asked, bitmap)
    return held


def _alike(pairs: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """Addresses of the later lines (``b_``) of the ``pairs`` that are similar to the earlier ones (``a_``)."""
    of = lambda x: held.select(*[F.col(c).alias(f"{x}_{c}") for c in _ADDRESS], F.col("w").alias(f"{x}_w"))
    both = pairs.join(of("a"), [f"a_{c}" for c in _ADDRESS]).join(of("b"), [f"b_{c}" for c in _ADDRESS])
    overlap = F.size(F.array_intersect("a_w", "b_w"))
    alike = overlap >= threshold * (F.size("a_w") + F.size("b_w") - overlap) - 1e-9
    return stored(both.where(alike).select(*_side("b")).distinct(), "line-later")


def _met(earlier: DataFrame, later: DataFrame, threshold: float, *more: Column) -> DataFrame:
    """Pairs of addresses of prefix rows that share a word: their sizes, how many words they share
    (``shared``) and where the first of them stands in each (``a_at``, ``b_at``).

    Filters that hold for a pair whatever the word: length, the parities, since sets differ in at least as
    many words as their signatures in bits, and the places of the shared word.
    """
    a, b = F.col("a.size"), F.col("b.size")
    both_till = "till" in earlier.columns
    # both sides of a join with itself use the same columns, so Spark shuffles their rows once
    till = ["till"] if both_till else []
    below = F.col("b.till" if both_till else "b.d")
    order = (F.col("a.d") < below) | ((F.col("a.d") == below) & (
        (F.col("a.v") < F.col("b.v")) | ((F.col("a.v") == F.col("b.v")) & (F.col("a.n") < F.col("b.n")))))
    x = {s: F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}")) for s in _SIGNATURE}
    differ = a + b - 2 * _overlap(a, b, threshold)
    # classes of the second kind: words with bit 64 and without; then with bits 128 and 64 in all four ways
    two = F.bit_count(x["s2"]) + F.bit_count(x["sig"].bitwiseXOR(x["s2"]))
    low = x["s2"].bitwiseXOR(x["s4"])  # 64 without 128
    none = x["sig"].bitwiseXOR(x["s3"]).bitwiseXOR(low)
    four = F.bit_count(x["s4"]) + F.bit_count(x["s3"].bitwiseXOR(x["s4"])) + F.bit_count(low) + F.bit_count(none)
    may = ((a >= threshold * b - 1e-9) & (b >= threshold * a - 1e-9) & (F.bit_count(x["sig"]) <= differ)
           & (F.coalesce(two, F.lit(0)) <= differ) & (F.coalesce(four, F.lit(0)) <= differ)
           # what may be shared before, at and behind this word, wherever the others stand
           & (F.least("a.at", "b.at") + F.least(a - F.col("a.at"), b - F.col("b.at")) >= _overlap(a, b, threshold)))
    if both_till:  # the prefixes that sets of these sizes need, and SLACK words more
        need = _overlap(a, b, threshold)
        may = may & (F.col("a.at") <= a - need + SLACK) & (F.col("b.at") <= b - need + SLACK)
    rows = earlier.alias("a").join(later.alias("b"), (F.col("a.word") == F.col("b.word")) & order & may).select(
        *[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "ab" for c in (*_ADDRESS, "size", "at", *till)],
        F.coalesce(four, two, F.bit_count(x["sig"])).alias("far"))
    return rows.groupBy(*_PAIR, "a_size", "b_size").agg(
        F.count(F.lit(1)).alias("shared"), F.min("a_at").alias("a_at"), F.min("b_at").alias("b_at"), *more)


def _overlap(a: Column, b: Column, threshold: float) -> Column:
    """Words that sets of these sizes share at least if they are similar."""
    return F.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def _room(threshold: float) -> Column:
    """Whether a pair of ``_met``, all shared words of both prefixes counted, can still be similar.

    Positional filter: what follows the first shared word, itself included.  Prefix overlap: a shared
    word is either in both prefixes (as long as the pair needs, ``SLACK`` more, the sets' own at most) or behind
    the one that ends first.
    """
    a, b = F.col("a_size"), F.col("b_size")
    need = _overlap(a, b, threshold)
    behind = F.greatest(F.ceil(threshold * a - 1e-9), F.ceil(threshold * b - 1e-9), need - SLACK) - 1
    return (F.least(a - F.col("a_at"), b - F.col("b_at")) >= need) & (F.col("shared") + behind >= need)


def near_duplicates(sets: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """Addresses of the sets (each with its first address) that are similar to an earlier one."""
    facts = [*_ADDRESS, "size", *_SIGNATURE]
    def spread(df: DataFrame, prefix) -> DataFrame:
        return df.select(*facts, F.explode(prefix).alias("p")).select(
            *facts, F.shiftright("p", 31).cast("int").alias("at"), F.col("p").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("word"))

    # dealt by word once, for the heads and for the join with them
    rarest = spread(sets, F.slice("prefix", 1, HEADS)).repartition("word")
    heads = rarest.groupBy("word", F.pmod(F.xxhash64(*_ADDRESS), F.lit(CLASSES)).alias("class")).agg(
        F.min(F.struct(*facts, "at")).alias("head")).select("word", "head.*")
    # at most HEADS * CLASSES heads a line, the TRIES nearest of which are verified
    best = _met(heads, rarest, threshold, F.min("far").alias("far")).groupBy(*_PAIR[3:]).agg(F.explode(F.slice(F.sort_array(
        F.collect_list(F.struct("far", (-F.col("shared")).alias("s"), *_PAIR[:3]))), 1, TRIES)).alias("a"))
    pairs = stored(best.select(*[f"a.{c}" for c in _PAIR[:3]], *_PAIR[3:]), "line-pairs")
    # what is not settled here is joined in full below
    held = _words_of(pairs, lines)
    settled = _alike(pairs, held, threshold)
    discard(pairs, held)
    release(sets.sparkSession)
    # ``till``: a settled set is the earlier one of a pair only, as no address is below its own
    open_ = sets.join(settled.withColumn("done", F.lit(True)), _ADDRESS, "left")
    left = stored(open_.withColumn("till", F.when(F.col("done"), F.lit(-(1 << 63))).otherwise(F.col("d"))).drop("done"), "line-open")
    facts.append("till")
    parts = []
    for turn in range(PASSES):  # the words are dealt to passes, so the shuffled rows of one pass at a time take disk
        rows = spread(left, "prefix").where(F.pmod("word", F.lit(PASSES)) == turn)
        parts.append(stored(_met(rows, rows, threshold, F.min("a_till").alias("a_till")), "line-part"))
        release(sets.sparkSession)
    pairs = reduce(DataFrame.union, parts).groupBy(*_PAIR, "a_size", "b_size").agg(
        F.sum("shared").alias("shared"), F.min("a_at").alias("a_at"), F.min("b_at").alias("b_at"))
    later = _settled(pairs.where(_room(threshold)).select(*_PAIR), lines, threshold)
    discard(left, *parts)
    return settled.union(later)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``text_col`` freed of later matches, plus ``lines_removed`` (replaced if it exists)."""
    docs = docs.drop("lines_removed")
    addressed = _documents(docs, id_col, text_col)
    lines = _lines(addressed, text_col)
    counts = word_counts(lines)
    marked = stored(_sets(lines, counts, threshold), "line-marks")
    discard(counts)
    sets = stored(marked.groupBy("k1", "k2").agg(
        F.min(F.struct(*_ADDRESS)).alias("first"), F.any_value("size").alias("size"), *[F.any_value(s).alias(s) for s in _SIGNATURE],
        F.any_value("prefix").alias("prefix"), F.count(F.lit(1)).alias("c")).select(
        "k1", "k2", "first.*", "size", *_SIGNATURE, "prefix", "c"), "line-sets")
    release(docs.sparkSession)
    later = near_duplicates(sets.where(F.size("prefix") > 0).select(*_ADDRESS, "size", *_SIGNATURE, "prefix"), lines, threshold)
    gone = sets.join(later.withColumn("gone", F.lit(True)), _ADDRESS, "left").where("gone or c > 1").select(
        "k1", "k2", F.struct(*_ADDRESS).alias("first"), F.coalesce("gone", F.lit(False)).alias("gone"))
    gone = stored(gone, "line-gone")
    removed = marked.select("k1", "k2", *_ADDRESS).join(gone, ["k1", "k2"]).where(
        F.col("gone") | (F.struct(*_ADDRESS) != F.col("first")))
    per_doc = stored(removed.groupBy(F.col("d").alias("_d"), F.col("v").alias("_v")).agg(
        F.collect_set("n").alias("_gone")), "line-removed")
    discard(marked, sets, gone)
    release(docs.sparkSession)
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda line, i: ~F.array_contains(F.col("_gone"), i))
    out = addressed.join(per_doc, ["_d", "_v"], "left")
    changed = F.col("_gone").isNotNull()
    return out.select(*[(F.when(changed, F.array_join(kept, "\n")).otherwise(F.col(text_col)).alias(text_col)
                         if c == text_col else F.col(f"`{c}`")) for c in docs.columns],
                      F.coalesce(F.size("_gone"), F.lit(0)).alias("lines_removed"))
