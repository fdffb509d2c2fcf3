"""Quality rules: a table of thresholds compiled into one projection over the whole text.

``measures`` gives the counts of a text as columns, ``RULES`` names what must hold of them and
``verdict`` turns that table into expressions: a rule bounds a count, or 100 times a count against
another one, so all comparisons are between integers.  Nothing is shuffled, no user function runs and
every text is read whole, once.

Repeated three-word windows are found inside the row: windows are hashed, sorted by hash, and only
windows whose hash occurs again are compared as text, so a collision of hashes never counts.  A text of
n words costs n log n at most, and no sort at all if its windows differ.

Edge cases: a null or empty text has no words, so only counts of 0, and fails the length rule; fewer than
three words have no window; a line without a word is no line; repeated rows are judged each for itself; an
empty table gives no rows.  Input columns are dropped, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendcode.functions.text import let
from spendcode.llm.common import ascii_lower

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Frequent short words of English, German, French and Spanish; running text has one in five.
STOP_WORDS = tuple("""the of and to in is that for was with be by are this as at from
les la le de et en un une que qui est dans pour par sur
der die und den von zu das mit ist dem nicht ein
los del el con las se por para""".split())


class Rule(NamedTuple):
    """``least <= part <= most``, or of ``100 * part`` in ``whole`` where a whole is named; None: no bound."""
    name: str
    part: str
    whole: str | None = None
    least: int | None = None
    most: int | None = None
    base: bool = False


RULES = (
    Rule("too_short", "n_words", least=50, base=True),
    Rule("repetitive", "n_repeat_words", "n_words", most=50, base=True),
    Rule("word_length", "word_chars", "n_words", least=300, most=1000),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("stop_words", "n_stop_words", "n_words", least=4),
    Rule("wordless", "n_letter_words", "n_words", least=80),
    Rule("capitals", "n_capital_words", "n_words", most=30),
    Rule("same_lines", "n_dup_lines", "n_lines", most=40),
    Rule("bullets", "n_bullet_lines", "n_lines", most=90),
    Rule("cut_lines", "n_cut_lines", "n_lines", most=30),
)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _beside_itself(items: Column, same) -> Column:
    """Members of a sorted array that are the ``same`` as a neighbour."""
    return let(items, lambda a: F.filter(a, lambda x, i: (
        F.coalesce(same(x) == same(F.get(a, i - 1)), F.lit(False)) | F.coalesce(same(x) == same(F.get(a, i + 1)), F.lit(False)))))


def repeat_words(words: Column) -> Column:
    """How many words lie in three-word windows that the text has twice or more; ``words``: an array column."""
    def window(i):
        return [F.get(words, i + k) for k in range(3)]

    starts = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(*window(i)))

    def covered(hs):
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        maybe = _beside_itself(pairs, lambda p: p["h"])
        texts = F.sort_array(F.transform(maybe, lambda p: F.struct(F.concat_ws(" ", *window(p["i"])).alias("w"), p["i"].alias("i"))))
        places = F.sort_array(F.transform(_beside_itself(texts, lambda p: p["w"]), lambda p: p["i"]))
        # windows in order of their places: each adds what lies beyond the one before
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(places, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    none = F.lit(0).cast("bigint")
    return F.when(F.size(words) < 3, none).otherwise(
        let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), none).otherwise(covered(hs))))


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the counts that rules may use, all bigint."""
    def count(items, holds):
        return F.size(F.filter(items, holds)).cast("bigint")

    whole = F.coalesce(F.col(text), F.lit(""))
    words, lines, body = F.col("words"), F.col("lines"), F.col("body")
    rows = docs.select(F.col(key), whole.alias("body")).select(
        key, "body", F.filter(F.split("body", SPACE_RUN), lambda w: w != "").alias("words"),
        F.filter(F.split("body", "\n"), lambda x: x.rlike(WORD_CHAR)).alias("lines"))
    return rows.select(
        key, F.size(words).cast("bigint").alias("n_words"),
        F.length(_without(body, SPACES)).cast("bigint").alias("word_chars"),
        (F.length(body) - F.length(_without(body, SYMBOLS))).cast("bigint").alias("n_symbols"),
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        repeat_words(words).alias("n_repeat_words"),
        count(words, lambda w: ascii_lower(w).isin(*STOP_WORDS)).alias("n_stop_words"),
        count(words, lambda w: F.upper(w) != F.lower(w)).alias("n_letter_words"),
        count(words, lambda w: (F.upper(w) != F.lower(w)) & (F.upper(w) == w) & (F.length(w) > 1)).alias("n_capital_words"),
        count(lines, lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•")).alias("n_bullet_lines"),
        count(lines, lambda x: F.rtrim(x).endswith("...")).alias("n_cut_lines"))


def broken(rule: Rule) -> Column:
    part, whole = F.col(rule.part), F.col(rule.whole) if rule.whole else F.lit(1)
    scaled = part * 100 if rule.whole else part
    out = F.lit(False)
    if rule.least is not None:
        out = out | (scaled < whole * rule.least)
    if rule.most is not None:
        out = out | (scaled > whole * rule.most)
    return out


def verdict(measured: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds ``failed`` (names of the broken rules, by comma), ``base_failed`` and ``kept``."""
    failed = F.concat_ws(",", *[F.when(broken(r), F.lit(r.name)) for r in rules])
    base = F.lit(False)
    for r in rules:
        if r.base:
            base = base | broken(r)
    return measured.withColumns({"failed": failed, "base_failed": base}).withColumn("kept", F.col("failed") == "")


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    return verdict(measures(docs), rules)
