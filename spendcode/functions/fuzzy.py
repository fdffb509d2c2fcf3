"""String similarity: the two scorers the matcher uses, as Column expressions and as
small Python helpers for the per-partition matcher.

``ratio(a, b)`` is the indel-based similarity ``2*LCS / (len(a)+len(b))`` scaled to 0..100
and rounded half-to-even (equal strings 100, otherwise an empty side 0).  It is *not*
the unit-cost edit distance (which charges 1 for a substitution).  The token-sort ratio first normalises
both strings (drop U+0080..U+00FF, non-word characters to spaces, lower case, split,
sort the tokens, join with one space) and then applies ``ratio``.

The LCS length uses the bit-parallel recurrence ``U = V & M[c]; V = (V + U) | (V - U)``
with one bit per character of the shorter string.  As a Spark expression the state is one
BIGINT of up to 62 bits; pairs whose sides are both longer run the recurrence over an array
of such words, the sum's carry going from word to word (``V - U`` clears bits only, so it
never borrows).  Strings of any length stay in the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendcode.functions.text import WORD, let

NATIVE_MAX = 62
# Characters the token-sort scorer deletes before scoring (Latin-1 supplement).
LATIN1_HIGH = r"[\x{80}-\x{FF}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_sort_key(c) -> Column:
    """Normalised, token-sorted form of an (already lower-cased) string."""
    t = F.regexp_replace(_c(c), LATIN1_HIGH, "")
    t = F.lower(F.regexp_replace(t, f"[^{WORD}]", " "))
    tokens = F.array_remove(F.split(t, " +"), "")
    return F.array_join(F.sort_array(tokens), " ")  # without a comparator called for each two tokens


def _bit(i: Column) -> Column:
    """BIGINT with only bit ``i`` set (``shiftleft`` with a column shift)."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _lcs_native(a: Column, b: Column) -> Column:
    """LCS length when ``length(a) <= NATIVE_MAX`` (bits over ``a``, iterate over ``b``)."""

    def with_chars(chars_a):
        m = F.size(chars_a)
        positions = F.sequence(F.lit(0), m - F.lit(1))

        def mask_of(ch):
            return F.aggregate(positions, F.lit(0).cast("long"),
                               lambda acc, i: acc.bitwiseOR(
                                   F.when(F.get(chars_a, i) == ch, _bit(i))
                                   .otherwise(F.lit(0).cast("long"))))

        def with_full(full):
            def step(v, mask):
                u = v.bitwiseAND(mask)
                return (v + u).bitwiseOR(v - u).bitwiseAND(full)

            chars_b = F.regexp_extract_all(b, F.lit("(?s)."), 0)
            v = F.aggregate(F.transform(chars_b, mask_of), full, step)
            return m - F.bit_count(v)

        return let(_bit(m) - F.lit(1), with_full)

    return let(F.regexp_extract_all(a, F.lit("(?s)."), 0), with_chars)


def _lcs_words(a: Column, b: Column) -> Column:
    """LCS length for any lengths: bits over ``a`` in words of ``NATIVE_MAX``, iterate over ``b``."""
    zero, full_word = F.lit(0).cast("long"), F.lit((1 << NATIVE_MAX) - 1)

    def with_chars(chars_a):
        m = F.size(chars_a)
        words = F.sequence(F.lit(0), F.floor((m - 1) / NATIVE_MAX).cast("int"))

        def mask_of(ch):
            """The character's positions, word by word."""
            def word(w):
                part = F.slice(chars_a, w * NATIVE_MAX + 1, NATIVE_MAX)
                bits = F.transform(part, lambda x, i: F.when(x == ch, _bit(i)).otherwise(zero))
                return F.aggregate(bits, zero, lambda acc, bit: acc.bitwiseOR(bit))
            return F.transform(words, word)

        def with_masks(masks):
            empty = F.transform(words, lambda w: zero)

            def step(v, ch):
                def add(state, w):
                    vw, mw = F.get(v, w), F.get(F.coalesce(F.element_at(masks, ch), empty), w)
                    total = vw + vw.bitwiseAND(mw) + state["carry"]
                    kept = total.bitwiseAND(full_word).bitwiseOR(vw.bitwiseAND(F.bitwise_not(mw)))
                    return F.struct(F.shiftright(total, NATIVE_MAX).alias("carry"), F.array_append(state["out"], kept).alias("out"))
                start = F.struct(zero.alias("carry"), F.array().cast("array<bigint>").alias("out"))
                return F.aggregate(words, start, add, lambda state: state["out"])

            v = F.aggregate(F.regexp_extract_all(b, F.lit("(?s)."), 0), F.transform(words, lambda w: full_word), step)
            # bits past the end of ``a`` never match, so they stay set
            left = F.aggregate(F.transform(v, lambda w: F.bit_count(w)), F.lit(0), lambda acc, n: acc + n)
            return F.size(words) * NATIVE_MAX - left

        distinct = F.array_distinct(chars_a)
        return let(F.map_from_arrays(distinct, F.transform(distinct, mask_of)), with_masks)

    return let(F.regexp_extract_all(a, F.lit("(?s)."), 0), with_chars)


def _ratio_from_lcs(la: Column, lb: Column, lcs: Column) -> Column:
    total = la + lb
    dist = total - F.lit(2) * lcs
    r = (total - dist).cast("double") / total.cast("double")
    return F.bround(F.lit(100.0) * r, 0).cast("int")


def ratio(a, b) -> Column:
    """0..100 similarity of two string columns of any length; null if one is null."""
    a, b = _c(a), _c(b)
    la, lb = F.length(a), F.length(b)
    short = F.when(la <= lb, a).otherwise(b)
    long_ = F.when(la <= lb, b).otherwise(a)
    return (F.when(a.isNull() | b.isNull(), F.lit(None).cast("int"))
            .when(a == b, F.lit(100))
            .when((la == 0) | (lb == 0), F.lit(0))
            .when(F.least(la, lb) <= NATIVE_MAX, _ratio_from_lcs(la, lb, _lcs_native(short, long_)))
            .otherwise(_ratio_from_lcs(la, lb, _lcs_words(short, long_))))


def with_ratio(df: DataFrame, a: str, b: str, out: str, token_sort: bool = False) -> DataFrame:
    """Add ``out`` = ratio (or token-sort ratio) of columns ``a`` and ``b`` for every row."""
    ka, kb = (token_sort_key(a), token_sort_key(b)) if token_sort else (F.col(a), F.col(b))
    keyed = df.withColumn("_ka", ka).withColumn("_kb", kb)
    return keyed.withColumn(out, ratio("_ka", "_kb")).drop("_ka", "_kb")


# --- Python helpers (used inside tasks) --------------------------------------------------

_NONWORD = re.compile(r"\W")
_HIGH = {i: None for i in range(128, 256)}


def py_token_sort_key(s: str) -> str:
    s = _NONWORD.sub(" ", s.translate(_HIGH)).lower().strip()
    return " ".join(sorted(s.split()))


def char_masks(s: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, ch in enumerate(s):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    return masks


def char_masks_np(s: str, alphabet) -> dict[str, int]:
    """``char_masks`` restricted to ``alphabet`` (characters that can match at all),
    built with one vectorised comparison per character instead of one big-int OR per
    position (linear instead of quadratic in the length of ``s``)."""
    import numpy as np

    codes = np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)
    masks: dict[str, int] = {}
    for ch in alphabet:
        hit = codes == ord(ch)
        if hit.any():
            masks[ch] = int.from_bytes(np.packbits(hit, bitorder="little").tobytes(), "little")
    return masks


def lcs_with_masks(masks: dict[str, int], m: int, other: str) -> int:
    """LCS of the string behind ``masks`` (length ``m``) and ``other``."""
    full = (1 << m) - 1
    v = full
    get = masks.get
    for ch in other:
        u = v & get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def is_subsequence(short: str, text: str) -> bool:
    """Whether ``text`` holds all characters of ``short`` in their order, so that their LCS is ``short``."""
    find, at = text.find, 0
    for ch in short:
        at = find(ch, at) + 1
        if not at:
            return False
    return True


def lcs_length(a: str, b: str) -> int:
    if len(a) > len(b):
        a, b = b, a
    return lcs_with_masks(char_masks(a), len(a), b)


def score_from_lcs(la: int, lb: int, lcs: int) -> int:
    total = la + lb
    return int(round(100 * ((total - (total - 2 * lcs)) / total)))


def py_ratio(a: str, b: str) -> int:
    if a == b:
        return 100
    if not a or not b:
        return 0
    return score_from_lcs(len(a), len(b), lcs_length(a, b))


def upper_bound(la: int, lb: int) -> int:
    """Best score any pair of these lengths can reach (LCS <= shorter length)."""
    if la == 0 or lb == 0:
        return 100 if la == lb else 0
    return score_from_lcs(la, lb, min(la, lb))
