"""Text expressions with Python ``re`` / ``str`` semantics, built from Spark SQL functions.

Every function takes and returns a ``Column`` and stays inside whole-stage codegen.
The regex text avoids ``\\w``, ``\\s``, ``\\b`` and ``$`` because Java and Python disagree on
them; the classes below are written so the same pattern text also runs in DuckDB (RE2),
which the oracle queries rely on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------
# Fixed values (must equal Python's definitions for the results to agree).
#   WORD:  Python str-pattern \w  -> letters, numbers, underscore
#   WS:    Python str-pattern \s  -> \t \n \v \f \r, \x1c-\x1f, space, \x85, Unicode Z*
#   DIGIT: Python str-pattern \d  -> Unicode decimal digits
#   NON_ENGLISH_LETTERS: the letters whose presence marks a text as not English
#   (Icelandic, Danish, German, Italian, French, Spanish, Swedish, Norwegian, Finnish,
#   Portuguese, Polish letters, then the Russian alphabet), lower case.
#   NA_TOKENS: strings pandas' CSV reader turns into missing values.
# ---------------------------------------------------------------------------------------
WORD = r"\p{L}\p{N}_"
WS = r"\t-\r\x1c-\x20\x85\p{Z}"
DIGIT = r"\p{Nd}"
NON_ENGLISH_LETTERS = (
    "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿąćęłńśźż"
    "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
)
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# Words removed from the start / end of a catalogue description.
LEADING_ARTICLES = ("the", "a", "an")
TRAILING_COMPANY = ("inc", "ltd", "llc", "co", "corp", "corporation")



def char_class(chars: str) -> str:
    """Regex class for a set of letters, with runs of consecutive code points written as
    ranges (Java tests a range in one step, a list of singletons one by one)."""
    cps = sorted({ord(c) for c in chars})
    out, i = [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        out.append(chr(cps[i]) if j == i else f"{chr(cps[i])}-{chr(cps[j])}")
        i = j + 1
    return "[" + "".join(out) + "]"


NON_ENGLISH_CLASS = char_class(NON_ENGLISH_LETTERS)
# The same whitespace set spelt out character by character (the Unicode Z categories are
# U+0020, U+00A0, U+1680, U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000).
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")
WS_RUN = f"[{WS}]+"
NUMBER = rf"\A[{WS}]*[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|(?i:inf|infinity))[{WS}]*\z"
STRIP_PATTERN = rf"\A[{WS}]+|[{WS}]+\z"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: remove leading and trailing Python whitespace (not only spaces).
    ``btrim`` with the explicit set only touches the trimmed ends of long texts."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def collapse_ws(c) -> Column:
    """``' '.join(t.split())``: whitespace runs to one space, trimmed."""
    return F.trim(F.regexp_replace(_c(c), WS_RUN, " "))


def is_blank(c) -> Column:
    """``not isinstance(t, str) or not t.strip()``."""
    c = _c(c)
    return c.isNull() | ~c.rlike(f"[^{WS}]")


def na_to_null(c) -> Column:
    """Strings pandas reads as missing become null (Spark's CSV reader knows one token only)."""
    c = _c(c)
    return F.when(c.isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def clean_description(c) -> Column:
    """Catalogue description cleaning: null -> ''; lower; punctuation -> space; collapse
    whitespace; drop one leading article and one trailing company suffix."""
    t = F.lower(_c(c))
    t = F.regexp_replace(t, f"[^{WORD}{WS}]", " ")
    t = collapse_ws(t)
    t = F.regexp_replace(t, r"\A(" + "|".join(LEADING_ARTICLES) + ") ", "")
    t = F.regexp_replace(t, r" (" + "|".join(TRAILING_COMPANY) + r")\z", "")
    return F.coalesce(t, F.lit(""))


def code_for_cleaning(c) -> Column:
    """Catalogue code: text, every literal '.0' removed, then numeric; bad or NaN -> null.
    Java would also read type suffixes (``12D``), so the shape is tested first."""
    txt = F.replace(_c(c).cast("string"), F.lit(".0"), F.lit(""))
    num = F.when(txt.rlike(NUMBER), txt.try_cast("double"))
    return F.when(F.isnan(num), F.lit(None).cast("double")).otherwise(num)


def code_for_embedding(c) -> Column:
    """Catalogue code for embedding: text with every literal '.0' removed, kept as text."""
    return F.replace(_c(c).cast("string"), F.lit(".0"), F.lit(""))


def embed_text(code, description) -> Column:
    """``code + ' - ' + description``."""
    return F.concat(_c(code), F.lit(" - "), _c(description))


def strip_digits(c) -> Column:
    """Account text: remove digit runs, then collapse whitespace."""
    return collapse_ws(F.regexp_replace(_c(c), f"[{DIGIT}]+", ""))


def combined_text(description, account) -> Column:
    """``f"{description} {account}"`` -- the trailing space stays when the account is empty."""
    return F.concat(_c(description), F.lit(" "), _c(account))


def is_english(c) -> Column:
    """Letter heuristic: true unless the lower-cased text has one of the non-English
    letters; a missing text is false."""
    c = _c(c)
    return F.coalesce(~F.lower(c).rlike(NON_ENGLISH_CLASS), F.lit(False))


def valid_naics_code(c) -> Column:
    """2 to 6 ASCII digits (one trailing newline tolerated, like Python's ``$``); null -> false."""
    return F.coalesce(_c(c).rlike(r"\A[0-9]{2,6}\n?\z"), F.lit(False))


def format_elapsed(seconds) -> Column:
    """``str(timedelta(seconds=int(s)))``: ``H:MM:SS`` with unpadded hours and, when the day
    count is not zero, a ``'N day(s), '`` prefix (negative values borrow a day)."""
    s = _c(seconds).cast("double").cast("long")  # int() truncates toward zero
    days = F.floor(s / F.lit(86400)).cast("long")
    rem = F.pmod(s, F.lit(86400))
    hms = F.format_string("%d:%02d:%02d", (rem / 3600).cast("long"),
                          ((rem % 3600) / 60).cast("long"), rem % 60)
    prefix = F.concat(days.cast("string"),
                      F.when(F.abs(days) == 1, F.lit(" day, ")).otherwise(F.lit(" days, ")))
    return F.when(days == 0, hms).otherwise(F.concat(prefix, hms))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Spark inlines expressions into higher-order-function lambdas, so an array used inside
    ``transform``/``aggregate`` would otherwise be recomputed for every element."""
    return F.get(F.transform(F.array(value), body), 0)
