"""Parsers for the classification model's answers, as Column expressions.

Two dialects exist: the application's own (``p1``: labelled description that may span
lines, ``Confidence: N%`` with a mandatory percent sign, missing parts tolerated) and the
modular variant (``p2``: one-line ``Description:``, bare ``Confidence: N``, all three
parts required).  Every parser returns ``struct<code string, description string,
confidence int>``; "no result" is ``(null, null, 0)``.

A group that matched but is empty is ``''`` (not null), so every extraction tests the
match with ``rlike`` first and extracts second.  Digits are ASCII in both engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendcode.functions.text import WS, py_strip, valid_naics_code



def _null_s() -> Column:
    return F.lit(None).cast("string")

# ---------------------------------------------------------------------------------------
# Answer labels and the patterns the reference parses them with.
# ``{L}`` is the code label ("NAICS" or "UNSPSC").
# ---------------------------------------------------------------------------------------
P1_CODE_ANY = r"{L} Code:[" + WS + r"]*([0-9]+)"
P1_CODE_6 = r"{L} Code:[" + WS + r"]*([0-9]{6})"
P1_DESCRIPTION = r"(?s){L} Description:[" + WS + r"]*(.*?)(?:Confidence:|\z)"
P1_CONFIDENCE = r"Confidence:[" + WS + r"]*([0-9]+)%"
P2_NAICS_CODE = r"NAICS Code: ([0-9]{2,6})"
P2_UNSPSC_CODE = r"UNSPSC Code: ([0-9]{8})"
P2_DESCRIPTION = r"(?d)Description: (.*?)(?:\n|\z)"
P2_CONFIDENCE = r"Confidence: ([0-9]+)"
CODE_GIVEN = r"{L} Code:[ \t]*[^" + WS + r"]"
DESCRIBE_ONLY = r"(?d)UNSPSC Description: (.+?)(?:\n|\z)"


def _label(pattern: str, label: str) -> str:
    return pattern.replace("{L}", label)


def extract(text: Column, pattern: str) -> Column:
    """Group 1 of the first match, or null when the pattern does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(_null_s())


def _result(code: Column, description: Column, confidence: Column) -> Column:
    return F.struct(code.cast("string").alias("code"),
                    description.cast("string").alias("description"),
                    confidence.cast("int").alias("confidence"))


def none_result() -> Column:
    return _result(_null_s(), _null_s(), F.lit(0))


def _to_int(c: Column) -> Column:
    return c.try_cast("int")


def parse_p1(response, label: str, validate_code: bool, code_digits: str = "any") -> Column:
    """Application dialect.  Industry answers (``validate_code``) need a 2-6 digit code or
    the whole result is dropped; product answers keep whatever matched."""
    t = py_strip(F.col(response) if isinstance(response, str) else response)
    code_pat = _label(P1_CODE_ANY if code_digits == "any" else P1_CODE_6, label)
    code = extract(t, code_pat)
    desc = py_strip(extract(t, _label(P1_DESCRIPTION, label)))
    conf = F.coalesce(_to_int(extract(t, P1_CONFIDENCE)), F.lit(0))
    res = _result(code, desc, conf)
    if validate_code:
        return F.when(valid_naics_code(code), res).otherwise(none_result())
    return F.when(t.isNotNull(), res).otherwise(none_result())


def parse_p2(response, label: str) -> Column:
    """Modular dialect: code, one-line description and bare confidence all required."""
    t = py_strip(F.col(response) if isinstance(response, str) else response)
    code = extract(t, P2_NAICS_CODE if label == "NAICS" else P2_UNSPSC_CODE)
    desc = extract(t, P2_DESCRIPTION)
    conf = extract(t, P2_CONFIDENCE)
    ok = code.isNotNull() & desc.isNotNull() & conf.isNotNull()
    res = _result(code, py_strip(desc), F.coalesce(_to_int(conf), F.lit(0)))
    if label == "NAICS":
        ok = ok & valid_naics_code(code)
    return F.when(ok, res).otherwise(none_result())


def naics_p1(response) -> Column:
    return parse_p1(response, "NAICS", validate_code=True)


def naics_p2(response) -> Column:
    return parse_p2(response, "NAICS")


def unspsc_p1(response) -> Column:
    return parse_p1(response, "UNSPSC", validate_code=False, code_digits="6")


def unspsc_p2(response) -> Column:
    return parse_p2(response, "UNSPSC")


def unspsc_generic(response) -> Column:
    """Any-length product code, description as in the application dialect, confidence kept
    as *text* (missing -> null, not 0); the answer is not stripped first."""
    t = F.col(response) if isinstance(response, str) else response
    code = extract(t, _label(P1_CODE_ANY, "UNSPSC"))
    desc = py_strip(extract(t, _label(P1_DESCRIPTION, "UNSPSC")))
    conf = extract(t, P1_CONFIDENCE)
    return F.struct(code.alias("code"), desc.alias("description"), conf.alias("confidence"))


def unspsc_describe(response) -> Column:
    """One-line product description after a literal ``'UNSPSC Description: '``; not stripped."""
    t = py_strip(F.col(response) if isinstance(response, str) else response)
    return extract(t, DESCRIBE_ONLY)


def parse_status(response, parsed: Column) -> Column:
    """Per-answer outcome: ``no_answer`` (failed or not asked), ``no_code``, ``incomplete``
    (code without description or confidence), ``ok``."""
    r = F.col(response) if isinstance(response, str) else response
    return (F.when(r.isNull(), F.lit("no_answer"))
            .when(parsed["code"].isNull(), F.lit("no_code"))
            .when(parsed["description"].isNull() | (parsed["confidence"] == 0), F.lit("incomplete"))
            .otherwise(F.lit("ok")))


def parse_outcome(response, parser: str) -> Column:
    """What became of an answer, in finer steps than ``parse_status``: ``no_answer``; ``no_code`` (no code
    was given); ``bad_code`` (one was, but the parser takes none of that shape); ``incomplete`` (no
    description or no confidence, where a stated 0 % is one); ``confidence_out_of_range`` (accepted, but
    above 100); ``ok``."""
    t = py_strip(F.col(response) if isinstance(response, str) else response)
    label, p1 = ("NAICS" if parser.startswith("naics") else "UNSPSC"), parser.endswith("p1")
    pattern = {"naics_p1": _label(P1_CODE_ANY, label), "unspsc_p1": _label(P1_CODE_6, label), "naics_p2": P2_NAICS_CODE, "unspsc_p2": P2_UNSPSC_CODE}[parser]
    code = extract(t, pattern)
    taken = (valid_naics_code(code) if label == "NAICS" else code.isNotNull())
    description = extract(t, _label(P1_DESCRIPTION, label) if p1 else P2_DESCRIPTION)
    confidence = extract(t, P1_CONFIDENCE if p1 else P2_CONFIDENCE)
    return (F.when(t.isNull(), F.lit("no_answer"))
            .when(~t.rlike(_label(CODE_GIVEN, label)), F.lit("no_code"))
            .when(~F.coalesce(taken, F.lit(False)), F.lit("bad_code"))
            .when(description.isNull() | confidence.isNull(), F.lit("incomplete"))
            .when(F.length(F.ltrim(confidence, F.lit("0"))) > 2, F.when(F.ltrim(confidence, F.lit("0")) == "100", F.lit("ok"))
                  .otherwise(F.lit("confidence_out_of_range")))
            .otherwise(F.lit("ok")))


PARSERS = {"naics_p1": naics_p1, "naics_p2": naics_p2, "unspsc_p1": unspsc_p1, "unspsc_p2": unspsc_p2}


def parse_responses(responses, column: str, parser: str):
    """Parse a response table: adds ``code``, ``description``, ``confidence`` and
    ``parse_status`` columns; returns ``(parsed, counts per status)``."""
    parsed = responses.withColumn("_r", PARSERS[parser](column)).select(
        "*", F.col("_r.code").alias("code"), F.col("_r.description").alias("description"),
        F.col("_r.confidence").alias("confidence")).drop("_r")
    parsed = parsed.withColumn("parse_status", parse_status(column, F.struct("code", "description", "confidence")))
    counts = parsed.groupBy("parse_status").agg(F.count(F.lit(1)).alias("n"))
    return parsed, counts
