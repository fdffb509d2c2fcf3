"""Recorded stand-in for the classification model.

No model is reachable here, so the registered queries answer requests with a
deterministic function of the request: the first 32 bits of the request key choose the
code, the confidence and the answer's shape (including malformed and refused answers and
failed requests), and the detection and translation stages read the text that was put
into the prompt.  It is a *responder* like any other: it receives only the misses of the
response store and returns ``response`` and ``error`` columns.

The same answer rule is emitted as SQL for Spark and for DuckDB, so the oracle can
recompute the recorded answers independently of the Spark plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendcode.functions.text import NON_ENGLISH_CLASS

# ---------------------------------------------------------------------------------------
# Fixed values of the stand-in (our own, not the reference's).
# ---------------------------------------------------------------------------------------
INDUSTRIES = ("Coffee and Tea Manufacturing", "Custom Computer Programming Services",
              "Office Supplies Stores", "Fluid Milk Manufacturing", "Soft Drink Manufacturing",
              "Janitorial Services", "Couriers and Express Delivery Services", "Commercial Printing")
PRODUCTS = ("Tea bags", "Desktop computers", "Business application software", "Paper towels",
            "Fluid milk", "Roasted coffee", "Printer paper", "Courier delivery services")
FAILURE_MODULUS = 53
FAILURE_TEXT = "stand-in: request failed"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pick(values, v: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {_lit(x)}" for i, x in enumerate(values))
    return f"(CASE {v} % {len(values)} {whens} END)"


class _Sql:
    """Engine-specific spellings."""

    def __init__(self, engine: str):
        self.engine = engine

    def v(self, key: str) -> str:
        if self.engine == "spark":
            return f"CAST(conv(substr({key}, 1, 8), 16, 10) AS BIGINT)"
        return f"CAST(('0x' || substr({key}, 1, 8)) AS BIGINT)"

    def matches(self, e: str, pat: str) -> str:
        if self.engine == "spark":
            return f"({e} RLIKE {_lit(pat)})"
        return f"regexp_matches({e}, {_lit(pat)})"

    def delete(self, e: str, pat: str) -> str:
        if self.engine == "spark":
            return f"regexp_replace({e}, {_lit(pat)}, '')"
        return f"regexp_replace({e}, {_lit(pat)}, '', 'g')"

    def s(self, sql: str) -> str:
        return sql.replace("VARCHAR", "STRING") if self.engine == "spark" else sql


def answer_sql(stage: str, engine: str, key: str = "request_key", payload: str = "payload") -> str:
    """SQL for the stand-in answer of one stage (``detect_p1``, ``naics_p2``, ...)."""
    e = _Sql(engine)
    v = e.v(key)
    nl = "chr(10)"
    kind, dialect = stage.rsplit("_", 1)
    english = f"coalesce(NOT {e.matches(f'lower({payload})', NON_ENGLISH_CLASS)}, false)"
    conf = f"CAST(40 + ({v} // 7) % 61 AS VARCHAR)" if engine == "duckdb" else \
        f"CAST(40 + floor({v} / 7) % 61 AS STRING)"
    shape = f"(({v} // 3) % 6)" if engine == "duckdb" else f"(floor({v} / 3) % 6)"
    if kind == "detect":
        yes, no = ("True", "False") if dialect == "p1" else ("yes", "no")
        return (f"CASE WHEN {english} THEN (CASE {v} % 3 WHEN 0 THEN {_lit(yes)} "
                f"WHEN 1 THEN ' ' || lower({_lit(yes)}) || {nl} ELSE upper({_lit(yes)}) END) "
                f"ELSE {_lit(no)} END")
    if kind == "translate":
        return e.delete(f"lower({payload})", NON_ENGLISH_CLASS)
    if kind == "describe":
        return f"'UNSPSC Description: ' || {_pick(PRODUCTS, v)}"
    label = "NAICS" if kind == "naics" else "UNSPSC"
    if kind == "naics":
        code = f"CAST(100000 + {v} % 900000 AS VARCHAR)"
        desc = _pick(INDUSTRIES, v)
    else:
        code = f"CAST(10000000 + {v} % 90000000 AS VARCHAR)"
        desc = _pick(PRODUCTS, v)
    code = e.s(code)
    dlabel = f"{label} Description" if dialect == "p1" else "Description"
    pct = "'%'" if dialect == "p1" else "''"
    exact = (f"'{label} Code: ' || {code} || {nl} || '{dlabel}: ' || {desc} || {nl} || "
             f"'Confidence: ' || {conf} || {pct}")
    return e.s(f"""CASE {shape}
        WHEN 4 THEN '{label} Code: ' || {code} || {nl} || '{dlabel}: ' || {desc}
        WHEN 5 THEN 'I cannot classify this.'
        ELSE {exact} END""")


def failed_sql(engine: str, key: str = "request_key") -> str:
    return f"({_Sql(engine).v(key)} % {FAILURE_MODULUS} = 7)"


def replay_responder(requests: DataFrame, stage: str) -> DataFrame:
    """Answer each request row of ``stage`` with the recorded stand-in answer.  The text
    put into the prompt is ``payload`` when the request carries it, else the user prompt
    itself (the application's detection and translation prompts are the bare text)."""
    payload = "payload" if "payload" in requests.columns else "user"
    answer = F.expr(answer_sql(stage, "spark", payload=payload))
    failed = F.expr(failed_sql("spark"))
    return requests.select(
        "*",
        F.when(failed, F.lit(None).cast("string")).otherwise(answer).alias("response"),
        F.when(failed, F.lit(FAILURE_TEXT)).otherwise(F.lit(None).cast("string")).alias("error"),
    )
