"""Answer parsers against the edge table of FIXTURES.md section 4."""

import pytest

from spendcode.functions import parsers as P

NL = "\n"


def naics(code="541511", desc="Custom Programming", conf="95%", desc_line=True, conf_line=True, sep=" "):
    lines = [f"NAICS Code:{sep}{code}"]
    if desc_line:
        lines.append(f"NAICS Description: {desc}")
    if conf_line:
        lines.append(f"Confidence: {conf}")
    return NL.join(lines)


NONE = (None, None, 0)
ROWS = [
    (naics(), ("541511", "Custom Programming", 95), ("541511", "Custom Programming", 95)),
    (naics(conf="95"), ("541511", "Custom Programming", 0), ("541511", "Custom Programming", 95)),
    (naics(conf="95.5%"), ("541511", "Custom Programming", 0), ("541511", "Custom Programming", 95)),
    (naics(code="12345678"), NONE, ("123456", "Custom Programming", 95)),
    (naics(code="7"), NONE, NONE),
    (naics(desc="Custom\nProgramming"), ("541511", "Custom\nProgramming", 95), ("541511", "Custom", 95)),
    (naics(desc_line=False), ("541511", None, 95), NONE),
    (naics(conf_line=False), ("541511", "Custom Programming", 0), NONE),
    ("I cannot classify this.", NONE, NONE),
    ("", NONE, NONE),
    (None, NONE, NONE),
    (naics(sep=""), ("541511", "Custom Programming", 95), NONE),
    (naics(conf="250%"), ("541511", "Custom Programming", 250), ("541511", "Custom Programming", 250)),
    ("  \n" + naics() + " \t", ("541511", "Custom Programming", 95), ("541511", "Custom Programming", 95)),
]


def parse_all(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.orderBy("i").select(fn("t").alias("r")).select("r.*").collect()
    return [tuple(r) for r in out]


@pytest.mark.parametrize("dialect", ["p1", "p2"])
def test_naics(spark, dialect):
    fn = P.naics_p1 if dialect == "p1" else P.naics_p2
    got = parse_all(spark, [r[0] for r in ROWS], fn)
    want = [r[1] if dialect == "p1" else r[2] for r in ROWS]
    assert got == want


def product(code, conf="95%"):
    return f"UNSPSC Code: {code}\nUNSPSC Description: Business software\nConfidence: {conf}"


def test_product_variants(spark):
    texts = [product("43211503"), product("432115"), "UNSPSC Description: Business software\nConfidence: 95%",
             "UNSPSC Code: 43211503\nUNSPSC Description: Business software", None]
    assert parse_all(spark, texts, P.unspsc_p1) == [
        ("432115", "Business software", 95), ("432115", "Business software", 95),
        (None, "Business software", 95), ("432115", "Business software", 0), NONE]
    assert parse_all(spark, texts, P.unspsc_p2) == [
        ("43211503", "Business software", 95), NONE, NONE, NONE, NONE]
    assert parse_all(spark, texts, P.unspsc_generic) == [
        ("43211503", "Business software", "95"), ("432115", "Business software", "95"),
        (None, "Business software", "95"), ("43211503", "Business software", None), (None, None, None)]


def test_describe(spark):
    df = spark.createDataFrame([(0, "UNSPSC Description: Tea bags\nmore"), (1, "UNSPSC Description: \nx"),
                                (2, "nothing"), (3, " UNSPSC Description:  padded ")], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(P.unspsc_describe("t")).collect()]
    assert got == ["Tea bags", None, None, " padded"]


def test_outcomes(spark):
    from pyspark.sql import functions as F
    from spendcode.functions import parsers as P
    body = lambda code, conf="Confidence: 90%", desc="{L} Description: Bolts": "\n".join(x for x in (code, desc, conf) if x)
    cases = [(None, "no_answer"), ("I cannot classify this.", "no_code"), (body("{L} Code: "), "no_code"), (body("{L} Code: n/a"), "bad_code"),
             (body("{L} Code: 7"), "bad_code"), (body("{L} Code: 123456", desc=None), "incomplete"), (body("{L} Code: 123456", conf=None), "incomplete"),
             (body("{L} Code: 123456", conf="Confidence: 0%"), "ok"), (body("{L} Code: 123456", conf="Confidence: 100%"), "ok"),
             (body("{L} Code: 123456", conf="Confidence: 101%"), "confidence_out_of_range"),
             (body("{L} Code: 123456", conf="Confidence: 99999999999999999999%"), "confidence_out_of_range"), (body("{L} Code: 123456"), "ok")]
    for parser, label in (("naics_p1", "NAICS"), ("unspsc_p1", "UNSPSC")):
        df = spark.createDataFrame([(i, t and t.replace("{L}", label)) for i, (t, _) in enumerate(cases)], "i int, t string")
        got = {r["i"]: r["o"] for r in df.select("i", P.parse_outcome("t", parser).alias("o")).collect()}
        assert got == {i: want for i, (_, want) in enumerate(cases)}, parser
    strict = spark.createDataFrame([("UNSPSC Code: 123456\nDescription: x\nConfidence: 5",), ("UNSPSC Code: 12345678\nDescription: x\nConfidence: 5",)], "t string")
    assert [r[0] for r in strict.select(P.parse_outcome(F.col("t"), "unspsc_p2")).collect()] == ["bad_code", "ok"]
