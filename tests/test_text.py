"""Edge cases of the text expressions (expected values written by hand from Python's
``re``/``str``/``timedelta`` semantics)."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendcode.functions import text as TX


def one_col(spark, values, expr, typ=T.StringType()):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)],
                               T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", typ)]))
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_clean_description(spark):
    cases = {None: "", "The Acme, Inc.": "acme", "A an thing": "an thing", "the": "the",
             "Ab  mjólk (1L)": "ab mjólk 1l", "Foo_Bar & Co.": "foo_bar", "Big Co Inc": "big co",
             "  ": "", "An apple\tLtd": "apple", "ÞÓR ehf.": "þór ehf"}
    got = one_col(spark, list(cases), TX.clean_description)
    assert got == list(cases.values())


def test_code_for_cleaning(spark):
    got = one_col(spark, ["51142018.0", "10.05", "abc", None, "NaN", "7"], TX.code_for_cleaning)
    assert got == [51142018.0, 105.0, None, None, None, 7.0]


def test_code_for_embedding(spark):
    assert one_col(spark, ["51142018.0", "10.05", "12"], TX.code_for_embedding) == ["51142018", "105", "12"]


def test_strip_digits(spark):
    got = one_col(spark, ["2345 Food at the cafeteria", "12 A 34  B", "999", "٣٤ x"], TX.strip_digits)
    assert got == ["Food at the cafeteria", "A B", "", "x"]


def test_combined_text_keeps_trailing_space(spark):
    df = spark.createDataFrame([("desc", "")], "d string, a string")
    assert df.select(TX.combined_text(F.col("d"), F.col("a"))).first()[0] == "desc "


def test_is_english(spark):
    got = one_col(spark, ["Plain office paper", "Matur á kaffistofu", "ÉCOLE", "Привет", None, ""],
                  TX.is_english)
    assert got == [True, False, False, False, False, True]


def test_is_blank_and_strip(spark):
    vals = [None, "", " \t\n", "　x ", "a"]
    assert one_col(spark, vals, TX.is_blank) == [True, True, True, False, False]
    assert one_col(spark, vals, TX.py_strip) == [None, "", "", "x", "a"]


def test_valid_naics_code(spark):
    vals = ["54", "541511", "5415111", "7", "", None, "12a", "123\n", "١٢٣"]
    assert one_col(spark, vals, TX.valid_naics_code) == [True, True, False, False, False, False,
                                                         False, True, False]


def test_format_elapsed(spark):
    vals = [0.0, 59.9, 3661.0, 90061.0, 864000.0, -1.0, -172800.0, -0.5]
    got = one_col(spark, vals, TX.format_elapsed, T.DoubleType())
    assert got == ["0:00:00", "0:00:59", "1:01:01", "1 day, 1:01:01", "10 days, 0:00:00",
                   "-1 day, 23:59:59", "-2 days, 0:00:00", "0:00:00"]


def test_na_tokens(spark):
    assert one_col(spark, ["NA", "None", "null", "n/a", "x"], TX.na_to_null) == [None, None, None, None, "x"]


def test_char_class_is_the_same_set():
    import re
    cls = re.compile(TX.NON_ENGLISH_CLASS)
    for cp in range(0x20, 0x500):
        ch = chr(cp)
        assert bool(cls.fullmatch(ch)) == (ch in TX.NON_ENGLISH_LETTERS), hex(cp)


def test_whitespace_set_matches_python():
    import re
    ws_class = re.compile(f"[{TX.WS.replace('\\p{Z}', '')}]")
    for cp in range(0x110000):
        ch = chr(cp)
        assert (ch in TX.WS_CHARS) == ch.isspace(), hex(cp)
    assert ws_class  # the regex class is also used in Spark/DuckDB patterns
