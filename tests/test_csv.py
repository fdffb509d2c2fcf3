import pytest

from spendcode.sources.csv_io import MissingColumns, read_catalogue, read_purchase_lines, write_csv


def write_text(spark, path, text):
    import os
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.csv"), "w", encoding="utf-8") as f:
        f.write(text)


CSV = ('procurment_description,account,extra\n'
       '"Whole Earth ""lemonade"", 1L",2345 Matur á kaffistofu,x\n'
       '"two\nlines",NA,None\n'
       'plain,  padded  ,\n')


def test_read_like_pandas(spark, tmp_path):
    p = str(tmp_path / "lines")
    write_text(spark, p, CSV)
    df = read_purchase_lines(spark, p)
    rows = [tuple(r) for r in df.orderBy("ordinal").select("procurement_description", "account", "extra").collect()]
    assert rows == [('Whole Earth "lemonade", 1L', "2345 Matur á kaffistofu", "x"),
                    ("two\nlines", None, None), ("plain", "  padded  ", None)]


def test_files_in_name_order_and_short_rows(spark, tmp_path):
    d = tmp_path / "many"
    d.mkdir()
    big = "".join(f"b{i},x\n" for i in range(2000))
    for name, body in (("b.csv", big), ("a.csv", "a0,y\na1\n"), ("c.csv", "c0,z\n")):
        (d / name).write_text("procurement_description,account\n" + body, encoding="utf-8")
    rows = read_purchase_lines(spark, str(d)).orderBy("ordinal").collect()
    assert [r["procurement_description"] for r in rows] == ["a0", "a1"] + [f"b{i}" for i in range(2000)] + ["c0"]
    assert rows[1]["account"] is None and len({r["ordinal"] for r in rows}) == len(rows)


def test_missing_columns(spark, tmp_path):
    p = str(tmp_path / "bad")
    write_text(spark, p, "description,other\nx,y\n")
    with pytest.raises(MissingColumns, match="procurement_description, account"):
        read_purchase_lines(spark, p)
    with pytest.raises(MissingColumns, match="code"):
        read_catalogue(spark, p)
    p2 = str(tmp_path / "p2")
    write_text(spark, p2, "description,x\nd,1\n")
    with pytest.raises(MissingColumns, match="description, account"):
        read_purchase_lines(spark, p2, dialect="p2")


def test_write_read_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', "line1\nline2", ""), (2, None, " sp ", "z")],
                               "n int, a string, b string, c string")
    p = str(tmp_path / "out")
    write_csv(df, p, single_file=True)
    import glob
    text = open(glob.glob(p + "/*.csv")[0], encoding="utf-8").read()
    assert text == 'n,a,b,c\n1,"a ""q"", b","line1\nline2",\n2,, sp ,z\n'


def test_surplus_fields_are_told(spark, tmp_path):
    from spendcode.sources.csv_io import read_csv, surplus_rows
    p = str(tmp_path / "surplus")
    write_text(spark, p, 'a,b\n"1,\n""x""",2\nc,d,EXTRA\nshort\n"e,f",g\n"h,i",j,k,"l,""\nm"\n')
    with pytest.raises(Exception, match="expected 2 fields, saw 3: c,d,EXTRA"):
        read_csv(spark, p).collect()
    with pytest.raises(Exception, match="expected 2 fields"):
        read_csv(spark, p).select("a").collect()  # columns that are not read do not hide it
    rows = read_csv(spark, p, on_surplus="skip").orderBy("ordinal").collect()
    assert [(r["a"], r["b"]) for r in rows] == [('1,\n"x"', "2"), ("short", None), ("e,f", "g")]
    assert rows[2]["ordinal"] - rows[0]["ordinal"] == 3
    assert sorted((r["fields"], r["record"].strip()) for r in surplus_rows(spark, p).collect()) == [(3, "c,d,EXTRA"), (4, '"h,i",j,k,"l,""\nm"')]


def test_cleaned_catalogue_is_read_back(spark, tmp_path):
    from spendcode.plans.catalog_job import clean_catalogue_job
    from spendcode.sources.csv_io import read_cleaned_catalogue
    p = str(tmp_path / "cat")
    write_text(spark, p, 'code,description\n51142018.0,"Foo, ""Bar"" Inc."\n6,foo  bar\nx,Zed\n,\n')
    for kind in ("parquet", "csv"):
        clean_catalogue_job(spark, p, str(tmp_path / f"out_{kind}"), output_format=kind)
        got = read_cleaned_catalogue(spark, str(tmp_path / f"out_{kind}"), input_format=kind)
        assert sorted((r["description"], r["code"]) for r in got.collect()) == [("", None), ("foo bar", 51142018.0), ("zed", None)]
        assert got.schema["code"].dataType.simpleString() == "double"
    with pytest.raises(MissingColumns):
        read_cleaned_catalogue(spark, p.replace("/cat", "/lines2"), input_format="csv") if not write_text(spark, p.replace("/cat", "/lines2"), "a,b\n1,2\n") else None


def random_csv(rnd, rows, end):
    def cell():
        return rnd.choice(("plain", "", "a,b", 'say ""hi""', "two\nlines", "x" * rnd.randrange(60), "é\n\n中", " pad "))
    quoted = lambda t: f'"{t}"' if any(c in t for c in ',"\n') or rnd.random() < 0.2 else t
    lines = [",".join(quoted(cell()) for _ in range(rnd.choice((3, 3, 3, 2, 1)))) for _ in range(rows)]
    return "a,b,c" + end + "".join((x or '""') + end + (end if rnd.random() < 0.1 else "") for x in lines)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_split_reading_equals_reading_by_one_task(spark, tmp_path, end):
    import random
    from spendcode.sources.csv_io import read_csv
    rnd = random.Random(17)
    d = tmp_path / "split"
    d.mkdir()
    for name in ("b.csv", "a.csv"):
        (d / name).write_text(random_csv(rnd, 600, end), encoding="utf-8", newline="")
    (d / "c.csv").write_text("a,b,c" + end + '"' + ("long\n" * 3000) + '",1,2' + end + "last,3,4", encoding="utf-8", newline="")  # a record over many blocks
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    want = [tuple(r)[:-1] for r in read_csv(spark, str(d)).orderBy("ordinal").collect()]
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = read_csv(spark, str(d), split=True).orderBy("ordinal").collect()
        assert spark.read.text(str(d)).rdd.getNumPartitions() > 30
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [tuple(r)[:-1] for r in got] == want and len(want) == 1202
    ordinals = [r["ordinal"] for r in got]
    assert ordinals[:600] == list(range(600)) and ordinals[600:1200] == [(1 << 33) + i for i in range(600)] and ordinals[1200:] == [1 << 34, (1 << 34) + 1]


def test_split_reading_tells_surplus_fields_and_reads_lines(spark, tmp_path):
    from spendcode.sources.csv_io import read_csv, read_purchase_lines
    p = str(tmp_path / "lines3")
    write_text(spark, p, CSV)
    plain, split = (read_purchase_lines(spark, p, split=s).orderBy("ordinal").collect() for s in (False, True))
    assert plain == split
    q = str(tmp_path / "surplus3")
    write_text(spark, q, 'a,b\nc,d,EXTRA\nshort\n')
    with pytest.raises(Exception, match="expected 2 fields, saw 3: c,d,EXTRA"):
        read_csv(spark, q, split=True).collect()
    assert [tuple(r) for r in read_csv(spark, q, split=True, on_surplus="skip").collect()] == [("short", None, 1)]
