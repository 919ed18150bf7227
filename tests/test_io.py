"""Sources, sinks and streaming forms."""

import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.operators import filter_rows, join_rows, longer, select
from tessella.sinks import split_by_key, split_lines, split_random, to_csv, to_md, to_tsv, to_xlsx
from tessella.sources import from_html, list_sheets, read_csv, read_tsv, read_xlsx
from tessella.sources.html import selector, tree
from tessella.sources.tsv import ORDER
from tessella.streaming import apply, in_batches, run_available, run_to_table, session_stats, stats_stream, stream, uniq_stream, window_stats


def write(path, text, newline=""):
    path.write_text(text, newline=newline)
    return str(path)


def cells(df):
    return [tuple(r) for r in df.orderBy(*ORDER).drop(*ORDER).collect()]


def test_tsv_in_order(spark, tmp_path):
    one = write(tmp_path / "b.tsv", 'x\ty\n1\t"\n2\t\n', "")
    two = write(tmp_path / "a.tsv", "x\ty\r\n3\tend\r\n\t\r\n4\tlast", "")
    gz = tmp_path / "c.tsv.gz"
    gz.write_bytes(gzip.compress(b"x\ty\n5\tzip\n"))
    df = read_tsv(spark, [one, two, str(gz)], order=True)
    assert cells(df) == [("1", '"'), ("2", ""), ("3", "end"), ("", ""), ("4", "last"), ("5", "zip")]


def test_tsv_headers(spark, tmp_path):
    p = write(tmp_path / "h.tsv", "# a\n#k\tv\n1\t2\n#no\t3\n")
    assert cells(read_tsv(spark, p, "hash", order=True)) == [("1", "2"), ("#no", "3")]
    assert read_tsv(spark, p, "hash").columns == ["k", "v"]
    assert read_tsv(spark, p, "hash1").columns == ["1", "2"] and cells(read_tsv(spark, p, "hash1", order=True)) == [("#no", "3")]
    q = write(tmp_path / "l.tsv", "﻿title\nk\tk\n1\t2\n")
    assert read_tsv(spark, q, "lines:2").columns == ["k", "k_2"] and read_tsv(spark, q, "lines:2").count() == 1
    r = write(tmp_path / "n.tsv", "1\t2\n3\t4\n")
    assert cells(read_tsv(spark, r, "none", order=True)) == [("1", "2"), ("3", "4")]
    for bad in ("lines:0", "other"):
        with pytest.raises(ValueError):
            read_tsv(spark, r, bad)


def test_tsv_ragged(spark, tmp_path):
    p = write(tmp_path / "r.tsv", "a\tb\n1\n1\t2\t3\n\n")
    with pytest.raises(Exception, match="line of 1 fields"):
        read_tsv(spark, p).collect()
    assert cells(read_tsv(spark, p, ragged="pad", order=True)) == [("1", None), ("1", "2"), ("", None)]
    assert cells(read_tsv(spark, p, ragged="keep", order=True, blank_lines=False)) == [(["1"],), (["1", "2", "3"],)]
    only = write(tmp_path / "e.tsv", "a\tb\n")
    assert read_tsv(spark, only).count() == 0


def test_csv(spark, tmp_path):
    p = write(tmp_path / "x.csv", '﻿k,v\n1,"a ""q"" b"\n2,"two\nlines\tand, tab"\n3,\n')
    df = read_csv(spark, p)
    assert sorted(map(tuple, df.collect())) == [("1", 'a "q" b'), ("2", "two lines and, tab"), ("3", "")]
    assert read_csv(spark, write(tmp_path / "y.csv", "a;b\n"), header=False, delimiter=";").columns == ["field1", "field2"]
    with pytest.raises(ValueError):
        read_csv(spark, p, delimiter="::")


PAGE = """<html lang=en><body><div id=m class="box big"><p>One <b>bold</b><p class=x data-k="v">Two</div>
<table id=t><thead><tr><th> A <th>B</thead><tr><td>1<td>2 <table><tr><td>inner</table></tr><tr></tr></table>
<ul><li><a href="/a">a</a><li><a href="/b" title=T>b</a></ul></body></html>"""


@pytest.mark.parametrize(
    ("css", "want"),
    [
        ("p", 2), ("div > p.x", 1), ("#m b", 1), (".box.big", 1), ("[data-k=v]", 1), ("a[href^='/']", 2), ("li:nth-child(2) a", 1), ("p + p", 1), ("p ~ p", 1),
        ("li:first-child, li:last-child", 2), ("a:not([title])", 1), ("table table td", 1), ("ul > li > a[title]", 1), ("*[lang|=en]", 1), ("span", 0),
    ],
)
def test_selectors(css, want):
    hit = selector(css)
    assert sum(map(hit, tree(PAGE).walk())) == want


def test_html_modes(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None)], "page long, html string")
    assert [tuple(r) for r in from_html(df, id_col="page", css="a attr{href}").collect()] == [(1, 1, "/a"), (1, 2, "/b")]
    assert [r.value for r in from_html(df, css="b").collect()] == ["<b>bold</b>"]
    assert [r.value for r in from_html(df, css="p text()").collect()] == ["One bold", "Two"]
    assert [r.cells for r in from_html(df, table=True).collect()] == [["A", "B"], ["1", "2 inner"]]
    assert [r.cells for r in from_html(df, table="table table").collect()] == [["inner"]]
    assert from_html(df, table=True, index=5).count() == 0
    rows = from_html(df, row="li", cols={"name": "a text{}", "title": "a attr{title}"}).collect()
    assert [tuple(r)[1:] for r in rows] == [("a", ""), ("b", "T")]
    with pytest.raises(ValueError):
        from_html(df)
    with pytest.raises(ValueError):
        from_html(df, css="a:hover")


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(1, "a|b", 1234.5), (2, 'q "x"', None), (3, "", 2.0)], "id long, text string, v double")


def test_sinks_round_trip(spark, table, tmp_path):
    to_tsv(table, str(tmp_path / "t"), order_by=["id"], single=True)
    lines = next((tmp_path / "t").glob("part-*")).read_text().splitlines()
    assert lines == ["id\ttext\tv", "1\ta|b\t1234.5", '2\tq "x"\tnan', "3\t\t2"]
    to_csv(table, str(tmp_path / "c"), single=True)
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "c")).collect())) == [("1", "a|b", "1234.5"), ("2", 'q "x"', "nan"), ("3", "", "2")]


def test_markdown(table):
    lines = to_md(table.orderBy("id"), center="text", numeric=True).splitlines()
    assert lines[0] == "|  id | text  |    v   |" or "a\\|b" in lines[2]
    assert lines[1].split("|")[1].strip().endswith(":") and lines[1].split("|")[2].strip().startswith(":")
    assert "1,234.50" in to_md(table.select("v").dropna(), grouped=True, digits=2)
    with pytest.raises(ValueError):
        to_md(table, most=2)


def test_xlsx(spark, table, tmp_path):
    p = str(tmp_path / "x.xlsx")
    to_xlsx(table, p, "Data & more", rules=[("v", "ge", "2"), ("v", "bt", "1,3"), ("text", "str_in_fld", "a")])
    assert list_sheets(spark, p) == ["Data & more"]
    got = [tuple(r)[1:] for r in read_xlsx(spark, p).collect()]
    assert got == [("1", "a|b", "1234.5"), ("2", 'q "x"', ""), ("3", "", "2.0")]
    assert "between" in zipfile.ZipFile(p).read("xl/worksheets/sheet1.xml").decode()
    with pytest.raises(ValueError):
        read_xlsx(spark, p, "none")


def test_split(spark, tmp_path):
    df = spark.range(25).select("id", (F.col("id") % 4).alias("k"))
    split_lines(df, str(tmp_path / "l"), 10, ["id"])
    sizes = {p.name: sum(len(f.read_text().splitlines()) - 1 for f in p.glob("part-*")) for p in (tmp_path / "l").glob("part=*")}
    assert sizes == {"part=0": 10, "part=1": 10, "part=2": 5}
    split_by_key(df, str(tmp_path / "k"), 3, "k")
    back = spark.read.csv(str(tmp_path / "k"), sep="\t", header=True)
    assert back.groupBy("k").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0 and back.count() == 25
    split_random(df, str(tmp_path / "r"), 3)
    assert spark.read.csv(str(tmp_path / "r"), sep="\t", header=True).count() == 25


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "in")
    spark.read.parquet("/root/testdata/sf0.01/events.parquet").repartition(4).write.parquet(path)
    return path


def test_stateless_stream_equals_batch(spark, events, tmp_path):
    steps = [lambda d: filter_rows(d, gt="value:100"), lambda d: select(d, "event_id,user_id,value"), lambda d: longer(d, "user_id", values_to="v")]
    run_available(apply(stream(spark, events, 2), *steps), str(tmp_path / "out"), str(tmp_path / "cp"))
    got, want = spark.read.parquet(str(tmp_path / "out")), apply(spark.read.parquet(events), *steps)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_static_join_stream(spark, events, tmp_path):
    lookup = spark.createDataFrame([(i, f"u{i}") for i in range(50)], "user_id long, name string")
    run_available(join_rows(stream(spark, events), lookup, "user_id", append="name"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(events).where("user_id < 50").count()


def test_keyed_streams_equal_batch(spark, events, tmp_path):
    batch = spark.read.parquet(events)
    run_available(uniq_stream(stream(spark, events, 2), "user_id"), str(tmp_path / "u"), str(tmp_path / "cu"))
    assert spark.read.parquet(str(tmp_path / "u")).count() == batch.select("user_id").distinct().count()
    run_to_table(stats_stream(stream(spark, events, 2), "event_type", count=True, sum="value"), "by_type", str(tmp_path / "cs"))
    got = {r.event_type: (r["count"], round(r.value_sum, 2)) for r in spark.table("by_type").collect()}
    want = {r.event_type: (r.n, round(r.s, 2)) for r in batch.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s")).collect()}
    assert got == want


def test_windows_and_sessions(spark, events, tmp_path):
    batch = spark.read.parquet(events)
    run_to_table(window_stats(stream(spark, events, 1), "ts", "1 day", ["event_type"], delay="3650 days", n=F.count("*")), "windows", str(tmp_path / "cw"))
    assert spark.table("windows").agg(F.sum("n")).first()[0] == batch.count()
    run_to_table(session_stats(stream(spark, events, 1), "ts", "1 hour", "user_id", delay="3650 days", n=F.count("*")), "sessions", str(tmp_path / "cx"))
    assert spark.table("sessions").agg(F.sum("n")).first()[0] == batch.count()


def test_batches(spark, events, tmp_path):
    seen = []
    in_batches(stream(spark, events, 4), lambda d, i: seen.append(d.orderBy("event_id").count()), str(tmp_path / "cb"))
    assert sum(seen) == spark.read.parquet(events).count()
