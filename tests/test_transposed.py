"""Transposed tables as files, and back; header lines beyond the first read."""

import glob

import pytest
from pyspark.sql import functions as F

from tessella.sinks import read_transposed, write_transposed
from tessella.sources import read_tsv


def whole(path):
    return "".join(open(p, newline="").read() for p in sorted(glob.glob(f"{path}/part-*")))


@pytest.mark.parametrize(("small", "tile"), [(10**6, 4096), (0, 7), (0, 1)])
def test_bytes_are_those_of_the_transposed_table(spark, tmp_path, small, tile):
    rows = [(i, f"näme {i}" if i % 3 else None, i / 4, "") for i in range(50)]
    df = spark.createDataFrame(rows, "i long, name string, x double, `odd name` string").repartition(4)
    path = str(tmp_path / "t")
    write_transposed(df, path, ["i"], tile, small=small)
    text = lambda v: "" if v is None else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    want = "".join("\t".join([n, *(text(r[k]) for r in rows)]) + "\n" for k, n in enumerate(df.columns))
    assert whole(path) == want
    back = read_transposed(spark, path, small=small)
    assert back.columns == ["row", *df.columns]
    assert [tuple(r) for r in back.orderBy("row").collect()] == [(k, *map(text, r)) for k, r in enumerate(rows)]
    again = read_tsv(spark, sorted(glob.glob(f"{path}/part-*")), header="none") if tile == 4096 else None
    assert again is None or again.count() >= 1


def test_two_hundred_thousand_rows_there_and_back(spark, tmp_path):
    df = spark.range(0, 200_000, 1, 6).select("id", *(F.hash("id", F.lit(k)).alias(f"c{k}") for k in range(12)))
    path = str(tmp_path / "big")
    write_transposed(df, path, ["id"], 2000, small=0)
    assert len(glob.glob(f"{path}/part-*")) > 2
    back = read_transposed(spark, path, small=0)
    wrong = back.join(df.withColumnRenamed("id", "row").select("row", *(F.col(f"c{k}").alias(f"d{k}") for k in range(12))), "row")
    assert wrong.count() == 200_000
    assert wrong.where(" or ".join(f"c{k} != d{k}" for k in range(12))).count() == 0


def test_empty_and_unfit_tables(spark, tmp_path):
    df = spark.createDataFrame([], "a long, b string")
    write_transposed(df, str(tmp_path / "e"), ["a"])
    assert whole(str(tmp_path / "e")) == "a\nb\n"
    for bad in ("x\ty", "x\ny"):
        with pytest.raises(ValueError, match="cells hold"):
            write_transposed(spark.createDataFrame([(1, bad), (2, "fine")], "a long, b string"), str(tmp_path / f"b{ord(bad[1])}"), ["a"])
    one = spark.createDataFrame([("x",)], "a string")
    write_transposed(one, str(tmp_path / "o"), ["a"])
    assert whole(str(tmp_path / "o")) == "a\tx\n"


def test_names_after_many_comment_lines(spark, tmp_path):
    path = str(tmp_path / "c.tsv")
    with open(path, "w") as f:
        f.write("".join(f"# note {i}\n" for i in range(300)) + "#a\tb\n1\t2\n3\t4\n")
    assert sorted(map(tuple, read_tsv(spark, path, header="hash").collect())) == [("1", "2"), ("3", "4")]
    assert read_tsv(spark, path, header="hash").columns == ["a", "b"]
