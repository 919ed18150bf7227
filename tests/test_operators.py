"""Operators on small text tables: missing cells, odd numbers, order, options."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions.fields import FieldError, resolve_fields, split_last
from tessella.functions.numbers import format_float, group_digits, num
from tessella.operators import (
    append,
    bin_values,
    blank,
    check,
    fill,
    filter_rows,
    header_table,
    join_rows,
    longer,
    nl,
    running_sum,
    sample,
    select,
    slice_rows,
    sort_rows,
    stats,
    transpose,
    uniq,
    wider,
)
from tessella.operators.bins import bin_count, box_outliers
from tessella.operators.plots import breaks, nice_step, plot_bin2d, plot_box, plot_point
from tessella.operators.process import pipe_rows
from tessella.operators.sampling import random_by_key
from tessella.plans.order import Ordered, assert_unique

COLUMNS = ["id", "run-time", "a,b", "user name", "count_1", "count_2", "1"]


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        ("1,3", ["id", "a,b"]),
        ("2-4", ["run-time", "a,b", "user name"]),
        ("4-2", ["user name", "a,b", "run-time"]),
        ("run\\-time", ["run-time"]),
        ("run-time", ["run-time"]),
        ("a\\,b", ["a,b"]),
        ("user\\ name", ["user name"]),
        ("count_*", ["count_1", "count_2"]),
        ("id-count_1", COLUMNS[:5]),
        ("id,id,1", ["id", "id", "id"]),
        ("\\1", ["1"]),
        ("*_2,id", ["count_2", "id"]),
    ],
)
def test_field_lists(spec, want):
    assert resolve_fields(spec, COLUMNS) == want


@pytest.mark.parametrize("spec", ["0", "8", "3-", "-3", "nope", "", "id,,1", "x*", "1048577", "id\\"])
def test_bad_field_lists(spec):
    with pytest.raises(FieldError):
        resolve_fields(spec, COLUMNS)


@given(st.lists(st.integers(1, 7), min_size=1, max_size=8))
def test_field_numbers_keep_order(numbers):
    assert resolve_fields(",".join(map(str, numbers)), COLUMNS) == [COLUMNS[n - 1] for n in numbers]


def test_small_helpers():
    assert resolve_fields("0", COLUMNS, zero=True) == COLUMNS
    assert split_last("a:b:3") == ("a:b", "3") and split_last("a 3") == ("a", "3")
    assert [format_float(x) for x in (1.0, 2.50, 1 / 3, float("nan"), None, float("-inf"), -0.00001)] == ["1", "2.5", "0.3333", "nan", "nan", "-inf", "0"]
    assert group_digits("1234567.5") == "1,234,567.5" and group_digits("1234.567", 1) == "1,234.6"
    assert nice_step(10) == 2 and breaks(0, 10) == [0, 2, 4, 6, 8, 10]
    assert bin_count(100, 0, 1, 0.5, "sqrt") == 10 and bin_count(1, 0, 0, 0, "fd") == 1


NUMBERS = ["nan", "NaN", "NAN", "inf", "-inf", "INF", "", "abc", "23", "-33.5", "+45", ".19", "-.20", "9e+02", "8E-17", "1d", "1f", "0x10", " 7 ", None, "1.", "é"]


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame(list(enumerate(NUMBERS)), "i int, x string").repartition(3)


def hits(df):
    return sorted(r.i for r in df.collect())


def test_number_guard(numbers):
    got = {r.i: r.v for r in numbers.select("i", num(F.col("x")).alias("v")).collect()}
    ok = {i for i, v in got.items() if v is not None}
    assert [NUMBERS[i] for i in sorted(set(got) - ok)] == ["", "abc", "1d", "1f", "0x10", None, "é"]
    assert got[12] == -0.2 and got[13] == 900 and got[18] == 7


def test_numeric_filters(numbers):
    assert hits(filter_rows(numbers, is_nan="x")) == [0, 1, 2]
    assert hits(filter_rows(numbers, is_infinity="x")) == [3, 4, 5]
    assert hits(filter_rows(numbers, gt="x:20")) == [3, 5, 8, 10, 13]
    assert hits(filter_rows(numbers, ne="x:23")) == [0, 1, 2, 3, 4, 5, 9, 10, 11, 12, 13, 14, 18, 20]
    assert hits(filter_rows(numbers, eq="x:nan")) == []
    assert hits(filter_rows(numbers, is_numeric="x", invert=True)) == [6, 7, 15, 16, 17, 19, 21]
    assert filter_rows(numbers, count=True, is_finite="x").first().n == 9


def test_text_filters(spark):
    df = spark.createDataFrame([(0, "Straße", "STRASSE"), (1, "ÅNGSTRÖM", "ångström"), (2, None, ""), (3, "éa", "éa"), (4, " 　", "x")], "i int, a string, b string")
    assert hits(filter_rows(df, istr_eq="a:ångström")) == [1]
    assert hits(filter_rows(df, str_ne="a:x")) == [0, 1, 2, 3, 4]
    assert hits(filter_rows(df, blank="a")) == [2, 4]
    assert hits(filter_rows(df, empty="a,b")) == [2]
    assert hits(filter_rows(df, any_of=True, empty="a,b")) == [2]
    assert hits(filter_rows(df, char_len_eq="a:2")) == [3, 4]
    assert hits(filter_rows(df, byte_len_eq="a:4")) == [3, 4]
    assert hits(filter_rows(df, ff_istr_eq="a:b")) == [1, 2]
    assert hits(filter_rows(df, iregex="a:^å")) == [1]
    assert {r.i: r.ok for r in filter_rows(df, label="ok", label_values=("y", "n"), str_in_fld="a:ra").collect()} == {0: "y", 1: "n", 2: "n", 3: "n", 4: "n"}
    for bad in ({"regex": "a:(?=x)"}, {"nothing": "a"}, {"ff_eq": "a,b:a"}):
        with pytest.raises(ValueError):
            filter_rows(df, **bad)


def test_field_to_field(spark):
    df = spark.createDataFrame([(0, "1", "1.0"), (1, "2", "x"), (2, "0", "5"), (3, "4", "6")], "i int, a string, b string")
    assert hits(filter_rows(df, ff_eq="a:b")) == [0]
    assert hits(filter_rows(df, ff_reldiff_le="a:b:0.5")) == [0, 3]
    assert hits(filter_rows(df, ff_reldiff_gt="a:b:1000")) == [2]
    assert hits(filter_rows(df, ff_absdiff_gt=("a", "b", 1))) == [2, 3]


def test_select(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert select(df, "c,a").columns == ["c", "a"]
    assert select(df, exclude="b").columns == ["a", "c"]
    assert select(df, "c", rest="last").columns == ["c", "a", "b"]
    assert select(df, "c", rest="first").columns == ["a", "b", "c"]
    assert select(df, "a,a").columns == ["a", "a_2"]
    with pytest.raises(FieldError):
        select(df, "a", exclude="a")


@pytest.fixture(scope="module")
def grades(spark):
    return spark.createDataFrame([(i, a, b, v) for i, (a, b, v) in enumerate([("A", "X", "10"), ("A", "X", "20"), ("A", "Y", "30"), ("B", "X", "40"), ("B", "Y", "50"), ("B", "Y", "60"), ("C", "", ""), ("C", "Z", "bad")])], "o int, g string, h string, v string")


def test_stats(grades):
    out = {r.g: r for r in stats(grades, "g", count=True, order_by=["o"], sum="v", mean="v", variance="v", stdev="v", cv="v", median="v", mad="v", min="v", range="v", geomean="v", harmmean="v", iqr="v", first="h", last="h", values="h", unique_values="h", nunique="h", mode="h", mode_count="h", missing_count="v", not_missing_count="v", rand="h").collect()}
    a, c = out["A"], out["C"]
    assert [a["count"], a.v_sum, a.v_mean, a.v_variance, a.v_stdev, a.v_median, a.v_mad, a.v_min, a.v_range] == pytest.approx([3, 60, 20, 100, 10, 20, 14.826, 10, 20])
    assert a.v_cv == 0.5 and a.v_iqr == 10 and math.isclose(a.v_geomean, 6000 ** (1 / 3)) and math.isclose(a.v_harmmean, 3 / (1 / 10 + 1 / 20 + 1 / 30))
    assert (a.h_first, a.h_last, a.h_values, a.h_unique_values, a.h_nunique, a.h_mode, a.h_mode_count) == ("X", "Y", "X|X|Y", "X|Y", 2, "X", 2)
    assert (c.v_sum, c.v_mean, c.v_missing_count, c.v_not_missing_count, c.h_first, c.h_last, c.h_values, c.h_mode) == (0, None, 1, 1, "Z", "Z", "|Z", "")
    assert a.h_rand in ("X", "Y")


def test_stats_options(grades, spark):
    assert stats(grades, replace_missing=0, mean="v:m").first().m == pytest.approx(30)
    assert stats(grades.where("false"), count=True, sum="v", mad="v", mode="h").first()["count"] == 0
    q = stats(grades, quantile="v:0,0.5,1").first()
    assert tuple(q) == (10, 35, 60)
    odd = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    assert tuple(stats(odd, max="x", min="x", sum="x", count="n").first()) == (3, 1, 1, 1)
    for bad in ({"sum": "g,h:one"}, {"quantile": "v:2"}, {"nothing": "v"}, {"first": "h"}):
        with pytest.raises(ValueError):
            stats(grades, "g", **bad)


def test_wider_and_longer(spark, grades):
    out = {r.g: r for r in wider(grades, "h", "v", "g", op="values", order_by=["o"]).collect()}
    assert out["A"].X == "10|20" and out["B"].Y == "50|60"
    assert wider(grades, "h", "v", "g", order_by=["o"]).columns == ["g", "X", "Y", "", "Z"]
    assert wider(grades, "h", "v", "g", order_by=["o"], names_sort=True, fill="-").where("g = 'A'").first().asDict() == {"g": "A", "": "-", "X": "20", "Y": "30", "Z": "-"}
    assert {r.g: r.X for r in wider(grades, "h", id_cols="g", op="count").collect()} == {"A": 2, "B": 1, "C": None}
    wide = spark.createDataFrame([("k", "1", "", "3"), ("l", None, "5", "6")], "id string, q_a_1 string, q_b_2 string, other string")
    rows = longer(wide, "q_*", names_to=["x", "n"], names_pattern="q_(.)_(.)", drop_na=True).collect()
    assert [tuple(r) for r in rows] == [("k", "3", "a", "1", "1"), ("l", "6", "b", "2", "5")]
    assert {tuple(r)[1:3] for r in longer(wide.drop("other"), "q_*", names_to=["p", "q"], names_pattern="z(.)").collect()} == {("q_a_1", ""), ("q_b_2", "")}
    with pytest.raises(ValueError):
        wider(grades, "h", op="sum")


def test_transpose(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert [tuple(r) for r in transpose(df, ["k"]).collect()] == [("k", "a", "b"), ("v", "1", "2")]


def test_joins(spark):
    data = spark.createDataFrame([("1", "a"), ("2", "b"), (None, "c"), ("", "d")], "k string, v string")
    side = spark.createDataFrame([("1", "x", ""), ("1", "x", ""), (None, "n", "1"), ("9", "z", "")], "k string, w string, u string")
    assert sorted(r.v for r in join_rows(data, side, "k").collect()) == ["a", "c"]
    assert sorted(r.v for r in join_rows(data, side, "k", exclude=True).collect()) == ["b", "d"]
    assert sorted((r.v, r.w) for r in join_rows(data, side, "k", append="w", fill="?").collect()) == [("a", "x"), ("b", "?"), ("c", "n"), ("d", "?")]
    assert join_rows(data, side, "k", append="w", mode="all").count() == 3
    clash = side.union(spark.createDataFrame([("1", "y", "")], side.schema)).withColumn("o", F.monotonically_increasing_id())
    with pytest.raises(Exception, match="several different rows"):
        join_rows(data, clash, "k", append="w").collect()
    assert {r.v: r.w for r in join_rows(data, clash, "k", append="w", last_wins=True, order_by=["o"]).collect()}["a"] == "y"
    assert join_rows(data, side.withColumnsRenamed({"k": "key", "w": "v"}), "key", "k", append="v", prefix="r_").columns == ["k", "v", "r_v"]
    for bad in ({"append": "w", "exclude": True}, {"fill": "x"}, {"append": "k"}, {"data_key": "k,v"}):
        with pytest.raises(ValueError):
            join_rows(data, side, "k", **bad)


def test_sets(spark):
    a, b = spark.createDataFrame([(1,), (1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    assert sorted(map(tuple, append({"a": a, "b": b}, source="s").collect())) == [("a", 1), ("a", 1), ("b", 2)]
    with pytest.raises(ValueError):
        append([a, b.withColumnRenamed("x", "y")])


@pytest.mark.parametrize("parts", [1, 2, 7])
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.none(), st.sampled_from(["a", "b", ""])), min_size=1, max_size=40))
def test_order_primitives_agree_over_partitions(spark, parts, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string").repartition(parts, "v")
    spread = lambda: Ordered(df, ["i"], small=0, partitions=parts)
    assert [r.n for r in spread().number("n").orderBy("i").collect()] == list(range(1, len(values) + 1))
    got = spread().last_present({"f": F.when(F.col("v") != "", F.col("v"))}).orderBy("i").collect()
    held, want = None, []
    for v in values:
        held = v or held
        want.append(held)
    assert [r.f for r in got] == want
    before = spread().previous({"p": F.col("v")}).orderBy("i").collect()
    assert [None if r.p is None else (r.p.v,) for r in before] == [None, *((v,) for v in values[:-1])]
    sums = [r.s for r in spread().running_sum({"s": F.col("i")}).orderBy("i").collect()]
    assert sums == [sum(range(k + 1)) for k in range(len(values))]


def test_ordered_operators(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "", "X"), (3, None, "x"), (4, "b", "y"), (5, "", "y")], "i int, v string, w string").repartition(3)
    rows = lambda d, c: [r[c] for r in d.orderBy("i").collect()]
    assert rows(fill(df, "v", ["i"]), "v") == ["a", "a", "a", "b", "b"]
    assert rows(fill(df, "v", value="?"), "v") == ["a", "?", "?", "b", "?"]
    assert rows(blank(df, "w", ["i"]), "w") == ["x", "X", "x", "y", ""]
    assert rows(blank(df, "w", ["i"], ignore_case=True, replacement="~"), "w") == ["x", "~", "~", "y", "~"]
    assert rows(nl(df, ["i"], start=-1), "line") == [-1, 0, 1, 2, 3]
    assert rows(running_sum(df, "i", ["i"]), "running_sum") == [1, 3, 6, 10, 15]
    assert rows(slice_rows(df, "2-3,5", ["i"]), "i") == [2, 3, 5]
    assert rows(slice_rows(df, "-2", ["i"], invert=True), "i") == [3, 4, 5]
    assert rows(slice_rows(df, "4-", ["i"], header_lines=1), "i") == [3, 4, 5]
    assert slice_rows(df, None, ["i"]).count() == 0 and slice_rows(df, None, ["i"], invert=True).count() == 5
    for bad in ("0-1", "3-2", "x", "-"):
        with pytest.raises(ValueError):
            slice_rows(df, bad, ["i"])
    texts = spark.createDataFrame([("10",), ("9",), ("x",), ("-1",)], "v string")
    assert [r.v for r in sort_rows(texts, "v", order_by=["v"]).collect()] == ["-1", "10", "9", "x"]
    assert [r.v for r in sort_rows(texts, "v", numeric=True, descending=True).collect()] == ["10", "9", "x", "-1"]
    with pytest.raises(ValueError):
        assert_unique(df, ["w"])


def test_uniq(spark):
    df = spark.createDataFrame(list(enumerate(["a", "b", "A", "a", "a", None, None])), "i int, v string").repartition(3)
    take = lambda **o: [r.i for r in uniq(df, "v", ["i"], **o).orderBy("i").collect()]
    assert take() == [0, 1, 2, 5]
    assert take(ignore_case=True) == [0, 1, 5]
    assert take(repeated=True) == [3, 6]
    assert take(at_least=3) == [4]
    assert take(maximum=2) == [0, 1, 2, 3, 5, 6]
    assert take(at_least=2, maximum=3) == [3, 4, 6]
    assert take(number="n", at_least=2) == [3, 4, 6]
    ids = uniq(df, "v", ["i"], equiv="e", number="n", equiv_start=10).orderBy("i").collect()
    assert [(r.e, r.n) for r in ids] == [(10, 1), (11, 1), (12, 1), (10, 2), (10, 3), (13, 1), (13, 2)]
    assert uniq(df, "v").count() == 4


def test_samples(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 40).alias("k"), (F.col("id") % 3).alias("w"))
    assert sample(df).count() == 2000
    assert 120 < sample(df, prob=0.1).count() < 290
    keyed = {r.k for r in sample(df, prob=0.25, key="k").collect()}
    assert 0 < len(keyed) < 40 and sample(df, prob=0.25, key="k").count() == 50 * len(keyed)
    small = {r.id for r in sample(df, n=50, order_by=["id"], stable=True).collect()}
    assert small < {r.id for r in sample(df, n=150, order_by=["id"], stable=True).collect()}
    ordered = [r.id for r in sample(df, n=30, order_by=["id"], in_order=True).collect()]
    assert ordered == sorted(ordered) and len(ordered) == 30
    assert {r.w for r in sample(df, n=300, weight="w").collect()} == {1, 2}
    assert sample(df, n=3000, replace=True, order_by=["id"]).count() == 3000
    assert sample(df, n=5, print_random=True).columns[0] == "random_value"
    per_key = random_by_key(df, "k").groupBy("k").agg(F.count_distinct("random_value").alias("n")).collect()
    assert {r.n for r in per_key} == {1}
    with pytest.raises(Exception, match="isn't a number"):
        sample(df.withColumn("w", F.lit("x")), n=3, weight="w").collect()
    for bad in ({"prob": 2}, {"prob": 0.1, "n": 3}, {"key": "k"}, {"replace": True}, {"n": 3, "in_order": True}):
        with pytest.raises(ValueError):
            sample(df, **bad)


def test_bins_and_plots(spark):
    df = spark.createDataFrame([("1.5", 1.0), ("x", 2.0), ("-0.5", 40.0), ("7", 3.0)], "a string, b double")
    assert [r.a for r in bin_values(df, "a", 2, 1).collect()] == ["1.0", "x", "-1.0", "7.0"]
    assert [r.n for r in bin_values(df, "a", 2, new_name="n").collect()] == [0, None, -2, 6]
    assert "•" in plot_point(df, "a", "b") and "─" in plot_point(df, "a", "b", ols=True)
    assert "○" in plot_box(spark.createDataFrame([(float(i),) for i in [1, 2, 3, 4, 5, 90]], "v double"), "v")
    assert plot_bin2d(df, "a", "b", (8, 4)).count("\n") == 3
    assert plot_point(df.where("false"), "a", "b") == "(no points)"


def test_shape(spark):
    lines = spark.createDataFrame([(1, "a\tb"), (2, "c\td"), (3, "e"), (4, "f\tg\th")], "row int, value string")
    assert tuple(check(lines).first()) == (4, 2, 3, 1)
    assert check(lines.where("row < 3")).first().bad_row is None
    rows = header_table(spark, {"x": ["a", "b", "a"], "y": ["a", "c"]}).collect()
    assert [r.duplicate for r in rows] == [True, False, True, False, False] and [r.diverging for r in rows][3:] == [False, True]


def test_pipe_rows(spark):
    df = spark.createDataFrame([("b", "1"), ("a", "2")], "k string, v string")
    with pytest.raises(PermissionError):
        pipe_rows(df, ["sort"])
    assert [tuple(r) for r in pipe_rows(df, ["sort"], allow=True, single=True).collect()] == [("a", "2"), ("b", "1")]


def test_custom_aggregates(grades):
    out = stats(grades, "g", custom={"squares": lambda x: F.sum(x * x)}, squares="v:sq").where("g = 'A'").first()
    assert out.sq == 1400


def test_filters_reach_the_scan(spark):
    rows = filter_rows(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"), gt="l_quantity:10", str_eq="l_returnflag:R")
    plan = select(rows, "l_orderkey")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters:")[1].split("]")[0]
    assert "GreaterThan(l_quantity" in pushed and "EqualTo(l_returnfl" in pushed  # Spark shortens the list
    assert "l_comment" not in plan and "l_extendedprice" not in plan


def test_quantiles_are_the_same_by_buffers_and_by_places(spark):
    rows = [(g, float((i * 7919) % 101) if i % 9 else None) for i in range(400) for g in ("a", None)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    ask = dict(median="x", q1="x", iqr="x", mad="x", quantile="x:0.1,0.37,1")
    for by in ("g", None):
        near = {r[0] if by else "": r for r in stats(df, by, count=True, **ask).collect()}
        far = {r[0] if by else "": r for r in stats(df, by, count=True, small=0, **ask).collect()}
        assert near == far and len(near) == (4 if by else 1)


def test_ignoring_case_folds_ascii_only(spark):
    df = spark.createDataFrame([(1, "a"), (2, "A"), (3, "é"), (4, "É")], "n int, x string")
    assert sorted(r.n for r in uniq(df, "x", order_by=["n"], ignore_case=True).collect()) == [1, 3, 4]
    assert [r.x for r in blank(df, "x", ["n"], ignore_case=True).orderBy("n").collect()] == ["a", "", "é", "É"]


def test_sample_with_replacement_of_a_large_frame(spark):
    got = sample(spark.range(50).repartition(3), n=200, replace=True).collect()
    assert len(got) == 200 and {r.id for r in got} <= set(range(50)) and len({r.id for r in got}) > 30


def test_box_outliers_as_rows(spark):
    df = spark.createDataFrame([("a", float(x)) for x in [*range(20), 900, -900]] + [("b", 1.0)], "g string, x double")
    assert sorted(map(tuple, box_outliers(df, "x", "g").collect())) == [("a", -900.0), ("a", 900.0)]


def test_plots_of_paths_and_densities(spark):
    df = spark.createDataFrame([(k, float(k % 2) * 10, float(k)) for k in range(4)], "k int, x double, y double")
    assert plot_point(df, "x", "y", path=["k"]).count("·") > plot_point(df, "x", "y", line=True).count("·") / 4
    dense = spark.createDataFrame([(0.0, 0.0)] * 100 + [(9.0, 0.0)] * 4 + [(0.0, 9.0)] * 5 + [(9.0, 9.0)] * 20, "x double, y double")
    assert plot_bin2d(dense, "x", "y", (2, 2)).split("\n") == ["·░", "█"]
    assert plot_bin2d(dense, "x", "y", None, binwidth=3.0).split("\n") == ["· ░", "", "█"]


def test_too_many_columns_are_refused(spark):
    with pytest.raises(ValueError, match="too many columns"):
        wider(spark.range(10_001).withColumn("v", F.lit(1)), "id", "v", op="sum")


def test_draws_with_replacement_are_even(spark):
    df = spark.range(0, 600, 1, 4).union(spark.range(600, 1000, 1, 1))
    out = sample(df, n=40_000, replace=True, seed=7)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    counts = {r.id: r["count"] for r in out.groupBy("id").count().collect()}
    assert sum(counts.values()) == 40_000 and len(counts) == 1000
    # chi-square over rows, and over the halves of very different tasks
    assert 850 < sum((counts[i] - 40) ** 2 / 40 for i in range(1000)) < 1150
    assert abs(sum(c for i, c in counts.items() if i >= 600) - 16_000) < 500
    assert sorted(r.id for r in out.collect()) == sorted(r.id for r in sample(df, n=40_000, replace=True, seed=7).collect())
    shuffled = df.repartition(3).withColumn("k", F.col("id") % 7)
    assert sample(shuffled, n=50, replace=True, print_random=True).count() == 50
    assert sample(df.where("id < 0"), n=50, replace=True).count() == 0
