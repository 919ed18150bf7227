"""Joins and places within keys where one key has most of the rows, without adaptive execution."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import join_rows, uniq
from tessella.plans import skew
from tessella.plans.skew import frequent, skew_join


@pytest.fixture
def fixed(spark):
    """No adaptive execution, no broadcast that isn't asked for."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(before, ("false", "-1", "16"), strict=True):
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def zipf(spark, n=40_000):
    """(k, v): key 0 has a third of all rows, the others follow a power law; some keys are NULL."""
    rnd = np.random.default_rng(3)
    k = np.where(rnd.random(n) < 0.35, 0, rnd.zipf(1.3, n) % 5000)
    return spark.createDataFrame([(None if x == 77 else int(x), i) for i, x in enumerate(k)], "k int, v long").repartition(8)


def most(df):
    """Share of the rows that the fullest task has."""
    n = df.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    return n[0] / n[1]


@pytest.mark.parametrize("options", [{"append": "name"}, {"append": "name", "fill": "-"}, {}, {"exclude": True}])
def test_skewed_joins(fixed, options):
    data = zipf(fixed)
    lookup = fixed.createDataFrame([(k, f"n{k}") for k in range(0, 3000, 2)] + [(None, "none")], "k long, name string")
    plain, skewed = (join_rows(data, lookup, "k", skew=s, **options) for s in (False, True))
    assert sorted(map(str, plain.collect())) == sorted(map(str, skewed.collect()))
    if options.get("append"):
        assert most(plain) > 0.3
    if not options.get("exclude"):
        assert most(skewed) < 0.15
    plan = skewed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Adaptive" not in plan


def test_all_matches_of_hot_keys_on_both_sides(fixed, monkeypatch):
    data, lookup = zipf(fixed, 3000), fixed.createDataFrame([(0, f"a{i}") for i in range(40)] + [(1, "b")], "k int, name string")
    plain = sorted(map(str, join_rows(data, lookup, "k", append="name", mode="all").collect()))
    for rows in (100_000, 10):
        monkeypatch.setattr(skew, "MOST_ROWS", rows)
        out = join_rows(data, lookup, "k", append="name", mode="all", skew=True)
        assert sorted(map(str, out.collect())) == plain
        assert most(out) < 0.3


def test_frequent_finds_all_that_are(spark):
    rnd = np.random.default_rng(5)
    x = np.concatenate([rnd.integers(0, 10**12, 60_000), np.repeat([7, 8, 9], [900, 500, 61]), np.repeat([11], 30)])
    rnd.shuffle(x)
    found = frequent(spark.createDataFrame([(int(v),) for v in x], "h long").repartition(7), 0.001)
    assert {7, 8} <= set(found) and 11 not in found and len(found) <= 2000
    assert frequent(spark.createDataFrame([], "h long")) == []


def test_keys_of_other_types_meet(fixed):
    a = fixed.createDataFrame([(0.0, 1), (-0.0, 2), (2.0, 3), (float("nan"), 4)] * 50, "k double, v int")
    b = fixed.createDataFrame([(0, "zero"), (2, "two")], "k int, name string")
    same = lambda f: sorted(map(str, f.collect()))
    assert same(join_rows(a, b, "k", append="name", skew=True)) == same(join_rows(a, b, "k", append="name", skew=False))
    c = fixed.createDataFrame([([1], "x")], "k array<int>, name string")
    d = fixed.createDataFrame([([1], 5)] * 20, "k array<int>, v int")
    assert skew_join(d, c.toDF("kk", "name"), [F.col("k")], [F.col("kk")], F.col("k") == F.col("kk"), "inner", True).count() == 20


@pytest.mark.parametrize("options", [{"number": "n"}, {"equiv": "e", "equiv_start": 10}, {"number": "n", "equiv": "e"}, {"number": "n", "at_least": 2}, {"equiv": "e", "maximum": 3}, {"number": "n", "ignore_case": True}])
def test_places_within_a_hot_key(fixed, options):
    data = zipf(fixed, 6000).withColumn("s", F.when(F.col("v") % 2 == 0, "Ab").otherwise("aB")).withColumn("f", F.when(F.col("k") == 0, F.when(F.col("v") % 3 == 0, -0.0).otherwise(0.0)).otherwise(F.col("k").cast("double")))
    for key in ("k", "f,s"):
        plain, spread = (uniq(data, key, ["v"], small=small, **options) for small in (10**6, 0))
        assert plain.columns == spread.columns
        assert sorted(map(str, plain.collect())) == sorted(map(str, spread.collect()))


def test_a_hot_key_is_numbered_by_many_tasks(fixed):
    data = fixed.range(20_000).select(F.lit("same").alias("k"), F.col("id").alias("v")).repartition(8)
    out = uniq(data, "k", ["v"], number="n", small=0)
    assert most(out) < 0.3
    assert out.where("n != v + 1").count() == 0


def test_first_rows_of_a_hot_key_are_cut_before_the_shuffle(fixed):
    data = zipf(fixed, 3000)
    for options in ({}, {"at_least": 3}, {"maximum": 4}):
        assert "WindowGroupLimit" in uniq(data, "k", ["v"], **options)._jdf.queryExecution().executedPlan().toString()
