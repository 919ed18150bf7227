"""Quantile sketches: error against exact quantiles, merged over groups, and on streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators.sketches import merge_sketches, quantile_sketches, sketch, sketch_quantiles
from tessella.streaming import run_to_table, stream, window_stats

PROBS = (0.01, 0.25, 0.5, 0.75, 0.99)


def places(values, found):
    """How far each quantile's place is from where it should be, as a share of the rows."""
    values = np.sort(values)
    low, high = np.searchsorted(values, found) / len(values), np.searchsorted(values, found, "right") / len(values)
    return np.maximum(0, np.maximum(low - PROBS, PROBS - high))


@pytest.mark.parametrize("error", [0.05, 0.01, 0.002])
def test_error_is_met_after_merging(spark, error):
    rnd = np.random.default_rng(1)
    values = np.concatenate([rnd.normal(size=60_000), rnd.exponential(3, 40_000), np.full(20_000, 1.5)])
    rnd.shuffle(values)
    df = spark.createDataFrame([(i % 30, float(v)) for i, v in enumerate(values)], "day int, v double").repartition(6)
    days = quantile_sketches(df, "day", "v", "s", error)
    assert days.count() == 30
    row = sketch_quantiles(merge_sketches(days, None, "s", error), "s", PROBS).first()
    assert list(row.asDict()) == [f"s_{p:g}" for p in PROBS]
    assert places(values, np.array(row)).max() <= error
    weeks = merge_sketches(days.withColumn("week", F.floor(F.col("day") / 7)), "week", "s", error)
    for r in sketch_quantiles(weeks, "s", PROBS).collect():
        own = np.array([v for i, v in enumerate(values) if (i % 30) // 7 == r.week])
        assert places(own, np.array([r[f"s_{p:g}"] for p in PROBS])).max() <= error


def test_missing_numbers_and_text(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "3"), ("a", "x"), ("a", None), ("b", None), ("c", "nan")], "k string, v string")
    got = {r.k: r["s_0.5"] for r in sketch_quantiles(quantile_sketches(df, "k", "v", "s"), "s", [0.5]).collect()}
    assert got["a"] in (1.0, 3.0) and got["b"] is None and got["c"] is None


def test_sketches_in_windows_of_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.read.parquet("/root/testdata/sf0.01/events.parquet").repartition(4).write.parquet(source)
    out = window_stats(stream(spark, source, 1), "ts", "1 day", ["event_type"], delay="3650 days", s=sketch(F.col("value")), n=F.count("*"))
    run_to_table(out, "sketched", str(tmp_path / "cp"))
    row = sketch_quantiles(merge_sketches(spark.table("sketched"), None, "s"), "s", PROBS).first()
    values = np.array([r.value for r in spark.read.parquet(source).select("value").collect()])
    assert spark.table("sketched").agg(F.sum("n")).first()[0] == len(values)
    assert places(values, np.array(row)).max() <= 0.01
