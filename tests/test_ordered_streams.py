"""Ordered operators on streams whose files arrive in any order, against the same operators on the whole table."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import blank, fill, nl
from tessella.plans.expr.api import running
from tessella.streaming import ordered, stream
from tessella.streaming.ordered import OrderedSteps, late_rows, released_rows, run_ordered

SCHEMA = "id long, ts timestamp, kind string, v long, extra double"
STEPS = OrderedSteps("ts", ("id",), "100 seconds", number="line", start=5, fill="kind,v", blank="extra", replacement="-", globals={"total": "default(@__t, 0) + @v as @__t", "peak": "max(0, default(@__p, 0) + @id % 7 - 3) as @__p"})


def rows(n, seed=2):
    rnd = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    return [(i, start + datetime.timedelta(seconds=i // 3), rnd.choice(["a", "b", "", None]), rnd.choice([None, 1, 2, 3]), float(rnd.randint(0, 1))) for i in range(n)]


def files(spark, data, folder, parts, spread, seed=1):
    """One file a part, rows up to ``spread`` seconds out of order."""
    rnd = random.Random(seed)
    order = sorted(data, key=lambda r: r[0] / 3 + rnd.random() * spread)
    size = -(-len(order) // parts)
    for k in range(parts):
        chunk = order[k * size : (k + 1) * size]
        rnd.shuffle(chunk)
        spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def wanted(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    order = ["ts", "id"]
    out = nl(df, order, "line", 5).select("id", "line")
    out = out.join(fill(df, "kind,v", order).select("id", "ts", "kind", "v"), "id").join(blank(df, "extra", order, "-").select("id", "extra"), "id")
    out = out.join(running(df, STEPS.globals["total"], order, name="total").select("id", "total"), "id")
    out = out.join(running(df, STEPS.globals["peak"], order, name="peak").select("id", "peak"), "id")
    return sorted(map(tuple, out.select("id", "ts", "kind", "v", "extra", "line", "total", "peak").collect()))


def got(spark, path):
    return sorted(map(tuple, released_rows(spark, path).collect()))


@pytest.fixture
def places(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")


def test_stream_equals_batch_in_any_order_of_files(spark, places):
    source, out, cp = places
    data = rows(900)
    files(spark, data[:600], source, 4, 60)
    run_ordered(stream(spark, source, 1), STEPS, out, cp, partitions=3)
    first = got(spark, out)
    assert 0 < len(first) < 600
    # what waits is no older than the watermark allows
    waiting = ordered._Versions(spark, cp).read(10**9, spark.read.parquet(source).schema)[0]
    assert waiting.count() == 600 - len(first) and waiting.agg(F.max("ts") - F.min("ts")).first()[0] <= datetime.timedelta(seconds=100)
    # a restart goes on from the checkpoint; what has been released stays
    files(spark, data[600:], source, 3, 60, seed=4)
    run_ordered(stream(spark, source, 1), STEPS, out, cp, close=True, partitions=3)
    second = got(spark, out)
    assert set(first) <= set(second)
    assert second == wanted(spark, data)
    assert late_rows(spark, out).count() == 0


def test_a_batch_that_fails_is_repeated(spark, places, monkeypatch):
    source, out, cp = places
    data = rows(300)
    files(spark, data, source, 3, 20)
    write, calls = ordered._Versions.write, []

    def failing(self, number, *rest):
        calls.append(number)
        if len(calls) == 2:
            raise OSError("lost")
        write(self, number, *rest)

    monkeypatch.setattr(ordered._Versions, "write", failing)
    with pytest.raises(Exception, match="lost"):
        run_ordered(stream(spark, source, 1), STEPS, out, cp)
    run_ordered(stream(spark, source, 1), STEPS, out, cp, close=True)
    assert calls[1] == calls[2] and got(spark, out) == wanted(spark, data)


def test_late_rows_and_rows_without_time_are_kept_apart(spark, places):
    source, out, cp = places
    data = rows(400)
    gone = [(1000, None, "x", 1, 0.0), (1001, data[0][1], "x", 1, 0.0)]
    files(spark, data, source, 1, 0)
    run_ordered(stream(spark, source, 1), STEPS, out, cp)
    spark.createDataFrame(gone, SCHEMA).write.mode("append").parquet(source)
    run_ordered(stream(spark, source, 1), STEPS, out, cp, close=True)
    assert sorted(r.id for r in late_rows(spark, out).collect()) == [1000, 1001]
    assert got(spark, out) == wanted(spark, data)
    # more that arrives takes the close back: its rows wait again, and are released with the new ones
    more = [(i, data[-1][1] + datetime.timedelta(seconds=i), "y", 2, 1.0) for i in range(500, 600)]
    spark.createDataFrame(more, SCHEMA).write.mode("append").parquet(source)
    run_ordered(stream(spark, source, 1), STEPS, out, cp, close=True)
    assert got(spark, out) == wanted(spark, data + more)


def test_an_update_that_cannot_be_composed_is_refused(spark, places):
    source, out, cp = places
    files(spark, rows(30), source, 1, 0)
    steps = OrderedSteps("ts", ("id",), "1 second", globals={"x": "default(@__x, 1) * default(@__x, 2) + @v as @__x"})
    with pytest.raises(Exception, match="composed"):
        run_ordered(stream(spark, source), steps, out, cp)
