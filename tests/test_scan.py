"""Globals over rows: composed transitions against evaluation row by row."""

import math
import random

import pytest
from tessella.plans.expr.api import Env, evaluate, parse, running

NAMES = ["i", "v", "w", "s", "c"]
EXPRESSIONS = [
    "default(@__x, 0) + @v as @__x",
    "default(@__x, 1) * @w as @__x",
    "max(default(@__x, 0), @v) as @__x",
    "min(default(@__x, 1000), @v + 500) as @__x",
    "default(@__x, 0) * 0.9 + @v * 0.1 as @__x",
    "if(@c, 0, default(@__x, 0) + @v) as @__x",
    "if(@c, default(@__x, 0) + 1, default(@__x, 0)) as @__x",
    "max(0, default(@__x, 0) + @v - 2) as @__x",
    "min(20, max(-20, default(@__x, 0) + @v)) as @__x",
    "10 - default(@__x, 3) as @__x",
    "default(@__x, 0.5) / 2 + @w as @__x",
    "-default(@__x, 0) + @v as @__x",
    "if(@c, @v, @__x) as @__x",
    "if(@c, @s, default(@__x, 'none')) as @__x",
    "default(@__p, 0) as @old; @v as @__p; @v - @old",
    "default(@__a, 0) + @v as @__a; default(@__b, 0) + 1 as @__b; @__a / @__b",
    "default(@__a, 0) + @v as @__a; max(default(@__b, 0), @__a) as @__b; @__b - @__a",
    "@v * 2 as @d; default(@__x, 0) + @d as @__x; default(@__x, 0) + 1",
    "@__n as @before; if(@v > 3, @s, @__n) as @__n; @before",
]


def table(n, seed=1):
    rnd = random.Random(seed)
    return [(i, rnd.randint(-9, 9), rnd.choice([0.5, 1.0, 2.0, -1.0, 0.0, 1.5]), rnd.choice(["a", "b", None, "long text"]), rnd.random() < 0.05) for i in range(n)]


def in_order(rows, expr):
    tree, kept, out = parse(expr), {}, []
    for r in rows:
        env = Env(NAMES, list(r), dict(kept))
        out.append(evaluate(tree, env))
        kept = {k: x for k, x in env.variables.items() if str(k).startswith("__")}
    return out


def same(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.fixture(scope="module")
def frames(spark):
    rows = table(700)
    schema = "i long, v long, w double, s string, c boolean"
    return rows, [spark.createDataFrame(random.Random(k).sample(rows, len(rows)), schema).repartition(k) for k in (1, 5)]


@pytest.mark.parametrize("expr", EXPRESSIONS)
@pytest.mark.parametrize(("small", "partitions"), [(10**6, None), (0, 7)])
def test_scans_equal_row_by_row(spark, frames, expr, small, partitions, caplog):
    rows, dfs = frames
    want = in_order(rows, expr)
    df = dfs[0 if small else 1]
    out = running(df, expr, ["i"], name="x", raw=False, small=small, partitions=partitions)
    assert out.columns == [*NAMES, "x"]
    got = {r.i: r.x for r in out.collect()}
    assert "one task" not in caplog.text
    wrong = [(i, got[i], w) for i, w in enumerate(want) if not same(got[i], w)]
    assert not wrong, wrong[:3]


def test_rows_of_one_partition_key_and_missing_numbers(spark):
    df = spark.createDataFrame([(1, 2), (2, None), (3, 5), (4, None)], "i long, v long").repartition(2)
    read = lambda e, small: [r.x for r in running(df, e, ["i"], name="x", small=small, partitions=3).orderBy("i").collect()]
    for small in (0, 100):
        assert read("max(0, default(@__s, 0) + @v) as @__s", small) == [2, 2, 7, 7]
        assert read("max(default(@__s, 0), @v) as @__s", small) == [2, 2, 5, 5]
        assert read("@v as @__s", small) == [2, None, 5, None]
        assert read("if(@v > 0, @v, @__s) as @__s", small) == [2, 2, 5, 5]
    assert running(df.where("false"), "max(0, default(@__s, 0) + @v) as @__s", ["i"], name="x").count() == 0


def test_what_cannot_be_composed_is_evaluated_in_order(spark, caplog):
    rows = [(i, v) for i, v in enumerate([3, 0, 4, 5, 0, 0, 7])]
    df = spark.createDataFrame(rows, "i long, v long")
    # a state of zero by arithmetic is missing to the next row, which no single transition says
    for expr in ("default(@__x, 9) - @v as @__x", "7 - default(@__x, 2) as @__x", "default(@__x, 1) * default(@__x, 2) + @v as @__x"):
        caplog.clear()
        got = [r.x for r in running(df, expr, ["i"], name="x", small=0).orderBy("i").collect()]
        tree, kept, want = parse(expr), {}, []
        for r in rows:
            env = Env(["i", "v"], list(r), dict(kept))
            want.append(evaluate(tree, env))
            kept = {"__x": env.variables["__x"]}
        assert [float(x) for x in got] == list(map(float, want))
    assert "one task" in caplog.text
