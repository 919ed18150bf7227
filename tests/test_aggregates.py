"""Aggregates of a user's own against plain Python, with a key that has most of the rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessella.operators.aggregates import aggregate_rows


class SecondLargest:
    """The second largest value of those that differ."""

    state, result = "first double, second double", "double"

    def start(self):
        return None, None

    def update(self, state, values):
        best = np.unique(values[0].drop_null().to_numpy())[-2:]
        return self.merge(state, tuple([None] * (2 - len(best)) + [float(x) for x in best])[::-1])

    def merge(self, a, b):
        best = sorted({x for x in (*a, *b) if x is not None})[-2:][::-1]
        return tuple(best + [None] * (2 - len(best)))

    def finish(self, state):
        return state[1]


class Words:
    """Distinct words of two fields, in order."""

    state, result = "words array<string>, n long", "string"

    def start(self):
        return [], 0

    def update(self, state, values):
        a, b = values
        words = {x for x in pa.concat_arrays([a, b]).to_pylist() if x is not None}
        return sorted(words | set(state[0])), state[1] + len(a)

    def merge(self, a, b):
        return sorted({*a[0], *b[0]}), a[1] + b[1]

    def finish(self, state):
        return f"{state[1]}:{','.join(state[0])}"


@pytest.mark.parametrize("most", [50_000, 5])
def test_aggregates_equal_plain_python(spark, most):
    rnd = random.Random(1)
    rows = [(0 if rnd.random() < 0.5 else rnd.choice([None, *range(30)]), rnd.choice(["x", None]), rnd.choice([None, *map(float, range(400))]), rnd.choice("abc")) for _ in range(5000)]
    df = spark.createDataFrame(rows, "k int, g string, v double, w string").repartition(9)
    groups = {}
    for k, g, v, w in rows:
        groups.setdefault((k, g), []).append((v, w))
    got = {(r.k, r.g): r.x for r in aggregate_rows(df, "k,g", "v", "x", SecondLargest(), most).collect()}
    assert got == {key: float(sorted({v for v, _ in own if v is not None})[-2]) for key, own in groups.items()}
    words = {(r.k, r.g): r.x for r in aggregate_rows(df, "k,g", "w,g", "x", Words(), most).collect()}
    assert words == {key: f"{len(own)}:{','.join(sorted({w for _, w in own} | ({key[1]} - {None})))}" for key, own in groups.items()}
    assert aggregate_rows(df, None, "v", "x", SecondLargest(), most).collect()[0].x == 398.0


def test_aggregates_of_nothing(spark):
    df = spark.createDataFrame([], "k int, v double, w string")
    assert aggregate_rows(df, "k", "v", "x", SecondLargest()).count() == 0
    assert [r.x for r in aggregate_rows(df, None, "w,w", "x", Words()).collect()] == ["0:"]
    assert [r.x for r in aggregate_rows(df, None, "v", "x", SecondLargest()).collect()] == [None]
