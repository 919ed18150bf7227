"""Whitening against whole-number arithmetic in plain Python."""

import collections
import math
import random

import numpy as np
import pytest

from tessella.llm.whitening import centred, primes, reconstructed, whiten

SCHEMA = "vec_id long, embedding array<double>, label int, v string, id string, deviation long"


def vectors(seed, n, d, spread):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(n, d)) @ rnd.normal(size=(d, d)) * spread
    return [(int(i), [float(c) for c in v]) for i, v in enumerate(base)]


def brute(rows, components=32):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    y = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    cov = np.array([[sum(r[i] * r[j] for r in y) / n**3 for j in range(d)] for i in range(d)])
    e, axes = np.linalg.eigh(cov)
    order = np.argsort(-e)[: min(components, d)]
    whitened = (np.array([[v / n for v in r] for r in y]) @ axes[:, order]) / np.sqrt(e[order])
    return n, [sum(v * v for v in r) for r in y], whitened, e[order] / np.trace(cov)


def check(df, rows, components=32):
    n, deviation, whitened, explained = brute(rows, components)
    got = collections.defaultdict(dict)
    out = df.collect()
    for r in out:
        assert r.n == n and abs(r.identity_error) <= 1e-4
        got[r.vec_id][r.component] = r
    assert len({r.identity_error for r in out}) == 1 and len(out) == len(rows) * len(explained)
    for k, share in enumerate(explained, 1):
        mine = np.array([got[i][k].whitened for i, _ in rows])
        sign = 1 if mine @ whitened[:, k - 1] > 0 else -1
        assert np.abs(mine - sign * whitened[:, k - 1]).max() < 1e-7
        assert all(got[i][k].explained == pytest.approx(share, rel=1e-9) for i, _ in rows)
    assert [got[i][1].deviation for i, _ in rows] == [x if x < 2**63 else None for x in deviation]


@pytest.mark.parametrize(("n", "d", "spread"), [(300, 40, 0.2), (57, 5, 1.0), (9000, 3, 0.1), (40, 4, 1e8)])
def test_whitening_equals_exact_arithmetic(spark, n, d, spread):
    rows = vectors(n, n, d, spread)
    df = spark.createDataFrame([(i, v, 1, "v", "i", 1) for i, v in rows], SCHEMA).repartition(3)
    check(whiten(df), rows)


def test_whitening_edge_cases(spark):
    rows = vectors(1, 60, 4, 0.5)
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [float("nan")] * 4), (103, [1.0, float("inf"), 0.0, 0.0]), (104, [1.0, 2.0]), (105, [])]
    df = spark.createDataFrame([(i, v, None, None, None, None) for i, v in rows + bad], SCHEMA).repartition(4)
    out = whiten(df, components=2)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(out, rows, 2)
    # repeated rows and null ids count like others
    twice = spark.createDataFrame([(i if i else None, v, 1, "v", "i", 1) for i, v in rows + rows], SCHEMA)
    got = whiten(twice).collect()
    assert len(got) == 480 and {r.n for r in got} == {120} and sum(r.vec_id is None for r in got) == 8
    # floats are taken as doubles; a dimension without variance gives no component
    flat = df.selectExpr("vec_id", "cast(transform(embedding, (c, i) -> if(i = 1, 7.5, c)) as array<float>) embedding")
    assert {r.component for r in whiten(flat.where("vec_id < 60")).collect()} == {1, 2, 3}
    same = df.selectExpr("vec_id", "array(1.0D, 2.0D) embedding")
    assert whiten(same).count() == 0 and whiten(df.where("false")).count() == 0
    assert whiten(df.where("false")).dtypes == out.dtypes


def test_chinese_remainders():
    rnd = random.Random(1)
    values = [rnd.randint(-(10**30), 10**30) for _ in range(50)] + [0, 10**30, -(10**30)]
    moduli = primes(10**30)
    assert math.prod(moduli) > 2 * 10**30 and len(set(moduli)) == len(moduli)
    residues = np.array([[v % p for v in values] for p in moduli])
    assert reconstructed(residues, moduli) == values


def test_centring_beyond_64_bits():
    x = np.array([[1 << 60, 3], [-(1 << 60), 5]])
    assert centred(x, 1000, np.array([7, 8], object)).tolist() == [[1000 * (1 << 60) - 7, 2992], [-1000 * (1 << 60) - 7, 4992]]
