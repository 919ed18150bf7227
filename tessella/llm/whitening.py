"""Embedding whitening on an exact scatter matrix, gathered in residues.

Entries are whole numbers x, so the scatter of centred vectors is one too. Centred by n, y = n * x - S needs no division,
and the sums of y_i * y_j are taken modulo several primes: each partition multiplies residues as doubles, in blocks so
short that every product sum stays below 2**53, hence exact. A task sends one row a prime and dimension; rows of one
dimension are added up modulo their primes and put together by Chinese remaindering, in tasks again, and only then
divided by n**3, which rounds once. The number of primes follows from n and the range of x, so nothing can wrap around.
The driver gets the upper half of the covariance, d * (d + 1) / 2 doubles whatever the number of rows, for one ``eigh``.

Edge cases: rows with a null vector, a null entry or one that isn't finite are dropped; null ids and repeated rows are
kept and count like others; vectors of another length than the most frequent one (of equally frequent ones the longest)
are dropped too, since no covariance has them; whole numbers beyond 2**61 are cut off there. Components of no variance (by
rounding) can't be scaled to one and are left out, so vectors that are all equal, or an empty table, give no rows.
A deviation that doesn't fit in a long is null. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import staging

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Primes are below this; balanced residues are half of it, and so many rows of their products stay below 2**53.
PRIMES_BELOW = 1 << 21
BLOCK_ROWS = 1 << 12
#: Tasks that gather a partial matrix each.
PARTIALS = 20_000
LARGEST = 1 << 61


def primes(bound: int) -> list[int]:
    """The largest primes below PRIMES_BELOW, as many as tell all whole numbers of magnitude ``bound`` apart."""
    out, product, p = [], 1, PRIMES_BELOW
    while product <= 2 * bound:
        p -= 1
        if all(p % k for k in range(2, math.isqrt(p) + 1)):
            out.append(p)
            product *= p
    return out


def reconstructed(residues: np.ndarray, moduli: list[int]) -> list[int]:
    """The whole numbers nearest zero that have these residues (a row a prime)."""
    product = math.prod(moduli)
    total = [0] * residues.shape[1]
    for row, p in zip(residues, moduli, strict=True):
        rest = product // p
        unit = rest * pow(rest, -1, p)
        total = [t + int(r) * unit for t, r in zip(total, row, strict=True)]
    return [t - product if 2 * (t := x % product) > product else t for x in total]


def whole(vectors: pa.Array, scale: int, shift: int) -> np.ndarray:
    """A row of whole numbers a vector."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    return np.clip(np.floor(scale * flat), -LARGEST, LARGEST).astype(np.int64) + shift


def _summed(scale: int, shift: int) -> Callable:
    """Vectors to one row a dimension: their number, sum (in two parts, neither of which can overflow) and range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            if not len(batch):
                continue
            x = whole(batch.column(0), scale, shift)
            high, low = np.divmod(x, 1 << 31)
            if not n:
                sums, least, most = np.zeros((2, x.shape[1]), np.int64), x.min(0), x.max(0)
            n += len(x)
            sums += [high.sum(0), low.sum(0)]
            least, most = np.minimum(least, x.min(0)), np.maximum(most, x.max(0))
        if n:
            cols = [np.arange(len(least)), np.full(len(least), n), *sums, least, most]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["dim", "n", "high", "low", "least", "most"])

    return run


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exactly: in 64 bits where that is enough, as Python's whole numbers else."""
    mean = np.array([int(s) // n for s in sums], object)
    rest = np.array([int(s) - n * int(m) for s, m in zip(sums, mean, strict=True)], object)
    near = x - mean.astype(np.int64)
    if len(near) and n * (int(np.abs(near).max()) + 1) >= 1 << 62:
        return near.astype(object) * n - rest
    return near * n - rest.astype(np.int64)


def _scattered(n: int, sums: list[int], moduli: list[int], scale: int, shift: int) -> Callable:
    """Vectors to the sums of y_i * y_j over this task modulo every prime: a row a prime and i, with all j from i on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(sums)
        total = np.zeros((len(moduli), d, d))
        off = [np.array([s % p for s in sums], np.int64) for p in moduli]
        any_rows = False
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                any_rows = True
                x = whole(batch.column(0).slice(at, BLOCK_ROWS), scale, shift)
                for k, p in enumerate(moduli):
                    y = (n % p * (x % p) - off[k]) % p
                    y = np.where(2 * y > p, y - p, y).astype(float)
                    total[k] = (total[k] + y.T @ y % p) % p
        if any_rows:
            for k in range(len(moduli)):
                values = [total[k, i, i:].astype(np.int32).tobytes() for i in range(d)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, k, np.int32)), pa.array(values, pa.binary())], names=["dim", "prime", "residues"])

    return run


def _joined(n: int, moduli: list[int]) -> Callable:
    """All rows of one dimension to its part of the covariance."""

    def run(rows: pa.Table) -> pa.Table:
        prime = rows.column("prime").to_numpy()
        sums: list = [0] * len(moduli)
        for k, values in zip(prime.tolist(), rows.column("residues"), strict=True):
            sums[k] = (sums[k] + np.frombuffer(values.as_buffer(), np.int32).astype(np.int64)) % moduli[k]
        exact = reconstructed(np.array(sums), moduli)
        return pa.table([rows.column("dim")[:1], pa.array([[y / n**3 for y in exact]])], names=["dim", "covariance"])

    return run


def _whitened(n: int, sums: list[int], axes: np.ndarray, scale: int, shift: int) -> Callable:
    """(vector, id) to (id, deviation, whitened): ``axes`` are eigenvectors over the roots of their eigenvalues."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            y = centred(whole(batch.column(0), scale, shift), n, np.array(sums, object))
            if y.dtype == object or int(np.abs(y).max()) ** 2 * y.shape[1] >= 1 << 63:
                squares = [sum(int(v) ** 2 for v in row) for row in y]
                deviation = pa.array([s if s < 1 << 63 else None for s in squares], pa.int64())
            else:
                deviation = pa.array((y * y).sum(1))
            w = (y / n).astype(float) @ axes
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(1), deviation, flat], names=["id", "deviation", "whitened"])

    return run


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whitened vectors to the sums of their entries and of products of two, one row a sum."""
    total = None
    for batch in batches:
        if len(batch):
            w = batch.column(0).flatten().to_numpy().reshape(len(batch), -1)
            w = np.column_stack([np.ones(len(w)), w])
            total = w.T @ w + (0 if total is None else total)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["place", "value"])


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(v double array, id): vectors of finite entries, of the most frequent length."""
    rows = vectors.select(F.col(vector_col).cast("array<double>").alias("v"), F.col(id_col).alias("id"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    top = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("v") == (top[0].d if top else 0))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row a vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    staging.ship(spark)
    rows = _usable(vectors, id_col, vector_col)
    kind = vectors.schema[id_col].dataType.simpleString()
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = rows.select("v").coalesce(PARTIALS).mapInArrow(_summed(scale, shift), "dim long, n long, high long, low long, least long, most long")
    sums = sums.groupBy("dim").agg(F.sum("n").alias("n"), exact("high").alias("high"), exact("low").alias("low"), F.min("least").alias("least"), F.max("most").alias("most"))
    sums = sums.orderBy("dim").collect()
    n, d = (sums[0].n, len(sums)) if sums else (1, 0)
    total = [(int(r.high) << 31) + int(r.low) for r in sums]
    widest = max((r.most - r.least for r in sums), default=0)
    moduli = primes(n * (n * widest) ** 2)
    scatter = rows.select("v").coalesce(PARTIALS).mapInArrow(_scattered(n, total, moduli, scale, shift), "dim int, prime int, residues binary")
    halves = scatter.groupBy("dim").applyInArrow(_joined(n, moduli), "dim int, covariance array<double>").collect() if d else []
    covariance = np.zeros((d, d))
    for r in halves:
        covariance[r.dim, r.dim :] = covariance[r.dim :, r.dim] = r.covariance
    e, axes = np.linalg.eigh(covariance) if d else (np.zeros(0), np.zeros((0, 0)))
    e, axes = e[::-1], axes[:, ::-1]
    trace = float(np.trace(covariance))
    k = min(components, int((e > d * np.finfo(float).eps * e.max(initial=0.0)).sum()))
    if not k:
        return spark.createDataFrame([], f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    scaled = axes[:, :k] / np.sqrt(e[:k])
    done = staging.stage(rows.mapInArrow(_whitened(n, total, scaled, scale, shift), f"id {kind}, deviation long, whitened array<double>"), "whitened")
    moments = done.select("whitened").coalesce(PARTIALS).mapInArrow(_moments, "place long, value double")
    m = np.zeros((k + 1) ** 2)
    for r in moments.groupBy("place").agg(F.sum("value").alias("value")).collect():
        m[r.place] = r.value
    m = m.reshape(k + 1, -1) / n
    error = float(np.abs(m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) - np.eye(k)).max())
    explained = F.array(*(F.lit(float(x / trace)) for x in e[:k]))
    out = done.select("id", "deviation", F.posexplode("whitened").alias("place", "value"))
    return out.select(
        F.col("id").alias(id_col),
        (F.col("place") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.col("value").alias("whitened"),
        explained[F.col("place")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
