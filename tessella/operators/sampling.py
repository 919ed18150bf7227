"""Random samples: shuffled, Bernoulli, by key, weighted, of fixed size with or without replacement.

Randomness is Spark's, so a seed gives the same sample for the same partitioning, not another tool's sample. Samples by
key hash the key, so they don't depend on partitioning at all. Draws with replacement are dealt over tasks by their
numbers of rows and drawn where rows lie. Top-k samples are a TakeOrdered: k rows a task move.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import resolve_fields
from ..functions.numbers import num
from ..plans.order import materialized

STATIC_SEED = 2438424139


def _drawn(counts: dict[int, int], draws: dict[int, int], seed: int) -> Callable:
    """Rows to the task's draws of them: places are drawn from the task's number of rows, then met as rows go by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        n, rnd = counts.get(task, 0), np.random.default_rng([seed, task])
        places = np.sort(rnd.integers(0, n, draws.get(task, 0))) if n else np.zeros(0, np.int64)
        shown, at = rnd.random(len(places)), 0
        for batch in batches:
            a, b = np.searchsorted(places, [at, at + len(batch)])
            if b > a:
                taken = batch.take(pa.array(places[a:b] - at))
                yield pa.RecordBatch.from_arrays([pa.array(shown[a:b]), *taken.columns], names=["__u", *batch.schema.names])
            at += len(batch)
        if at != n:
            raise ValueError(f"task {task} has {at} rows, not {n}: the frame isn't the same when read again")

    return run


def _with_replacement(df: DataFrame, n: int, seed: int, random_name: str) -> DataFrame:
    """n draws with replacement: dealt over tasks in proportion to their rows (multinomially), then drawn in each.

    The frame is read twice, and neither sorted nor shuffled; one that isn't read straight from a source is written first,
    since its tasks may differ when it is computed again.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        df = materialized(df)
    counts = {r.p: r.n for r in df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}
    total, tasks = sum(counts.values()), sorted(counts)
    dealt = np.random.default_rng(seed).multinomial(n, np.array([counts[p] / total for p in tasks])) if total else []
    draws = dict(zip(tasks, map(int, dealt), strict=True)) if total else {}
    schema = T.StructType([T.StructField("__u", T.DoubleType()), *df.schema.fields])
    return df.mapInArrow(_drawn(counts, draws, seed), schema).withColumnRenamed("__u", random_name)


def sample(
    df: DataFrame,
    n: int | None = None,
    prob: float | None = None,
    key: str | None = None,
    weight: str | None = None,
    replace: bool = False,
    order_by: Sequence[str] | None = None,
    in_order: bool = False,
    seed: int | None = None,
    stable: bool = False,
    print_random: bool = False,
    random_name: str = "random_value",
) -> DataFrame:
    """A random sample, or with neither ``n`` nor ``prob`` nor ``weight`` all rows in random order.

    ``prob`` keeps each row with that probability; with ``key``, whole keys, one of every round(1 / prob). ``weight``
    orders by ln(u) / weight (weights of 0 or less are dropped) and takes ``n``. ``in_order`` keeps the order of
    ``order_by``. ``stable`` draws one number a row from the seed and the row's order key, so that samples of larger
    ``n`` or ``prob`` contain smaller ones. ``print_random`` puts the number drawn first.
    """
    if prob is not None and not 0 < prob <= 1:
        raise ValueError("prob is over 0, and 1 at most")
    if prob is not None and (n is not None or weight or replace):
        raise ValueError("prob excludes n, weight and replace")
    if key and prob is None:
        raise ValueError("key needs prob")
    if replace and (weight or n is None or in_order):
        raise ValueError("replace needs n, and neither weight nor in_order")
    if in_order and not order_by:
        raise ValueError("in_order needs order_by")
    seed = STATIC_SEED if seed is None else seed
    if stable:
        if not order_by:
            raise ValueError("a stable sample needs order_by")
        u = (F.pmod(F.xxhash64(*order_by, F.lit(seed)), F.lit(1 << 53)) + 1) / float(1 << 53)
    else:
        u = F.rand(seed)
    if key:
        names = resolve_fields(key, df.columns, zero=True)
        every = max(1, round(1 / prob))
        bucket = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in names), F.lit(seed)), F.lit(every))
        out = df.withColumn(random_name, bucket.cast("double")).where(F.col(random_name) == 0)
    elif prob is not None:
        out = df.withColumn(random_name, u).where(F.col(random_name) < prob)
    elif replace:
        out = _with_replacement(df, n, seed, random_name)
    else:
        if weight:
            c = resolve_fields(weight, df.columns)[0]
            w = num(F.col(f"`{c}`"), df.schema[c].dataType)
            w = F.when(w.isNull(), F.raise_error(F.lit(f"sample: weight {c} isn't a number"))).otherwise(w)
            out = df.withColumn("__w", w).where("__w > 0").withColumn(random_name, F.ln(u) / F.col("__w")).drop("__w")
        else:
            out = df.withColumn(random_name, u)
        out = out.orderBy(F.desc(random_name))
        out = out.limit(n) if n is not None else out
    if in_order:
        out = out.orderBy(*order_by)
    rest = [F.col(f"`{c}`") for c in df.columns]
    return out.select(random_name, *rest) if print_random else out.select(*rest)


def random_by_key(df: DataFrame, key: str | None = None, seed: int = STATIC_SEED, name: str = "random_value") -> DataFrame:
    """All rows with a random number first; one number a key with ``key``."""
    if key:
        names = resolve_fields(key, df.columns, zero=True)
        u = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in names), F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    else:
        u = F.rand(seed)
    return df.select(u.alias(name), *(F.col(f"`{c}`") for c in df.columns))
