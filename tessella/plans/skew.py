"""Keys that very many rows share: found in one pass by mergeable counters, and joined without one task for each.

Every task keeps at most ``counters`` keys (hashes) with counts. Where there are more, the smallest count is taken from all,
so a count is too low by no more than rows / counters; the sums over tasks then hold every key of more than ``share`` of
all rows, and no more than a bounded number of others. Only these sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import materialized

#: A key of this share of the rows is hot: a thousandth of a large frame is more than a task should read at once.
SHARE = 0.001
#: Frames that Spark takes for smaller aren't looked through.
SKEW_BYTES = 1 << 30
#: Rows of hot keys that are broadcast.
MOST_ROWS = 100_000
SALTS = 64


def _counters(most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, rows = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for batch in batches:
            own, n = np.unique(batch.column(0).to_numpy(), return_counts=True)
            rows += len(batch)
            keys, at = np.unique(np.concatenate([keys, own]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
            if len(keys) > most:
                counts = counts - np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1]
                keys, counts = keys[counts > 0], counts[counts > 0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts), pa.array(np.where(np.arange(len(keys)) == 0, rows, 0))], names=["key", "n", "rows"])

    return run


def frequent(hashes: DataFrame, share: float = SHARE) -> list[int]:
    """Of one column of 64-bit numbers, all that more than ``share`` of the rows have, and at most 2 / share in all."""
    sums = hashes.mapInArrow(_counters(int(4 / share)), "key long, n long, rows long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    sums = materialized(sums)
    total = sums.agg(F.sum("rows")).first()[0] or 0
    return [r.key for r in sums.where(F.col("n") >= 0.75 * share * total).select("key").collect()]


def common_hash(frames: Sequence[DataFrame], keys: Sequence[Sequence[Column]]) -> list[Column] | None:
    """For each frame the hash of its key, alike for equal keys of different numeric types; None for types without one."""
    kinds = [[f.select(*k).schema.fields[i].dataType for i in range(len(k))] for f, k in zip(frames, keys, strict=True)]
    out: list[list[Column]] = [[] for _ in frames]
    for i in range(len(keys[0])):
        types = [k[i] for k in kinds]
        if all(isinstance(t, T.IntegralType) for t in types):
            to = "long"
        elif all(isinstance(t, (T.IntegralType, T.FloatType, T.DoubleType)) for t in types):
            to = "double"
        elif len({t.simpleString() for t in types}) == 1 and isinstance(types[0], (T.StringType, T.DateType, T.TimestampType, T.BooleanType, T.BinaryType, T.DecimalType)):
            to = types[0].simpleString()
        else:
            return None
        for own, k in zip(out, keys, strict=True):
            c = k[i].cast(to)
            own.append(c + F.lit(0.0) if to == "double" else c)  # zero has one sign
    return [F.xxhash64(*own) for own in out]


def large(df: DataFrame, least: int) -> bool:
    """Whether Spark takes a frame for this large; its estimate of a plan, no count."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= least


def skew_join(left: DataFrame, right: DataFrame, left_keys: Sequence[Column], right_keys: Sequence[Column], same: Column, how: str, one: bool, share: float = SHARE) -> DataFrame:
    """left joined with right on ``same``; rows of hot keys of ``left`` stay where they are and meet a broadcast.

    ``one``: right has one row a key, so the hot rows of right are as few as hot keys. Else they are counted, and beyond
    MOST_ROWS rows of left are dealt by a hash over SALTS copies of them. All other rows are shuffled by key.
    ``left`` is read twice, and must be the same both times.
    """
    hashes = common_hash([left, right], [left_keys, right_keys])
    hot = frequent(left.select(hashes[0].alias("h")), share) if hashes else []
    if not hot:
        return left.join(right, same, how)
    in_left, in_right = hashes[0].isin(hot), hashes[1].isin(hot)
    met, rows = right.where(in_right), left.where(in_left)
    if one or met.count() <= MOST_ROWS:
        joined = rows.join(F.broadcast(met), same, how)
    else:
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in left.columns)), F.lit(SALTS)).cast("int"))
        met = met.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(met, same & (F.col("__salt") == F.col("__copy")), how).drop("__salt", "__copy")
    return left.where(~in_left).join(right.where(~in_right), same, how).union(joined)
