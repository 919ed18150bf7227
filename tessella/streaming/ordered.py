"""Operators that depend on the order of all rows (numbering, filling down, blanking, globals), on streams.

Files may arrive in any order. Each micro-batch joins the rows that wait; those whose event time the watermark has passed
are *released* in order, the others wait on. A release is an ordered batch like any other: ranges of rows are composed in
parallel (``plans.scan``) and go on from the states that the release before ended with, so no single task reads a
stream. What is kept between batches is the waiting rows, no older than the watermark, and one state a column.

Everything of a batch is written under its number: what it released, what waits after it, the states. A batch that is
repeated after a failure reads what its predecessor left and writes the same again, so results hold each row once. Rows
that come after their time was released, and rows without an event time, have no place in the order any more: they are
kept in a table of their own (``late``).
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import resolve_fields
from ..functions.numbers import ascii_lower, plain
from ..plans.expr.api import scan_globals
from ..plans.order import materialized
from ..plans.scan import Update, counting, keeping, scanned


@dataclass
class OrderedSteps:
    """What to do with rows in order, each with the columns as they came in.

    ``number`` names a column of row numbers (from ``start``), ``fill`` fields that are filled down, ``blank`` fields whose
    repeats are replaced, ``globals`` new columns by expressions with globals.
    """

    event_time: str
    order_by: tuple[str, ...] = ()  # of rows with one event time
    delay: str = "10 minutes"
    number: str | None = None
    start: int = 1
    fill: str | None = None
    na: str = ""
    blank: str | None = None
    replacement: str = ""
    ignore_case: bool = False
    globals: dict[str, str] = field(default_factory=dict)

    def apply(self, rows: DataFrame, states: dict, partitions: int | None = None) -> tuple[DataFrame, dict]:
        """Rows with these steps done, and the states to go on from."""
        order = [self.event_time, *self.order_by]
        c = lambda n: F.col(f"`{n}`")
        kind = lambda n: rows.schema[n].dataType.simpleString()
        filled = resolve_fields(self.fill, rows.columns) if self.fill else []
        blanked = resolve_fields(self.blank, rows.columns) if self.blank else []
        shown = lambda n: ascii_lower(plain(c(n))) if self.ignore_case else plain(c(n))
        updates: list[Update] = [counting("number")] if self.number else []
        updates += [keeping(n, c(n), kind(n), c(n).isNotNull() & (plain(c(n)) != self.na)) for n in filled]
        updates += [keeping(n, shown(n), "string") for n in blanked]
        out, after = rows, {}
        if updates:
            out, after["own"] = scanned(rows, order, updates, 0, partitions, states.get("own"))
            at = 1 if self.number else 0
            new = {n: F.coalesce(F.col(f"__after{at + i}"), c(n)) for i, n in enumerate(filled)}
            at += len(filled)
            new |= {n: F.when(F.col(f"__before{at + i}") == shown(n), F.lit(self.replacement)).otherwise(c(n).cast("string")) for i, n in enumerate(blanked)}
            own = [(new[n] if n in new else c(n)).alias(n) for n in rows.columns]
            extra = [(F.col("__after0") + (self.start - 1)).alias(self.number)] if self.number else []
            raw = [c(n).alias(f"__in_{n}") for n in rows.columns] if self.globals else []
            out = out.select(*own, *extra, *raw)
        named = [*rows.columns, *([self.number] if self.number else [])]
        for name, expr in self.globals.items():
            # expressions read what came in, not what was filled or blanked
            source = out.select(*(c(f"__in_{n}" if updates else n).alias(n) for n in rows.columns), F.struct(*(c(n) for n in out.columns)).alias("__out"))
            composed = scan_globals(source, expr, order, small=0, partitions=partitions, start=states.get(name))
            if composed is None:
                raise ValueError(f"not an update that can be composed over a stream: {expr}")
            frame, value, after[name] = composed
            out = frame.select("__out.*", value.alias(name))
            named.append(name)
        return out.select(*(c(n) for n in named)), after


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class _Versions:
    """What batches left, by number, below the stream's checkpoint."""

    def __init__(self, spark: SparkSession, checkpoint: str):
        self.spark, self.top = spark, f"{checkpoint.rstrip('/')}-ordered"

    def numbers(self) -> list[int]:
        fs, p = _path(self.spark, self.top)
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        found = sorted(int(n.removeprefix("v")) for n in names if n.startswith("v"))
        return [n for n in found if fs.exists(_path(self.spark, f"{self.at(n)}/states/_SUCCESS")[1])]

    def at(self, number: int) -> str:
        return f"{self.top}/v{number}"

    def read(self, before: int, schema: T.StructType) -> tuple[DataFrame | None, dict, object, object]:
        """(rows that wait, states, latest event time, time released up to) of the last version before a number."""
        number = max((n for n in self.numbers() if n < before), default=None)
        if number is None:
            return None, {}, None, None
        r = self.spark.read.parquet(f"{self.at(number)}/states").first()
        return self.spark.read.schema(schema).parquet(f"{self.at(number)}/waiting"), pickle.loads(r.states), r.latest, r.released

    def write(self, number: int, waiting: DataFrame, states: dict, latest, released) -> None:
        waiting.write.mode("overwrite").parquet(f"{self.at(number)}/waiting")
        kept = self.spark.createDataFrame([(bytearray(pickle.dumps(states)), latest, released)], "states binary, latest timestamp, released timestamp")
        kept.coalesce(1).write.mode("overwrite").parquet(f"{self.at(number)}/states")
        for old in self.numbers():
            if old < number - 1 and old != max((n for n in self.numbers() if n < number), default=number):
                fs, p = _path(self.spark, self.at(old))
                fs.delete(p, True)


def _released(batch: DataFrame, number: int, steps: OrderedSteps, path: str, versions: _Versions, close: bool, partitions: int | None) -> None:
    t = F.col(f"`{steps.event_time}`").cast("timestamp")
    waiting, states, latest, released = versions.read(number, batch.schema)
    late = t.isNull() | (t <= F.lit(released)) if released is not None else t.isNull()
    batch = materialized(batch)
    batch.where(late).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
    rows = batch.where(~late)
    rows = rows if waiting is None else waiting.unionByName(rows)
    seen = batch.agg(F.max(t).alias("t")).select(F.greatest("t", F.lit(latest).cast("timestamp")).alias("t"))
    r = seen.select("t", F.expr(f"t - INTERVAL {steps.delay}").alias("upto")).first()
    upto = r.t if close else r.upto
    if upto is not None and (released is None or upto > released):
        released = upto
    go = t <= F.lit(released) if released is not None else F.lit(False)
    out, after = steps.apply(rows.where(go), states, partitions)
    out.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
    versions.write(number, rows.where(~go), {k: v or states.get(k) for k, v in after.items()}, r.t, released)


def run_ordered(df: DataFrame, steps: OrderedSteps, path: str, checkpoint: str, close: bool = False, partitions: int | None = None) -> None:
    """Writes all that is available now and released, to Parquet below ``path``/rows (late rows below ``path``/late).

    ``close`` ends the stream: rows that wait are released as well. Called again with the same checkpoint, it goes on.
    """
    spark = df.sparkSession
    versions = _Versions(spark, checkpoint)
    query = df.writeStream.foreachBatch(lambda b, n: _released(b, n, steps, path, versions, False, partitions))
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if close:
        number = max(versions.numbers(), default=-1)
        _released(spark.createDataFrame([], df.schema), number + 1, steps, path, versions, True, partitions)


def released_rows(spark: SparkSession, path: str) -> DataFrame:
    """What has been released so far."""
    return spark.read.parquet(f"{path}/rows").drop("batch")


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/late").drop("batch")
