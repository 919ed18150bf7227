"""Row order over unordered DataFrames, without a single-task global window.

``Ordered`` range-partitions and sorts a frame by its order key once, writes it below the shared checkpoint folder,
and numbers rows from (partition, place in partition): what one partition must know of those before it is one row a
partition, collected and handed back as a map. Small frames take the plain global window instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder

SMALL_ROWS = 1_000_000
PID, LOC = "__pid", "__loc"


def materialized(df: DataFrame) -> DataFrame:
    """df written below the shared folder and read again, so that all later readers see the same rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


class Ordered:
    """A frame with its order key: columns (names or Columns) that determine the order of rows; none is any order."""

    def __init__(self, df: DataFrame, order_by: Sequence[str | Column], small: int = SMALL_ROWS, partitions: int | None = None):
        self.columns = df.columns
        keys = [F.col(c) if isinstance(c, str) else c for c in order_by]
        self.keys = keys
        if df.count() <= small:
            self.df = df
            self.wide = Window.orderBy(*(keys or [F.lit(0)]))
            self.distributed = False
            return
        ranged = df
        if keys:
            ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
            ranged = ranged.sortWithinPartitions(*keys)
        ids = F.monotonically_increasing_id()  # partition number and row number within it
        ranged = ranged.withColumn(PID, F.shiftright(ids, 33)).withColumn(LOC, ids.bitwiseAND((1 << 33) - 1))
        self.df = materialized(ranged)
        self.wide = Window.partitionBy(PID).orderBy(LOC)
        self.distributed = True

    def _carried(self, per_partition: dict[int, object], kind: str) -> Column:
        """The value of this row's partition in a map that has one entry a partition."""
        if not per_partition:
            return F.lit(None).cast(kind)
        pairs = [F.lit(x) for k, v in per_partition.items() for x in (k, v)]
        pairs = [p if i % 2 == 0 else p.cast(kind) for i, p in enumerate(pairs)]
        return F.create_map(*pairs)[F.col(PID)]

    def number(self, name: str, start: int = 1) -> DataFrame:
        """Rows numbered densely in order."""
        if not self.distributed:
            return self.df.withColumn(name, (F.row_number().over(self.wide) + (start - 1)).cast("long"))
        sizes = {r[PID]: r["n"] for r in self.df.groupBy(PID).agg(F.count("*").alias("n")).collect()}
        before, offsets = 0, {}
        for pid in sorted(sizes):
            offsets[pid], before = before, before + sizes[pid]
        n = self._carried(offsets, "long") + F.col(LOC) + start
        return self.df.withColumn(name, n).drop(PID, LOC)

    def places(self, keys: Sequence[str], name: str) -> DataFrame:
        """Rows numbered from 1 within each key, for an order that begins with the keys; partition and place stay.

        A key may go over many partitions: of each, its first and last key and how many rows the last one has there are
        known, so what comes before a partition's first key follows from one row a partition.
        """
        if not self.distributed:
            raise ValueError("places are for distributed orders")
        kinds = {f.name: f.dataType.simpleString() for f in self.df.schema.fields}
        h = F.xxhash64(*(F.col(k) + F.lit(0.0) if kinds[k] in ("double", "float") else F.col(k) for k in keys))  # zero has one sign
        rows = self.df.withColumn("__h", h)
        runs = rows.groupBy(PID, "__h").agg(F.min(LOC).alias("a"), F.max(LOC).alias("b"))
        last = F.max_by(F.struct(F.col("__h").alias("h"), (F.col("b") - F.col("a") + 1).alias("n")), "b").alias("last")
        ends = runs.groupBy(PID).agg(F.min_by("__h", "a").alias("first"), last).collect()
        firsts, carry, held = {}, {}, (None, 0)
        for r in sorted(ends, key=lambda r: r[PID]):
            firsts[r[PID]], carry[r[PID]] = r["first"], held[1] if held[0] == r["first"] else 0
            held = r["last"].h, r["last"].n + (carry[r[PID]] if r["last"].h == r["first"] else 0)
        own = F.col(LOC) - F.min(LOC).over(Window.partitionBy(PID, "__h")) + 1
        more = F.when(F.col("__h") == self._carried(firsts, "long"), self._carried(carry, "long")).otherwise(0)
        return rows.withColumn(name, (own + more).cast("long")).drop("__h")

    def last_present(self, values: dict[str, Column]) -> DataFrame:
        """For each name, the last non-NULL value of its expression up to and including each row."""
        up_to = self.wide.rowsBetween(Window.unboundedPreceding, 0)
        filled = {k: F.last(v, ignorenulls=True).over(up_to) for k, v in values.items()}
        if not self.distributed:
            return self.df.withColumns(filled)
        mine = self.df.withColumns({f"__v{i}": v for i, v in enumerate(values.values())})
        last = mine.groupBy(PID).agg(*(F.max_by(f"__v{i}", F.when(F.col(f"__v{i}").isNotNull(), F.col(LOC))).alias(f"__v{i}") for i in range(len(values)))).collect()
        kinds = [mine.schema[f"__v{i}"].dataType.simpleString() for i in range(len(values))]
        out = {}
        for i, name in enumerate(values):
            carry, held = {}, None
            for r in sorted(last, key=lambda r: r[PID]):
                carry[r[PID]] = held
                held = r[f"__v{i}"] if r[f"__v{i}"] is not None else held
            out[name] = F.coalesce(filled[name], self._carried(carry, kinds[i]))
        return self.df.withColumns(out).drop(PID, LOC)

    def previous(self, values: dict[str, Column]) -> DataFrame:
        """For each name, the value (wrapped in a one-field struct, NULL at the first row) of the row before."""
        wrapped = {k: F.lag(F.struct(v.alias("v"))).over(self.wide) for k, v in values.items()}
        if not self.distributed:
            return self.df.withColumns(wrapped)
        mine = self.df.withColumns({f"__v{i}": F.struct(v.alias("v")) for i, v in enumerate(values.values())})
        last = sorted(mine.groupBy(PID).agg(*(F.max_by(f"__v{i}", LOC).alias(f"__v{i}") for i in range(len(values)))).collect(), key=lambda r: r[PID])
        out = {}
        for i, name in enumerate(values):
            kind = mine.schema[f"__v{i}"].dataType["v"].dataType.simpleString()
            carry = {b[PID]: a[f"__v{i}"]["v"] for a, b in zip(last, last[1:], strict=False)}
            first = F.when(F.col(LOC) == 0, F.when(F.col(PID) > min((r[PID] for r in last), default=0), F.struct(self._carried(carry, kind).alias("v"))))
            out[name] = F.coalesce(wrapped[name], first)
        return self.df.withColumns(out).drop(PID, LOC)

    def running_sum(self, values: dict[str, Column]) -> DataFrame:
        """For each name, the sum of its expression up to and including each row; NULL counts as nothing."""
        up_to = self.wide.rowsBetween(Window.unboundedPreceding, 0)
        sums = {k: F.coalesce(F.sum(v).over(up_to), F.lit(0)) for k, v in values.items()}
        if not self.distributed:
            return self.df.withColumns(sums)
        totals = sorted(self.df.groupBy(PID).agg(*(F.sum(v).alias(f"__v{i}") for i, v in enumerate(values.values()))).collect(), key=lambda r: r[PID])
        out = {}
        for i, name in enumerate(values):
            before, carry = 0, {}
            for r in totals:
                carry[r[PID]], before = before, before + (r[f"__v{i}"] or 0)
            kind = "double" if isinstance(before, float) else "long"
            out[name] = sums[name] + F.coalesce(self._carried(carry, kind), F.lit(0))
        return self.df.withColumns(out).drop(PID, LOC)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """An order key that isn't unique leaves the order of its ties open: refuse it."""
    if df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise ValueError(f"order key {list(keys)} isn't unique")


def exact_quantiles(df: DataFrame, keys: Sequence[str], x: Column, probs: Sequence[float], name: str) -> DataFrame:
    """(keys, ``name``: the quantiles of x, interpolated) without bringing a group's values together.

    Counts by value are range partitioned by (keys, value) and added up across partitions; of each quantile the two
    values are picked whose places it lies between.
    """
    own = [f"__k{i}" for i in range(len(keys))]
    counted = df.select(*(F.col(f"`{k}`").alias(o) for k, o in zip(keys, own, strict=True)), x.alias("__x")).where("__x is not null").groupBy(*own, "__x").agg(F.count("*").alias("__c"))
    sums = Ordered(counted, [*own, "__x"], small=0).running_sum({"__to": F.col("__c")}).withColumn("__from", F.col("__to") - F.col("__c"))
    ends = sums.groupBy(*own).agg(F.min("__from").alias("__start"), F.max("__to").alias("__end"))
    same = F.lit(True)
    for o in own:
        same &= F.col(o).eqNullSafe(F.col(f"_{o}"))
    ends = ends.select(*(F.col(o).alias(f"_{o}") for o in own), "__start", "__end")
    placed = sums.join(ends, same) if own else sums.crossJoin(ends)  # one row of ends
    picks = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("__end") - F.col("__start") - 1)
        for side, place in (("l", F.floor(at)), ("h", F.ceil(at))):
            place += F.col("__start")
            picks.append(F.max(F.when((F.col("__from") <= place) & (place < F.col("__to")), F.col("__x"))).alias(f"{side}{i}"))
        picks.append(F.max(at).alias(f"p{i}"))
    picked = placed.groupBy(*own).agg(*picks)
    between = [
        F.when(F.col(f"l{i}") == F.col(f"h{i}"), F.col(f"l{i}")).otherwise((F.ceil(f"p{i}") - F.col(f"p{i}")) * F.col(f"l{i}") + (F.col(f"p{i}") - F.floor(f"p{i}")) * F.col(f"h{i}"))
        for i in range(len(probs))
    ]
    return picked.select(*(F.col(o).alias(k) for o, k in zip(own, keys, strict=True)), F.array(*between).alias(name))
