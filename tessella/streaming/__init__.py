"""The operators' streaming forms: stateless ones as they are, keyed state by Spark's own operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.fields import resolve_fields


def stream(spark: SparkSession, path: str, files_per_trigger: int = 10) -> DataFrame:
    """Parquet files of a folder as a stream with the schema of what is there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(df: DataFrame, event_time: str, delay: str) -> DataFrame:
    """With a watermark; event times without a zone are taken in the session's."""
    return df.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay)


def apply(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stateless operators (filter_rows, select, bin_values, extend, longer, ...) in a row."""
    for step in steps:
        df = step(df)
    return df


def join_static(df: DataFrame, lookup: DataFrame, key: str, append: str | None = None, **options) -> DataFrame:
    """A stream joined with a lookup that doesn't change."""
    from ..operators import join_rows

    return join_rows(df, lookup, key, append=append, **options)


def uniq_stream(df: DataFrame, key: str, event_time: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """The first row of each key; with an event time, a key is forgotten after ``delay``, so state is bounded."""
    names = resolve_fields(key, df.columns, zero=True)
    if event_time is None:
        return df.dropDuplicates(names)
    return timed(df, event_time, delay).dropDuplicatesWithinWatermark(names)


def stats_stream(df: DataFrame, group_by: str, **ops) -> DataFrame:
    """Grouped statistics of all that has come so far (algebraic operators; output mode complete or update)."""
    from ..operators import stats

    return stats(df, group_by, **ops)


def window_stats(df: DataFrame, event_time: str, width: str, group_by: Sequence[str] = (), delay: str = "10 minutes", slide: str | None = None, **aggs) -> DataFrame:
    """Tumbling or sliding windows over event time with a watermark; ``aggs`` are Columns by name."""
    window = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    out = timed(df, event_time, delay).groupBy(window.alias("window"), *group_by).agg(*(c.alias(n) for n, c in aggs.items()))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *group_by, *aggs)


def session_stats(df: DataFrame, event_time: str, gap: str, key: str, delay: str = "10 minutes", **aggs) -> DataFrame:
    """Sessions of a key: runs of events no more than ``gap`` apart."""
    out = timed(df, event_time, delay).groupBy(F.session_window(event_time, gap).alias("session"), key).agg(*(c.alias(n) for n, c in aggs.items()))
    return out.select(F.col("session.start").alias("start"), F.col("session.end").alias("end"), key, *aggs)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes all that is available now to Parquet (append) and stops."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Writes all that is available now to a table in memory and stops."""
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def in_batches(df: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Operators that need a whole batch (sorts, pivots, exact quantiles), on each micro-batch."""
    query = df.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
