"""Shared folders for results that are read more than once, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read again: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def folder(spark: SparkSession, name: str) -> str:
    """A path of this name and no other run's in the shared folder; what is there goes when the session ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    return written(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


_SHIPPED: set[str] = set()

#: Bytes of an Arrow batch of texts. Spark's own limit lets a task hold tens of MB several times, in its JVM and in Python.
BATCH_BYTES = 4 << 20
_BATCH_KEY, _SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Gives every executor this package, once a session's context; workers import it to run Arrow functions.

    Where the session has no limit of its own for the bytes of a batch, it gets ours; rows are never cut or left out.
    """
    if spark.conf.get(_BATCH_KEY, _SPARKS_OWN) == _SPARKS_OWN:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    key = spark.sparkContext.applicationId
    if key in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    folder = Path(tempfile.mkdtemp(prefix="tessella-ship-"))
    target = folder / "tessella.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(key)


#: Neighbours beyond which a node's minimum is sent to its edges by a broadcast, not by a shuffle of them all to one task.
HOT_NODE = 50_000


#: Rows of keys met by very many rows, which are broadcast.
MOST_HOT = 100_000


def matched(rows: DataFrame, table: DataFrame, keys: list[str], n: int) -> DataFrame:
    """rows joined with ``table`` (one row a key; c counts the rows that have it) without one task for a hot key.

    Keys of more than n / MOST_HOT rows, and of a thousand at least, can't be more than MOST_HOT for n rows that have
    a key each (a thousand times as many for rows that have a thousand): those are broadcast, all others shuffled.
    """
    limit = max(1000, n // MOST_HOT)
    hot, cold = table.where(F.col("c") > limit), table.where(F.col("c") <= limit)
    if hot.count() > MOST_HOT:
        limit = int(table.agg(F.sum("c")).first()[0]) // MOST_HOT
        hot, cold = table.where(F.col("c") > limit), table.where(F.col("c") <= limit)
    hot = F.broadcast(hot.drop("c"))
    return rows.join(hot, keys, "left_anti").join(cold.drop("c"), keys).unionByName(rows.join(hot, keys))


def _to_edges(edges: DataFrame, low: DataFrame, n: int) -> DataFrame:
    """edges (u, v), no more than n, with the minimum m of low (u, m, c) at u, where c counts u's edges there."""
    if n <= HOT_NODE:
        return edges.join(low.drop("c"), "u").select("u", "v", "m")
    hot = F.broadcast(low.where(F.col("c") > HOT_NODE).drop("c"))  # one row for HOT_NODE edges at most
    cold = edges.join(hot, "u", "left_anti").join(low.where(F.col("c") <= HOT_NODE).drop("c"), "u")
    return cold.select("u", "v", "m").union(edges.join(hot, "u").select("u", "v", "m"))


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component): the smallest id reachable from each id of links (a, b), by alternating large and small stars.

    Every star is a group-by and a join on node ids, written to the shared folder, so neither links nor labels
    reach the driver, and no plan holds the one before it many times; a node with very many neighbours is reduced to its minimum before anything is sent back.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges, path = written(edges, name)
    seen, n = None, edges.count()
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        large = _to_edges(both.where("v > u"), low, 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, large_path = written(large.union(low.where("u > m").select("u", F.col("m").alias("v"))).where("u > v").distinct(), name)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = _to_edges(large, low, 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        after = small.union(low.select("u", F.col("m").alias("v"))).distinct()
        after, new_path = written(after, name)
        state = after.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        for old in (path, large_path):
            discard(spark, old)
        edges, path = after, new_path
        if tuple(state) == seen:
            break
        seen, n = tuple(state), state[0]
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
