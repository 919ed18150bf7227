"""Transposed tables of any number of rows, as a folder of text files.

A transposed table has a line a field, with as many cells as there were rows, so no line need fit anywhere. Rows are
numbered and cut into tiles; a tile's task turns its rows into one *segment* a field. Segments are written in order of
(field, tile) by Spark's text writer with a tab after each: the first segment of the next line stands after a line break
within the last one of the line before. The parts, in order of their names, are one file of tab-separated lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.order import SMALL_ROWS, Ordered, materialized
from ..sources.tsv import ORDER
from .tables import _text

TILE_ROWS = 4096
#: The last part's name: it sorts after Spark's.
TAIL = "part-z"


def _turned(delimiter: str) -> Callable:
    """(tile, cells of a row) in order of tiles and rows to (tile, field, number, segment): cells of one field, joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []

        def turned() -> Iterator[pa.RecordBatch]:
            for i in range(held[0].num_columns if held else 0):
                cells = [x or "" for h in held for x in h.column(i).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tile], pa.int64()), pa.array([i], pa.int32()), pa.array([len(cells)], pa.int32()), pa.array([delimiter.join(cells)], pa.string())],
                    names=["tile", "field", "n", "segment"],
                )

        for batch in batches:
            own = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for a, b in pairwise(edges):
                if b == a:
                    continue
                if own[a] != tile:
                    yield from turned()
                    tile, held = int(own[a]), []
                held.append(pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[1:]], names=batch.schema.names[1:]))
        yield from turned()

    return run


def segments(df: DataFrame, order_by: Sequence[str], tile_rows: int = TILE_ROWS, delimiter: str = "\t", small: int = SMALL_ROWS) -> DataFrame:
    """(tile, field, n, segment): of each field the cells of each run of rows, as text."""
    cells = [_text(df, c).alias(f"c{i}") for i, c in enumerate(df.columns)]
    numbered = Ordered(df, order_by, small).number("__row", 0).select(F.floor(F.col("__row") / tile_rows).alias("tile"), "__row", *cells)
    tiles = numbered.repartition("tile").sortWithinPartitions("tile", "__row").drop("__row")
    return tiles.mapInArrow(_turned(delimiter), "tile long, field int, n int, segment string")


def write_transposed(df: DataFrame, path: str, order_by: Sequence[str], tile_rows: int = TILE_ROWS, delimiter: str = "\t", small: int = SMALL_ROWS) -> None:
    """One line a field: its name, then its cells in the order of rows. Cells may hold neither tabs nor line breaks."""
    spark, names = df.sparkSession, df.columns
    parts = materialized(segments(df, order_by, tile_rows, delimiter, small))
    last = parts.agg(F.max("tile")).first()[0]
    if last is None:
        spark.createDataFrame([("\n".join(names),)], "value string").coalesce(1).write.text(path, lineSep="\n")
        return
    breaks = F.length(F.regexp_replace("segment", f"[^{delimiter}\n\r]", ""))
    if parts.where(breaks != F.col("n") - 1).limit(1).count():
        raise ValueError("cells hold tabs or line breaks")
    following = F.get(F.array(*(F.lit(n) for n in [*names[1:], ""])), F.col("field"))
    value = F.when(F.col("tile") == last, F.concat("segment", F.lit("\n"), following)).otherwise(F.col("segment"))
    end = (F.col("tile") == last) & (F.col("field") == len(names) - 1)
    first = spark.createDataFrame([(names[0], -1, -1)], "value string, field int, tile long")
    lines = parts.where(~end).select(value.alias("value"), "field", "tile").union(first)
    lines.repartitionByRange("field", "tile").sortWithinPartitions("field", "tile").select("value").write.text(path, lineSep=delimiter)
    tail = parts.where(end).select(F.col("segment").alias("value"))
    tail.coalesce(1).write.text(f"{path}/_tail", lineSep="\n")
    _moved(spark, f"{path}/_tail", f"{path}/{TAIL}")


def _moved(spark: SparkSession, folder: str, target: str) -> None:
    """The only part of a folder as a file of its own."""
    jvm = spark._jvm.org.apache.hadoop.fs
    source = jvm.Path(folder)
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(source) if f.getPath().getName().startswith("part-")]
    if len(found) != 1 or not fs.rename(found[0], jvm.Path(target)):
        raise OSError(f"can't move the last line's end to {target}")
    fs.delete(source, True)


def read_transposed(spark: SparkSession, path: str, delimiter: str = "\t", small: int = SMALL_ROWS) -> DataFrame:
    """The table whose transposition a folder holds: text columns, and ``row``, the place of each row.

    Cells are read where they lie, in any number of tasks: a cell's place in the whole says its field and its row.
    """
    pieces = spark.read.option("lineSep", delimiter).text(path)
    pieces = pieces.select("value", F.col("_metadata.file_name").alias(ORDER[0]), F.col("_metadata.file_block_start").alias(ORDER[1]), F.monotonically_increasing_id().alias(ORDER[2]))
    numbered = materialized(Ordered(pieces, ORDER, small).number("__k", 0))
    broken = F.col("value").contains("\n")
    width = numbered.agg(F.min(F.when(broken, F.col("__k")))).first()[0]
    if width is None:
        raise ValueError("a transposed table has two lines at least")
    ends = numbered.where(broken).select("__k", F.split("value", "\n")).collect()  # one piece a field
    names = [numbered.where("__k = 0").first().value]
    if width == 0:  # fields without any cells
        names = [n for n in ends[0][1] if n]
        return spark.createDataFrame([], ", ".join(["row long", *(f"`{n}` string" for n in names)]))
    for k, parts in sorted(ends):
        if len(parts) > 2 or k % width:
            raise ValueError("lines of a transposed table differ in length")
        if parts[1]:
            names.append(parts[1])
    cells = numbered.where("__k > 0").select(
        F.floor((F.col("__k") - 1) / width).cast("int").alias("field"), ((F.col("__k") - 1) % width).alias("row"), F.split_part("value", F.lit("\n"), F.lit(1)).alias("x")
    )
    return cells.groupBy("row").agg(*(F.max(F.when(F.col("field") == i, F.col("x"))).alias(n) for i, n in enumerate(names)))
