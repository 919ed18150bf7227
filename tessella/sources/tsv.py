"""Strict TSV: no quoting, no escapes; several files are one stream in the order given.

Lines are read by Spark's own text source, so any store and codec that it knows works. A line's place is (file, offset
of its block, number in its task): ``ORDER`` columns that sort like the stream. What is known a file (where its data
begins) comes from one small aggregation.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ["__file", "__block", "__line"]


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(value, path, and ORDER columns) of every line; a carriage return before the line's end is dropped."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files: list[str] = []
    for p in paths:
        files += sorted(spark.read.text(p).inputFiles())
    files = list(dict.fromkeys(files))
    if not files:
        return spark.createDataFrame([], "value string, path string, __file int, __block long, __line long")
    # the URIs that _metadata gives differ in slashes from those of inputFiles
    short = lambda p: re.sub(r"^(\w+):/+", r"\1:/", p)
    known = spark.createDataFrame([(short(p), i) for i, p in enumerate(files)], "__path string, __file int")
    rows = spark.read.option("lineSep", "\n").text(paths).select(
        F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__line"),
    )
    keyed = rows.withColumn("__path", F.regexp_replace("path", r"^(\w+):/+", "$1:/"))
    return keyed.join(known, "__path").select("value", "path", *ORDER)


def header_lines(mode: str) -> int | None:
    """Lines of a fixed header: of ``first`` 1, of ``none`` 0, of ``lines:N`` N; None where ``#`` lines decide."""
    if mode in ("first", "none"):
        return 1 if mode == "first" else 0
    if m := re.fullmatch(r"lines:(\d+)", mode):
        if int(m[1]) == 0:
            raise ValueError("a header has one line at least")
        return int(m[1])
    if mode in ("hash", "hash1"):
        return None
    raise ValueError(f"no header mode {mode!r}")


def header_names(spark: SparkSession, path: str, mode: str, delimiter: str) -> list[str]:
    """Names of the last header line of a file; without a header, field1, field2, ..."""
    n = header_lines(mode)
    lines, some = spark.read.option("lineSep", "\n").text(path), max(64, n or 0)
    top = [r.value.removesuffix("\r") for r in lines.take(some)]
    while n is None and len(top) == some and all(line.startswith("#") for line in top[:-1]):  # comments go on
        some *= 4
        top = [r.value.removesuffix("\r") for r in lines.take(some)]
    if n is None:
        n = next((i for i, line in enumerate(top) if not line.startswith("#")), len(top))
        if mode == "hash1":
            n += 1 if n < len(top) else 0
    if mode == "none":
        return [f"field{i + 1}" for i in range(len(top[0].split(delimiter)) if top else 1)]
    if n == 0 or not top:
        return []
    line = top[min(n, len(top)) - 1].removeprefix("﻿")
    return (line.lstrip("#") if mode == "hash" else line).split(delimiter)


def read_tsv(spark: SparkSession, paths: str | Sequence[str], header: str = "first", delimiter: str = "\t", ragged: str = "fail", blank_lines: bool = True, order: bool = False) -> DataFrame:
    """Text columns by the first file's header; later files' headers are skipped.

    ``header``: first, none, lines:N, hash (leading ``#`` lines) or hash1 (those and one more). ``ragged`` lines ``fail``,
    are ``pad``-ded with NULL and cut, or are kept as they are in an array column (``keep``). ``order`` keeps the
    ORDER columns. Names that repeat get a number.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    names = header_names(spark, paths[0], header, delimiter)
    seen: dict[str, int] = {}
    unique = []
    for c in names:
        seen[c] = seen.get(c, 0) + 1
        unique.append(c if seen[c] == 1 else f"{c}_{seen[c]}")
    lines = read_lines(spark, paths)
    n = header_lines(header)
    if n != 0:
        begin = F.min("__line") + n if n is not None else F.coalesce(F.min(F.when(~F.col("value").startswith("#"), F.col("__line"))), F.lit(1 << 62)) + (1 if header == "hash1" else 0)
        starts = lines.where("__block = 0").groupBy("__file").agg(begin.alias("__begin"))
        lines = lines.join(starts, "__file", "left").where("__begin is null or __block > 0 or __line >= __begin")
    if not blank_lines:
        lines = lines.where("value != ''")
    cells = F.split("value", "\\Q" + delimiter + "\\E", -1)
    kept = [F.col(c) for c in ORDER] if order else []
    if ragged == "keep":
        return lines.select(*kept, cells.alias("fields"))
    if ragged == "fail":
        size = F.size(cells)
        message = F.concat(F.lit("line of "), size.cast("string"), F.lit(f" fields, not {len(unique)}, in "), F.col("path"))
        cells = F.when(size == len(unique), cells).otherwise(F.raise_error(message))
    elif ragged != "pad":
        raise ValueError("ragged is fail, pad or keep")
    return lines.select(*kept, cells.alias("__cells")).select(*kept, *(F.get("__cells", F.lit(i)).alias(c) for i, c in enumerate(unique)))
