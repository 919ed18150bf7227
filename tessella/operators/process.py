"""Rows piped through an external process, as lines; off unless it is allowed, for the command runs on executors."""

from __future__ import annotations

import itertools
import subprocess
import tempfile
import threading
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of output that are held at a time.
BATCH = 10_000


def pipe_rows(df: DataFrame, command: Sequence[str], delimiter: str = "\t", allow: bool = False, single: bool = False) -> DataFrame:
    """The body (all partitions apart, or as ``single``) through ``command``; the columns keep their names.

    A failing command fails the job. Cells are text; a delimiter in a cell isn't escaped.
    """
    if not allow:
        raise PermissionError("pipe_rows runs a process on every executor: pass allow=True")
    names = df.columns
    lines = df.select(F.concat_ws(delimiter, *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names)).alias("value"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with tempfile.TemporaryFile("w+") as complaints:
            process = subprocess.Popen(list(command), stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=complaints, text=True)

            def feed() -> None:
                try:
                    for p in parts:
                        process.stdin.writelines(v + "\n" for v in p["value"])
                    process.stdin.close()
                except BrokenPipeError:
                    pass  # the command has read all it wants

            writer = threading.Thread(target=feed)
            writer.start()
            while rows := [line.rstrip("\n").split(delimiter) for line in itertools.islice(process.stdout, BATCH)]:
                yield pd.DataFrame([(r + [""] * len(names))[: len(names)] for r in rows], columns=names, dtype=object)
            writer.join()
            if process.wait():
                complaints.seek(0)
                raise RuntimeError(f"{command[0]} ended with {process.returncode}: {complaints.read()[-500:]}")

    lines = lines.coalesce(1) if single else lines
    return lines.mapInPandas(run, ", ".join(f"`{c}` string" for c in names))
