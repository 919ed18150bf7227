"""Exact sums of long vectors of whole numbers over the rows of a table: a task sends its own once, in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 1 << 13
#: Blocks in a batch.
SENT = 64
SCHEMA = "block long, sums binary"


def sent(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a task passes on: the blocks of its sums that aren't all zero, a few at a time."""
    for at in range(0, len(sums), SENT * BLOCK):
        part = sums[at : at + SENT * BLOCK]
        blocks = np.pad(part, (0, -len(part) % BLOCK)).reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(at // BLOCK + some), pa.array([blocks[k].astype(np.int64).tobytes() for k in some], pa.binary())], names=["block", "sums"])


def _added(block: pa.Table) -> pa.Table:
    """The sums of a block's rows, of which there are as many as tasks."""
    total = np.zeros(BLOCK, np.int64)
    for x in block["sums"]:
        total += np.frombuffer(x.as_buffer(), np.int64)
    return pa.table({"block": block["block"][:1], "sums": pa.array([total.tobytes()], pa.binary())})


def total(rows: DataFrame, func: Callable, size: int) -> np.ndarray:
    """The sums that ``func``, an Arrow function over rows, sends from all tasks."""
    got = rows.mapInArrow(func, SCHEMA).groupBy("block").applyInArrow(_added, SCHEMA).toArrow()
    out = np.zeros(-(-size // BLOCK) * BLOCK)
    for k, x in zip(got["block"].to_pylist(), got["sums"], strict=True):
        out[k * BLOCK : (k + 1) * BLOCK] = np.frombuffer(x.as_buffer(), np.int64)
    return out[:size]
