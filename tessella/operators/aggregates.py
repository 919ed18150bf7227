"""Aggregates of a user's own: a state that starts, takes in values, merges with others, and ends in a result.

Every task keeps one state a key that it has met (at most MOST_STATES, then they are passed on), taking a batch of
a key's values at a time. States of a key are merged in a tree: by key and task group first, then by key. So no task reads
more of a hot key than its own rows, and no more states than tasks in a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import resolve_fields

MOST_STATES = 50_000
#: Task groups whose states of a key are merged first.
GROUPS = 256


class Aggregate(Protocol):
    """``state`` and ``result`` are Spark types; a state is a tuple of the state's fields."""

    state: str
    result: str

    def start(self) -> tuple: ...

    def update(self, state: tuple, values: Sequence[pa.Array]) -> tuple:
        """Takes in some rows of one key: an array a field."""
        ...

    def merge(self, a: tuple, b: tuple) -> tuple: ...

    def finish(self, state: tuple) -> Any: ...


def _rows(states: dict[tuple, tuple], keys: pa.Schema, fields: list[str], kinds: list[pa.DataType], group: int) -> pa.RecordBatch:
    """Keys, the number of a task group, and states."""
    cols = [pa.array([k[i] for k in states], t) for i, t in enumerate(keys.types)]
    cols.append(pa.array([group] * len(states), pa.int32()))
    cols += [pa.array([s[i] for s in states.values()], t) for i, t in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(cols, names=[*keys.names, "__group", *fields])


def _partial(aggregate: Aggregate, n_keys: int, fields: list[str], kinds: list[pa.DataType], groups: int, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, tuple] = {}
        group = TaskContext.get().partitionId() % groups
        schema = None
        for batch in batches:
            if not len(batch):
                continue
            schema = pa.schema([batch.schema.field(i) for i in range(n_keys)])
            code = np.zeros(len(batch), np.int64)
            for i in range(n_keys):
                own = batch.column(i).dictionary_encode("encode").indices.to_numpy()
                code = np.unique(code * (int(own.max()) + 1) + own, return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            rows = batch.take(pa.array(order))
            edges = [0, *(np.flatnonzero(np.diff(code[order])) + 1).tolist(), len(order)]
            for a, b in zip(edges, edges[1:], strict=False):
                key = tuple(rows.column(i)[a].as_py() for i in range(n_keys))
                values = [c.slice(a, b - a) for c in rows.columns[n_keys:]]
                states[key] = aggregate.update(states[key] if key in states else aggregate.start(), values)
            if len(states) > most:
                yield _rows(states, schema, fields, kinds, group)
                states = {}
        if states:
            yield _rows(states, schema, fields, kinds, group)

    return run


def _merged(aggregate: Aggregate, fields: list[str], kinds: list[pa.DataType]) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        states = zip(*(rows.column(f).to_pylist() for f in fields), strict=True)
        state = next(states)
        for other in states:
            state = aggregate.merge(state, other)
        keys = [c for c in rows.column_names if c not in fields]
        return pa.table([*(rows.column(k)[:1] for k in keys), *(pa.array([v], t) for v, t in zip(state, kinds, strict=True))], names=[*keys, *fields])

    return run


def _finished(aggregate: Aggregate, n_keys: int, kind: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = zip(*(c.to_pylist() for c in batch.columns[n_keys:]), strict=True)
            result = pa.array([aggregate.finish(s) for s in states], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], result], names=[*batch.schema.names[:n_keys], "__result"])

    return run


def aggregate_rows(df: DataFrame, group_by: str | None, fields: str, name: str, aggregate: Aggregate, most: int = MOST_STATES) -> DataFrame:
    """One row a key (or one in all), with the aggregate's result of ``fields`` as ``name``.

    Missing values are passed on as NULL. An empty frame gives no rows, or without keys the result of a state that has
    just started. Keys compare as Spark's do.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    keys = resolve_fields(group_by, df.columns) if group_by else []
    inputs = resolve_fields(fields, df.columns)
    parsed = T._parse_datatype_string(aggregate.state)
    names = [f"__s{i}" for i in range(len(parsed.fields))]
    kinds = [to_arrow_type(f.dataType) for f in parsed.fields]
    own = T.StructType([T.StructField(f"__k{i}", df.schema[k].dataType) for i, k in enumerate(keys)])
    states = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, parsed.fields, strict=True)])
    chosen = df.select(*(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)), *(F.col(f"`{c}`").alias(f"__v{i}") for i, c in enumerate(inputs)))
    marked = T.StructType([*own.fields, T.StructField("__group", T.IntegerType()), *states.fields])
    partial = chosen.mapInArrow(_partial(aggregate, len(keys), names, kinds, GROUPS, most), marked)
    merge = _merged(aggregate, names, kinds)
    some = partial.groupBy(*(f.name for f in own.fields), "__group").applyInArrow(merge, marked).drop("__group")
    every = T.StructType([*own.fields, *states.fields])
    whole = some.groupBy(*(f.name for f in own.fields)).applyInArrow(merge, every)
    kind = T._parse_datatype_string(aggregate.result)
    done = whole.mapInArrow(_finished(aggregate, len(keys), to_arrow_type(kind)), T.StructType([*own.fields, T.StructField("__result", kind)]))
    if not keys:
        start = spark.createDataFrame([(aggregate.finish(aggregate.start()),)], T.StructType([T.StructField("__start", kind)]))
        done = start.join(done, F.lit(True), "left").select(F.coalesce("__result", "__start").alias("__result"))
    return done.select(*(F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)), F.col("__result").alias(name))
