"""Running state over ordered rows as a parallel prefix: transitions of rows are composed, not rows read in turn.

A row changes a numeric state x to ``max(lo, min(hi, a * x + b))`` where there is a state and to ``n`` where there is
none. Such transitions are closed under composition, so each run of rows becomes one transition, the state before each
partition follows from one transition a run on the driver, and every partition applies its own rows from there. Sums,
counts, products, minima, maxima, constants on a condition, saturating sums and smoothing are all of this form. A state
of any other type is *kept*: rows set it or leave it.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import pairwise
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import LOC, PID, SMALL_ROWS, Ordered

#: Bounds of whole numbers: sums of any 64-bit data that don't overflow keep these out of reach of states.
FAR = 1 << 61
BLOCK = 4096


@dataclass
class Update:
    """A global's transition of a row, as Columns.

    Numeric: ``a``, ``b``, ``lo``, ``hi`` (NULL: no bound), ``gone`` (the state is set to NULL), ``n`` (what a missing state
    becomes). Kept: ``setting`` (whether the row sets the state), ``value``, and ``n``, a literal or None.
    ``zero_missing``: a state of zero, or an empty text, counts as missing when it is read.
    """

    name: str
    kind: str  # long, double, or a kept state's type
    parts: dict[str, Column]
    numeric: bool
    zero_missing: bool = False

    def column(self) -> Column:
        number = lambda c: c.cast(self.kind)
        if not self.numeric:
            return F.struct(self.parts["setting"].alias("setting"), self.parts["value"].cast(self.kind).alias("value"), self.parts["n"].cast(self.kind).alias("n"))
        p = self.parts
        return F.struct(*(number(p[k]).alias(k) for k in ("a", "b", "lo", "hi")), p["gone"].alias("gone"), number(p["n"]).alias("n"))


class Steps:
    """Transitions of consecutive rows, or of consecutive runs of rows, as arrays."""

    NAMES = ("a", "b", "lo", "hi", "gone", "n", "none")

    def __init__(self, arrays: dict[str, np.ndarray], zero_missing: bool):
        self.v, self.zero = arrays, zero_missing

    def __len__(self) -> int:
        return len(self.v["a"])

    @classmethod
    def of(cls, column: pa.StructArray, kind: str, zero_missing: bool) -> Steps:
        whole = kind == "bigint"
        far = FAR if whole else np.inf

        def numbers(name: str, missing: Any) -> np.ndarray:
            return pc.fill_null(column.field(name), missing).to_numpy(zero_copy_only=False).astype(np.int64 if whole else float)

        out = {"a": numbers("a", 1), "b": numbers("b", 0), "lo": numbers("lo", -far), "hi": numbers("hi", far), "n": numbers("n", 0)}
        out["gone"] = column.field("gone").to_numpy(zero_copy_only=False).astype(bool)
        out["none"] = column.field("n").is_null().to_numpy(zero_copy_only=False)
        return cls(out, zero_missing)

    def tidied(self) -> Steps:
        """What is zero for any state, where zero counts as missing, is missing for the row after."""
        if not self.zero:
            return self
        v = self.v
        zero = (v["a"] == 0) & (np.maximum(v["lo"], np.minimum(v["hi"], v["b"])) == 0)
        return Steps(v | {"gone": v["gone"] | zero, "none": v["none"] | (v["n"] == 0)}, self.zero)

    def nothing(self) -> np.ndarray:
        """Rows that make zero, or nothing, of any state and of none."""
        v = self.v
        zero = (v["a"] == 0) & (np.maximum(v["lo"], np.minimum(v["hi"], v["b"])) == 0)
        return (v["gone"] | zero) & (v["none"] | (v["n"] == 0))

    def at(self, where) -> Steps:
        return Steps({k: x[where] for k, x in self.v.items()}, self.zero)

    def after(self, first: Steps) -> Steps:
        """These transitions, each after one of ``first``."""
        s, f = self.v, first.v
        lo, hi = (s["a"] * f[k] for k in ("lo", "hi"))
        if lo.dtype == float:
            with np.errstate(invalid="ignore"):
                lo, hi = np.where(s["a"] == 0, 0, lo), np.where(s["a"] == 0, 0, hi)
        lo, hi = np.minimum(lo, hi), np.maximum(lo, hi)
        clamp = lambda x: np.maximum(s["lo"], np.minimum(s["hi"], x))
        out = {"a": s["a"] * f["a"], "b": s["a"] * f["b"] + s["b"], "lo": clamp(lo + s["b"]), "hi": clamp(hi + s["b"]), "gone": s["gone"]}
        for k, x in (("a", 0), ("b", s["n"]), ("lo", s["n"]), ("hi", s["n"]), ("gone", s["none"])):
            out[k] = np.where(f["gone"], x, out[k])
        value, none = self.given(f["n"], f["none"])
        return Steps(out | {"n": value, "none": none}, self.zero).tidied()

    def given(self, state: np.ndarray, none: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, whether it is missing) that these transitions make of states."""
        v = self.v
        x = np.where(none, v["n"], np.maximum(v["lo"], np.minimum(v["hi"], v["a"] * state + v["b"])))
        return x, np.where(none, v["none"], v["gone"])

    def prefixes(self) -> Steps:
        """Of each row, all transitions up to and including its own."""
        out, k = self, 1
        while k < len(self):
            both = out.at(slice(k, None)).after(out.at(slice(None, -k)))
            out = Steps({n: np.concatenate([out.v[n][:k], both.v[n]]) for n in self.NAMES}, self.zero)
            k *= 2
        return out

    def whole(self) -> Steps:
        """All transitions as one."""
        out = self
        while len(out) > 1:
            odd = out.at(slice(len(out) - len(out) % 2, None))
            even = out.at(slice(1, len(out) - len(out) % 2, 2)).after(out.at(slice(0, len(out) - len(out) % 2, 2)))
            out = Steps({n: np.concatenate([even.v[n], odd.v[n]]) for n in self.NAMES}, self.zero)
        return out


class Number:
    """A numeric state that goes through rows in order."""

    def __init__(self, update: tuple, carried: tuple = (None, False)):
        self.kind, self.zero = update[1:]
        self.state, self.by_chance = carried  # by chance: a zero that the last row came upon by arithmetic

    @property
    def carried(self) -> tuple:
        return self.state, self.by_chance

    def missing(self) -> bool:
        return self.state is None or self.zero and self.state == 0

    def _given(self, steps: Steps) -> None:
        x, none = steps.given(np.full(1, 0 if self.missing() else self.state, steps.v["a"].dtype), np.full(1, self.missing()))
        self.state = None if none[0] else x[0].item()
        self.by_chance = bool(self.state == 0 and not steps.nothing()[-1])

    def run(self, column: pa.StructArray) -> tuple[dict, dict]:
        """A run of rows as one transition of all but the last, and the last."""
        steps = Steps.of(column, self.kind, self.zero)
        head = steps.at(slice(0, len(steps) - 1)).tidied().whole()
        return head.v, steps.at(slice(len(steps) - 1, None)).v

    def skip(self, run: tuple[dict, dict]) -> None:
        for arrays in run:
            if len(arrays["a"]):
                self._given(Steps(arrays, self.zero))

    def through(self, column: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
        """(state after each row, rows that met a zero by chance, which the form doesn't allow for)."""
        steps = Steps.of(column, self.kind, self.zero)
        after, odd = [], []
        for at in range(0, len(steps), BLOCK):
            rows = steps.at(slice(at, at + BLOCK))
            n = len(rows)
            start = np.full(n, 0 if self.missing() else self.state, rows.v["a"].dtype)
            x, none = rows.tidied().prefixes().given(start, np.full(n, self.missing()))
            x, none = rows.given(np.concatenate([start[:1], x[:-1]]), np.concatenate([[self.missing()], none[:-1]]))
            by_zero, by_none = rows.given(np.zeros(n, x.dtype), np.zeros(n, bool)), rows.given(x, np.ones(n, bool))
            differ = (by_zero[1] != by_none[1]) | ~by_zero[1] & (by_zero[0] != by_none[0])
            chance = ~none & (x == 0) & ~rows.nothing()
            odd.append(differ & np.concatenate([[self.by_chance], chance[:-1]]) & self.zero)
            after.append(pa.array(x, mask=none))
            self.state, self.by_chance = after[-1][-1].as_py(), bool(chance[-1])
        return pa.concat_arrays(after), np.concatenate(odd)


class Kept:
    """A state of any type that rows set or leave."""

    def __init__(self, update: tuple, carried: tuple = (None,)):
        self.kind, self.zero = update[1:]
        self.state = carried[0]

    @property
    def carried(self) -> tuple:
        return (self.state,)

    def missing(self) -> bool:
        return self.state is None or self.zero and not self.state

    def run(self, column: pa.StructArray) -> tuple:
        setting = np.flatnonzero(column.field("setting").to_numpy(zero_copy_only=False).astype(bool))
        n = column.field("n")[0].as_py()
        if not len(setting):
            return False, None, True, n
        return True, column.field("value")[int(setting[-1])].as_py(), setting[-1] < len(column) - 1, n

    def skip(self, run: tuple) -> None:
        sets, value, later, n = run
        if sets:
            self.state = value
        if later and self.missing():
            self.state = n

    def through(self, column: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
        setting, value = column.field("setting").to_numpy(zero_copy_only=False).astype(bool), column.field("value")
        n = len(setting)
        last = np.maximum.accumulate(np.where(setting, np.arange(n), -1))
        after = pa.concat_arrays([value, pa.array([self.state], value.type)]).take(pa.array(np.where(last < 0, n, last)))
        leave = pa.array(~setting)
        if self.zero and (pa.types.is_string(value.type) or pa.types.is_primitive(value.type) and not pa.types.is_temporal(value.type)):
            empty = pa.scalar("" if pa.types.is_string(value.type) else 0).cast(value.type)
            after = pc.if_else(pc.and_(leave, pc.fill_null(pc.equal(after, empty), False)), pa.scalar(None, value.type), after)
        after = pc.if_else(pc.and_(leave, after.is_null()), column.field("n"), after)
        self.state = after[n - 1].as_py()
        return after, np.zeros(n, bool)


def _states(plain: list[tuple], carried: Sequence[tuple] | None = None) -> list[Number | Kept]:
    kinds = [Number if u[0] else Kept for u in plain]
    return [k(u, *([c] if carried else [])) for k, u, c in zip(kinds, plain, carried or plain, strict=True)]


def _edges(pid: np.ndarray, loc: np.ndarray) -> list[int]:
    """Where runs of consecutive rows of a partition begin, and the end."""
    return [0, *(np.flatnonzero((pid[1:] != pid[:-1]) | (loc[1:] != loc[:-1] + 1)) + 1).tolist(), len(pid)]


def _runs(plain: list[tuple]) -> Callable:
    """(partition, place, transitions) to one composed transition a run of rows and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            pid, loc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            states, edges = _states(plain), _edges(pid, loc)
            made = [pickle.dumps([s.run(batch.column(2 + i).slice(a, b - a)) for i, s in enumerate(states)]) for a, b in pairwise(edges)]
            first = edges[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(pid[first]), pa.array(loc[first]), pa.array(made, pa.binary())], names=["pid", "loc", "made"])

    return run


def _applied(plain: list[tuple], sent, width: int) -> Callable:
    """Rows in order of (partition, place), those columns and the transitions last, to rows with the states before and after each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, states, names = None, [], []
        for batch in batches:
            if not len(batch):
                continue
            names = names or [*batch.schema.names[:width], *(f"__{k}{i}" for i in range(len(plain)) for k in ("before", "after")), "__odd"]
            pid = batch.column(width).to_numpy()
            edges = [0, *(np.flatnonzero(pid[1:] != pid[:-1]) + 1).tolist(), len(pid)]
            for a, b in pairwise(edges):
                if pid[a] != at:
                    at, states = pid[a], _states(plain, sent.value[int(pid[a])])
                out, odd = [], np.zeros(b - a, bool)
                for i, s in enumerate(states):
                    before = s.state
                    after, met = s.through(batch.column(width + 1 + i).slice(a, b - a))
                    out += [pa.concat_arrays([pa.array([before], after.type), after[:-1]]), after]
                    odd |= met
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:width]), *out, pa.array(odd)], names=names)

    return run


def scanned(
    df: DataFrame, order_by: Sequence[str | Column], updates: Sequence[Update], small: int = SMALL_ROWS, partitions: int | None = None, start: Sequence[tuple] | None = None
) -> tuple[DataFrame, list[tuple] | None]:
    """(df with ``__before{i}`` and ``__after{i}`` of each update, and ``__odd``; the states after the last row).

    ``__odd`` is whether a state that counts zero as missing came upon a zero by arithmetic, after which states are not
    reliable. Runs of rows are composed where they lie; one transition a run and batch reaches the driver, one state a
    partition goes back. ``start`` are states to go on from, as returned; a frame of up to ``small`` rows is read by
    one task and returns none.
    """
    plain = [(u.numeric, u.kind, u.zero_missing) for u in updates]
    columns = [f"__u{i}" for i in range(len(updates))]
    rows = Ordered(df.withColumns({c: u.column() for c, u in zip(columns, updates, strict=True)}), order_by, small, partitions)
    own = [F.col(f"`{c}`") for c in df.columns]
    states = _states(plain, start)
    if rows.distributed:
        runs = rows.df.select(PID, LOC, *columns).mapInArrow(_runs(plain), "pid long, loc long, made binary").collect()
        carried: dict[int, list[tuple]] = {}
        for r in sorted(runs, key=lambda r: (r.pid, r.loc)):
            carried.setdefault(r.pid, [s.carried for s in states])
            for s, made in zip(states, pickle.loads(r.made), strict=True):
                s.skip(made)
        ordered = rows.df.repartition(PID).sortWithinPartitions(PID, LOC).select(*own, PID, *columns)
    else:
        carried = {0: [s.carried for s in states]}
        ordered = rows.df.withColumn(PID, F.lit(0).cast("long")).repartition(1).sortWithinPartitions(*rows.keys).select(*own, PID, *columns)
    kinds = ordered.schema
    schema = T.StructType(list(df.schema.fields))
    for i in range(len(updates)):
        kind = kinds[columns[i]].dataType["n"].dataType
        schema = schema.add(f"__before{i}", kind).add(f"__after{i}", kind)
    sent = df.sparkSession.sparkContext.broadcast(carried)
    out = ordered.mapInArrow(_applied(plain, sent, len(df.columns)), schema.add("__odd", T.BooleanType()))
    return out, [s.carried for s in states] if rows.distributed else None


def running_states(df: DataFrame, order_by: Sequence[str | Column], updates: Sequence[Update], small: int = SMALL_ROWS, partitions: int | None = None) -> DataFrame:
    return scanned(df, order_by, updates, small, partitions)[0]


def counting(name: str) -> Update:
    """The number of rows so far."""
    return Update(name, "bigint", {"a": F.lit(1), "b": F.lit(1), "lo": F.lit(None), "hi": F.lit(None), "gone": F.lit(False), "n": F.lit(1)}, True)


def keeping(name: str, value: Column, kind: str, setting: Column | None = None) -> Update:
    """The last value; with ``setting``, of rows where it holds."""
    return Update(name, kind, {"setting": F.lit(True) if setting is None else setting, "value": value, "n": F.lit(None)}, False)
