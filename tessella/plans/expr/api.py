"""Expressions over DataFrames: evaluate, extend, mutate, filter and skip nulls, and running globals."""

from __future__ import annotations

import contextlib
import logging
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..order import SMALL_ROWS, Ordered
from ..scan import scanned
from .compiler import COMPILED, Scope, Typed, Untypable, compile_expr, mixed, text, truthy
from .evaluator import FUNCTIONS, Env, adopt, evaluate, show
from .evaluator import truthy as plain_truthy
from .globals import references, update_of
from .parser import Binary, Bind, Call, ExprError, Items, Lit, Ref, Seq, parse


BUILT_IN = frozenset(FUNCTIONS)


def _scope(df: DataFrame, raw: bool, on_error: str) -> Scope:
    if on_error not in ("fail", "null"):
        raise ValueError("on_error is fail or null")
    return Scope({f.name: f.dataType for f in df.schema.fields}, raw, on_error)


def header(e: Any, source: str) -> str:
    """Name of an expression's column: its variable, its column, or its text."""
    if isinstance(e, Seq):
        e = e.parts[-1]
    if isinstance(e, Bind):
        return e.name
    if isinstance(e, Ref) and isinstance(e.name, str):
        return e.name
    return source.strip()


def evaluate_rows(df: DataFrame, expr: str, on_error: str = "fail") -> Column:
    """The expression evaluated in Python, in Arrow batches: a text Column. For what the compiler can't type."""
    tree, names = parse(expr), list(df.columns)
    own = {k: v for k, v in FUNCTIONS.items() if k not in BUILT_IN}

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        adopt(own)
        for part in parts:
            out = []
            for row in part.itertuples(index=False, name=None):
                cells = [None if x is None or x is pd.NaT or isinstance(x, float) and x != x else x for x in row]
                try:
                    v = evaluate(tree, Env(names, cells))
                    out.append(None if v is None else show(v))
                except (ExprError, ValueError, TypeError, IndexError):
                    if on_error == "fail":
                        raise
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return run(F.struct(*(F.col(f"`{c}`") for c in names)))


def _compiled(df: DataFrame, expr: str, raw: bool, on_error: str) -> tuple[Any, Typed]:
    tree = parse(expr)
    try:
        return tree, shown(compile_expr(tree, _scope(df, raw, on_error)))
    except Untypable as why:
        logging.getLogger(__name__).warning("evaluated row by row in Python (%s): %s", why, expr)
        return tree, Typed(evaluate_rows(df, expr, on_error), "string")


def shown(x: Typed) -> Typed:
    """Values whose type differs by row come out as text."""
    return Typed(text(x), "string") if mixed(x.t) else x


def predicate(expr: str, df: DataFrame, raw: bool = True, on_error: str = "fail") -> Column:
    """Truthiness of an expression; text columns may hold numbers."""
    tree = parse(expr)
    try:
        return truthy(compile_expr(tree, _scope(df, raw, on_error)))
    except Untypable:
        shown = evaluate_rows(df, f"if({expr}, 'y', '')", on_error)
        return F.coalesce(shown == "y", F.lit(False))


def select_expr(df: DataFrame, expr: str, raw: bool = True, on_error: str = "fail", keep: bool = False) -> DataFrame:
    """The expression's value as new columns: a list written out makes one column an item."""
    tree = parse(expr)
    last = tree.parts[-1] if isinstance(tree, Seq) else tree
    own = [F.col(f"`{c}`") for c in df.columns] if keep else []
    if isinstance(last, Items) and last.items:
        scope = _scope(df, raw, on_error)
        before = tree.parts[:-1] if isinstance(tree, Seq) else ()
        try:
            for p in before:
                compile_expr(p, scope)
            made = [compile_expr(i, scope) for i in last.items]
            names = [header(i, f"c{k}") for k, i in enumerate(last.items, 1)]
            return df.select(*own, *(shown(m).c.alias(n) for m, n in zip(made, names, strict=True)))
        except Untypable:
            pass
    _, x = _compiled(df, expr, raw, on_error)
    return df.select(*own, x.c.alias(header(tree, expr)))


def extend(df: DataFrame, raw: bool = True, on_error: str = "fail", **exprs: str) -> DataFrame:
    """New columns by name."""
    return df.withColumns({n: _compiled(df, e, raw, on_error)[1].c for n, e in exprs.items()})


def mutate(df: DataFrame, expr: str, raw: bool = True, on_error: str = "fail") -> DataFrame:
    """Replaces the column that a trailing ``as @name`` names."""
    tree = parse(expr)
    last = tree.parts[-1] if isinstance(tree, Seq) else tree
    if not isinstance(last, Bind) or last.name not in df.columns:
        raise ExprError("mutate needs a trailing 'as @column' of an existing column")
    return df.withColumn(last.name, _compiled(df, expr, raw, on_error)[1].c)


def skip_null(df: DataFrame, expr: str, raw: bool = True, on_error: str = "fail") -> DataFrame:
    """The expression's value, for rows where it isn't null."""
    out = select_expr(df, expr, raw, on_error)
    return out.where(F.col(f"`{out.columns[0]}`").isNotNull())


def register(name: str, fewest: int, most: int | None, plain: Callable, compiled: Callable[..., Column] | None = None, kind: str = "string") -> None:
    """Adds a function to the language: ``plain`` evaluates values; ``compiled``, if given, makes a Column of type
    ``kind`` of its arguments' Columns, else calls are evaluated in Python.
    """
    if name in FUNCTIONS:
        raise ExprError(f"{name} is taken")
    FUNCTIONS[name] = (fewest, most, plain)
    if compiled is not None:
        COMPILED[name] = lambda args, scope: Typed(compiled(*(compile_expr(a, scope).c for a in args)), kind)


def as_text(df: DataFrame, expr: str, raw: bool = True, on_error: str = "fail") -> Column:
    return text(_compiled(df, expr, raw, on_error)[1])


def _running(tree: Any) -> tuple[str, Any] | None:
    """(name, addend) of ``default(@__x, 0) + e as @__x``."""
    if isinstance(tree, Bind) and tree.name.startswith("__") and isinstance(tree.value, Binary) and tree.value.op == "+":
        left = tree.value.left
        if left == Call("default", (Ref(tree.name), Lit(0))):
            return tree.name, tree.value.right
    return None


def scan_globals(
    df: DataFrame, expr: str, order_by: Sequence[str], raw: bool = True, on_error: str = "fail", small: int = SMALL_ROWS, partitions: int | None = None, start: dict[str, tuple] | None = None
) -> tuple[DataFrame, Column, dict[str, tuple] | None] | None:
    """(rows with the states of all globals, the value of the last part, the states after the last row); None if an
    update can't be composed. ``start`` are states to go on from, as returned.
    """
    tree = parse(expr)
    parts = tree.parts if isinstance(tree, Seq) else (tree,)
    bound = {p.name: i for i, p in enumerate(parts) if isinstance(p, Bind) and p.name.startswith("__")}
    if len(bound) < sum(isinstance(p, Bind) and p.name.startswith("__") for p in parts):
        return None
    known: dict[str, tuple[Typed, Typed]] = {}  # before and after the row's update
    states: dict[str, tuple] = {}

    def seen(upto: int) -> tuple[Scope, Typed | None]:
        """What the parts before this place say, and the last one's value."""
        scope, out = _scope(df, raw, on_error), None
        scope.variables.update({g: before for g, (before, _) in known.items()})
        for i, p in enumerate(parts[:upto]):
            if bound.get(getattr(p, "name", None)) == i and isinstance(p, Bind):
                if p.name in known:
                    scope.variables[p.name] = out = known[p.name][1]
                continue
            try:
                out = compile_expr(p, scope)
            except (Untypable, ExprError):
                if len(known) == len(bound):
                    raise
        return scope, out

    frame, chance = df, []
    while len(known) < len(bound):
        ready = []
        for g, i in bound.items():
            if g not in known:
                with contextlib.suppress(Untypable, ExprError):
                    ready.append((g, *update_of(parts[i].value, g, seen(i)[0])))
        if not ready:
            return None
        frame, last = scanned(frame, order_by, [u for _, u, _, _ in ready], small, partitions, [start[g] for g, *_ in ready] if start else None)
        states.update(zip([g for g, *_ in ready], last or [], strict=False))
        for k, (g, u, t, by_chance) in enumerate(ready):
            names = [f"__{len(known)}_{w}" for w in ("before", "after")]
            frame = frame.withColumnsRenamed({f"__before{k}": names[0], f"__after{k}": names[1]})
            known[g] = tuple(Typed(F.col(n), t) for n in names)
            chance.append(u.zero_missing and by_chance)
        odd = f"__odd_{len(known)}"
        frame = frame.withColumnRenamed("__odd", odd)
        if any(chance[-len(ready) :]) and frame.where(odd).limit(1).count():
            return None
    try:
        return frame, shown(seen(len(parts))[1]).c, states or None
    except Untypable:
        return None


def running(df: DataFrame, expr: str, order_by: Sequence[str], name: str | None = None, raw: bool = True, on_error: str = "fail", small: int = SMALL_ROWS, partitions: int | None = None) -> DataFrame:
    """An expression with globals (names that begin with two underscores) that last over rows, in order.

    Updates that add to a global, multiply it, bound it by ``min`` or ``max``, set it, or leave it, each also on a
    condition of the row, are composed and run in parallel; a global may use others, and be read before its update,
    where it still has the value of the row before. The plain sum is a window. Anything else is evaluated in order by
    one task, which suits small frames only; a warning says so.
    """
    tree = parse(expr)
    found = _running(tree)
    name = name or header(tree, expr).removeprefix("__")
    if found and not any(str(r).startswith("__") for r in references(found[1])):
        addend = compile_expr(found[1], _scope(df, raw, on_error))
        return Ordered(df, order_by, small, partitions).running_sum({name: addend.c})
    if (composed := scan_globals(df, expr, order_by, raw, on_error, small, partitions)) is not None:
        return composed[0].select(*(F.col(f"`{c}`") for c in df.columns), composed[1].alias(name))
    logging.getLogger(__name__).warning("evaluated row by row in one task: %s", expr)
    columns = list(df.columns)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, Any] = {}
        for part in parts:
            out = []
            for row in part.itertuples(index=False, name=None):
                env = Env(columns, [None if x is None or isinstance(x, float) and x != x else x for x in row], dict(kept))
                v = evaluate(tree, env)
                kept = {k: x for k, x in env.variables.items() if str(k).startswith("__")}
                out.append(None if v is None else show(v))
            yield part.assign(**{name: pd.Series(out, dtype=object, index=part.index)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{name}` string"
    return df.repartition(1).sortWithinPartitions(*order_by).mapInPandas(run, schema)


__all__ = ["as_text", "evaluate_rows", "extend", "mutate", "plain_truthy", "predicate", "register", "running", "select_expr", "skip_null"]
