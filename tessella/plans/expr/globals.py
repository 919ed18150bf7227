"""Expressions with globals that last over rows, as transitions that can be composed.

An update ``... as @__x`` is taken apart into what it does to @__x: nothing, setting it, adding to it, multiplying it, bounding
it from below or above, or one of these on a condition that doesn't read it. ``default(@__x, v)`` gives v where the
state is missing, zero or empty, as everywhere in the language. A row whose own numbers are NULL leaves the state.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, is_dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..scan import Update
from .compiler import Scope, Typed, Untypable, compile_expr, number, spark_type, truthy, unify
from .parser import Binary, Call, Lit, Ref, Unary

def none() -> Column:
    return F.lit(None).cast("double")



def references(e: Any) -> set:
    """Names of all columns and variables that an expression reads."""
    if isinstance(e, Ref):
        return {e.name}
    if isinstance(e, tuple):
        return set().union(*map(references, e))
    if is_dataclass(e):
        return set().union(*(references(getattr(e, f.name)) for f in fields(e)))
    return set()


def _defaulted(e: Any, g: str) -> list:
    """All v of default(@g, v) in an expression."""
    if isinstance(e, tuple):
        return [v for x in e for v in _defaulted(x, g)]
    if not is_dataclass(e):
        return []
    own = [e.args[1]] if isinstance(e, Call) and e.name == "default" and e.args[:1] == (Ref(g),) else []
    return own + [v for f in fields(e) for v in _defaulted(getattr(e, f.name), g)]


@dataclass
class _Step:
    """x to max(lo, min(hi, a * x + b)), or to ``n`` without x; ``base`` is what the state is where it is left alone."""

    a: Column
    b: Column
    lo: Column
    hi: Column
    gone: Column
    n: Column
    base: Column
    bad: Column  # a number that the row needs is NULL
    whole: bool
    scaled: bool = False


def _identity(init: Typed | None) -> _Step:
    n = none() if init is None else init.c
    return _Step(F.lit(1), F.lit(0), none(), none(), F.lit(False), n, n, F.lit(False), init is None or init.t == "int")


def _constant(x: Typed) -> _Step:
    return _Step(F.lit(0), F.coalesce(x.c, F.lit(0)), none(), none(), x.c.isNull(), x.c, none(), F.lit(False), x.t == "int")


def _shifted(s: _Step, x: Typed) -> _Step:
    e = F.coalesce(x.c, F.lit(0))
    return replace(s, b=s.b + e, lo=s.lo + e, hi=s.hi + e, n=s.n + e, bad=s.bad | x.c.isNull(), whole=s.whole and x.t == "int")


def _scaled(s: _Step, x: Typed, plain: bool = False) -> _Step:
    """``plain``: a factor of one or minus one, which keeps whole numbers whole."""
    e = F.coalesce(x.c, F.lit(1))
    lo, hi = (F.when(e >= 0, p * e).otherwise(q * e) for p, q in ((s.lo, s.hi), (s.hi, s.lo)))
    return replace(s, a=s.a * e, b=s.b * e, lo=lo, hi=hi, n=s.n * e, bad=s.bad | x.c.isNull(), scaled=s.scaled or not plain)


def _bounded(s: _Step, x: Typed, below: bool) -> _Step:
    e = x.c
    if below:
        lo, hi, n = F.greatest(s.lo, e), F.when(s.hi.isNotNull(), F.greatest(s.hi, e)), F.greatest(s.n, e)
    else:
        lo, hi, n = F.when(s.lo.isNotNull(), F.least(s.lo, e)), F.least(s.hi, e), F.least(s.n, e)
    return replace(s, lo=lo, hi=hi, n=n, gone=s.gone & e.isNull(), whole=s.whole and x.t == "int")


def _chosen(c: Column, s: _Step, t: _Step) -> _Step:
    columns = {k: F.when(c, getattr(s, k)).otherwise(getattr(t, k)) for k in ("a", "b", "lo", "hi", "gone", "n", "base", "bad")}
    return _Step(**columns, whole=s.whole and t.whole, scaled=s.scaled or t.scaled)


def _step(e: Any, g: str, scope: Scope) -> _Step:
    def value(x: Any, what: str) -> Typed:
        return number(compile_expr(x, scope), scope, what, False)

    if g not in references(e):
        x = compile_expr(e, scope)
        if x.t not in ("int", "float", "null", "dyn"):
            raise Untypable("a global that isn't a number")
        return _constant(number(x, scope, "as", False))
    if e == Ref(g):
        return _identity(None)
    if isinstance(e, Unary) and e.op == "-":
        return _scaled(_step(e.arg, g, scope), Typed(F.lit(-1), "int"), plain=True)
    if isinstance(e, Binary):
        on_left = g in references(e.left)
        if on_left and g in references(e.right):
            raise Untypable("a global on both sides")
        inner, x = _step(e.left if on_left else e.right, g, scope), value(e.right if on_left else e.left, e.op)
        if e.op == "+":
            return _shifted(inner, x)
        if e.op == "-":
            return _shifted(inner, Typed(-x.c, x.t)) if on_left else _shifted(_scaled(inner, Typed(F.lit(-1), "int"), plain=True), x)
        if e.op == "*":
            return _scaled(inner, x)
        if e.op == "/" and on_left and isinstance(e.right, Lit) and e.right.value:
            return _scaled(inner, Typed(F.lit(1.0) / x.c, "float"))
    if isinstance(e, Call):
        if e.name == "default" and e.args[0] == Ref(g) and g not in references(e.args[1]):
            return _identity(value(e.args[1], "default"))
        if e.name in ("min", "max") and sum(g in references(x) for x in e.args) == 1:
            inner = next(_step(x, g, scope) for x in e.args if g in references(x))
            for x in e.args:
                if g not in references(x):
                    inner = _bounded(inner, value(x, e.name), e.name == "max")
            return inner
        if e.name == "if" and len(e.args) == 3 and g not in references(e.args[0]):
            return _chosen(truthy(compile_expr(e.args[0], scope)), _step(e.args[1], g, scope), _step(e.args[2], g, scope))
    raise Untypable("an update that can't be composed")


def _kept(e: Any, g: str, scope: Scope, values: list[Typed]) -> tuple[Column, Any]:
    """(whether the row sets the state, index in ``values`` or a choice of two of them) of an update that only sets or leaves."""
    if g not in references(e):
        values.append(compile_expr(e, scope))
        return F.lit(True), len(values) - 1
    if e == Ref(g) or isinstance(e, Call) and e.name == "default" and e.args[0] == Ref(g) and isinstance(e.args[1], Lit):
        return F.lit(False), None
    if isinstance(e, Call) and e.name == "if" and len(e.args) == 3 and g not in references(e.args[0]):
        c = truthy(compile_expr(e.args[0], scope))
        (s, x), (t, y) = (_kept(a, g, scope, values) for a in e.args[1:])
        return F.when(c, s).otherwise(t), (c, x, y)
    raise Untypable("an update that does more than set")


def update_of(e: Any, g: str, scope: Scope) -> tuple[Update, Any, bool]:
    """(update, type of the state, whether a zero met by arithmetic would be read as missing) of ``e as @g``."""
    inits = _defaulted(e, g)
    try:
        found: list[Typed] = []
        setting, choice = _kept(e, g, scope, found)
        literals = {v for v in inits}
        if len(literals) > 1 or not found:
            raise Untypable("several defaults")
        columns, t = unify([*found, *(compile_expr(v, scope) for v in literals)])
        if t == "null" or isinstance(t, tuple):
            raise Untypable("a state without a type")

        def picked(choice: Any) -> Column:
            if choice is None:
                return F.lit(None)
            return columns[choice] if isinstance(choice, int) else F.when(choice[0], picked(choice[1])).otherwise(picked(choice[2]))

        n = columns[-1] if literals else F.lit(None)
        return Update(g, spark_type(t), {"setting": setting, "value": picked(choice), "n": n}, False, bool(inits)), t, False
    except Untypable:
        s = _step(e, g, scope)
    whole = s.whole and not s.scaled
    leave = lambda x, y: F.when(s.bad, y).otherwise(x)
    parts = {"a": leave(s.a, F.lit(1)), "b": leave(s.b, F.lit(0)), "lo": leave(s.lo, none()), "hi": leave(s.hi, none()), "gone": leave(s.gone, F.lit(False)), "n": leave(s.n, s.base)}
    chance = any(v != Lit(0) for v in inits)
    return Update(g, "bigint" if whole else "double", parts, True, bool(inits)), "int" if whole else "float", chance
