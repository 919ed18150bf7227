"""Expression trees to typed Columns, so that Catalyst folds, prunes and generates code for them.

Types are null, bool, int, float, string, datetime, dyn (a text cell that may hold a number) and list of one of them.
Variables are inlined, lambdas become Spark's higher-order functions, pipes and methods are gone after parsing.
``Untypable`` is raised where no Column can say the same (lists of mixed types, closures as values): the caller then
evaluates the tree in Python.

Deviations kept on purpose: ``==`` between an integer and a float compares numbers; NULL in a typed column makes
arithmetic NULL instead of an error; byte-based text functions count characters; ``now()`` is constant in a query.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.numbers import num, plain
from .evaluator import FUNCTIONS, check_call, show
from .formatting import pieces
from .parser import Binary, Bind, Call, ExprError, Items, Lambda, Lit, Name, Ref, Seq, Unary


class Untypable(Exception):
    pass


@dataclass(frozen=True)
class Typed:
    c: Column
    t: Any  # a type's name, or ("list", element type)
    const: Any = field(default=None, compare=False)  # a literal's value


SPARK = {"bool": "boolean", "int": "bigint", "float": "double", "string": "string", "datetime": "timestamp", "dyn": "string", "null": "void", "any": "variant"}


def of_spark(kind: T.DataType, raw: bool) -> Any:
    if isinstance(kind, T.StringType):
        return "dyn" if raw else "string"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, T.NumericType):
        return "float"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(kind, T.ArrayType):
        return ("list", of_spark(kind.elementType, raw))
    if isinstance(kind, T.NullType):
        return "null"
    if isinstance(kind, T.VariantType):
        return "any"
    raise Untypable(kind.simpleString())


def spark_type(t: Any) -> str:
    return f"array<{spark_type(t[1])}>" if isinstance(t, tuple) else SPARK[t]


class Scope:
    def __init__(self, columns: dict[str, T.DataType], raw: bool, on_error: str):
        self.columns, self.raw, self.on_error = columns, raw, on_error
        self.variables: dict[Any, Typed] = {}
        self.names: dict[str, Typed] = {}

    def with_names(self, names: dict[str, Typed]) -> Scope:
        s = Scope(self.columns, self.raw, self.on_error)
        s.variables, s.names = dict(self.variables), {**self.names, **names}
        return s


def guarded(scope: Scope, ok: Column, value: Column, message: str) -> Column:
    """value where ok holds; else an error, or NULL in lenient mode. A NULL condition passes (the value is NULL then)."""
    otherwise = F.lit(None) if scope.on_error == "null" else F.raise_error(F.lit(message))
    return F.when(F.coalesce(ok, F.lit(True)), value).otherwise(otherwise)


def mixed(t: Any) -> bool:
    """Whether values of this type say their own type: ``any``, a VARIANT, or lists of it."""
    return mixed(t[1]) if isinstance(t, tuple) else t == "any"


def as_any(x: Typed) -> Column:
    """A value that keeps its own type among others: text of a cell is a number where it reads as one."""
    if x.t in ("any", "null"):
        return x.c.cast("variant")
    if x.t not in ("bool", "int", "float", "string", "dyn"):
        raise Untypable("lists and times among other values")
    if x.t != "dyn":
        return x.c.cast("variant")
    whole, v = x.c.rlike(r"^[+-]?\d{1,18}$"), num(x.c)
    return F.when(whole, x.c.cast("long").cast("variant")).when(v.isNotNull(), v.cast("variant")).otherwise(F.when(x.c != "", x.c).cast("variant"))


def kind_of(c: Column) -> Column:
    """null, bool, int, float or string."""
    shown = F.schema_of_variant(c)
    return F.when(c.isNull() | (shown == "VOID"), "null").when(shown == "BOOLEAN", "bool").when(shown == "BIGINT", "int").when(shown == "STRING", "string").otherwise("float")


def any_number(c: Column) -> Column:
    return F.when(kind_of(c).isin("int", "float"), F.try_variant_get(c, "$", "double"))


def any_text(c: Column) -> Column:
    kind = kind_of(c)
    return F.when(kind == "null", "null").when(kind == "float", float_text(F.try_variant_get(c, "$", "double"))).otherwise(F.try_variant_get(c, "$", "string"))


def any_key(c: Column) -> Column:
    """A text alike for equal values: whole numbers and floats of one value are."""
    kind = kind_of(c)
    return F.when(kind.isin("int", "float"), F.concat(F.lit("n"), float_text(any_number(c)))).otherwise(F.concat(F.substring(kind, 1, 1), any_text(c)))


def is_list(t: Any) -> bool:
    return isinstance(t, tuple)


def truthy(x: Typed) -> Column:
    c = x.c
    if is_list(x.t):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if x.t == "null":
        return F.lit(False)
    if x.t == "any":
        kind = kind_of(c)
        return F.when(kind == "null", F.lit(False)).when(kind == "string", any_text(c) != "").when(kind == "bool", F.try_variant_get(c, "$", "boolean")).otherwise(any_number(c) != 0)
    if x.t == "bool":
        return F.coalesce(c, F.lit(False))
    if x.t in ("int", "float"):
        return F.coalesce(c != 0, F.lit(False))
    if x.t == "dyn":
        return F.coalesce((c != "") & F.coalesce(num(c) != 0, F.lit(True)), F.lit(False))
    if x.t == "datetime":
        return c.isNotNull()
    return F.coalesce(c != "", F.lit(False))


def float_text(c: Column) -> Column:
    """Whole numbers without a point."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(F.isnan(c), "NaN").when(F.abs(c) == float("inf"), F.when(c > 0, "inf").otherwise("-inf")).when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))


def text(x: Typed) -> Column:
    """As show() does it."""
    if is_list(x.t):
        quote = x.t[1] in ("string", "dyn")
        quoted = lambda i: F.concat(F.lit('"'), i, F.lit('"'))
        if x.t[1] == "any":
            parts = F.transform(x.c, lambda i: F.when(kind_of(i) == "string", quoted(any_text(i))).otherwise(any_text(i)))
        else:
            parts = F.transform(x.c, lambda i: quoted(i) if quote else text(Typed(i, x.t[1])))
        return F.coalesce(F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]")), F.lit("null"))
    if x.t == "null":
        return F.lit("null")
    if x.t == "any":
        return any_text(x.c)
    if x.t == "dyn":
        return F.coalesce(F.when(x.c != "", x.c), F.lit("null"))
    c = float_text(x.c) if x.t == "float" else x.c.cast("string")
    return F.coalesce(c, F.lit("null"))


def number(x: Typed, scope: Scope, what: str, strict: bool) -> Typed:
    """A numeric operand; ``strict`` operands (of operators) may not be text."""
    if x.t in ("int", "float"):
        return x
    if x.t == "any":
        v = any_number(x.c) if strict else F.coalesce(any_number(x.c), num(any_text(x.c)))
        return Typed(guarded(scope, v.isNotNull() | (kind_of(x.c) == "null" if not strict else F.lit(False)), v, f"{what}: not a number"), "float")
    if x.t == "dyn" or x.t == "string" and not strict:
        v = num(x.c)
        missing = plain(x.c) == ""
        return Typed(guarded(scope, v.isNotNull() | (missing if not strict else F.lit(False)), v, f"{what}: not a number"), "float")
    if x.t == "null":
        if strict and scope.on_error != "null":
            raise ExprError(f"{what}: not a number: null")
        return Typed(F.lit(None).cast("double"), "float")
    if x.t == "bool" and not strict:
        return Typed(x.c.cast("long"), "int")
    if scope.on_error == "null":
        return Typed(F.lit(None).cast("double"), "float")
    raise ExprError(f"{what}: not a number")


def unify(items: list[Typed]) -> tuple[list[Column], Any]:
    kinds = {i.t for i in items if i.t != "null"}
    if kinds == {"string", "dyn"}:
        return [i.c for i in items], "dyn"
    if len(kinds) > 1:  # integers and floats of one list keep their own types, too
        return [as_any(i) for i in items], "any"
    t = next(iter(kinds), "null")
    return [i.c.cast(spark_type(t)) if i.t == "null" and t != "null" else i.c for i in items], t


def compile_expr(e: Any, scope: Scope) -> Typed:
    if isinstance(e, Lit):
        v = e.value
        t = "null" if v is None else "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "string"
        return Typed(F.lit(v).cast("long") if t == "int" else F.lit(v), t, v)
    if isinstance(e, Ref):
        return _ref(e, scope)
    if isinstance(e, Name):
        if e.name not in scope.names:
            raise ExprError(f"unknown name {e.name!r}")
        return scope.names[e.name]
    if isinstance(e, Items):
        items = [compile_expr(i, scope) for i in e.items]
        if any(i.t == "dyn" for i in items):  # cells are numbers where they read as such
            items = [Typed(as_any(i), "any") for i in items]
        cols, t = unify(items)
        return Typed(F.array(*cols), ("list", t))
    if isinstance(e, Lambda):
        raise Untypable("a lambda as a value")
    if isinstance(e, Unary):
        x = compile_expr(e.arg, scope)
        if e.op == "not":
            return Typed(~truthy(x), "bool")
        x = number(x, scope, "-", True)
        return Typed(-x.c, x.t)
    if isinstance(e, Bind):
        scope.variables[e.name] = x = compile_expr(e.value, scope)
        return x
    if isinstance(e, Seq):
        for p in e.parts:
            out = compile_expr(p, scope)
        return out
    if isinstance(e, Binary):
        return _binary(e.op, compile_expr(e.left, scope), compile_expr(e.right, scope), scope)
    if isinstance(e, Call):
        check_call(e.name, len(e.args))
        if e.name not in COMPILED:
            raise Untypable(e.name)
        return COMPILED[e.name](list(e.args), scope)
    raise Untypable(repr(e))


def _ref(e: Ref, scope: Scope) -> Typed:
    if e.name in scope.variables:
        return scope.variables[e.name]
    names = list(scope.columns)
    if e.name == 0:
        return Typed(F.concat_ws("\t", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names)), "string")
    if isinstance(e.name, int):
        if e.name > len(names):
            raise ExprError(f"no column @{e.name}")
        name = names[e.name - 1]
    elif e.name in scope.columns:
        name = e.name
    elif str(e.name).startswith("__"):
        raise Untypable("a global variable")
    else:
        raise ExprError(f"no column or variable @{e.name}")
    t = of_spark(scope.columns[name], scope.raw)
    c = F.col(f"`{name}`")
    return Typed(F.when(c != "", c) if t == "dyn" else c.cast("double") if t == "float" else c, t)


def _same(a: Typed, b: Typed) -> Column:
    numeric = ("int", "float")
    if a.t == "null" or b.t == "null":
        other = b if a.t == "null" else a
        return F.lit(True) if other.t == "null" else other.c.isNull()
    if a.t == b.t and a.t != "dyn" or a.t in numeric and b.t in numeric:
        if "float" in (a.t, b.t):
            return a.c.eqNullSafe(b.c) & ~F.coalesce(F.isnan(a.c.cast("double")), F.lit(False))
        return a.c.eqNullSafe(b.c)
    if "any" in (a.t, b.t):
        if is_list(a.t) or is_list(b.t) or "datetime" in (a.t, b.t):
            return F.lit(False)
        return any_key(as_any(a)) == any_key(as_any(b))
    if "dyn" in (a.t, b.t):
        d, other = (a, b) if a.t == "dyn" else (b, a)
        if other.t in numeric:
            return F.coalesce(num(d.c) == other.c, F.lit(False))
        if other.t in ("string", "dyn"):
            x, y = num(d.c), num(other.c) if other.t == "dyn" else F.lit(None).cast("double")
            as_text = d.c.eqNullSafe(other.c) if other.t == "dyn" else d.c.eqNullSafe(other.c) & x.isNull()
            return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(as_text)
    return F.lit(False)


def _binary(op: str, a: Typed, b: Typed, scope: Scope) -> Typed:
    if op == "++":
        return Typed(F.concat(text(a), text(b)), "string")
    if op in ("and", "or"):
        return Typed(truthy(a) & truthy(b) if op == "and" else truthy(a) | truthy(b), "bool")
    if op in ("==", "!="):
        same = _same(a, b)
        return Typed(same if op == "==" else ~same, "bool")
    if op in ("eq", "ne", "lt", "le", "gt", "ge"):
        x, y = text(a), text(b)
        return Typed({"eq": x == y, "ne": x != y, "lt": x < y, "le": x <= y, "gt": x > y, "ge": x >= y}[op], "bool")
    a, b = number(a, scope, op, True), number(b, scope, op, True)
    both_int = a.t == b.t == "int"
    if op in ("<", "<=", ">", ">="):
        x, y = a.c, b.c
        r = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        if not both_int:
            r = r & ~F.isnan(x.cast("double")) & ~F.isnan(y.cast("double"))
        return Typed(r, "bool")
    if op == "/":
        return Typed(guarded(scope, b.c != 0, F.try_divide(a.c.cast("double"), b.c.cast("double")), "division by zero"), "float")
    if op == "%":
        safe = F.when(b.c != 0, b.c)
        return Typed(guarded(scope, b.c != 0, a.c % safe, "division by zero"), "int" if both_int else "float")
    if op == "**":
        return Typed(F.pow(a.c.cast("double"), b.c.cast("double")), "float")
    r = {"+": lambda: a.c + b.c, "-": lambda: a.c - b.c, "*": lambda: a.c * b.c}[op]()
    return Typed(r, "int" if both_int else "float")


# functions -----------------------------------------------------------------------------------------------------------


def _string_in(x: Typed) -> Column:
    """A text argument: NULL shows as null, as show() has it."""
    return text(x)


def _strings(f, t: Any = "string"):
    def run(args, scope):
        return Typed(f(*(_string_in(compile_expr(a, scope)) for a in args)), t)

    return run


def _maths(f, ok=None, out: str = "float"):
    def run(args, scope):
        x = number(compile_expr(args[0], scope), scope, "number", False)
        v = f(x.c)
        if ok is not None:
            v = guarded(scope, ok(x.c), F.when(ok(x.c), v), "out of domain")
        return Typed(v.cast("long") if out == "int" else v, x.t if out == "same" else out)

    return run


def _constant(e, scope) -> Any:
    x = compile_expr(e, scope)
    if x.const is None:
        raise Untypable("needs a constant")
    return x.const


def _list(e, scope) -> Typed:
    x = compile_expr(e, scope)
    if not is_list(x.t):
        raise Untypable("needs a list")
    return x


def _lambda(e, params: list[Typed], scope: Scope) -> Typed:
    if not isinstance(e, Lambda) or len(e.params) != len(params):
        raise Untypable("needs a lambda of so many parameters")
    return compile_expr(e.body, scope.with_names(dict(zip(e.params, params, strict=True))))


def _body_type(e, scope: Scope, *elements: Any) -> Any:
    """The type of a lambda's result, found on stand-in columns."""
    return _lambda(e, [Typed(F.lit(None).cast(spark_type(t)) if t != "null" else F.lit(None), t) for t in elements], scope).t


def _len(args, scope):
    x = compile_expr(args[0], scope)
    if is_list(x.t):
        return Typed(F.coalesce(F.size(x.c), F.lit(0)).cast("long"), "int")
    if x.t == "null":
        return Typed(F.lit(0).cast("long"), "int")
    shown = F.when(x.c.isNull(), "").otherwise(text(x))
    return Typed(F.octet_length(shown).cast("long"), "int")


def _contains(args, scope):
    x, y = (compile_expr(a, scope) for a in args)
    if is_list(x.t):
        return Typed(F.exists(x.c, lambda i: _same(Typed(i, x.t[1]), y)), "bool")
    return Typed(text(x).contains(text(y)), "bool")


def _is_empty(args, scope):
    x = compile_expr(args[0], scope)
    if is_list(x.t):
        return Typed(F.coalesce(F.size(x.c) == 0, F.lit(True)), "bool")
    return Typed(F.lit(True) if x.t == "null" else x.c.isNull() | (text(x) == ""), "bool")


def _take(args, scope):
    x, n = compile_expr(args[0], scope), compile_expr(args[1], scope).c.cast("int")
    n = F.greatest(n, F.lit(0))
    return Typed(F.slice(x.c, F.lit(1), n), x.t) if is_list(x.t) else Typed(F.substring(text(x), F.lit(1), n), "string")


def _drop(args, scope):
    x, n = compile_expr(args[0], scope), compile_expr(args[1], scope).c.cast("int")
    n = F.greatest(n, F.lit(0))
    if is_list(x.t):
        return Typed(F.slice(x.c, n + 1, F.greatest(F.size(x.c), F.lit(0))), x.t)
    return Typed(F.substring(text(x), n + 1, F.length(text(x))), "string")


def _concat(args, scope):
    xs = [compile_expr(a, scope) for a in args]
    if is_list(xs[0].t):
        lists = [x if is_list(x.t) else Typed(F.array(x.c), ("list", x.t)) for x in xs]
        if len({x.t for x in lists}) > 1:
            lists = [_any_list(x) for x in lists]
        return Typed(F.concat(*(x.c for x in lists)), lists[0].t)
    return Typed(F.concat(*map(text, xs)), "string")


def _substr(args, scope):
    s, start, n = (compile_expr(a, scope) for a in args)
    at = F.greatest(start.c.cast("int"), F.lit(0))
    return Typed(F.substring(text(s), at + 1, F.greatest(n.c.cast("int"), F.lit(0))), "string")


def _split(args, scope):
    sep = _constant(args[1], scope)
    s = text(compile_expr(args[0], scope))
    if sep == "":
        chars = F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))
        return Typed(F.concat(F.array(F.lit("")), F.filter(chars, lambda c: c != ""), F.array(F.lit(""))), ("list", "string"))
    return Typed(F.split(s, re.sub(r"([^\w])", r"\\\1", sep), -1), ("list", "string"))


def _wordcount(args, scope):
    s = text(compile_expr(args[0], scope))
    return Typed(F.regexp_count(s, F.lit(r"(?U)\S+")).cast("long"), "int")


def _truncate(args, scope):
    s, n = text(compile_expr(args[0], scope)), compile_expr(args[1], scope).c.cast("int")
    end = text(compile_expr(args[2], scope)) if len(args) > 2 else F.lit("...")
    short = F.concat(F.substring(s, F.lit(1), F.greatest(n - F.length(end), F.lit(0))), end)
    return Typed(F.when(F.octet_length(s) <= n, s).otherwise(short), "string")


def _fmt(args, scope):
    template = _constant(args[0], scope)
    values = [compile_expr(a, scope) for a in args[1:]]
    out, turn = [], 0
    for p in pieces(template):
        if isinstance(p, str):
            out.append(F.lit(p))
            continue
        ref, spec = p
        if not ref:
            if turn >= len(values):
                raise ExprError("fmt: too few arguments")
            x, turn = values[turn], turn + 1
        elif ref.isdigit():
            x = values[int(ref) - 1]
        elif ref in scope.names:
            x = scope.names[ref]
        else:
            name = ref.removeprefix("@")
            x = _ref(Ref(int(name) if name.isdigit() else name), scope)
        out.append(_format(x, spec))
    return Typed(F.concat(*out), "string")


def _format(x: Typed, spec: str) -> Column:
    if not spec:
        return text(x)
    m = re.fullmatch(r"(?:(.)?([<>]))?([+-])?(0)?(\d+)?(?:\.(\d+))?([xX]|b)?", spec)
    if not m or x.t == "dyn":
        raise Untypable("format")
    fill, align, sign, zero, width, precision, kind = m.groups()
    numeric = x.t in ("int", "float")
    if numeric:
        size = F.abs(x.c)
        if kind:
            if x.t != "int":
                raise Untypable("format")
            shown = F.bin(size) if kind == "b" else F.lower(F.hex(size)) if kind == "x" else F.hex(size)
        elif precision is not None and x.t == "float":
            shown = F.format_string(f"%.{precision}f", size)
        elif precision is not None:
            shown = F.lpad(size.cast("string"), int(precision), "0")
        else:
            shown = text(Typed(size, x.t))
        mark = F.when(x.c < 0, "-").otherwise("+" if sign == "+" else "")
        if zero and not align:
            pad = F.greatest(F.lit(int(width or 0)) - F.length(mark) - F.length(shown), F.lit(0))
            return F.concat(mark, F.repeat(F.lit("0"), pad), shown)
        shown = F.concat(mark, shown)
    else:
        shown = text(x)
        if precision is not None:
            shown = F.substring(shown, 1, int(precision))
    if not width:
        return shown
    pad = F.repeat(F.lit(fill or " "), F.greatest(F.lit(int(width)) - F.length(shown), F.lit(0)))
    return F.concat(pad, shown) if (align or (">" if numeric else "<")) == ">" else F.concat(shown, pad)


def _extreme(f):
    def run(args, scope):
        xs = [compile_expr(a, scope) for a in args]
        xs = [number(x, scope, "min/max", False) for x in xs if x.t != "null" and not is_list(x.t)]
        if not xs:
            return Typed(F.lit(None).cast("double"), "float")
        t = "int" if all(x.t == "int" for x in xs) else "float"
        return Typed(xs[0].c if len(xs) == 1 else f(*(x.c for x in xs)), t)

    return run


def _int(args, scope):
    x = number(compile_expr(args[0], scope), scope, "int", False)
    return Typed(x.c.cast("long"), "int")


def _float(args, scope):
    x = number(compile_expr(args[0], scope), scope, "float", False)
    return Typed(x.c.cast("double"), "float")


def _pow(args, scope):
    a, b = (number(compile_expr(a, scope), scope, "pow", False) for a in args)
    return Typed(F.pow(a.c.cast("double"), b.c.cast("double")), "float")


def _branches(a: Typed, b: Typed) -> tuple[Column, Column, Any]:
    if a.t == b.t:
        return a.c, b.c, a.t
    (x, y), t = unify([a, b])
    return x, y, t


def _if(args, scope):
    c = truthy(compile_expr(args[0], scope))
    a = compile_expr(args[1], scope)
    b = compile_expr(args[2], scope) if len(args) > 2 else Typed(F.lit(None), "null")
    x, y, t = _branches(a, b)
    return Typed(F.when(c, x).otherwise(y), t)


def _default(args, scope):
    a, b = (compile_expr(x, scope) for x in args)
    if a.t == "null":
        return b
    if a.t == "float" and b.t == "int":
        b = Typed(b.c.cast("double"), "float")
    x, y, t = _branches(a, b)
    return Typed(F.when(truthy(a), x).otherwise(y), t)


def _join(args, scope):
    x, d = _list(args[0], scope), text(compile_expr(args[1], scope))
    parts = F.transform(x.c, lambda i: text(Typed(i, x.t[1])))
    joined = F.aggregate(parts, F.lit(None).cast("string"), lambda s, i: F.when(s.isNull(), i).otherwise(F.concat(s, d, i)))
    return Typed(F.coalesce(joined, F.lit("")), "string")


def _at(k):
    return lambda args, scope: (lambda x: Typed(F.try_element_at(x.c, F.lit(k)), x.t[1]))(_list(args[0], scope))


def _nth(args, scope):
    x, n = _list(args[0], scope), compile_expr(args[1], scope).c.cast("int")
    return Typed(F.get(x.c, n), x.t[1])


def _replace_nth(args, scope):
    x, n, v = _list(args[0], scope), compile_expr(args[1], scope).c.cast("int"), compile_expr(args[2], scope)
    if v.t != x.t[1]:
        element = x.t[1]
        x, v = Typed(F.transform(x.c, lambda i: as_any(Typed(i, element))), ("list", "any")), Typed(as_any(v), "any")
    inside = (n >= 0) & (n < F.size(x.c))
    return Typed(guarded(scope, inside, F.transform(x.c, lambda i, k: F.when(k == n, v.c).otherwise(i)), "replace_nth: out of range"), x.t)


def _any_list(x: Typed) -> Typed:
    element = x.t[1]
    return x if element == "any" else Typed(F.transform(x.c, lambda i: as_any(Typed(i, element))), ("list", "any"))


def _plain_element(x: Typed) -> None:
    if x.t[1] in ("dyn",) or is_list(x.t[1]):
        raise Untypable("order of such elements")


def _sort(args, scope):
    x = _list(args[0], scope)
    if x.t[1] == "any":  # values of one type together: missing ones, truth values, numbers, texts
        rank = lambda i: F.when(kind_of(i) == "null", 0).when(kind_of(i) == "bool", 1).when(kind_of(i) == "string", 3).otherwise(2)
        keyed = F.transform(x.c, lambda i, k: F.struct(rank(i).alias("r"), any_number(i).alias("n"), any_text(i).alias("t"), k.alias("k")))
        return Typed(F.transform(F.array_sort(keyed), lambda s: F.get(x.c, s["k"])), x.t)
    _plain_element(x)
    nulls = F.filter(x.c, lambda i: i.isNull())
    return Typed(F.concat(nulls, F.array_sort(F.filter(x.c, lambda i: i.isNotNull()))), x.t)


def _sort_by(args, scope):
    x = _list(args[0], scope)
    kt = _body_type(args[1], scope, x.t[1])
    if kt == "dyn" or mixed(kt) or mixed(x.t):
        raise Untypable("order of such elements")
    keyed = F.transform(x.c, lambda i, k: F.struct(_lambda(args[1], [Typed(i, x.t[1])], scope).c.alias("key"), k.alias("k"), i.alias("v")))
    return Typed(F.transform(F.array_sort(keyed), lambda s: s["v"]), x.t)


def _reduce(args, scope):
    x, init = _list(args[0], scope), compile_expr(args[1], scope)
    acc = init.t
    if acc == "null":
        raise Untypable("an initial value without a type")
    got = _body_type(args[2], scope, acc, x.t[1])
    if got == "float" and acc == "int":
        init, acc = Typed(init.c.cast("double"), "float"), "float"
        got = _body_type(args[2], scope, acc, x.t[1])
    if got != acc:
        raise Untypable("an accumulator that changes its type")
    return Typed(F.aggregate(F.coalesce(x.c, F.array().cast(spark_type(x.t))), init.c, lambda a, i: _lambda(args[2], [Typed(a, acc), Typed(i, x.t[1])], scope).c), acc)


def _map(args, scope):
    x = _list(args[0], scope)
    t = _body_type(args[1], scope, x.t[1])
    return Typed(F.transform(x.c, lambda i: _lambda(args[1], [Typed(i, x.t[1])], scope).c), ("list", t))


def _keeps(args, scope, x):
    return lambda i: truthy(_lambda(args[1], [Typed(i, x.t[1])], scope))


def _filter(args, scope):
    x = _list(args[0], scope)
    return Typed(F.filter(x.c, _keeps(args, scope, x)), x.t)


def _take_while(args, scope):
    x = _list(args[0], scope)
    first = F.array_position(F.transform(x.c, _keeps(args, scope, x)), F.lit(False))
    return Typed(F.when(first == 0, x.c).otherwise(F.slice(x.c, F.lit(1), (first - 1).cast("int"))), x.t)


def _partition(args, scope):
    x = _list(args[0], scope)
    keep = _keeps(args, scope, x)
    return Typed(F.array(F.filter(x.c, keep), F.filter(x.c, lambda i: ~keep(i))), ("list", x.t))


def _flat_map(args, scope):
    x = _map(args, scope)
    return Typed(F.flatten(x.c), x.t[1]) if is_list(x.t[1]) else x


def _flatten(args, scope):
    x = _list(args[0], scope)
    return Typed(F.flatten(x.c), x.t[1]) if is_list(x.t[1]) else x


def _zip(args, scope):
    xs = [_list(a, scope) for a in args]
    if len({x.t for x in xs}) > 1:
        xs = [_any_list(x) for x in xs]
    n = F.least(*(F.size(x.c) for x in xs))
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return Typed(F.transform(index, lambda k: F.array(*(F.get(x.c, k) for x in xs))), ("list", xs[0].t))


def _grouped(args, scope):
    x, n = _list(args[0], scope), compile_expr(args[1], scope).c.cast("int")
    starts = F.when(F.size(x.c) > 0, F.sequence(F.lit(1), F.size(x.c), n)).otherwise(F.array().cast("array<int>"))
    return Typed(F.transform(starts, lambda k: F.slice(x.c, k, n)), ("list", x.t))


def _filter_index(args, scope):
    x = _list(args[0], scope)
    keep = _keeps(args, scope, x)
    marked = F.transform(x.c, lambda i, k: F.when(keep(i), k.cast("long")))
    return Typed(F.filter(marked, lambda k: k.isNotNull()), ("list", "int"))


def _slice(args, scope):
    x = _list(args[0], scope)
    n = F.size(x.c)
    start = F.least(F.greatest(compile_expr(args[1], scope).c.cast("int"), F.lit(0)), n)
    end = F.least(F.greatest(compile_expr(args[2], scope).c.cast("int"), start), n) if len(args) > 2 else n
    return Typed(F.slice(x.c, start + 1, end - start), x.t)


def _reverse(args, scope):
    x = compile_expr(args[0], scope)
    return Typed(F.reverse(x.c), x.t) if is_list(x.t) else Typed(F.reverse(text(x)), "string")


def _unique(args, scope):
    x = _list(args[0], scope)
    if mixed(x.t):
        if x.t[1] != "any":
            raise Untypable("equality of such elements")
        shown = F.transform(x.c, any_text)  # values that look alike count as one
        return Typed(F.filter(x.c, lambda i, k: F.array_position(shown, any_text(i)) == k + 1), x.t)
    return Typed(F.array_distinct(x.c), x.t)


def _range(args, scope):
    xs = [number(compile_expr(a, scope), scope, "range", False).c.cast("long") for a in args]
    start, stop = (F.lit(0).cast("long"), xs[0]) if len(xs) == 1 else xs[:2]
    step = xs[2] if len(xs) == 3 else F.lit(1).cast("long")
    some = F.when(step > 0, start < stop).otherwise(start > stop)
    last = stop - F.signum(step).cast("long")
    safe = F.when(step != 0, step).otherwise(1)
    full = F.when(some, F.sequence(F.when(some, start).otherwise(0), F.when(some, last).otherwise(0), F.when(some, safe).otherwise(1)))
    return Typed(guarded(scope, step != 0, F.coalesce(full, F.array().cast("array<bigint>")), "range: step is zero"), ("list", "int"))


def _regex_extract(args, scope):
    s, p = text(compile_expr(args[0], scope)), _constant(args[1], scope)
    g = int(_constant(args[2], scope)) if len(args) > 2 else 0
    return Typed(F.when(s.rlike(p), F.regexp_extract(s, p, g)), "string")


def _regex_replace(args, scope):
    s, p, r = text(compile_expr(args[0], scope)), _constant(args[1], scope), _constant(args[2], scope)
    return Typed(F.regexp_replace(s, p, r), "string")


#: chrono and strftime directives as Java's date patterns.
_DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "a": "E", "A": "EEEE", "j": "DDD", "p": "a", "I": "hh", "f": "SSSSSS", "z": "xx", "F": "yyyy-MM-dd", "T": "HH:mm:ss"}


def java_pattern(f: str) -> str:
    out = []
    for m in re.finditer(r"%(.)|([^%]+)", f):
        if m[1] == "%":
            out.append("%")
        elif m[1]:
            if m[1] not in _DIRECTIVES:
                raise Untypable(f"directive %{m[1]}")
            out.append(_DIRECTIVES[m[1]])
        else:
            out.append(re.sub(r"[A-Za-z]+", lambda x: f"'{x[0]}'", m[2].replace("'", "''")))
    return "".join(out)


def _strptime(args, scope):
    s, f = text(compile_expr(args[0], scope)), java_pattern(_constant(args[1], scope))
    v = F.try_to_timestamp(s, F.lit(f))
    return Typed(guarded(scope, v.isNotNull(), v, "strptime: not a date and time of that format"), "datetime")


def _strftime(args, scope):
    x, f = compile_expr(args[0], scope), java_pattern(_constant(args[1], scope))
    c = x.c if x.t == "datetime" else F.to_timestamp(text(x))
    return Typed(F.date_format(c, f), "string")


def _type(args, scope):
    x = compile_expr(args[0], scope)
    if x.t == "any":
        return Typed(kind_of(x.c), "string")
    if x.t == "dyn":
        whole = x.c.rlike(r"^[+-]?\d{1,18}$")
        return Typed(F.when(x.c.isNull(), "null").when(whole, "int").when(num(x.c).isNotNull(), "float").otherwise("string"), "string")
    name = "list" if is_list(x.t) else x.t
    return Typed(F.lit(name) if name == "null" else F.when(x.c.isNull(), "null").otherwise(name), "string")


def _is(*names):
    def run(args, scope):
        shown = _type(args, scope).c
        return Typed(shown.isin(*names), "bool")

    return run


def _driver(name):
    """Functions of the driver's surroundings, which are constants of a query."""

    def run(args, scope):
        value = FUNCTIONS[name][2](*(_constant(a, scope) for a in args))
        return Typed(F.lit(value), "null" if value is None else "string", value)

    return run


def _last_argument(args, scope):
    return [compile_expr(a, scope) for a in args][-1]


COMPILED = {
    "len": _len, "contains": _contains, "is_empty": _is_empty, "take": _take, "drop": _drop, "concat": _concat,
    "trim": _strings(lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), "upper": _strings(F.upper), "lower": _strings(F.lower),
    "substr": _substr, "split": _split, "starts_with": _strings(lambda s, p: s.startswith(p), "bool"), "ends_with": _strings(lambda s, p: s.endswith(p), "bool"),
    "replace": _strings(F.replace), "wordcount": _wordcount, "char_len": _strings(lambda s: F.char_length(s).cast("long"), "int"), "truncate": _truncate, "fmt": _fmt,
    "abs": _maths(F.abs, out="same"), "round": _maths(lambda x: F.round(x), out="int"), "min": _extreme(F.least), "max": _extreme(F.greatest),
    "int": _int, "float": _float, "string": _strings(lambda s: s), "ceil": _maths(F.ceil, out="int"), "floor": _maths(F.floor, out="int"),
    "sqrt": _maths(F.sqrt, lambda x: x >= 0), "pow": _pow, "sin": _maths(F.sin), "cos": _maths(F.cos), "tan": _maths(F.tan),
    "ln": _maths(F.ln, lambda x: x > 0), "log10": _maths(F.log10, lambda x: x > 0), "exp": _maths(F.exp),
    "if": _if, "default": _default, "print": _last_argument, "eprint": _last_argument,
    "join": _join, "first": _at(1), "last": _at(-1), "reverse": _reverse, "nth": _nth, "replace_nth": _replace_nth, "sort": _sort, "sort_by": _sort_by,
    "unique": _unique, "slice": _slice, "reduce": _reduce, "map": _map, "filter": _filter, "take_while": _take_while, "range": _range, "flatten": _flatten,
    "zip": _zip, "partition": _partition, "flat_map": _flat_map, "grouped": _grouped, "filter_index": _filter_index,
    "regex_match": lambda args, scope: Typed(text(compile_expr(args[0], scope)).rlike(_constant(args[1], scope)), "bool"),
    "regex_extract": _regex_extract, "regex_replace": _regex_replace,
    "md5": _strings(F.md5), "sha256": _strings(lambda s: F.sha2(s, 256)), "base64": _strings(lambda s: F.base64(s.cast("binary"))), "unbase64": _strings(lambda s: F.unbase64(s).cast("string")),
    "now": lambda args, scope: Typed(F.current_timestamp(), "datetime"), "strptime": _strptime, "strftime": _strftime,
    "type": _type, "is_null": _is("null"), "is_int": _is("int"), "is_float": _is("float"), "is_numeric": _is("int", "float"), "is_string": _is("string"), "is_bool": _is("bool"), "is_list": _is("list"),
    "env": _driver("env"), "cwd": _driver("cwd"), "version": _driver("version"), "platform": _driver("platform"),
}

assert COMPILED.keys() == FUNCTIONS.keys()
__all__ = ["Scope", "Typed", "Untypable", "compile_expr", "show", "text", "truthy"]
