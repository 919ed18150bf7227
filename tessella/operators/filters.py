"""Row filters: numeric, text, regular-expression, length and field-to-field tests, combined by AND or OR.

A test is a keyword with one spec or a list of them, ``"FIELDS:VALUE"`` (split at the last colon, or else at the last
space) or a tuple ``(fields, value)``. A list of fields makes one test a field. NULL and the empty text are missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import FieldError, resolve_fields, split_last
from ..functions.numbers import ieee, missing, num, plain

_LOOKAROUND = ("(?=", "(?!", "(?<=", "(?<!")


def _pattern(text: str, fold: bool) -> str:
    """Only what a linear-time engine could match; character classes are Unicode's."""
    if any(x in text for x in _LOOKAROUND):
        raise ValueError(f"look-around isn't supported in {text!r}")
    return ("(?iuU)" if fold else "(?U)") + text


def graphemes(c: Column) -> Column:
    return F.regexp_count(plain(c), F.lit(r"\X"))


def _unary() -> dict[str, Callable[[Column, object], Column]]:
    return {
        "empty": lambda c, _: missing(c),
        "not_empty": lambda c, _: ~missing(c),
        "blank": lambda c, _: ~plain(c).rlike(r"(?U)\S"),
        "not_blank": lambda c, _: plain(c).rlike(r"(?U)\S"),
        "is_numeric": lambda c, k: num(c, k).isNotNull(),
        "is_finite": lambda c, k: F.coalesce(~F.isnan(num(c, k)) & (F.abs(num(c, k)) != float("inf")), F.lit(False)),
        "is_nan": lambda c, k: F.coalesce(F.isnan(num(c, k)), F.lit(False)),
        "is_infinity": lambda c, k: F.coalesce(F.abs(num(c, k)) == float("inf"), F.lit(False)),
    }


def _valued() -> dict[str, Callable[[Column, object, str], Column]]:
    out: dict[str, Callable[[Column, object, str], Column]] = {}
    for op in ("eq", "ne", "lt", "le", "gt", "ge"):
        out[op] = lambda c, k, v, op=op: ieee(op, num(c, k), F.lit(float(v)))
        out[f"char_len_{op}"] = lambda c, _, v, op=op: ieee(op, graphemes(c).cast("double"), F.lit(float(v)))
        out[f"byte_len_{op}"] = lambda c, _, v, op=op: ieee(op, F.octet_length(plain(c)).cast("double"), F.lit(float(v)))
    text = lambda c: c.cast("string")
    for name, test in {"lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "eq": lambda a, b: a == b}.items():
        out[f"str_{name}"] = lambda c, _, v, test=test: test(text(c), F.lit(v))
    out["str_ne"] = lambda c, _, v: c.isNull() | (text(c) != v)
    out["istr_eq"] = lambda c, _, v: F.lower(text(c)) == v.lower()
    out["istr_ne"] = lambda c, _, v: c.isNull() | (F.lower(text(c)) != v.lower())
    out["str_in_fld"] = lambda c, _, v: plain(c).contains(v)
    out["str_not_in_fld"] = lambda c, _, v: ~plain(c).contains(v)
    out["istr_in_fld"] = lambda c, _, v: F.lower(plain(c)).contains(v.lower())
    out["istr_not_in_fld"] = lambda c, _, v: ~F.lower(plain(c)).contains(v.lower())
    out["regex"] = lambda c, _, v: plain(c).rlike(_pattern(v, False))
    out["not_regex"] = lambda c, _, v: ~plain(c).rlike(_pattern(v, False))
    out["iregex"] = lambda c, _, v: plain(c).rlike(_pattern(v, True))
    out["not_iregex"] = lambda c, _, v: ~plain(c).rlike(_pattern(v, True))
    return out


def _apart(left: Column, right: Column) -> Column:
    return F.abs(left - right)


def _relative(left: Column, right: Column) -> Column:
    """abs(l - r) / min(abs(l), abs(r)); equal values are 0 apart, a zero on one side alone is infinitely far."""
    low = F.least(F.abs(left), F.abs(right))
    return F.when(left == right, 0.0).when(low == 0, float("inf")).otherwise(F.abs(left - right) / low)


UNARY, VALUED = _unary(), _valued()
PAIRED = {f"ff_{op}" for op in ("eq", "ne", "lt", "le", "gt", "ge")} | {"ff_str_eq", "ff_str_ne", "ff_istr_eq", "ff_istr_ne"}
MEASURED = {"ff_absdiff_le": (_apart, "le"), "ff_absdiff_gt": (_apart, "gt"), "ff_reldiff_le": (_relative, "le"), "ff_reldiff_gt": (_relative, "gt")}


def _many(spec) -> Iterable:
    return spec if isinstance(spec, list) else [spec]


def _pairs(df: DataFrame, left: str, right: str) -> list[tuple[str, str]]:
    a, b = resolve_fields(left, df.columns), resolve_fields(right, df.columns)
    if len(a) != len(b):
        raise FieldError(f"field lists of different length: {left!r}, {right!r}")
    return list(zip(a, b, strict=True))


def predicates(df: DataFrame, safe: bool = True, **tests) -> list[Column]:
    """One Column a test and field; NULL-free if ``safe``, else NULL stands for false, and scans can take the terms."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    number = lambda c: num(F.col(f"`{c}`"), kinds[c])
    out: list[Column] = []
    for name, specs in tests.items():
        for spec in _many(specs):
            if name in UNARY:
                out += [UNARY[name](F.col(f"`{c}`"), kinds[c]) for c in resolve_fields(spec, df.columns)]
            elif name in VALUED:
                fields, value = spec if isinstance(spec, tuple) else split_last(spec)
                out += [VALUED[name](F.col(f"`{c}`"), kinds[c], str(value)) for c in resolve_fields(fields, df.columns)]
            elif name in PAIRED:
                left, right = spec if isinstance(spec, tuple) else split_last(spec)
                op = name.rpartition("_")[2]
                for a, b in _pairs(df, left, right):
                    if "str" in name:
                        x, y = (plain(F.col(f"`{c}`")) for c in (a, b))
                        x, y = (F.lower(x), F.lower(y)) if "istr" in name else (x, y)
                        out.append(x == y if op == "eq" else x != y)
                    else:
                        out.append(ieee(op, number(a), number(b)))
            elif name in MEASURED:
                if isinstance(spec, tuple):
                    left, right, limit = spec
                else:
                    both, limit = split_last(spec)
                    left, right = split_last(both)
                measure, op = MEASURED[name]
                out += [ieee(op, measure(number(a), number(b)), F.lit(float(limit))) for a, b in _pairs(df, left, right)]
            elif name == "expr":
                from ..plans.expr import predicate

                out.append(predicate(spec, df))
            else:
                raise ValueError(f"no test named {name!r}")
    return [F.coalesce(p, F.lit(False)) for p in out] if safe else out


def filter_rows(df: DataFrame, any_of: bool = False, invert: bool = False, count: bool = False, label: str | None = None, label_values: tuple[str, str] = ("1", "0"), **tests) -> DataFrame:
    """Rows that pass all tests (any, with ``any_of``; those that don't, with ``invert``).

    ``count`` gives one row with the number of such rows (``n``); ``label`` keeps all rows and adds a column of that
    name that holds the first label value for rows that pass and the second for the others.
    """
    if count and label is not None:
        raise ValueError("count and label exclude each other")
    plain_where = not (any_of or invert or count or label is not None)
    tested = predicates(df, safe=not plain_where, **tests)
    if not tested:
        passes = F.lit(True)
    else:
        passes = reduce((lambda a, b: a | b) if any_of else (lambda a, b: a & b), tested)
    passes = ~passes if invert else passes
    if label is not None:
        return df.withColumn(label, F.when(passes, F.lit(label_values[0])).otherwise(F.lit(label_values[1])))
    if count:
        return df.agg(F.count_if(passes).alias("n"))
    return df.where(passes)
