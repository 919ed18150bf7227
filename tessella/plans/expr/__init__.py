"""The expression language: parsed to a tree, compiled to Columns; what can't be typed is evaluated in Python."""

from .api import evaluate_rows, extend, mutate, predicate, register, select_expr, skip_null
from .parser import ExprError, parse

__all__ = ["ExprError", "evaluate_rows", "extend", "mutate", "parse", "predicate", "register", "select_expr", "skip_null"]
