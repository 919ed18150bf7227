"""Lazy operators: each takes a DataFrame and returns one."""

from .bins import bin2d, bin_values, box_outliers, box_stats, regression
from .dedup import uniq
from .filters import filter_rows
from .joins import join_rows
from .ordered import blank, fill, nl, reverse, running_sum, slice_rows, sort_rows
from .reshape import longer, transpose, wider
from .sampling import sample
from .select import select
from .sets import append, except_left, intersect_left, union_distinct
from .shape import check, header_table
from .stats import stats

__all__ = [
    "append", "bin2d", "bin_values", "blank", "box_outliers", "box_stats", "check", "except_left", "fill", "filter_rows", "header_table",
    "intersect_left", "join_rows", "longer", "nl", "regression", "reverse", "running_sum", "sample", "select", "slice_rows",
    "sort_rows", "stats", "transpose", "union_distinct", "uniq", "wider",
]
