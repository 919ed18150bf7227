"""Text plots: Spark computes what is drawn, the driver draws a canvas of bounded size."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import resolve_fields
from ..functions.numbers import num
from ..plans.order import Ordered
from .bins import bin2d, box_outliers, box_stats, regression

MARKS = "•+xo*#@%"
#: Glyphs of density, each from that share of the fullest cell on; less isn't drawn.
SHADES = [(0.05, "·"), (0.2, "░"), (0.4, "▒"), (0.6, "▓"), (0.8, "█")]


def nice_step(span: float, parts: int = 5) -> float:
    """A step of 1, 2 or 5 times a power of ten that makes about so many parts."""
    if span <= 0:
        return 1.0
    raw = span / parts
    power = 10.0 ** math.floor(math.log10(raw))
    return next(f * power for f in (1, 2, 5, 10) if raw <= f * power * (1 + 1e-9))


def breaks(low: float, high: float, parts: int = 5) -> list[float]:
    step = nice_step(high - low, parts)
    first = math.ceil(low / step - 1e-9)
    return [k * step for k in range(first, math.floor(high / step + 1e-9) + 1)]


class Canvas:
    def __init__(self, width: int, height: int, x: tuple[float, float], y: tuple[float, float]):
        self.width, self.height = width, height
        self.x, self.y = (a if a[1] > a[0] else (a[0] - 0.5, a[0] + 0.5) for a in (x, y))
        self.cells = [[" "] * width for _ in range(height)]

    def at(self, x: float, y: float) -> tuple[int, int]:
        column = round((x - self.x[0]) / (self.x[1] - self.x[0]) * (self.width - 1))
        row = round((self.y[1] - y) / (self.y[1] - self.y[0]) * (self.height - 1))
        return column, row

    def put(self, x: float, y: float, mark: str) -> None:
        column, row = self.at(x, y)
        if 0 <= column < self.width and 0 <= row < self.height:
            self.cells[row][column] = mark

    def line(self, x0: float, y0: float, x1: float, y1: float, mark: str) -> None:
        steps = max(self.width, self.height) * 2
        for k in range(steps + 1):
            self.put(x0 + (x1 - x0) * k / steps, y0 + (y1 - y0) * k / steps, mark)

    def text(self) -> str:
        labels = {self.at(self.x[0], b)[1]: f"{b:g}" for b in breaks(*self.y)}
        margin = max(map(len, labels.values()), default=0)
        lines = [f"{labels.get(i, ''):>{margin}} │{''.join(row)}".rstrip() for i, row in enumerate(self.cells)]
        axis = [" "] * self.width
        for b in breaks(*self.x):
            column, shown = self.at(b, self.y[0])[0], f"{b:g}"
            column = max(0, min(column, self.width - len(shown)))
            axis[column : column + len(shown)] = shown
        return "\n".join([*lines, " " * margin + " └" + "─" * self.width, " " * (margin + 2) + "".join(axis).rstrip()])


def plot_point(df: DataFrame, x: str, y: str, by: str | None = None, width: int = 60, height: int = 20, line: bool = False, ols: bool = False, path: Sequence[str] = ()) -> str:
    """Scatter (one mark a group), lines through points sorted by x, the least-squares line, or a path.

    A path joins points in the order of the columns named by ``path``. Points are reduced to the canvas's cells, and
    steps of a path to pairs of cells, by one aggregation before they are collected.
    """
    cx, cy = (resolve_fields(f, df.columns)[0] for f in (x, y))
    group = resolve_fields(by, df.columns)[0] if by else None
    order = [F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(path)]
    rows = df.select(num(F.col(f"`{cx}`"), df.schema[cx].dataType).alias("x"), num(F.col(f"`{cy}`"), df.schema[cy].dataType).alias("y"), (F.col(f"`{group}`").cast("string") if group else F.lit("")).alias("g"), *order)
    rows = rows.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    b = rows.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if b[0] is None:
        return "(no points)"
    canvas = Canvas(width, height, (b[0], b[1]), (b[2], b[3]))
    sx, sy = (canvas.x[1] - canvas.x[0]) / (width - 1), (canvas.y[1] - canvas.y[0]) / (height - 1)
    placed = rows.withColumns({"i": F.round((F.col("x") - canvas.x[0]) / sx), "j": F.round((F.col("y") - canvas.y[0]) / sy)})
    cells = placed.groupBy("g", "i", "j").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    points = sorted(cells.collect(), key=lambda r: (r.g or "", r.x))
    groups = sorted({r.g or "" for r in points})
    if ols:
        fit = regression(rows, "x", "y").first()
        if fit.slope is not None:
            canvas.line(b[0], fit.slope * b[0] + fit.intercept, b[1], fit.slope * b[1] + fit.intercept, "─")
    if path:
        step = Ordered(placed, ["g", *(f"o{i}" for i in range(len(path)))]).previous({"p": F.struct("g", "i", "j")})
        step = step.where("p is not null and p.v.g <=> g and (p.v.i != i or p.v.j != j)").select("p.v.i", "p.v.j", F.col("i").alias("i2"), F.col("j").alias("j2")).distinct()
        for r in step.collect():
            canvas.line(*(canvas.x[0] + r[0] * sx, canvas.y[0] + r[1] * sy, canvas.x[0] + r[2] * sx, canvas.y[0] + r[3] * sy), "·")
    for k, g in enumerate(groups):
        own = [r for r in points if (r.g or "") == g]
        if line:
            for p, q in zip(own, own[1:], strict=False):
                canvas.line(p.x, p.y, q.x, q.y, "·")
        for r in own:
            canvas.put(r.x, r.y, MARKS[k % len(MARKS)])
    legend = "" if not group else "\n" + "  ".join(f"{MARKS[k % len(MARKS)]} {g}" for k, g in enumerate(groups))
    return canvas.text() + legend


def plot_box(df: DataFrame, field: str, by: str | None = None, width: int = 60) -> str:
    """One box a group: whiskers, quartiles, median and outliers."""
    rows = box_stats(df, field, by, outliers=False).collect()
    if not rows or rows[0].min is None:
        return "(no values)"
    low, high = min(r.min for r in rows), max(r.max for r in rows)
    name = resolve_fields(by, df.columns)[0] if by else None
    labels = [str(r[name]) if name else field for r in rows]
    # outliers are reduced to the canvas's columns before they are collected
    column = F.round((F.col("outlier") - low) / ((high - low) or 1.0) * (width - 1))
    far = box_outliers(df, field, by)
    group = F.col(f"`{name}`").cast("string") if name else F.lit(field)
    marks: dict[str, list[float]] = {}
    for r in far.groupBy(group.alias("g"), column.alias("c")).agg(F.first("outlier").alias("v")).collect():
        marks.setdefault(str(r.g), []).append(r.v)
    margin, out = max(map(len, labels)), []
    for label, r in sorted(zip(labels, rows, strict=True), key=lambda p: p[0]):
        canvas = Canvas(width, 1, (low, high), (0.0, 1.0))
        canvas.line(r.low, 0.5, r.high, 0.5, "─")
        canvas.line(r.q1, 0.5, r.q3, 0.5, "█")
        for v, mark in ((r.low, "├"), (r.high, "┤"), (r.median, "│"), *((o, "○") for o in marks.get(label, []))):
            canvas.put(v, 0.5, mark)
        out.append(f"{label:>{margin}} {''.join(canvas.cells[0])}".rstrip())
    return "\n".join([*out, f"{'':>{margin}} {low:g}{f'{high:g}':>{max(1, width - len(f'{low:g}'))}}"])


def plot_bin2d(df: DataFrame, x: str, y: str, bins: tuple[int, int] | None = (40, 16), binwidth: tuple[float, float] | float | None = None, strategy: str | None = None) -> str:
    """A heat map of counts, by numbers of bins, their widths or a rule for their numbers."""
    rows = bin2d(df, x, y, bins, binwidth, strategy).collect()
    most = max((r["count"] for r in rows), default=1)
    cells = {(r.x_bin, r.y_bin): r["count"] for r in rows}
    fixed = binwidth is None and strategy is None and bins
    wide, high = bins if fixed else (max((r[k] for r in rows), default=0) + 1 for k in ("x_bin", "y_bin"))
    shade = lambda n: next((g for share, g in reversed(SHADES) if n >= share * most), " ")
    return "\n".join("".join(shade(cells.get((i, j), 0)) for i in range(wide)).rstrip() for j in reversed(range(high)))
