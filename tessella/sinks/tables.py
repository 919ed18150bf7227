"""TSV and CSV files by Spark's writers; Markdown and spreadsheets, which people read, on the driver."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import resolve_fields
from ..functions.numbers import format_float, group_digits, num, plain


def _text(df: DataFrame, c: str):
    x = F.col(f"`{c}`")
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
        return F.when(x.isNull() | F.isnan(x), "nan").when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))
    return plain(x)


def to_tsv(df: DataFrame, path: str, delimiter: str = "\t", header: bool = True, order_by: Sequence[str] | None = None, single: bool = False, mode: str = "errorifexists") -> None:
    """Lines without quoting. ``single`` (one file, for small results) is sorted and starts with the header; else every
    part is written where it is computed, each with the header.
    """
    if order_by:
        df = df.orderBy(*order_by)
    text = df.select(F.concat_ws(delimiter, *(_text(df, c) for c in df.columns)).alias("value"))
    if not header:
        (text.coalesce(1) if single else text).write.mode(mode).text(path)
        return
    cells = df.select(*(_text(df, c).alias(c) for c in df.columns))
    # the character that can't occur switches quoting off
    (cells.coalesce(1) if single else cells).write.mode(mode).csv(path, sep=delimiter, header=True, quote="", escape="", emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def to_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, single: bool = False, mode: str = "errorifexists") -> None:
    """CSV with quotes only where they are needed."""
    cells = df.select(*(_text(df, c).alias(c) for c in df.columns))
    (cells.coalesce(1) if single else cells).write.mode(mode).csv(path, sep=delimiter, header=header, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _show(x) -> str:
    return "" if x is None else format_float(x, 12) if isinstance(x, float) else str(x)


def to_md(df: DataFrame, center: str | None = None, right: str | None = None, numeric: bool = False, grouped: bool = False, digits: int | None = None, most: int = 100_000) -> str:
    """A Markdown table. ``numeric`` aligns right the columns that hold numbers in all rows; ``grouped`` writes those
    with thousands separators. Tables beyond ``most`` rows are refused: they are collected.
    """
    at_center = set(resolve_fields(center, df.columns)) if center else set()
    at_right = set(resolve_fields(right, df.columns)) if right else set()
    numbers: set[str] = set()
    if numeric or grouped or digits is not None:
        tests = [F.bool_and(num(F.col(f"`{c}`"), df.schema[c].dataType).isNotNull()).alias(f"c{i}") for i, c in enumerate(df.columns)]
        got = df.agg(*tests).first()
        numbers = {c for i, c in enumerate(df.columns) if got[i]}
        at_right |= numbers - at_center if numeric else set()
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda c, x: group_digits(_show(x), digits) if c in numbers and (grouped or digits is not None) else _show(x).replace("|", "\\|")
    lines = [[c.replace("|", "\\|") for c in df.columns], *([cell(c, x) for c, x in zip(df.columns, r, strict=True)] for r in rows)]
    width = [max(3, *(len(line[k]) for line in lines)) for k in range(len(df.columns))]
    put = lambda c, s, w: s.rjust(w) if c in at_right else s.center(w) if c in at_center else s.ljust(w)
    rule = lambda c, w: "-" * (w - 1) + ":" if c in at_right else ":" + "-" * (w - 2) + ":" if c in at_center else "-" * w
    shown = ["| " + " | ".join(put(c, s, w) for c, s, w in zip(df.columns, line, width, strict=True)) + " |" for line in lines]
    shown.insert(1, "| " + " | ".join(rule(c, w) for c, w in zip(df.columns, width, strict=True)) + " |")
    return "\n".join(shown) + "\n"


def _ref(column: int, row: int) -> str:
    name = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        name = chr(65 + rest) + name
    return f"{name}{row}"


def to_xlsx(df: DataFrame, path: str, sheet: str = "Sheet1", rules: Sequence[tuple[str, str, str]] = (), most: int = 1_048_575) -> None:
    """A workbook with a bold, frozen header and number cells; ``path`` is a local file of the driver.

    ``rules`` are conditional formats (field, op, value): le, ge, bt ("low,high") or str_in_fld.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("more rows than a sheet holds")
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def cell(c: str, x, k: int, n: int) -> str:
        if x is None:
            return ""
        if isinstance(x, bool) or not isinstance(x, (int, float)):
            try:
                x = float(str(x)) if not isinstance(x, bool) and isinstance(kinds[c], T.StringType) else str(x)
            except ValueError:
                x = str(x)
        if isinstance(x, (int, float)) and x == x and abs(x) != float("inf"):
            return f'<c r="{_ref(k, n)}"><v>{x!r}</v></c>'
        return f'<c r="{_ref(k, n)}" t="inlineStr"><is><t xml:space="preserve">{escape(str(x))}</t></is></c>'

    body = ["<row r=\"1\">" + "".join(f'<c r="{_ref(k, 1)}" s="1" t="inlineStr"><is><t>{escape(c)}</t></is></c>' for k, c in enumerate(df.columns)) + "</row>"]
    for n, r in enumerate(rows, 2):
        body.append(f'<row r="{n}">' + "".join(cell(c, x, k, n) for k, (c, x) in enumerate(zip(df.columns, r, strict=True))) + "</row>")
    formats = []
    for p, (fields, op, value) in enumerate(rules, 1):
        for c in resolve_fields(fields, df.columns):
            k = df.columns.index(c)
            span = f"{_ref(k, 2)}:{_ref(k, len(rows) + 1)}"
            if op == "str_in_fld":
                rule = f'<cfRule type="containsText" dxfId="0" priority="{p}" operator="containsText" text="{escape(value)}"><formula>NOT(ISERROR(SEARCH("{escape(value)}",{_ref(k, 2)})))</formula></cfRule>'
            else:
                low, _, high = value.partition(",")
                name = {"le": "lessThanOrEqual", "ge": "greaterThanOrEqual", "bt": "between"}[op]
                rule = f'<cfRule type="cellIs" dxfId="0" priority="{p}" operator="{name}"><formula>{float(low)!r}</formula>' + (f"<formula>{float(high)!r}</formula>" if op == "bt" else "") + "</cfRule>"
            formats.append(f'<conditionalFormatting sqref="{span}">{rule}</conditionalFormatting>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {ns}><fonts count="2"><font/><font><b/></font></fonts><fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs><dxfs count="1"><dxf><fill><patternFill><bgColor rgb="FFFFC7CE"/></patternFill></fill></dxf></dxfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {ns}><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>{"".join(body)}</sheetData>{"".join(formats)}</worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    with open(path, "wb") as f:
        f.write(out.getvalue())
