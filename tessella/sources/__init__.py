"""Readers: strict TSV with row order, CSV, HTML (query, table and struct modes), spreadsheets."""

from .csv import read_csv
from .html import from_html
from .tsv import read_lines, read_tsv
from .xlsx import list_sheets, read_xlsx

__all__ = ["from_html", "list_sheets", "read_csv", "read_lines", "read_tsv", "read_xlsx"]
