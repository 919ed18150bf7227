"""Writers: TSV, CSV, Markdown, spreadsheets and split files."""

from .tables import to_csv, to_md, to_tsv, to_xlsx
from .split import split_by_key, split_lines, split_random
from .transposed import read_transposed, write_transposed

__all__ = ["read_transposed", "write_transposed", "split_by_key", "split_lines", "split_random", "to_csv", "to_md", "to_tsv", "to_xlsx"]
