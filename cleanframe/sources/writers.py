"""Writers: CSV and TSV folders, one part per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, types as T

from cleanframe.functions.cells import blank_to_null, cell_text, col, flat_text, format_double


def export_cells(df: DataFrame, decimals: bool = False) -> list[Column]:
    """Every cell as text; with `decimals` doubles are written to six decimals."""
    cells = []
    for f in df.schema.fields:
        c = col(f.name)
        if decimals and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = format_double(c.cast("double"))
        else:
            c = cell_text(c, f.dataType)
        cells.append(c.alias(f.name))
    return cells


def write_csv(
    df: DataFrame,
    path: str,
    decimals: bool = False,
    mode: str = "errorifexists",
    partition_by: list[str] | None = None,
) -> None:
    """K1: header and rows, NULL as an empty cell, quotes doubled.

    In a table of one column a blank cell is written as `""`, as a blank line would be no row.
    """
    cells = export_cells(df, decimals)
    data = [c for c in df.columns if c not in (partition_by or [])]
    empty = ""
    if len(data) == 1:
        empty = '""'
        cells = [blank_to_null(c).alias(n) if n in data else c for c, n in zip(cells, df.columns)]
    writer = (
        df.select(*cells)
        .write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("nullValue", empty)
        .option("emptyValue", empty)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    if partition_by:
        # Only the folders written to are replaced.
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.csv(path)


def write_tsv(df: DataFrame, path: str, decimals: bool = False, mode: str = "errorifexists") -> None:
    """K2: tab-separated without quoting; tabs and line breaks in cells become spaces."""
    flat = []
    for c, name in zip(export_cells(df, decimals), df.columns):
        header = name.translate({9: " ", 10: " ", 13: " "})
        flat.append(flat_text(c).alias(header))
    (
        df.select(*flat)
        .write.mode(mode)
        .option("header", True)
        .option("sep", "\t")
        .option("quote", "")
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
