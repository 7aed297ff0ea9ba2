"""Cells of the first sheet of a workbook, as text; runs inside Spark tasks.

A workbook is a zip of XML parts. A sheet has at most 1,048,576 rows, and rows
are handed on in batches, so a task never holds more than one batch of them.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd

BATCH_ROWS = 5_000

# Built-in number format ids that show dates or times.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_OFFICE_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _parts(book: zipfile.ZipFile, name: str, tag: str) -> list:
    if name not in book.namelist():
        return []
    return [e for e in ElementTree.fromstring(book.read(name)).iter() if _tag(e) == tag]


def _text(element) -> str:
    return "".join(t.text or "" for t in element.iter() if _tag(t) == "t")


def _first_sheet(book: zipfile.ZipFile) -> str:
    wanted = _parts(book, "xl/workbook.xml", "sheet")[0].get(_OFFICE_REL)
    for rel in _parts(book, "xl/_rels/workbook.xml.rels", "Relationship"):
        if rel.get("Id") == wanted:
            target = rel.get("Target")
            return target.lstrip("/") if target.startswith("/") else "xl/" + target
    raise ValueError("workbook has no first sheet")


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Indexes of the cell styles whose number format shows a date or a time."""
    dates = set(_DATE_FORMATS)
    for fmt in _parts(book, "xl/styles.xml", "numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", fmt.get("formatCode", ""))
        if re.search(r"[dmyhs]", code, re.I):
            dates.add(int(fmt.get("numFmtId")))
    styles = set()
    for block in _parts(book, "xl/styles.xml", "cellXfs"):
        for i, xf in enumerate(block):
            if int(xf.get("numFmtId", 0)) in dates:
                styles.add(i)
    return styles


def number_text(x: float) -> str:
    """Whole numbers without a decimal point, others in shortest form."""
    if x == x and abs(x) != float("inf") and x == int(x):
        return str(max(min(int(x), 2**63 - 1), -(2**63)))
    if 1e-3 <= abs(x) < 1e7 or x != x:
        return repr(x)
    digits, _, exponent = f"{x!r}".partition("e")
    if not exponent:
        digits, _, exponent = f"{x:.17e}".partition("e")
        for places in range(1, 17):
            if float(f"{x:.{places}e}") == x:
                digits, _, exponent = f"{x:.{places}e}".partition("e")
                break
    return f"{digits if '.' in digits else digits + '.0'}E{int(exponent)}"


def date_text(serial: float, since_1904: bool) -> str:
    """ISO date and time; seconds and milliseconds only where they are not zero."""
    if since_1904:
        start = datetime(1904, 1, 1)
    else:
        start = datetime(1899, 12, 31) if serial < 60 else datetime(1899, 12, 30)
    at = start + timedelta(milliseconds=round(serial * 86_400_000))
    if at.microsecond:
        return at.isoformat(timespec="milliseconds")
    return at.isoformat(timespec="seconds" if at.second else "minutes")


def _column_index(reference: str) -> int:
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def sheet_rows(content: bytes) -> Iterator[dict[int, str]]:
    """Every present row of the first sheet as `{column index: text}`."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = [_text(si) for si in _parts(book, "xl/sharedStrings.xml", "si")]
    dates = _date_styles(book)
    since_1904 = any(p.get("date1904") in ("1", "true") for p in _parts(book, "xl/workbook.xml", "workbookPr"))
    with book.open(_first_sheet(book)) as sheet:
        for _, element in ElementTree.iterparse(sheet):
            if _tag(element) != "row":
                continue
            row = {}
            for at, cell in enumerate(e for e in element if _tag(e) == "c"):
                index = _column_index(cell.get("r")) if cell.get("r") else at
                row[index] = _cell_text(cell, shared, dates, since_1904)
            element.clear()
            yield row


def _cell_text(cell, shared: list[str], dates: set[int], since_1904: bool) -> str:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return _text(cell)
    children = {_tag(e): e for e in cell}
    value = children["v"].text if "v" in children else None
    if value is None or kind == "e":
        return ""
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    if kind != "n":
        return value
    if "f" not in children and int(cell.get("s", 0)) in dates:
        return date_text(float(value), since_1904)
    return number_text(float(value))


def header_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Header of each workbook, or why it cannot be read."""
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                first = next(sheet_rows(content), {})
                out.append((path, [first[i] for i in sorted(first)], None))
            except Exception as e:  # any malformed part makes the workbook unreadable
                out.append((path, None, str(e) or type(e).__name__))
        yield pd.DataFrame(out, columns=["path", "header", "error"])


def row_batches(width: int):
    """Data rows of each workbook, padded to `width` cells."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "line"] + [f"c{i}" for i in range(width)]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = []
                for line, row in enumerate(sheet_rows(content)):
                    if line == 0:
                        continue
                    rows.append((path, line, *[row.get(i, "") for i in range(width)]))
                    if len(rows) == BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return read
