"""Cells of an Excel workbook (.xlsx) as text, read with the standard library: a workbook is a zip archive of XML parts."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that show dates.
_DATE_FORMATS = {14, 15, 16, 17, 22}


def _texts(part: bytes) -> list[str]:
    """Shared strings; a string may be split into runs."""
    return ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(part).iter(f"{_MAIN}si")]


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _number(text: str, is_date: bool) -> str:
    if is_date:
        return (datetime(1899, 12, 30) + timedelta(days=float(text))).isoformat(sep=" ")
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def first_sheet(content: bytes) -> list[list[str | None]]:
    """Rows of the first sheet, empty cells null. Whole numbers are written without a decimal point."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = _texts(z.read("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in names else []
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        first = next(book.iter(f"{_MAIN}sheet")).get(_REL)
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = links[first]
        sheet = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
        dates: set[int] = set()
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(z.read("xl/styles.xml")).find(f"{_MAIN}cellXfs")
            dates = {i for i, x in enumerate(styles if styles is not None else []) if int(x.get("numFmtId") or 0) in _DATE_FORMATS}
    rows: list[list[str | None]] = []
    for row in sheet.iter(f"{_MAIN}row"):
        cells: dict[int, str | None] = {}
        for i, c in enumerate(row.iter(f"{_MAIN}c")):
            at = _column(c.get("r")) if c.get("r") else i
            kind, v = c.get("t"), c.find(f"{_MAIN}v")
            if kind == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
            elif v is None or v.text is None:
                cells[at] = None
            elif kind == "s":
                cells[at] = shared[int(v.text)]
            elif kind == "b":
                cells[at] = "True" if v.text == "1" else "False"
            elif kind in ("str", "e"):
                cells[at] = v.text
            else:
                cells[at] = _number(v.text, int(c.get("s") or 0) in dates)
        rows.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    return rows
