"""Workbooks in Office Open XML as a Python data source: a partition a sheet, rows streamed, typed cells, merged cells filled.

``spark.dataSource.register(WorkbookSource)``, then ``spark.read.format("workbook").schema(...).option("path", ...)``.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Where a workbook's parts are named, and the namespaces of its XML.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
LINK = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"


def place(reference: str) -> tuple[int, int]:
    """Row and column from 0 of a reference such as BC12."""
    letters, digits = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", reference).groups()
    column = 0
    for c in letters:
        column = 26 * column + ord(c) - 64
    return int(digits) - 1, column - 1


def _text(element) -> str:
    """The text of a shared or inline string: all its runs, without phonetic hints."""
    return "".join(t.text or "" for e in element if not e.tag.endswith("}rPh") for t in ([e] if e.tag == f"{MAIN}t" else e.iter(f"{MAIN}t")))


def _stream(z: zipfile.ZipFile, name: str, tag: str) -> Iterator:
    """The elements of one tag of a part, one at a time; what was read before is let go."""
    with z.open(name) as f:
        events = ElementTree.iterparse(f, events=("start", "end"))
        _, root = next(events)
        for event, element in events:
            if event == "end" and element.tag == f"{MAIN}{tag}":
                yield element
                element.clear()
                for child in root:
                    child.clear() if child.tag == f"{MAIN}sheetData" else None


def sheets(z: zipfile.ZipFile) -> tuple[list[tuple[str, str]], bool]:
    """Names and parts of a workbook's sheets in order, and whether days are counted from 1904."""
    links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(LINK)}
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    part = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
    properties = book.find(f"{MAIN}workbookPr")
    return [(s.get("name"), part(links[s.get(RELATION)])) for s in book.iter(f"{MAIN}sheet")], properties is not None and properties.get("date1904") in ("1", "true")


def cells(z: zipfile.ZipFile, part: str, *, fill: bool = True) -> Iterator[tuple[int, dict[int, tuple[str, str]]]]:
    """(row, {column: (type, text)}) of every row with cells; type is n, s, b or e. Merged cells all have the first one's value."""
    strings = [_text(e) for e in _stream(z, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in z.namelist() else []
    merged: dict[int, list[tuple[int, int, int]]] = {}
    for m in _stream(z, part, "mergeCell") if fill else ():
        (top, left), (bottom, right) = map(place, m.get("ref").split(":"))
        merged.setdefault(top, []).append((left, right, bottom))
    held: list[tuple[int, int, int, tuple[str, str]]] = []  # left, right, last row, value
    at = -1

    def filled(row: int, own: dict) -> dict:
        held[:] = [h for h in held if h[2] >= row]
        for left, right, bottom in merged.pop(row, ()):
            if left in own:
                held.append((left, right, bottom, own[left]))
        for left, right, _, value in held:
            own |= {c: value for c in range(left, right + 1)}
        return own

    for element in _stream(z, part, "row"):
        row, column, own = int(element.get("r", at + 2)) - 1, -1, {}
        while held and at + 1 < row:  # rows without cells of their own inside a merged range
            at += 1
            gap = filled(at, {})
            if gap:
                yield at, gap
        at = row
        for c in element.iter(f"{MAIN}c"):
            column = place(c.get("r"))[1] if c.get("r") else column + 1
            kind, v = c.get("t", "n"), c.find(f"{MAIN}v")
            if kind == "inlineStr":
                own[column] = ("s", _text(c.find(f"{MAIN}is")))
            elif v is not None and v.text is not None:
                own[column] = ("s", strings[int(v.text)]) if kind == "s" else ("s" if kind == "str" else kind, v.text)
        yield row, filled(row, own)


def convert(cell: tuple[str, str] | None, wanted: str, from_1904: bool = False):
    """A cell as a value of a Spark type; null for an empty cell, an error value, and what isn't of that type."""
    kind, text = cell or ("e", "")
    if kind == "e" or text == "":
        return None
    if wanted == "string":
        return {"0": "FALSE", "1": "TRUE"}.get(text, text) if kind == "b" else text
    try:
        if wanted == "boolean":
            return text.strip().lower() in ("1", "true") if kind == "b" or text.strip().lower() in ("0", "1", "true", "false") else None
        if wanted in ("date", "timestamp"):
            if kind == "s":
                when = datetime.fromisoformat(text.strip())
            else:
                when = (datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)) + timedelta(days=float(text))
            return when.date() if wanted == "date" else when
        number = float(text)
        if wanted in ("double", "float"):
            return number
        return int(number) if number == int(number) else None
    except (ValueError, OverflowError):
        return None


def _open(path: str):
    import pyarrow.fs

    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(at)


class _Part(InputPartition):
    def __init__(self, path: str, sheet: str, part: str, from_1904: bool):
        super().__init__((path, sheet))
        self.path, self.sheet, self.part, self.from_1904 = path, sheet, part, from_1904


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.fields = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        self.paths, self.wanted = options["path"].split(","), options.get("sheet")
        self.header, self.fill = int(options.get("headerrow", 1)), options.get("fillmerged", "true") == "true"

    def partitions(self):
        out = []
        for path in self.paths:
            with _open(path) as f, zipfile.ZipFile(f) as z:
                found, from_1904 = sheets(z)
            out += [_Part(path, name, part, from_1904) for name, part in found if self.wanted in (None, name)]
        return out

    def read(self, partition):
        with _open(partition.path) as f, zipfile.ZipFile(f) as z:
            at: dict[str, int] | None = None
            for row, own in cells(z, partition.part, fill=self.fill):
                if row + 1 < self.header:
                    continue
                if at is None:
                    if row + 1 > self.header:
                        return  # no header, no columns
                    at = {}
                    for c, cell in sorted(own.items()):
                        at.setdefault((convert(cell, "string") or "").strip(), c)
                    continue
                values = [partition.sheet if n == "_sheet" else row + 1 if n == "_row" else convert(own.get(at[n]) if n in at else None, t, partition.from_1904) for n, t in self.fields]
                if any(v is not None for (n, _), v in zip(self.fields, values, strict=True) if n not in ("_sheet", "_row")):
                    yield tuple(values)


class WorkbookSource(DataSource):
    """Sheets of workbooks as rows, columns by their header's names.

    Options: path (several by commas), sheet (one by name; all by default), headerrow (from 1), fillmerged. A column
    has the type that the schema gives it; a cell that isn't of that type is null. ``_sheet`` and ``_row`` in the schema
    are the sheet's name and the row's number. Rows without any value are left out; of equal headers the first counts.
    A task holds the shared strings of its workbook and one row at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        raise ValueError("give the columns by schema()")

    def reader(self, schema):
        return _Reader(schema, self.options)
