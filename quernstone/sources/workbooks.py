"""Rows of workbooks in the open spreadsheet format (ECMA-376), of whole files.

The workbook part lists the sheets and its relations say where they lie; cells
carry their own address, so that rows and columns come from addresses and not
from the order of the elements. Every fault of a file is a WorkbookError with a
short name, and becomes one row with that reason.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quernstone.sources.pages import whole_files

#: Bytes of one part that are unpacked at most, so that a small file cannot fill the memory.
MOST_PART = 200_000_000
# Fixed values of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_ADDRESS = re.compile(r"([A-Z]{1,3})([1-9][0-9]{0,6})")


class WorkbookError(ValueError):
    """The file is no workbook that can be read; its argument names the fault."""


class Workbook:
    def __init__(self, content: bytes):
        try:
            self.parts = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile:
            raise WorkbookError("not_a_workbook") from None
        self.shared = self._strings()

    def _part(self, name: str) -> ElementTree.Element:
        try:
            with self.parts.open(name) as f:
                raw = f.read(MOST_PART + 1)
        except KeyError:
            raise WorkbookError("part_missing") from None
        except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, OSError):
            raise WorkbookError("part_damaged") from None
        if len(raw) > MOST_PART:
            raise WorkbookError("part_too_large")
        if b"<!" in raw.replace(b"<!--", b"").replace(b"<![CDATA[", b""):
            # a document type could define entities
            raise WorkbookError("document_type")
        try:
            return ElementTree.fromstring(raw)
        except ElementTree.ParseError:
            raise WorkbookError("part_damaged") from None

    def _strings(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.parts.namelist():
            return []
        return [_text(item) for item in self._part("xl/sharedStrings.xml").iterfind(f"{MAIN}si")]

    def sheets(self) -> dict[str, str]:
        """Name of each sheet, in order, and the part it lies in."""
        targets = {r.get("Id"): r.get("Target", "") for r in self._part("xl/_rels/workbook.xml.rels").iterfind(f"{PACKAGE}Relationship")}
        found = {}
        for sheet in self._part("xl/workbook.xml").iterfind(f"{MAIN}sheets/{MAIN}sheet"):
            target = targets.get(sheet.get(f"{RELATION}id"))
            if target is None:
                raise WorkbookError("sheet_missing")
            found[sheet.get("name", "")] = posixpath.normpath(posixpath.join("/xl", target)).lstrip("/")
        return found

    def cells(self, part: str) -> Iterator[tuple[int, int, str | None]]:
        """(row, column, text) of each filled cell, both from 1."""
        for cell in self._part(part).iter(f"{MAIN}c"):
            address = _ADDRESS.fullmatch(cell.get("r") or "")
            if address is None:
                raise WorkbookError("cell_without_address")
            column = 0
            for letter in address.group(1):
                column = 26 * column + ord(letter) - ord("A") + 1
            yield int(address.group(2)), column, self._value(cell)

    def _value(self, cell: ElementTree.Element) -> str | None:
        if cell.find(f"{MAIN}f") is not None:
            # a formula's stored result may be stale
            raise WorkbookError("formula")
        kind, value = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
        if kind == "inlineStr":
            return _text(cell)
        if kind == "e":
            raise WorkbookError("error_value")
        if value is None or kind != "s":
            return value
        if not value.strip().isdigit() or int(value) >= len(self.shared):
            raise WorkbookError("string_out_of_range")
        return self.shared[int(value)]


def _text(element: ElementTree.Element) -> str:
    """All text runs of a string; readings for pronunciation are no part of it."""
    runs = [element.find(f"{MAIN}is")] if element.tag == f"{MAIN}c" else [element]
    return "".join(t.text or "" for e in runs if e is not None for part in e if part.tag != f"{MAIN}rPh" for t in part.iter(f"{MAIN}t"))


def table_rows(content: bytes, labels: list[str], *, sheet: str | None = None, within: int = 10) -> list[tuple[int, dict[str, str | None]]]:
    """(row number, label to text) below the header of a sheet: the first of its first `within` rows that holds all labels.

    Without a name the workbook must have one sheet. A label that stands twice
    in the header, and a cell that is given twice, are faults.
    """
    book = Workbook(content)
    sheets = book.sheets()
    if sheet is None and len(sheets) != 1:
        raise WorkbookError("several_sheets")
    part = sheets.get(sheet) if sheet is not None else next(iter(sheets.values()))
    if part is None:
        raise WorkbookError("sheet_missing")
    rows: dict[int, dict[int, str | None]] = {}
    for r, c, text in book.cells(part):
        if c in rows.setdefault(r, {}):
            raise WorkbookError("cell_given_twice")
        rows[r][c] = text
    for r in sorted(rows):
        if r > within:
            break
        at: dict[str, list[int]] = {}
        for c, text in rows[r].items():
            at.setdefault((text or "").strip(), []).append(c)
        if all(x in at for x in labels):
            if any(len(at[x]) > 1 for x in labels):
                raise WorkbookError("label_given_twice")
            return [(n, {x: rows[n].get(at[x][0]) for x in labels}) for n in sorted(rows) if n > r and any(v for v in rows[n].values())]
    raise WorkbookError("no_header")


def workbook_rows(spark: SparkSession, path: str, labels: list[str], pattern: str = "*.xlsx", *, sheet: str | None = None) -> DataFrame:
    """(path, row_no, cells, reason): labelled cells of workbooks; a file that cannot be read is one row with a reason."""
    schema = pa.schema([("path", pa.string()), ("row_no", pa.int32()), ("cells", pa.map_(pa.string(), pa.string())), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    out = [(name, n, list(cells.items()), None) for n, cells in table_rows(content, labels, sheet=sheet)]
                except WorkbookError as e:
                    out = [(name, -1, [], str(e))]
                columns = list(zip(*out)) if out else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    return whole_files(spark, path, pattern).mapInArrow(run, "path string, row_no int, cells map<string,string>, reason string")
