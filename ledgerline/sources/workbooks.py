"""Spreadsheet workbooks (XLSX) as cells: sheets are read in tasks, row after row, with the standard library only."""

from __future__ import annotations

import datetime
import functools
import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from decimal import Decimal
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

BROKEN = "the workbook could not be opened"
TOO_LARGE = "the workbook is too large when unpacked"
#: Bytes of all the parts of one workbook that are read, unpacked.
MAX_UNPACKED = 1 << 29
#: Bytes of a part that is parsed as a whole.
MAX_TREE = 1 << 20
MAX_COLUMNS = 16_384
#: Cells that a task holds before it hands them on.
HELD_CELLS = 65_536
LETTERS = re.compile("[A-Z]*")
COLUMNS = ("file_id", "part", "row_no", "cells", "error")
SCHEMA = "file_id {0}, part int, row_no int, cells array<string>, error string"
#: The built-in number formats that show a date or a time.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
_FAILURES = (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, KeyError, IndexError, ValueError, OverflowError, RuntimeError, NotImplementedError, EOFError)


class _TooLarge(Exception):
    pass


@functools.lru_cache(4096)
def _name(tag: str) -> str:
    """A tag without its namespace: the two flavours of the format differ in it."""
    return tag.rsplit("}", 1)[-1]


def _attribute(element: ElementTree.Element, name: str) -> str | None:
    """An attribute whatever its namespace."""
    return next((v for k, v in element.attrib.items() if _name(k) == name), None)


@functools.lru_cache(4096)
def _is_date_format(code: str) -> bool:
    """Whether a number format shows days or times: a letter of these outside quotes, brackets and escapes."""
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!(?:h+|m+|s+)\])[^\]]*\]', "", code.split(";")[0].lower())
    return bare != "general" and bool(re.search(r"[dmyhs]", bare))


def serial_text(value: float, from_1904: bool = False) -> str:
    """A serial day as ISO text: a day, a day and a time, or a time alone."""
    seconds = round((value % 1) * 86_400)
    time = datetime.timedelta(seconds=seconds)
    if 0 <= value < 1 and seconds < 86_400:
        return str((datetime.datetime.min + time).time())
    day = int(value // 1)
    start = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 31 if 1 <= day < 60 else 30)  # the format knows a 29th of February 1900
    moment = start + datetime.timedelta(days=day) + time
    return moment.date().isoformat() if moment.time() == datetime.time() else moment.isoformat()


def number_text(raw: str) -> str:
    """Digits without exponent; a whole number without its point."""
    if re.fullmatch(r"-?\d+", raw):
        return str(int(raw))
    plain = format(Decimal(repr(float(raw))), "f")
    return plain.rstrip("0").rstrip(".") if "." in plain else plain


class Workbook:
    """One container: its sheets in order, their rows as lists of texts (None: nothing in the cell)."""

    def __init__(self, content: bytes):
        self.parts = zipfile.ZipFile(io.BytesIO(content))
        self.unpacked = 0
        main = next((t for kind, t in self._targets("").values() if kind.endswith("/officeDocument")), "xl/workbook.xml")
        tree, targets = self._tree(main), self._targets(main)
        self.from_1904 = any((_attribute(e, "date1904") or "").lower() in ("1", "true") for e in tree.iter() if _name(e.tag) == "workbookPr")
        wanted = [targets.get(e.get(next((k for k in e.attrib if k.endswith("}id")), ""), "")) for e in tree.iter() if _name(e.tag) == "sheet"]
        self.sheets = [t for kind, t in filter(None, wanted) if kind.endswith("/worksheet")]
        of_kind = {kind.rsplit("/", 1)[-1]: t for kind, t in targets.values()}
        self.shared = self._shared(of_kind.get("sharedStrings"))
        self.dated = self._dated(of_kind.get("styles"))

    def _open(self, part: str) -> io.BufferedIOBase:
        self.unpacked += self.parts.getinfo(part).file_size
        if self.unpacked > MAX_UNPACKED:
            raise _TooLarge
        return self.parts.open(part)

    def _tree(self, part: str) -> ElementTree.Element:
        with self._open(part) as source:
            return ElementTree.parse(source).getroot()

    def _targets(self, part: str) -> dict[str, tuple[str, str]]:
        """Kind and place of each part that this one names, by the name it uses."""
        folder, file = posixpath.split(part)
        place = posixpath.join(folder, "_rels", f"{file}.rels")
        if place not in self.parts.NameToInfo:
            return {}
        return {e.get("Id", ""): (e.get("Type", ""), posixpath.normpath(posixpath.join("/", folder, e.get("Target", ""))).lstrip("/")) for e in self._tree(place)}

    @staticmethod
    def _text(element: ElementTree.Element) -> str:
        """All runs of a rich text, without its phonetic ones."""
        runs = [element] + [e for e in element if _name(e.tag) == "r"]
        return "".join(t.text or "" for run in runs for t in run if _name(t.tag) == "t")

    def _elements(self, part: str, tag: str) -> Iterator[ElementTree.Element]:
        """The elements of this tag; of a large part, each is dropped when the next one is asked for."""
        with self._open(part) as source:
            if self.parts.getinfo(part).file_size <= MAX_TREE:
                yield from [e for e in ElementTree.parse(source).getroot().iter() if _name(e.tag) == tag]
                return
            path: list[ElementTree.Element] = []
            for event, element in ElementTree.iterparse(source, ("start", "end")):
                if event == "start":
                    path.append(element)
                    continue
                path.pop()
                if _name(element.tag) == tag:
                    yield element
                    if path:
                        path[-1].remove(element)

    def _shared(self, part: str | None) -> list[str]:
        return [self._text(e) for e in self._elements(part, "si")] if part else []

    def _dated(self, part: str | None) -> list[bool]:
        """For each cell style whether it shows days."""
        if not part:
            return []
        tree = self._tree(part)
        own = {int(e.get("numFmtId", 0)): _is_date_format(e.get("formatCode", "")) for e in tree.iter() if _name(e.tag) == "numFmt"}
        styles = next((list(e) for e in tree if _name(e.tag) == "cellXfs"), [])
        formats = [int(e.get("numFmtId", 0)) for e in styles]
        return [own.get(f, f in DATE_FORMATS) for f in formats]

    def _value(self, cell: ElementTree.Element) -> str | None:
        kind = cell.get("t", "n")
        wanted = "is" if kind == "inlineStr" else "v"
        inner = None
        for e in cell:
            if _name(e.tag) == wanted:
                inner = e
        if inner is None:
            return None
        if kind == "inlineStr":
            return self._text(inner)
        raw = inner.text
        if raw is None:
            return None
        if kind == "s":
            return self.shared[int(raw)]
        if kind == "b":
            return "True" if raw.strip() in ("1", "true") else "False"
        if kind != "n":  # formula texts, errors, ISO days
            return raw
        style = int(cell.get("s", 0))
        return serial_text(float(raw), self.from_1904) if style < len(self.dated) and self.dated[style] else number_text(raw.strip())

    def rows(self, part: str) -> Iterator[tuple[int, list[str | None]]]:
        number = -1
        for row in self._elements(part, "row"):
            number = int(row.get("r", number + 2)) - 1
            cells: list[str | None] = []
            for cell in row:
                if _name(cell.tag) != "c":
                    continue
                letters = LETTERS.match(cell.get("r", ""))[0]
                column = len(cells)
                if letters:
                    column = -1
                    for letter in letters:
                        column = 26 * (column + 1) + ord(letter) - 65
                if not len(cells) <= column < MAX_COLUMNS:
                    raise ValueError("column out of order")
                cells += [None] * (column - len(cells)) + [self._value(cell)]
            yield number, cells


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of the files of a batch, handed on for many files together."""
    for batch in batches:
        kind = batch.schema.field("file_id").type
        types = dict(zip(COLUMNS, (kind, pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string()), strict=True))
        handed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], list(types))  # noqa: B023, E731
        held, size = [], 0
        for file_id, content in zip(batch.column("file_id").to_pylist(), batch.column("content"), strict=True):
            before = len(held)
            try:
                book = Workbook(content.as_py())
                for part, place in enumerate(book.sheets, 1):
                    for number, cells in book.rows(place):
                        if any((c or "").strip() for c in cells):
                            held.append((file_id, part, number, cells, None))
                            size += len(cells)
                        if size > HELD_CELLS:
                            yield handed(held)
                            held, size, before = [], 0, 0
            except _TooLarge:
                held = [*held[:before], (file_id, None, None, None, TOO_LARGE)]
            except _FAILURES:
                held = [*held[:before], (file_id, None, None, None, BROKEN)]
        if held:
            yield handed(held)


def sheet_cells(files: DataFrame) -> DataFrame:
    """``file_id, part, row_no, cells, error`` of workbooks (``file_id, content``): all sheets, numbered from 1, rows without a filled cell left out.

    Days come as ISO text, numbers as plain digits, formulas as their stored values. A workbook that cannot be read to its end gives a row with its
    error and no part; rows of it that were handed on before do not count (``readable`` drops them). A task holds one container, its shared strings
    and a bounded number of cells.
    """
    kind = files.schema["file_id"].dataType.simpleString()
    return files.select("file_id", "content").mapInArrow(_cells, SCHEMA.format(kind))


def readable(sheets: DataFrame) -> DataFrame:
    """``file_id, part, row_no, cells`` of the workbooks without an error."""
    bad = sheets.filter("error is not null").select("file_id")
    return sheets.filter("error is null").join(bad, "file_id", "left_anti").select("file_id", "part", "row_no", "cells")
