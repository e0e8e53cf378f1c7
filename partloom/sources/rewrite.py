"""Workbooks written from cells, and their single cells rewritten in place.

A rewrite copies the file part by part.  A sheet with changes goes through as a stream
whose bytes are copied as they are, but for the cells that change: these keep their
style and get the new text.  Everything else of the workbook stays, to the byte.
"""

from __future__ import annotations

import io
import zipfile
from collections import deque
from collections.abc import Iterator
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.sources.ooxml import UNREADABLE, _column, _texts, sheet_parts

# Fixed by the format: name spaces and the parts that every workbook has.
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
_SHEET = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def column_name(i: int) -> str:
    """A, B, … of a column's number from 0 on."""
    name, i = "", i + 1
    while i:
        i, r = divmod(i - 1, 26)
        name = chr(65 + r) + name
    return name


def cell_xml(row: int, column: int, value: str, style: str | None = None) -> bytes:
    kept = f" s={quoteattr(style)}" if style is not None else ""
    return f'<c r="{column_name(column)}{row}"{kept} t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'.encode()


class _Sheet:
    """Copies a sheet's bytes, with some cells changed."""

    def __init__(self, changes: dict[tuple[int, int], str], texts: list[str], write) -> None:
        self.texts, self.write, self.n = texts, write, 0
        self.rows: dict[int, dict[int, str]] = {}
        for (row, column), value in changes.items():
            self.rows.setdefault(row, {})[column] = value
        self.numbers = deque(sorted(self.rows))  # rows that may still be to come
        self.parser = p = expat.ParserCreate()
        p.buffer_text = False
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self.start, self.end, self.text
        p.DefaultHandlerExpand = lambda _: self.mark()
        self.held, self.base = bytearray(), 0  # bytes that aren't written yet, and where they begin
        self.resume = False  # the next event's place is where copying goes on
        self.just_opened = False  # nothing has come since a row's or the sheet's tag
        self.row = self.cell = None
        self.value, self.kind, self.style, self.inside = "", None, None, None

    def feed(self, data: bytes, last: bool = False) -> None:
        self.held += data
        self.parser.Parse(data, last)
        if last:
            self.copy(self.base + len(self.held))

    def copy(self, upto: int) -> None:
        self.write(bytes(self.held[: upto - self.base]))
        self.skip(upto)

    def skip(self, upto: int) -> None:
        del self.held[: upto - self.base]
        self.base = upto

    def mark(self) -> int:
        at = self.parser.CurrentByteIndex
        if self.resume:
            self.skip(at)
            self.resume = False
        elif self.cell is None and not self.just_opened and at - self.base > 1 << 16:
            self.copy(at)
        self.just_opened = False
        return at

    def added(self, cells: dict[int, str], row: int) -> None:
        for column in sorted(cells):
            if cells[column]:
                self.write(cell_xml(row, column, cells[column]))
                self.n += 1

    def rows_before(self, row: int | None) -> None:
        while self.numbers and (row is None or self.numbers[0] < row):
            number = self.numbers.popleft()
            cells = {c: v for c, v in self.rows.pop(number, {}).items() if v}
            if cells:
                self.write(f'<row r="{number}">'.encode())
                self.added(cells, number)
                self.write(b"</row>")

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        at, name = self.mark(), tag.rsplit(":", 1)[-1]
        if name == "sheetData":
            self.copy(at)
            self.just_opened, self.opened = True, (tag, attributes)
        elif name == "row":
            self.copy(at)
            self.row = int(attributes["r"])
            self.rows_before(self.row)
            if self.row in self.rows:
                self.just_opened, self.opened = True, (tag, attributes)
        elif name == "c" and self.row in self.rows:
            column = _column(attributes["r"])
            before = {c: v for c, v in self.rows[self.row].items() if c < column}
            if before:
                self.copy(at)
                self.added(before, self.row)
                for c in before:
                    del self.rows[self.row][c]
            if column in self.rows[self.row]:
                self.copy(at)
                self.cell, self.value, self.kind, self.style = column, "", attributes.get("t"), attributes.get("s")
        elif self.cell is not None and name in ("v", "t"):
            self.inside = name

    def text(self, data: str) -> None:
        self.mark()
        if self.cell is not None and self.inside:
            self.value += data

    def reopened(self) -> None:
        """An element that was closed at once gets room for what it lacks."""
        tag, attributes = self.opened
        self.write(f"<{tag}{''.join(f' {k}={quoteattr(v)}' for k, v in attributes.items())}>".encode())

    def end(self, tag: str) -> None:
        upto = self.parser.CurrentByteIndex - self.base
        at_once = self.just_opened and self.held[upto - 2 : upto] == b"/>"  # its end is told behind such a tag
        at, name = self.mark(), tag.rsplit(":", 1)[-1]
        if self.cell is not None and name in ("v", "t"):
            self.inside = None
        elif self.cell is not None and name == "c":
            new = self.rows[self.row].pop(self.cell)
            old = self.value
            if self.kind == "s" and old:
                old = self.texts[int(old)]
            elif self.kind == "b" and old:
                old = "TRUE" if old == "1" else "FALSE"
            if new and new != old:
                self.write(cell_xml(self.row, self.cell, new, self.style))
                self.n += 1
                self.resume = True
            self.cell = None
        elif name == "row" and self.row in self.rows:
            cells = {c: v for c, v in self.rows.pop(self.row).items() if v}
            if cells and at_once:
                self.reopened()
                self.added(cells, self.row)
                self.write(f"</{tag}>".encode())
                self.resume = True
            elif cells:
                self.copy(at)
                self.added(cells, self.row)
            self.row = None
        elif name == "sheetData" and self.rows:
            if at_once:
                self.reopened()
                self.rows_before(None)
                self.write(f"</{tag}>".encode())
                self.resume = True
            else:
                self.copy(at)
                self.rows_before(None)


def rewritten(content: bytes, changes: list[tuple[str, int, int, str]]) -> tuple[bytes, int]:
    """The workbook after changes (sheet, row, column from 0 on, text), and how many
    cells differ: blank texts and those that are there already change nothing."""
    by_part: dict[str, dict[tuple[int, int], str]] = {}
    out, n = io.BytesIO(), 0
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as copy:
        parts, texts = dict(sheet_parts(z)), _texts(z)
        for sheet, row, column, value in changes:
            if parts.get(sheet):
                by_part.setdefault(parts[sheet], {})[row, column] = value or ""
        for info in z.infolist():
            if info.filename not in by_part:
                copy.writestr(info, z.read(info), info.compress_type)
                continue
            with z.open(info) as f, copy.open(info.filename, "w") as g:
                sheet = _Sheet(by_part[info.filename], texts, g.write)
                while chunk := f.read(1 << 16):
                    sheet.feed(chunk)
                sheet.feed(b"", True)
                n += sheet.n
    return out.getvalue(), n


def rewrite_workbooks(files: DataFrame, changes: DataFrame) -> DataFrame:
    """name, content, n_changes, error of files (name, content) after their changes (name,
    sheet, row_idx, col_idx, value).

    A file without changes comes out as it is; one that can't be read too, with the error.
    A workbook's changes are at most its cells, so they fit beside it.
    """
    own = changes.groupBy("name").agg(F.collect_list(F.struct("sheet", "row_idx", "col_idx", "value")).alias("changes"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                new, n, error = r.content, 0, None
                if r.changes is not None:
                    try:
                        new, n = rewritten(r.content, [(c["sheet"], c["row_idx"], c["col_idx"], c["value"]) for c in r.changes])
                    except (*UNREADABLE, expat.ExpatError) as e:
                        error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"name": [r.name], "content": [new], "n_changes": [n], "error": [error]})

    return files.select("name", "content").join(own, "name", "left").mapInPandas(run, "name string, content binary, n_changes long, error string")


def workbook(cells: dict[str, list[tuple[int, int, str]]]) -> bytes:
    """A workbook of sheets with their cells (row, column from 0 on, text)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kind = lambda i: f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_SHEET}.worksheet+xml"/>'
        n = range(1, len(cells) + 1)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_SHEET}.sheet.main+xml"/>{"".join(map(kind, n))}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>' for i, name in zip(n, cells, strict=True))
        z.writestr("xl/workbook.xml", f'<workbook {_MAIN} xmlns:r="{_OFFICE}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n)
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}">{links}</Relationships>')
        for i, own in zip(n, cells.values(), strict=True):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f"<worksheet {_MAIN}><sheetData>".encode())
                last = None
                for row, column, value in sorted(own):
                    if row != last:
                        f.write((b"</row>" if last is not None else b"") + f'<row r="{row}">'.encode())
                        last = row
                    f.write(cell_xml(row, column, value))
                f.write((b"</row>" if last is not None else b"") + b"</sheetData></worksheet>")
    return out.getvalue()


def workbooks_of(cells: DataFrame) -> DataFrame:
    """name, content: a workbook for each name of cells (name, sheet, row_idx, col_idx,
    value); blank cells aren't written, sheets are in order of their names."""

    def build(own: pa.Table) -> pa.Table:
        sheets: dict[str, list] = {}
        for sheet, row, column, value in zip(*(own[c].to_pylist() for c in ("sheet", "row_idx", "col_idx", "value")), strict=True):
            sheets.setdefault(sheet, [])
            if value:
                sheets[sheet].append((row, column, value))
        content = workbook({s: sheets[s] for s in sorted(sheets)})
        return pa.table({"name": own["name"][:1], "content": pa.array([content], pa.binary())})

    return cells.select("name", "sheet", "row_idx", "col_idx", "value").groupBy("name").applyInArrow(build, "name string, content binary")
