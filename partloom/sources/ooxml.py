"""Workbooks and slide decks as tables of cells and text, read from their zip parts.

Files come in as binary rows, so any file system that Spark reads will do, and
each file is one task's row.  A part that can't be read gives a row with the
error, and doesn't stop the others.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed by the formats: the parts' name spaces.
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """The files of a folder as binary rows, without the lock files of open ones."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return found.where(~F.col("path").rlike(r"/~\$[^/]*$"))


def _column(reference: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def _elements(z: zipfile.ZipFile, part: str, tag: str) -> Iterator[ET.Element]:
    """A part's elements of one tag, each forgotten when the next one comes."""
    with z.open(part) as f:
        above: list[ET.Element] = []
        for event, e in ET.iterparse(f, ("start", "end")):
            if event == "start":
                above.append(e)
                continue
            above.pop()
            if e.tag == tag:
                yield e
                e.clear()
                if above:
                    above[-1].remove(e)


def _texts(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in _elements(z, "xl/sharedStrings.xml", f"{_S}si")]


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    if part not in z.namelist():
        return {}
    return {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read(part))}


def sheet_parts(z: zipfile.ZipFile) -> list[tuple[str, str | None]]:
    """The name of every sheet of a workbook and its part, None where that is not told."""
    targets, out = _targets(z, "xl/_rels/workbook.xml.rels"), []
    for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
        target = (targets.get(sheet.get(f"{_R}id")) or "").lstrip("/")
        out.append((sheet.get("name"), (target if target.startswith("xl/") else f"xl/{target}") if target else None))
    return out


def part_cells(z: zipfile.ZipFile, part: str, texts: list[str], last_row: int | None = None) -> Iterator[tuple[int, int, str]]:
    """row_idx, col_idx, value of a sheet's cells that aren't empty, read as a stream down to last_row."""
    for row in _elements(z, part, f"{_S}row"):
        number = int(row.get("r"))
        if last_row is not None and number > last_row:
            return
        for c in row.iter(f"{_S}c"):
            kind, v = c.get("t"), c.find(f"{_S}v")
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{_S}t"))
            elif v is None or v.text is None:
                continue
            elif kind == "s":
                value = texts[int(v.text)]
            elif kind == "b":
                value = "TRUE" if v.text == "1" else "FALSE"
            else:
                value = v.text
            yield number, _column(c.get("r")), value


#: What a damaged part may raise.
UNREADABLE = (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError, IndexError)


def sheet_cells(content: bytes) -> Iterator[tuple]:
    """sheet, sheet_idx, row_idx, col_idx, value, error of every cell that isn't empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        texts = _texts(z)
        for i, (name, part) in enumerate(sheet_parts(z)):
            try:
                for row, column, value in part_cells(z, part or "", texts):
                    yield name, i, row, column, value, None
            except UNREADABLE as e:
                yield name, i, None, None, None, f"{type(e).__name__}: {e}"


def _read(of, columns: list[str], batch: int = 10_000):
    """Rows of each file in batches, so that a large one isn't a list first."""

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        try:
            for r in of(content):
                yield (path, *r)
        except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
            yield (path, *[None] * (len(columns) - 2), f"{type(e).__name__}: {e}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                found = rows(path, content)
                while part := list(islice(found, batch)):
                    yield pd.DataFrame(part, columns=columns, dtype=object)

    return run


def workbooks(spark: SparkSession, folder: str, *, glob: str = "*.xls[xm]") -> DataFrame:
    """file_id, sheet, sheet_idx, row_idx, col_idx, value, error of all workbooks below a folder."""
    columns = ["file_id", "sheet", "sheet_idx", "row_idx", "col_idx", "value", "error"]
    schema = "file_id string, sheet string, sheet_idx int, row_idx int, col_idx int, value string, error string"
    return files(spark, folder, glob).select("path", "content").mapInPandas(_read(sheet_cells, columns), schema)


def _paragraphs(body: ET.Element) -> Iterator[tuple[str, bool]]:
    """Text and whether it has bold parts; what is struck through is left out."""
    for p in body.iter(f"{_A}p"):
        text, bold = "", False
        for r in p.iter(f"{_A}r"):
            props, t = r.find(f"{_A}rPr"), r.find(f"{_A}t")
            if props is not None and props.get("strike", "noStrike") != "noStrike":
                continue
            text += (t.text or "") if t is not None else ""
            bold |= props is not None and props.get("b") == "1"
        if text.strip():
            yield text.strip(), bold


def slide_texts(content: bytes | BinaryIO, slides: set[int] | None = None) -> Iterator[tuple]:
    """slide, shape, kind, row, col, text, bold, error of all paragraphs and table cells, of some slides or all."""
    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content) as z:
        found = [re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n) for n in z.namelist()]
        for m in sorted(filter(None, found), key=lambda m: int(m[1])):
            slide = int(m[1])
            if slides is not None and slide not in slides:
                continue
            try:
                root = ET.fromstring(z.read(m[0]))
                shapes = [e for e in root.iter() if e.tag in (f"{_P}sp", f"{_P}graphicFrame")]
                for i, shape in enumerate(shapes):
                    if shape.tag == f"{_P}sp":
                        for text, bold in _paragraphs(shape):
                            yield slide, i, "text", None, None, text, bold, None
                    for r, row in enumerate(shape.iter(f"{_A}tr")):
                        for k, cell in enumerate(row.iter(f"{_A}tc")):
                            parts = list(_paragraphs(cell))
                            yield slide, i, "table", r, k, "\n".join(t for t, _ in parts), any(b for _, b in parts), None
            except ET.ParseError as e:
                yield slide, None, None, None, None, None, None, f"{type(e).__name__}: {e}"


def decks(spark: SparkSession, folder: str, *, glob: str = "*.pptx") -> DataFrame:
    """file_id, slide, shape, kind, row, col, text, bold, error of all decks below a folder."""
    columns = ["file_id", "slide", "shape", "kind", "row", "col", "text", "bold", "error"]
    schema = "file_id string, slide int, shape int, kind string, row int, col int, text string, bold boolean, error string"
    return files(spark, folder, glob).select("path", "content").mapInPandas(_read(slide_texts, columns), schema)


def slide_tables(slides: DataFrame) -> DataFrame:
    """file_id, slide, shape, header, everything, n_cells, n_checks of each table, for its type."""
    cells = slides.where("kind = 'table'")
    cell = F.struct("row", "col", "text")
    in_order = F.array_sort(F.collect_list(cell))
    compact = F.regexp_replace(F.upper("text"), r"\s+", "")
    texts = lambda keep: F.array_join(F.transform(F.filter(F.col("__cells"), keep), lambda c: c["text"]), " | ")
    grouped = cells.groupBy("file_id", "slide", "shape").agg(
        in_order.alias("__cells"), F.count_if(F.trim("text") != "").alias("n_cells"), F.count_if(compact.isin("O", "X", "OX", "(O,X)")).alias("n_checks")
    )
    return grouped.select("file_id", "slide", "shape", texts(lambda c: c["row"] == 0).alias("header"), texts(lambda c: F.lit(True)).alias("everything"), "n_cells", "n_checks")
