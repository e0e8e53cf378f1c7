"""Data sources ``partloom_workbook`` and ``partloom_deck``: cells and texts by sheet and slide.

    register(spark)
    spark.read.format("partloom_workbook").option("path", folder).load().where("sheet = 'Master' AND row_idx <= 50")

A workbook is read sheet by sheet, each a task of its own and its XML a stream.
Filters on file, sheet, its number and the last row are pushed: other sheets make no task, and a
stream ends at the last row that is asked for.  A part that can't be read is a row
with the error.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual

from partloom.sources import ooxml
from partloom.sources.stored import listed, opened

CELLS = "file_id string, sheet string, sheet_idx int, row_idx int, col_idx int, value string, error string"
SLIDES = "file_id string, slide int, shape int, kind string, row int, col int, text string, bold boolean, error string"
_BATCH = 10_000


class Part(InputPartition):
    """One sheet (or a file whose sheets can't be told, or a deck)."""

    def __init__(self, path: str, name: str | None = None, number: int | None = None, part: str | None = None, error: str | None = None) -> None:
        self.path, self.name, self.number, self.part, self.error = path, name, number, part, error


class PushedReader(DataSourceReader):
    """Keeps what equal-to, one-of and at-most filters say of some columns."""

    columns: tuple[str, ...] = ()
    last_of: str | None = None

    def __init__(self, path: str, glob: str) -> None:
        self.path, self.glob = path, glob
        self.allowed: dict[str, set] = {}
        self.last: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if isinstance(f, EqualTo | In) and name in self.columns:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.allowed[name] = self.allowed.get(name, values) & values
            elif isinstance(f, LessThan | LessThanOrEqual) and name == self.last_of:
                last = f.value - isinstance(f, LessThan)
                self.last = last if self.last is None else min(self.last, last)
            yield f  # Spark looks again: rows with errors have nulls there

    def wants(self, column: str, value) -> bool:
        return value is None or column not in self.allowed or value in self.allowed[column]

    def files(self) -> list[str]:
        return [path for path, _ in listed(self.path, self.glob) if self.wants("file_id", path)]


class WorkbookReader(PushedReader):
    columns, last_of = ("file_id", "sheet", "sheet_idx"), "row_idx"

    def partitions(self) -> Sequence[InputPartition]:
        system, _ = opened(self.path)
        out = []
        for path in self.files():
            try:
                with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:  # its list of parts and sheets alone
                    for i, (name, part) in enumerate(ooxml.sheet_parts(z)):
                        if self.wants("sheet", name) and self.wants("sheet_idx", i):
                            out.append(Part(path, name, i, part))
            except ooxml.UNREADABLE as e:
                out.append(Part(path, error=f"{type(e).__name__}: {e}"))
        return out or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in CELLS.split(", ")]
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        head = (partition.path, partition.name, partition.number)

        def rows() -> Iterator[tuple]:
            if partition.error:
                yield (*head, None, None, None, partition.error)
            elif partition.path:
                try:
                    with opened(self.path)[0].open_input_file(partition.path) as f, zipfile.ZipFile(f) as z:
                        for cell in ooxml.part_cells(z, partition.part or "", ooxml._texts(z), self.last):
                            yield (*head, *cell, None)
                except ooxml.UNREADABLE as e:
                    yield (*head, None, None, None, f"{type(e).__name__}: {e}")

        yield from batches(rows(), names, types)


class DeckReader(PushedReader):
    columns = ("file_id", "slide")

    def partitions(self) -> Sequence[InputPartition]:
        return [Part(path) for path in self.files()] or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in SLIDES.split(", ")]
        types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string()]

        def rows() -> Iterator[tuple]:
            if partition.path:
                try:
                    with opened(self.path)[0].open_input_file(partition.path) as f:
                        for r in ooxml.slide_texts(f, self.allowed.get("slide")):
                            yield (partition.path, *r)
                except ooxml.UNREADABLE as e:
                    yield (partition.path, *[None] * 7, f"{type(e).__name__}: {e}")

        yield from batches(rows(), names, types)


def batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "partloom_workbook"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return WorkbookReader(self.options["path"], self.options.get("glob", "*.xls[xm]"))


class DeckSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "partloom_deck"

    def schema(self) -> str:
        return SLIDES

    def reader(self, schema) -> DataSourceReader:
        return DeckReader(self.options["path"], self.options.get("glob", "*.pptx"))


def register(spark: SparkSession) -> SparkSession:
    """Make the sources known to a session, and let it push filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)
    spark.dataSource.register(DeckSource)
    return spark


def sheets(spark: SparkSession, folder: str, *, glob: str = "*.xls[xm]") -> DataFrame:
    """The cells of all workbooks below a folder."""
    return register(spark).read.format("partloom_workbook").option("path", folder).option("glob", glob).load()


def slides(spark: SparkSession, folder: str, *, glob: str = "*.pptx") -> DataFrame:
    """The texts of all decks below a folder."""
    return register(spark).read.format("partloom_deck").option("path", folder).option("glob", glob).load()
