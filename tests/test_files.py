"""Workbooks by sheet, cells rewritten in place, sinks that commit."""

import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from partloom.sources import committed, ooxml, rewrite, workbooks


def cells_of(content):
    return {(sheet, row, column): value for sheet, _, row, column, value, error in ooxml.sheet_cells(content) if error is None}


@pytest.fixture
def folder(tmp_path):
    for n in range(3):
        sheets = {"Master": [(r, c, f"{n}/{r}/{c}") for r in range(1, 200) for c in range(3)], "Notes": [(1, 0, "a < b & c")], "Empty": []}
        (tmp_path / f"book{n}.xlsx").write_bytes(rewrite.workbook(sheets))
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    (tmp_path / "~$book0.xlsx").write_bytes(b"lock")
    return tmp_path


def test_sheets_are_partitions(spark, folder):
    every = workbooks.sheets(spark, str(folder))
    assert every.rdd.getNumPartitions() == 10  # three sheets of three books, and the broken one
    assert every.where("error IS NOT NULL").count() == 1
    same = ooxml.workbooks(spark, str(folder)).where("error IS NULL").drop("file_id")
    assert sorted(map(tuple, every.where("error IS NULL").drop("file_id").collect())) == sorted(map(tuple, same.collect()))
    some = every.where("sheet = 'Master' AND row_idx <= 50")
    assert some.count() == 3 * 50 * 3
    assert some.rdd.getNumPartitions() == 4  # the sheet of each book; what can't be read is still told
    assert every.where(F.col("sheet").isin("Notes", "Empty")).select("value").distinct().collect()[0].value == "a < b & c"
    assert workbooks.sheets(spark, str(folder), glob="*.nothing").count() == 0


def test_streams_end_at_the_last_row(folder, monkeypatch):
    seen = []
    whole = ooxml._column
    monkeypatch.setattr(ooxml, "_column", lambda r: seen.append(r) or whole(r))
    reader = workbooks.WorkbookReader(str(folder), "*.xlsx")
    list(reader.pushFilters([workbooks.EqualTo(("sheet",), "Master"), workbooks.LessThan(("row_idx",), 6), workbooks.EqualTo(("sheet_idx",), 0)]))
    parts = reader.partitions()
    assert len(parts) == 4
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 3 * 5 * 3 + 1
    assert len(seen) == 3 * 5 * 3


def test_decks_by_slide(spark, tmp_path):
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    with zipfile.ZipFile(tmp_path / "d.pptx", "w") as z:
        for i in (1, 2, 10):
            z.writestr(f"ppt/slides/slide{i}.xml", f"<p:sld {a}><p:sp><p:txBody><a:p><a:r><a:t>text {i}</a:t></a:r></a:p></p:txBody></p:sp></p:sld>")
    (tmp_path / "bad.pptx").write_bytes(b"")
    slides = workbooks.slides(spark, str(tmp_path))
    assert [r.text for r in slides.where("slide = 10").collect()] == ["text 10"]
    assert slides.where("error IS NULL").count() == 3 and slides.where("error IS NOT NULL").count() == 1


def test_rewritten_cells():
    sheet = '<?xml version="1.0"?><!-- kept --><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cols><col min="1"/></cols><sheetData><row r="1" ht="20"><c r="A1" s="3" t="s"><v>0</v></c><c r="C1" s="4"/><c r="E1"><v>7</v></c></row><row r="3"/><row r="5" spans="1:2"><c r="B5" t="b"><v>1</v></c></row></sheetData><pageMargins left="1"/></worksheet>'
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>old</t></si></sst>')
        z.writestr("xl/styles.xml", "<styleSheet/>")
        z.writestr("xl/worksheets/s.xml", sheet)
    changes = [("S", 1, 0, "new <x>"), ("S", 1, 2, "into"), ("S", 1, 1, "between"), ("S", 1, 4, "7"), ("S", 1, 9, "after"), ("S", 3, 0, "third"), ("S", 4, 2, "fourth"), ("S", 5, 1, "TRUE"), ("S", 5, 0, ""), ("S", 9, 1, "ninth"), ("no", 1, 1, "x")]
    new, n = rewrite.rewritten(content.getvalue(), changes)
    assert n == 7
    assert cells_of(new) == {("S", 1, 0): "new <x>", ("S", 1, 1): "between", ("S", 1, 2): "into", ("S", 1, 4): "7", ("S", 1, 9): "after", ("S", 3, 0): "third", ("S", 4, 2): "fourth", ("S", 5, 1): "TRUE", ("S", 9, 1): "ninth"}
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        text = z.read("xl/worksheets/s.xml").decode()
        assert z.read("xl/styles.xml") == b"<styleSheet/>"
    assert '<c r="A1" s="3" t="inlineStr">' in text and '<c r="C1" s="4" t="inlineStr">' in text
    for kept in ("<!-- kept -->", '<row r="1" ht="20">', '<c r="E1"><v>7</v></c>', '<c r="B5" t="b"><v>1</v></c>', '</sheetData><pageMargins left="1"/></worksheet>'):
        assert kept in text
    same, none = rewrite.rewritten(content.getvalue(), [("S", 1, 0, "old"), ("S", 5, 1, "TRUE")])
    assert none == 0 and zipfile.ZipFile(io.BytesIO(same)).read("xl/worksheets/s.xml").decode() == sheet


@pytest.mark.parametrize("seed", range(5))
def test_rewrites_of_any_cells(seed):
    rng = random.Random(seed)
    cells = {(rng.randrange(1, 3000), rng.randrange(30)): f"v{rng.randrange(1000)} & é" for _ in range(6000)}
    book = rewrite.workbook({"S": [(r, c, v) for (r, c), v in cells.items()]})
    changes = {(rng.randrange(1, 3300), rng.randrange(40)): rng.choice(["", "new", "<b>"]) for _ in range(3000)} | {k: v for k, v in list(cells.items())[:50]}
    new, n = rewrite.rewritten(book, [("S", r, c, v) for (r, c), v in changes.items()])
    want = cells | {k: v for k, v in changes.items() if v}
    assert cells_of(new) == {("S", *k): v for k, v in want.items()}
    assert n == sum(1 for k, v in changes.items() if v and cells.get(k) != v)
    empty, n = rewrite.rewritten(rewrite.workbook({"S": []}), [("S", 2, 0, "x")])
    assert cells_of(empty) == {("S", 2, 0): "x"} and n == 1


def test_broken_workbooks_stay(spark):
    files = spark.createDataFrame([("a.xlsx", b"no zip"), ("b.xlsx", b"untouched")], "name string, content binary")
    changes = spark.createDataFrame([("a.xlsx", "S", 1, 0, "x")], "name string, sheet string, row_idx int, col_idx int, value string")
    got = {r.name: r for r in rewrite.rewrite_workbooks(files, changes).collect()}
    assert got["a.xlsx"].content == b"no zip" and "BadZipFile" in got["a.xlsx"].error
    assert got["b.xlsx"].content == b"untouched" and got["b.xlsx"].error is None


ROWS = "file string, v int"


def load(spark, path, rows, partitions=3, least=0):
    committed.load_files(spark.createDataFrame(rows, ROWS).repartition(partitions), path, {"small": F.col("v") >= least})


def test_files_load_whole_or_not(spark, tmp_path):
    path = str(tmp_path / "store")
    names = ["a", "b c", "한글/x", "100%"]
    rows = [(f, i) for f in names for i in range(50)] + [("bad", i) for i in range(100)] + [("bad", -1)]
    load(spark, path, rows)
    got = committed.loaded_rows(spark, path, "v int")
    assert sorted(map(tuple, got.select("file", "v").collect())) == sorted(r for r in rows if r[0] != "bad")
    log = {r.file: (r.n_rows, r.status, r.error) for r in committed.load_log(spark, path).collect()}
    assert log == {f: (50, "completed", None) for f in names} | {"bad": (101, "failed", "small")}
    load(spark, path, [("a", 7), ("new", 1)])
    assert committed.loaded_rows(spark, path, "v int").count() == 201
    assert {(r.file, r.status) for r in committed.load_log(spark, path).collect()} >= {("a", "loaded before"), ("new", "completed")}
    assert os.listdir(path + "/_aside") == []
    committed.truncated(path)
    assert os.listdir(path) == []


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(Exception, match="without a file"):
        load(spark, path, [("a", 1), (None, 2)], partitions=2)
    assert not os.path.exists(path + "/rows")
    assert not os.path.exists(path + "/_aside") or os.listdir(path + "/_aside") == []


def test_a_repeated_task_counts_once(tmp_path):
    """What an attempt wrote that isn't told to the commit never appears."""
    import pyarrow as pa

    writer = committed.RowWriter(str(tmp_path))
    batch = lambda *v: pa.record_batch({"file": ["f"] * len(v), "v": list(v), "error": pa.array([None] * len(v), pa.string())})
    writer.write(iter([batch(1, 2)]))  # lost
    told = writer.write(iter([batch(1, 2), batch(3)]))
    writer.commit([told, None])
    import pyarrow.parquet as pq

    assert pq.read_table(str(tmp_path / "rows"))["v"].to_pylist() == [1, 2, 3]


def test_bytes_are_written_at_once(spark, tmp_path):
    files = spark.createDataFrame([("x/a.bin", b"1"), ("b.bin", b"2" * 5000)], "name string, content binary")
    committed.write_files(files, str(tmp_path / "out"))
    assert (tmp_path / "out/x/a.bin").read_bytes() == b"1" and (tmp_path / "out/b.bin").stat().st_size == 5000
