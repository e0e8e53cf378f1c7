"""Workbooks, decks, layouts and sinks, on files made here."""

import json
import zipfile

from pyspark.sql import functions as F

from partloom.operators import classify, ingest, layout
from partloom.sources import ooxml, sinks

_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_P = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def workbook(path, sheets):
    strings = [v for _, rows in sheets for _, cells in rows for v in cells if v]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {_S}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {_S}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        at = 0
        for i, (_, rows) in enumerate(sheets):
            body = ""
            for number, cells in rows:
                body += f'<row r="{number}">'
                for k, v in enumerate(cells):
                    if v:
                        body += f'<c r="{chr(65 + k)}{number}" t="s"><v>{at}</v></c>'
                        at += 1
                body += "</row>"
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {_S}><sheetData>{body}</sheetData></worksheet>")


HEADER = ["No.", "BOM Level", "Base P/No", "New P/No", "부품명", "변경점"]


def test_workbook_to_records(spark, tmp_path):
    rows = [(1, ["제목"]), (3, HEADER), (4, ["1", ".1", "AEC00000001", "←", " Motor  A", "구조"]), (5, ["2", "..2", "-", "AEC00000002", "Fan", ""])]
    workbook(tmp_path / "유럽.xlsx", [("Master", rows), ("Summary", [(1, ["x"])])])
    workbook(tmp_path / "~$유럽.xlsx", [("Master", rows)])
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    cells = ooxml.workbooks(spark, str(tmp_path)).cache()
    assert cells.where("error IS NOT NULL").count() == 1
    good = cells.where("error IS NULL")
    assert good.select("sheet").distinct().count() == 2
    labelled = layout.labelled_cells(good, layout.alias_table(spark))
    headers = layout.header_rows(labelled)
    assert [(r.sheet, r.header_row) for r in headers.collect()] == [("Master", 3)]
    fields = ["bom_level_raw", "part_no_base", "part_no_new", "part_name", "change_point_raw"]
    got = layout.records(good, headers, layout.column_map(labelled, headers), fields).orderBy("row_idx").collect()
    assert [tuple(r[f] for f in fields) for r in got] == [(".1", "AEC00000001", "←", "Motor A", "구조"), ("..2", "-", "AEC00000002", "Fan", None)]
    assert layout.header_by_words(good).collect()[0].header_row == 3
    assert good.where(layout.is_excluded_sheet(F.col("sheet"))).select("sheet").distinct().count() == 1


def test_fixed_layouts_and_labels(spark):
    cells = [("f", "v1", 8, 1, "BOM Level"), ("f", "v1", 9, 2, "Base P/No"), ("f", "v2", 9, 1, "BOM  Level"), ("f", "v2", 9, 2, "Base P/No"), ("f", "no", 1, 0, "New Model"), ("f", "no", 1, 3, " WSED7613B ")]
    df = spark.createDataFrame(cells, "file_id string, sheet string, row_idx int, col_idx int, value string")
    assert {r.sheet: r.layout for r in layout.fixed_layout(df).collect()} == {"v1": "v1", "v2": "v2", "no": None}
    assert [r.value for r in layout.value_right_of(df, "new model").collect()] == ["WSED7613B"]


def test_deck(spark, tmp_path):
    run = lambda t, p="": f"<a:r><a:rPr {p}/><a:t>{t}</a:t></a:r>"
    cell = lambda t: f"<a:tc><a:txBody><a:p>{run(t)}</a:p></a:txBody></a:tc>"
    row = lambda *ts: "<a:tr>" + "".join(map(cell, ts)) + "</a:tr>"
    shape = f'<p:sp><p:txBody><a:p>{run("개발 PJT 개요", chr(98) + chr(61) + chr(34) + "1" + chr(34))}{run("gone", "strike=" + chr(34) + "sngStrike" + chr(34))}</a:p></p:txBody></p:sp>'
    table = "<p:graphicFrame>" + row("Module", "주요 변경점") + row("Door", "구조 변경") + "</p:graphicFrame>"
    with zipfile.ZipFile(tmp_path / "a.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", f"<p:sld {_P}>{shape}{table}</p:sld>")
        z.writestr("ppt/slides/slide2.xml", "<broken")
    slides = ooxml.decks(spark, str(tmp_path)).cache()
    text = slides.where("kind = 'text'").collect()
    assert [(r.text, r.bold) for r in text] == [("개발 PJT 개요", True)]
    assert slides.where("error IS NOT NULL").count() == 1
    tables = ooxml.slide_tables(slides).withColumn("t", classify.table_type(F.col("header"), F.col("everything"), F.col("n_cells"), F.col("n_checks")))
    assert [(r.header, r.n_cells, r.t) for r in tables.collect()] == [("Module | 주요 변경점", 4, "MAIN")]


def test_slide_roles(spark):
    texts = ["개발 PJT 개요 심의 결과", "유첨3. 개발 변경점 CAVITY DOOR", "개발 등급 분류 기준 운영 기준 절차", "hello"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(classify.slide_role(F.col("t")).alias("r"))
    assert [r.r for r in df.collect()] == ["OVERVIEW", "DETAIL", "REFERENCE", "UNKNOWN"]


def test_csv_round_trip_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "x"\ny', None), ("a", "", "2")], "k string, v string, w string")
    sinks.write_csvs({"t": df}, str(tmp_path), {"t": ["v", "w", "missing"]})
    back = {tuple(r) for r in sinks.read_csv(spark, f"{tmp_path}/t", ["v", "w", "missing"]).collect()}
    assert back == {('say "x"\ny', "", ""), ("", "2", "")}
    assert json.loads(sinks.manifest(df, ["k"]).first().json) == {"total": 2, "sheets": [{"k": "a", "rows": 2}]}
    present = spark.createDataFrame([("x/y/a.csv",)], "path string")
    assert [r.name for r in sinks.missing_files(spark, ["a.csv", "b.csv"], present).collect()] == ["b.csv"]


def test_long_sheets_come_in_batches():
    read = ooxml._read(lambda content: ((i, None) for i in range(25)), ["path", "n", "error"], batch=10)
    import pandas as pd

    got = list(read(iter([pd.DataFrame({"path": ["a", "b"], "content": [b"", b""]})])))
    assert [len(x) for x in got] == [10, 10, 5] * 2


def test_upserts_fold_their_batch(spark):
    """Of rows that repeat a key within a batch the last one by order is stored, and the first is let in."""
    from partloom.operators import merge

    old = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (3, "x", 5), (3, "y", 4)], "k int, v string, ord int")
    assert sorted(map(tuple, merge.upsert(old, new, ["k"], order="ord").collect())) == [(1, "b"), (2, "old"), (3, "x")]
    assert sorted(map(tuple, merge.insert_new(old, new, ["k"], order="ord").collect())) == [(3, "y")]


def test_repeated_rows_stay(spark):
    from partloom.operators import match

    rows = spark.createDataFrame([("red ring",), ("red ring",), ("bolt",)], "name string")
    words = spark.createDataFrame([("q", 1, "ring"), ("q", 0, "red"), ("r", 0, "BOLT")], "query string, position int, word string")
    want = [("q", "red ring", 0), ("q", "red ring", 0), ("r", "bolt", 0)]
    assert sorted(map(tuple, match.keyword_candidates(rows, words, "name").collect())) == want
    right = spark.createDataFrame([(5, "ring"), (3, "red"), (9, "the bolt")], "ord int, l1 string")
    got = match.either_contains(rows, right, "name", "l1", order="ord").collect()
    assert sorted(map(tuple, got)) == [("bolt", 9, "the bolt"), ("red ring", 3, "red"), ("red ring", 3, "red")]
    assert match.keyword_candidates(rows, words.where("false"), "name").count() == 0


def test_files_register_once(spark, tmp_path):
    for name, data in (("a", b"1"), ("b", b"1"), ("c", b"2")):
        (tmp_path / f"{name}.bin").write_bytes(data)
    prints = ingest.fingerprints(ooxml.files(spark, str(tmp_path), "*.bin")).cache()
    none = prints.where("false")
    first = ingest.register(none, prints).cache()
    assert first.count() == 2
    assert ingest.register(first, prints).count() == 0


def test_cell_changes_and_documents(spark):
    old = spark.createDataFrame([(1, "a", "b"), (2, "c", None)], "k int, x string, y string")
    new = spark.createDataFrame([(1, "a", "z"), (2, "", "q")], "k int, x string, y string")
    got = {tuple(r) for r in sinks.cell_changes(old, new, ["k"], ["x", "y"]).collect()}
    assert got == {(1, "y", "z"), (2, "y", "q")}
    docs = spark.createDataFrame([("1", "t", {"a": None})], "id string, text string, meta map<string,string>")
    assert sinks.store_documents(docs, docs).first().meta == {"a": ""}
    tree = spark.createDataFrame([("d", 2, 1, 2, "b"), ("d", 1, None, 1, "a")], "doc string, row_no int, parent int, level int, name string")
    assert [n["name"] for n in json.loads(sinks.tree_json(tree).first().json)] == ["a", "b"]
    extra = ingest.structured_and_extra(old, ["k"]).orderBy("k").collect()
    assert [r.extra for r in extra] == [{"x": "a", "y": "b"}, {"x": "c"}]
