"""Workbooks and loads: written to the shared folder from the driver's tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.operators import layout
from partloom.plans.bom import BOM, bom_rows
from partloom.plans.registry import query, table
from partloom.session import shared_folder
from partloom.sources import committed, rewrite, workbooks

_HEADER = ["No.", "BOM Level", "Base P/No", "New P/No", "Class Desc.(Part Name)", "변경점", "변경 사유 (상세)"]
_FIELDS = ["no", "bom_level_raw", "part_no_base", "part_no_new", "part_name", "change_point_raw", "change_reason_raw"]


def _book_cells(spark, sf):
    """A workbook for each brand: the sheet Master, whose header's row depends on the
    brand's letters, and a sheet Notes without one."""
    rows = bom_rows(spark, sf).withColumn("head", (F.length("doc") % 4 + 3).cast("int"))
    name = F.concat(F.regexp_replace("doc", "#", "-"), F.lit(".xlsx")).alias("name")
    cell = lambda i, v: F.struct(F.lit(i).alias("col_idx"), v.cast("string").alias("value"))
    values = [F.col("row_no"), F.col("raw_level"), F.col("base_no"), F.col("new_no"), F.col("name"), F.col("point"), F.col("reason")]
    body = rows.select(name, F.lit("Master").alias("sheet"), (F.col("row_no") + F.col("head") + 1).cast("int").alias("row_idx"), F.explode(F.array(*(cell(i, v) for i, v in enumerate(values)))).alias("c"))
    books = rows.select("doc", "head").distinct()
    head = books.select(name, F.lit("Master").alias("sheet"), F.col("head").alias("row_idx"), F.explode(F.array(*(cell(i, F.lit(h)) for i, h in enumerate(_HEADER)))).alias("c"))
    notes = rows.select(name, F.lit("Notes").alias("sheet"), (F.col("row_no") + 1).cast("int").alias("row_idx"), F.explode(F.array(cell(0, F.col("point")))).alias("c"))
    return body.unionByName(head).unionByName(notes).select("name", "sheet", "row_idx", "c.col_idx", "c.value")


def _books(spark, sf):
    folder = shared_folder(spark, "books")
    committed.write_files(rewrite.workbooks_of(_book_cells(spark, sf)), folder)
    return folder


_V = "SELECT replace(doc, '#', '-') || '.xlsx' AS name, row_no, 3 + length(doc) % 4 AS head, [CAST(row_no AS VARCHAR), raw_level, base_no, new_no, name, point, reason] AS v, point FROM bom"


@query(f"""WITH {BOM}, c AS ({_V}) SELECT name AS file, {', '.join(f"nullif(trim(regexp_replace(v[{i + 1}], ' +', ' ', 'g')), '') AS {f}" for i, f in enumerate(_FIELDS))} FROM c""")
def workbook_records(spark, sf):
    """Workbooks are written, probed by their first fifty rows, and only sheets with a header are read on."""
    folder, aliases = _books(spark, sf), layout.alias_table(spark)
    first = workbooks.sheets(spark, folder).where("row_idx <= 50")
    labelled = layout.labelled_cells(first, aliases)
    headers = layout.header_rows(labelled)
    names = [r["sheet"] for r in headers.select("sheet").distinct().limit(1001).collect()]
    cells = workbooks.sheets(spark, folder)
    if len(names) <= 1000:  # else other sheets are read too, and their rows go in the join with headers
        cells = cells.where(F.col("sheet").isin(names))
    return layout.records(cells, headers, layout.column_map(labelled, headers), _FIELDS).select(F.element_at(F.split("file_id", "/"), -1).alias("file"), *_FIELDS)


@query(f"""WITH {BOM}, c AS ({_V}), n AS (SELECT name, row_no + 1 AS row_idx, point AS value FROM c) SELECT name AS file, CAST(row_idx AS INTEGER) AS row_idx, 0 AS col_idx, value FROM n WHERE value <> '' AND row_idx <= 400""")
def workbook_cells(spark, sf):
    """One sheet of every workbook, down to a row: both filters reach the reader."""
    cells = workbooks.sheets(spark, _books(spark, sf)).where("sheet = 'Notes' AND row_idx <= 400")
    return cells.select(F.element_at(F.split("file_id", "/"), -1).alias("file"), "row_idx", "col_idx", "value")


def _changes(spark, sf):
    """New names for every third row (some as before, some blank), a mark in a column that isn't there, and cells a million rows on (below the last row, or in one of a workbook that long)."""
    rows = bom_rows(spark, sf).where("row_no % 3 = 0")
    name = F.concat(F.regexp_replace("doc", "#", "-"), F.lit(".xlsx")).alias("name")
    row = (F.col("row_no") + F.length("doc") % 4 + 4).cast("int")
    new = F.when(F.col("row_no") % 4 == 0, F.col("name")).when(F.col("row_no") % 5 == 0, "").otherwise(F.concat(F.upper("name"), F.lit(" <&>")))
    cell = lambda r, c, v: F.struct(r.alias("row_idx"), F.lit(c).alias("col_idx"), v.alias("value"))
    cells = F.array(cell(row, 4, new), cell(row, 9, F.when(F.col("row_no") % 6 == 0, "seen")), cell((row + 1_000_000).cast("int"), 1, F.when(F.col("row_no") % 21 == 0, "below")))
    return rows.select(name, F.lit("Master").alias("sheet"), F.explode(cells).alias("c")).select("name", "sheet", "c.*")


@query(f"""WITH {BOM}, c AS ({_V}), m AS (SELECT name, row_no, row_no + head + 1 AS row_idx, unnest(v) AS value, unnest(range(0, 7)) AS col_idx FROM c
        UNION ALL SELECT DISTINCT name, NULL, head, unnest([{', '.join(f"'{h}'" for h in _HEADER)}]), unnest(range(0, 7)) FROM c),
    e AS (SELECT name, row_idx, col_idx, CASE WHEN col_idx = 4 AND row_no % 3 = 0 AND row_no % 4 <> 0 AND row_no % 5 <> 0 THEN upper(value) || ' <&>' ELSE value END AS value, 0 AS turn FROM m
        UNION ALL SELECT name, row_no + head + 1, 9, 'seen', 1 FROM c WHERE row_no % 6 = 0 UNION ALL SELECT name, row_no + head + 1000001, 1, 'below', 1 FROM c WHERE row_no % 21 = 0)
    SELECT name AS file, CAST(row_idx AS INTEGER) AS row_idx, CAST(col_idx AS INTEGER) AS col_idx, arg_max(value, turn) AS value FROM e WHERE value <> '' GROUP BY name, row_idx, col_idx""")
def workbook_rewrite(spark, sf):
    """Cells rewritten in place, the workbooks written again and read back; a cell that is there already gets the new text."""
    files = spark.read.format("binaryFile").load(_books(spark, sf)).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    folder = shared_folder(spark, "rewritten")
    committed.write_files(rewrite.rewrite_workbooks(files, _changes(spark, sf)), folder)
    cells = workbooks.sheets(spark, folder).where("sheet = 'Master'")
    return cells.select(F.element_at(F.split("file_id", "/"), -1).alias("file"), "row_idx", "col_idx", "value")


@query(f"""WITH {BOM}, c AS ({_V}) SELECT name, count(*) FILTER (WHERE row_no % 3 = 0 AND row_no % 4 <> 0 AND row_no % 5 <> 0) + count(*) FILTER (WHERE row_no % 6 = 0) + count(*) FILTER (WHERE row_no % 21 = 0) AS n_changes FROM c GROUP BY name""")
def workbook_change_counts(spark, sf):
    """How many cells a rewrite changes: not those that stay or would become blank."""
    files = spark.read.format("binaryFile").load(_books(spark, sf)).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return rewrite.rewrite_workbooks(files, _changes(spark, sf)).select("name", "n_changes")


_LOADS = """r AS (SELECT CAST(o_custkey AS VARCHAR) AS file, o_orderkey, o_totalprice, CASE WHEN o_totalprice <= 1000 THEN 'price' WHEN o_orderkey % 97 = 0 THEN 'name' END AS error FROM orders),
    f AS (SELECT file, count(*) AS n_rows, min(error) AS error FROM r GROUP BY file)"""


def _loaded(spark, sf):
    """Two loads of the same files: the second one finds those of the first."""
    folder = shared_folder(spark, "loads")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("file"), "o_orderkey", "o_totalprice")
    checks = {"price": F.col("o_totalprice") > 1000, "name": F.col("o_orderkey") % 97 != 0}
    committed.load_files(rows.where("file % 3 = 0"), folder, checks)
    committed.load_files(rows, folder, checks)
    return folder


@query(f"WITH {_LOADS} SELECT file, o_orderkey, o_totalprice FROM r WHERE file IN (SELECT file FROM f WHERE error IS NULL)")
def transactional_rows(spark, sf):
    """A file's rows are there whole, once, or not at all."""
    return committed.loaded_rows(spark, _loaded(spark, sf), "o_orderkey long, o_totalprice double")


@query(f"""WITH {_LOADS} SELECT file, n_rows, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status, error FROM f WHERE CAST(file AS INTEGER) % 3 = 0
    UNION ALL SELECT file, n_rows, CASE WHEN error IS NOT NULL THEN 'failed' WHEN CAST(file AS INTEGER) % 3 = 0 THEN 'loaded before' ELSE 'completed' END, error FROM f""")
def transactional_log(spark, sf):
    return committed.load_log(spark, _loaded(spark, sf))
