"""Sheets as cells, made from the driver's tables, and read back as records."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.functions import text
from partloom.operators import ingest, layout
from partloom.plans.bom import BOM, bom_rows
from partloom.plans.registry import query, table

_HEADER = ["No.", "BOM Level", "Base P/No", "New P/No", "Class Desc.(Part Name)", "New Q'ty", "변경점", "변경 사유 (상세)", "금형 개발 /수정", "설계자", "출처"]
_FIELDS = ["no", "bom_level_raw", "part_no_base", "part_no_new", "part_name", "qty_new", "change_point_raw", "change_reason_raw", "mold_dev", "designer"]


def _cells(spark, sf):
    """A sheet for each brand: a title, its header in row 5, the parts below row 100."""
    rows = bom_rows(spark, sf)
    k = F.col("row_no")
    values = [k.cast("string"), F.col("raw_level"), F.col("base_no"), F.col("new_no"), F.concat(F.lit("  "), "name", F.lit(" ")), F.col("qty"), F.col("point"), F.col("reason"), F.when(k % 2 == 0, "O"), F.concat(F.lit("s"), (k % 9).cast("string")), F.lit("x")]
    cell = lambda i, v: F.struct(F.lit(i).alias("col_idx"), v.cast("string").alias("value"))
    body = rows.select(F.col("doc").alias("file_id"), (k + 100).cast("int").alias("row_idx"), F.explode(F.array(*(cell(i, v) for i, v in enumerate(values)))).alias("c"))
    files = rows.select(F.col("doc").alias("file_id")).distinct()
    head = files.select("file_id", F.lit(5).alias("row_idx"), F.explode(F.array(*(cell(i, F.lit(h)) for i, h in enumerate(_HEADER)))).alias("c"))
    title = files.select("file_id", F.lit(2).alias("row_idx"), F.explode(F.array(cell(0, F.lit("BOM Level 표")), cell(3, F.lit("Remark")))).alias("c"))
    return body.unionByName(head).unionByName(title).select("file_id", F.lit("Master").alias("sheet"), "row_idx", "c.col_idx", "c.value")


@query(f"""WITH {BOM}, c AS (SELECT doc AS file_id, row_no + 100 AS row_idx, [CAST(row_no AS VARCHAR), raw_level, base_no, new_no, name, qty, point, reason, CASE WHEN row_no % 2 = 0 THEN 'O' END, 's' || (row_no % 9)] AS v FROM bom)
    SELECT file_id, CAST(row_idx AS INTEGER) AS row_idx, {', '.join(f"nullif(trim(regexp_replace(v[{i + 1}], ' +', ' ', 'g')), '') AS {f}" for i, f in enumerate(_FIELDS))} FROM c""")
def sheet_records(spark, sf):
    """Header found by its words, columns by their aliases, rows below it as records."""
    cells, aliases = _cells(spark, sf), layout.alias_table(spark)
    cells = layout.probe(cells, aliases)
    labelled = layout.labelled_cells(cells, aliases)
    headers = layout.header_rows(labelled)
    return layout.records(cells, headers, layout.column_map(labelled, headers), _FIELDS).drop("sheet")


@query("SELECT DISTINCT p_brand AS file_id, 5 AS header_row, 18 AS score FROM part")
def header_scores(spark, sf):
    """Six header fields, a name, a number, a change with its reason."""
    return layout.header_rows(layout.labelled_cells(_cells(spark, sf), layout.alias_table(spark))).select("file_id", "header_row", F.col("score").cast("int").alias("score"))


@query("SELECT DISTINCT p_brand AS file_id, 5 AS header_row, 8 AS hits FROM part")
def header_hits(spark, sf):
    """level, bom, p/no, new, base, desc, 변경 (and its qty as Q'ty counts not); the title has two."""
    cells = _cells(spark, sf).where("row_idx < 100")
    more = cells.where("row_idx = 5 AND col_idx = 5").withColumn("value", F.lit("Qty"))
    return layout.header_by_hits(cells.unionByName(more)).select("file_id", "header_row", "hits")


@query("""SELECT DISTINCT p_brand AS file_id, 3 AS new_no, 2 AS part_no, 7 AS reason, 4 AS name, CAST(NULL AS INTEGER) AS none FROM part""")
def column_finders(spark, sf):
    head = _cells(spark, sf).where("row_idx = 5")
    found = [
        layout.find_column(head, ["new", "p/no"]).withColumnRenamed("col_idx", "new_no"), layout.find_column(head, ["part no"], ["p/no"]).withColumnRenamed("col_idx", "part_no"),
        layout.pick_column(head, ["Reason", "변경사유"], partly=True).withColumnRenamed("col_idx", "reason"), layout.pick_column(head, ["class desc part name", "x"]).withColumnRenamed("col_idx", "name"),
        layout.pick_column(head, ["변경사유"]).withColumnRenamed("col_idx", "none"),
    ]
    out = head.select("file_id", "sheet").distinct()
    for f in found:
        out = out.join(f, ["file_id", "sheet"], "left")
    return out.drop("sheet")


_V1 = [(8, 1, "BOM Level"), (8, 2, "Part Type"), (8, 3, "P/No"), (8, 5, "부품명"), (8, 6, "Q'ty"), (8, 8, "변경점"), (9, 3, "Base P/No"), (9, 4, "New P/No"), (8, 10, "Supplier"), (8, 11, "No. 2")]
_V2 = [(9, 0, "No."), (9, 1, "BOM Level"), (9, 2, "Base P/No"), (9, 3, "New P/No"), (9, 4, "Class Desc."), (9, 5, "Quantity"), (9, 6, "Q'ty"), (9, 7, "구분"), (9, 8, "설계자 (정)"), (8, 9, "변경점")]


def _forms(spark, sf):
    """A form for each nation, in the two fixed layouts by turns; columns move with the region."""
    n = table(spark, sf, "nation")
    cell = lambda r, c, v: F.struct(F.lit(r).alias("row_idx"), F.lit(c).alias("col_idx"), (v if not isinstance(v, str) else F.lit(v)).alias("value"))
    model = F.concat(F.lit("M"), F.col("n_nationkey").cast("string"))
    head1 = [(2, 1, "Base Model"), (2, 5, F.concat(model, F.lit(" / D (사우디)"))), (3, 1, "New  Model"), (3, 5, F.concat(F.lit("N"), model)), (4, 1, "Event"), (4, 5, "PP")]
    head2 = [(2, 7, "모델명(등급)"), (2, 8, model), (2, 10, "모델명(등급)"), (2, 11, F.concat(model, F.lit("x/Cb"))), (3, 7, "Buyer명"), (3, 8, F.col("n_name")), (5, 7, "Set P/No."), (5, 8, "S1"), (7, 9, "Event"), (7, 10, "DV")]
    first = F.array(*(cell(*c) for c in _V1), *(cell(*c) for c in head1))
    second = F.array(*(cell(*c) for c in _V2), *(cell(*c) for c in head2))
    out = n.select(F.col("n_name").alias("file_id"), F.lit("s").alias("sheet"), "n_regionkey", F.explode(F.when(F.col("n_nationkey") % 2 == 0, first).otherwise(second)).alias("c"))
    moved = F.when(F.col("c.row_idx") >= 8, F.col("c.col_idx") + F.col("n_regionkey")).otherwise(F.col("c.col_idx")).cast("int")
    return out.select("file_id", "sheet", "c.row_idx", moved.alias("col_idx"), "c.value")


@query("""WITH a(field, pos) AS (VALUES ('bom_level_raw', 1), ('part_type', 2), ('part_no_base', 3), ('part_no_new', 4), ('part_name', 5), ('qty_base', 6), ('qty_new', 7), ('change_point_raw', 8), ('supplier', 10)),
    b(field, pos) AS (VALUES ('bom_level_raw', 1), ('part_no_base', 2), ('part_no_new', 3), ('part_name', 4), ('qty_new', 6), ('classification', 7), ('designer', 8))
    SELECT n_name AS file_id, 9 AS header_row, field, CAST(pos + n_regionkey AS INTEGER) AS col_idx FROM nation, a WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_name, 9, field, CAST(pos + n_regionkey AS INTEGER) FROM nation, b WHERE n_nationkey % 2 = 1""")
def fixed_layout_columns(spark, sf):
    return layout.fixed_columns(_forms(spark, sf)).drop("sheet")


@query("""SELECT n_name AS file_id, CASE WHEN n_nationkey % 2 = 0 THEN 'v1' ELSE 'v2' END AS layout, 'M' || n_nationkey AS base_model, CASE WHEN n_nationkey % 2 = 0 THEN 'D' END AS base_grade,
    CASE WHEN n_nationkey % 2 = 0 THEN 'NM' || n_nationkey ELSE 'M' || n_nationkey || 'x' END AS new_model, CASE WHEN n_nationkey % 2 = 1 THEN 'Cb' END AS new_grade, CASE WHEN n_nationkey % 2 = 0 THEN 'PP' ELSE 'DV' END AS event,
    CASE WHEN n_nationkey % 2 = 1 THEN n_name END AS buyer, CAST(NULL AS VARCHAR) AS brand, CASE WHEN n_nationkey % 2 = 1 THEN 'S1' END AS set_part_no, CAST(NULL AS VARCHAR) AS production_date FROM nation""")
def form_metadata(spark, sf):
    return layout.form_metadata(_forms(spark, sf)).drop("sheet")


@query("""WITH r AS (SELECT o_custkey AS file, o_orderkey, o_totalprice > 1000 AS ok, o_orderkey % 97 <> 0 AS named FROM orders), f AS (SELECT file, count(*) AS n, min(CASE WHEN NOT ok THEN 'price' WHEN NOT named THEN 'name' END) AS failed FROM r GROUP BY file)
    SELECT c_custkey AS file, coalesce(n, 0) AS n_rows, failed, CASE WHEN failed IS NOT NULL THEN 'failed' WHEN n > 0 THEN 'completed' ELSE 'skipped' END AS status, CASE WHEN failed IS NULL THEN coalesce(n, 0) ELSE 0 END AS n_stored FROM customer LEFT JOIN f ON file = c_custkey""")
def whole_files(spark, sf):
    """A file is stored whole or, where a row fails, not at all."""
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("file"), "o_orderkey", "o_totalprice")
    files = table(spark, sf, "customer").select(F.col("c_custkey").alias("file"))
    stored, log = ingest.load_once(files, rows, {"price": F.col("o_totalprice") > 1000, "name": F.col("o_orderkey") % 97 != 0})
    n = stored.groupBy("file").agg(F.count("*").alias("n_stored"))
    return log.join(n, "file", "left").withColumn("n_stored", F.coalesce("n_stored", F.lit(0).cast("long")))


@query(f"""WITH {BOM}, a AS (SELECT name, arg_min(part_no, (part_no, qty)) AS part_no, arg_min(qty, (part_no, qty)) AS qty FROM bom WHERE row_no % 3 = 0 GROUP BY name), b AS (SELECT name, arg_min(part_no, (part_no, part_type)) AS part_no, arg_min(part_type, (part_no, part_type)) AS part_type FROM bom WHERE row_no % 3 <> 0 GROUP BY name)
    SELECT name, part_no, qty, CAST(NULL AS VARCHAR) AS part_type FROM a UNION ALL SELECT name, part_no, NULL, part_type FROM b WHERE name NOT IN (SELECT name FROM a)""")
def reference_union(spark, sf):
    """Lists with different columns; the first list's row of a name counts."""
    rows = bom_rows(spark, sf)
    return ingest.union_first([rows.where("row_no % 3 = 0").select("name", "part_no", "qty"), rows.where("row_no % 3 != 0").select("name", "part_no", "part_type")], "name")


@query("SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS r_name FROM nation UNION ALL SELECT NULL, NULL, r_name FROM region")
def evolved_schema(spark, sf):
    loaded = ingest.unless_loaded(table(spark, sf, "region"), table(spark, sf, "nation"))  # nothing: regions are there
    first = ingest.unless_loaded(table(spark, sf, "nation").where("false"), table(spark, sf, "nation"))
    return ingest.evolved(first.unionByName(loaded).select("n_nationkey", "n_name"), table(spark, sf, "region").select("r_name"))


@query(f"""WITH {BOM} SELECT doc, row_no, coalesce(CASE WHEN row_no % 5 <> 0 THEN new_no END, '') AS new_no FROM bom WHERE NOT (row_no % 15 = 0)""")
def blank_rows(spark, sf):
    """Rows without any cell go; other nulls become blanks."""
    k = F.col("row_no")
    rows = bom_rows(spark, sf).select(F.when(k % 15 != 0, F.col("doc")).alias("doc"), F.when(k % 15 != 0, k).alias("row_no"), F.when(k % 5 != 0, F.col("new_no")).alias("new_no"))
    return layout.drop_blank_rows(rows)


@query("""SELECT o_orderkey, (o_orderkey % 4 = 0) AS is_blank FROM orders""")
def blank_cells(spark, sf):
    k = F.col("o_orderkey")
    a = F.when(k % 2 == 0, F.lit(" \u3000\t")).otherwise(F.lit("x"))
    b = F.when(k % 4 == 0, F.lit(None).cast("string")).otherwise(F.when(k % 4 == 2, "y").otherwise(""))
    return table(spark, sf, "orders").select("o_orderkey", text.all_blank(a, b).alias("is_blank"))
