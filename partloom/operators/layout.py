"""Where a sheet's header is and which column means what.

cells: file_id, sheet, row_idx, col_idx, value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partloom.functions.text import clean_cell, header_key, header_norm, key, model_and_grade

# The names that sheets give a field, best first, and the fields that make a header.
ALIASES = {
    "no": ["No.", "No"],
    "bom_level_raw": ["BOM Level", "Level", "Lvl"],
    "part_type": ["Part Type", "분과", "CMDT", "CMDT-2"],
    "part_no_base": ["Base P/No", "Base Part No", "Base P/no", "Base P/No."],
    "part_no_new": ["New P/No", "New Part No", "New P/no", "New P/No.", "P/no.", "P/No.", "Part No", "Part No.", "P/no"],
    "part_name": ["Class Desc.(Part Name)", "Class Desc.", "Part Name", "Desc.", "Description", "부품명", "Part"],
    "qty_base": ["Base Q'ty", "Base Qty", "Base Quantity"],
    "qty_new": ["New Q'ty", "New Qty", "New Quantity", "Q'ty", "Qty", "QTY", "Quantity", "Quanty"],
    "change_point_raw": ["Changing Point", "Changing Point.", "변경점", "변경 내역", "변경내역"],
    "change_reason_raw": ["Changing Reason", "Changing Reason.", "변경사유", "변경 사유"],
    "supplier": ["Supplier", "양산처", "Supplier Code"],
    "classification": ["Classification", "신규/변경", "구분", "신규"],
    "mold_dev": ["Mold Dev", "Mold Dev.", "금형 개발", "금형", "금형 개발 /수정"],
    "in_house": ["In-house", "In-house.", "사내 제작 or 직거래", "사내 입고", "사내"],
    "designer": ["설계자", "설계"],
    "fig_ref": ["Fig.", "Fig", "Picture"],
    "part_grade": ["부품 등급", "Grade"],
    "remark": ["Remark", "비고", "비 고"],
    "module": ["Module"],
    "buyer": ["구매"],
    "introduced": ["도입"],
}
HEADER_FIELDS = ["bom_level_raw", "part_no_base", "part_no_new", "part_name", "classification", "change_point_raw", "change_reason_raw"]
# The beginnings of headers of the two fixed layouts; a group spans a column and the next.
TWO_ROW_PREFIXES = [
    ("No.", []), ("BOM Level", ["bom_level_raw"]), ("Part Type", ["part_type"]), ("P/No", ["part_no_base", "part_no_new"]), ("부품명", ["part_name"]), ("Class Desc.", ["part_name"]),
    ("Q'ty", ["qty_base", "qty_new"]), ("변경점", ["change_point_raw"]), ("변경사유", ["change_reason_raw"]), ("양산처", ["supplier"]), ("Supplier", ["supplier"]),
    ("신규/변경", ["classification"]), ("Classification", ["classification"]), ("금형", ["mold_dev"]), ("Mold Dev", ["mold_dev"]), ("사내", ["in_house"]), ("In-house", ["in_house"]),
]
ONE_ROW_PREFIXES = [
    ("No.", []), ("부품 개발 등록", []), ("BOM Level", ["bom_level_raw"]), ("Part Type", ["part_type"]), ("금형 개발", ["mold_dev"]), ("사내 제작 or 직거래", ["in_house"]), ("Base P/No", ["part_no_base"]),
    ("New P/No", ["part_no_new"]), ("Class Desc.", ["part_name"]), ("Fig.", ["fig_ref"]), ("변경점", ["change_point_raw"]), ("구분", ["classification"]), ("변경사유", ["change_reason_raw"]),
    ("Quanty", ["qty_new"]), ("Quantity", ["qty_new"]), ("Q'ty", ["qty_new"]), ("설계자", ["designer"]),
]
HEADER_WORDS = ["level", "레벨", "bom", "품번", "p/no", "new", "base", "qty", "수량", "desc", "품명", "change", "변경"]
EXCLUDED_SHEETS = ["history", "summary", "dqms", "hsms", "ssoid", "fcm", "partdms", "pra", "시험", "인정시험", "부품등급", "등급심의", "비교단가", "bom compare"]


def alias_table(spark: SparkSession, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """field, alias_key, position: a few hundred rows, fixed by the program."""
    rows = [(f, a, i) for i, (f, a) in enumerate((f, a) for f, names in aliases.items() for a in names)]
    table = spark.createDataFrame(rows, "field string, alias string, position int")
    return table.select("field", header_key(F.col("alias")).alias("alias_key"), "position")


def labelled_cells(cells: DataFrame, aliases: DataFrame, *, rows: int = 20, cols: int = 80) -> DataFrame:
    """Cells that name a field: exactly, or with an alias of four signs or more inside."""
    near = cells.where((F.col("row_idx") <= rows) & (F.col("col_idx") < cols)).withColumn("cell_key", header_key(F.col("value"))).where("cell_key != ''")
    match = (F.col("cell_key") == F.col("alias_key")) | ((F.length("alias_key") >= 4) & F.contains("cell_key", F.col("alias_key")))
    if aliases.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 aliases; a header's names are fixed words")
    found = near.join(F.broadcast(aliases), match)  # checked above
    order = F.struct((F.col("cell_key") != F.col("alias_key")).alias("inexact"), "position")
    return found.groupBy("file_id", "sheet", "row_idx", "col_idx").agg(F.min_by("field", order).alias("field"), F.min_by("position", order).alias("position"))


def header_rows(labelled: DataFrame, *, least: int = 3) -> DataFrame:
    """file_id, sheet, header_row, score: the first row of most points: two for a header
    field, and two each for a name, a number, and a change with its reason."""
    fields = labelled.select("file_id", "sheet", "row_idx", "field").distinct()
    has = lambda *names: F.bool_or(F.col("field").isin(*names)).cast("int")
    points = F.sum(F.when(F.col("field").isin(HEADER_FIELDS), 2).otherwise(0))
    both = has("change_point_raw") * has("change_reason_raw")
    bonus = 2 * (has("part_name") + has("part_no_new", "part_no_base") + both)
    score = fields.groupBy("file_id", "sheet", "row_idx").agg((points + bonus).alias("score"))
    best = score.where(F.col("score") >= least).groupBy("file_id", "sheet").agg(F.max(F.struct("score", (-F.col("row_idx")).alias("r"))).alias("x"))
    return best.select("file_id", "sheet", (-F.col("x.r")).alias("header_row"), F.col("x.score").alias("score"))


def column_map(labelled: DataFrame, headers: DataFrame) -> DataFrame:
    """file_id, sheet, field, col_idx: each field's first column in its header row."""
    own = labelled.join(headers, ["file_id", "sheet"]).where("row_idx = header_row")
    return own.groupBy("file_id", "sheet", "field").agg(F.min("col_idx").alias("col_idx"))


def records(cells: DataFrame, headers: DataFrame, columns: DataFrame, fields: list[str]) -> DataFrame:
    """file_id, sheet, row_idx and a column for each field, of the rows below the header."""
    body = cells.join(headers.select("file_id", "sheet", "header_row"), ["file_id", "sheet"]).where("row_idx > header_row")
    named = body.join(columns, ["file_id", "sheet", "col_idx"]).withColumn("value", clean_cell(F.col("value")))
    return named.groupBy("file_id", "sheet", "row_idx").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields))


def fixed_layout(cells: DataFrame) -> DataFrame:
    """file_id, sheet, layout: v1 (two header rows), v2 (one), by rows 8 and 9; null for others."""
    has = lambda row, word: F.bool_or((F.col("row_idx") == row) & F.contains(key(F.col("value")), F.lit(word)))
    flags = cells.groupBy("file_id", "sheet").agg(has(8, "bom level").alias("l8"), has(9, "bom level").alias("l9"), has(9, "base p/no").alias("b9"))
    return flags.select("file_id", "sheet", F.when(F.col("l8") & F.col("b9"), "v1").when(F.col("l9") & F.col("b9"), "v2").alias("layout"))


def header_by_words(cells: DataFrame, *, rows: int = 40) -> DataFrame:
    """file_id, sheet, header_row: the first row with a word for level and one for a part."""
    k = key(F.col("value"))
    level, part = F.contains(k, F.lit("level")) | F.contains(k, F.lit("lvl")), k.rlike("p/no|part no|part name|부품명")
    hit = cells.where(F.col("row_idx") <= rows).groupBy("file_id", "sheet", "row_idx").agg(F.bool_or(level).alias("l"), F.bool_or(part).alias("p"))
    return hit.where("l AND p").groupBy("file_id", "sheet").agg(F.min("row_idx").alias("header_row"))


def value_right_of(cells: DataFrame, label: str) -> DataFrame:
    """file_id, sheet, value: the next cell that isn't blank, right of the first cell with a label."""
    row = Window.partitionBy("file_id", "sheet", "row_idx").orderBy("col_idx")
    filled = cells.withColumn("value", clean_cell(F.col("value"))).where("value IS NOT NULL")
    nexts = filled.withColumn("next", F.lead("value").over(row)).where(F.contains(key(F.col("value")), F.lit(label.lower())))
    return nexts.groupBy("file_id", "sheet").agg(F.min_by("next", F.struct("row_idx", "col_idx")).alias("value"))


def is_excluded_sheet(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.exists(F.array(*map(F.lit, EXCLUDED_SHEETS)), lambda w: F.contains(low, w))


def fill_down(cells: DataFrame, column: str, keys: list[str], order: str) -> DataFrame:
    """Merged cells: a blank one takes what stands above it."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn(column, F.last(F.when(F.trim(F.coalesce(F.col(column), F.lit(""))) != "", F.col(column)), ignorenulls=True).over(window))


def _by_prefix(cells: DataFrame, row: int, prefixes: list[tuple[str, list[str]]]) -> DataFrame:
    """file_id, sheet, field, col_idx: what each header of a row begins with, the first
    prefix that fits; a field's last column counts."""
    text = clean_cell(F.col("value"))
    fields = F.lit(None).cast("array<string>")
    for prefix, names in reversed(prefixes):
        fields = F.when(F.startswith(text, F.lit(prefix)), F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")).otherwise(fields)
    found = cells.where((F.col("row_idx") == row) & (F.col("col_idx") < 30)).select("file_id", "sheet", "col_idx", F.posexplode(fields).alias("off", "field"))
    return found.groupBy("file_id", "sheet", "field").agg(F.max_by(F.col("col_idx") + F.col("off"), "col_idx").alias("col_idx"))


def fixed_columns(cells: DataFrame) -> DataFrame:
    """file_id, sheet, header_row, field, col_idx of sheets in one of the fixed layouts:
    v1 names numbers and quantities once for two columns (row 8, with row 9
    below it), v2 has one header row (9)."""
    layouts = fixed_layout(cells).where("layout IS NOT NULL")
    v1 = _by_prefix(cells, 8, TWO_ROW_PREFIXES).join(layouts.where("layout = 'v1'"), ["file_id", "sheet"])
    v2 = _by_prefix(cells, 9, ONE_ROW_PREFIXES).join(layouts.where("layout = 'v2'"), ["file_id", "sheet"])
    return v1.unionByName(v2).select("file_id", "sheet", F.lit(9).alias("header_row"), "field", "col_idx")


def form_metadata(cells: DataFrame) -> DataFrame:
    """file_id, sheet, layout and the cells of a form's head (rows 2 to 7): models with
    their grades, event, and where v2 has them buyer, brand, set number, date."""
    head = cells.where(F.col("row_idx").between(2, 7)).join(fixed_layout(cells).where("layout IS NOT NULL"), ["file_id", "sheet"])
    at = lambda k: F.max(F.when(F.col("col_idx") == k, clean_cell(F.col("value"))))
    rows = head.groupBy("file_id", "sheet", "layout", "row_idx").agg(*(at(k).alias(f"c{k}") for k in (1, 5, 7, 8, 9, 10, 11)))
    v1, v2 = F.col("layout") == "v1", F.col("layout") == "v2"
    said = lambda label, word: F.contains(F.col(label), F.lit(word))
    pick = lambda cond, value: F.max_by(F.when(cond, F.col(value)), F.when(cond, F.col("row_idx")))
    out = rows.groupBy("file_id", "sheet", "layout").agg(
        F.coalesce(pick(v1 & said("c1", "Base Model"), "c5"), pick(v2 & said("c7", "모델명"), "c8")).alias("base"),
        F.coalesce(pick(v1 & said("c1", "New Model"), "c5"), pick(v2 & said("c10", "모델명"), "c11")).alias("new"),
        F.coalesce(pick(v1 & said("c1", "Event"), "c5"), pick(v2 & (F.col("c9") == "Event"), "c10")).alias("event"),
        *(pick(v2 & said("c7", word), "c8").alias(name) for name, word in [("buyer", "Buyer"), ("brand", "Brand"), ("set_part_no", "Set P/No"), ("production_date", "양산 일자")]),
    )
    (bm, bg), (nm, ng) = model_and_grade(F.col("base")), model_and_grade(F.col("new"))
    return out.select("file_id", "sheet", "layout", bm.alias("base_model"), bg.alias("base_grade"), nm.alias("new_model"), ng.alias("new_grade"), "event", "buyer", "brand", "set_part_no", "production_date")


def header_by_hits(cells: DataFrame, *, rows: int = 40) -> DataFrame:
    """file_id, sheet, header_row, hits: the first row whose words hold most of the header words."""
    words = cells.where(F.col("row_idx") <= rows).groupBy("file_id", "sheet", "row_idx").agg(
        *(F.bool_or(F.contains(F.lower("value"), F.lit(w))).alias(f"w{i}") for i, w in enumerate(HEADER_WORDS))
    )
    hits = sum((F.coalesce(f"w{i}", F.lit(False)).cast("int") for i in range(len(HEADER_WORDS))), F.lit(0))
    best = words.groupBy("file_id", "sheet").agg(F.max(F.struct(hits.alias("hits"), (-F.col("row_idx")).alias("r"))).alias("x"))
    return best.select("file_id", "sheet", (-F.col("x.r")).alias("header_row"), F.col("x.hits").alias("hits"))


def find_column(headers: DataFrame, *choices: list[str]) -> DataFrame:
    """file_id, sheet, col_idx: the first column with all words of a choice, the first choice that any column fits."""
    k = key(F.col("value"))
    fits = [F.forall(F.array(*map(F.lit, words)), lambda w: F.contains(k, w)) for words in choices]
    rank = F.coalesce(*(F.when(f, F.lit(i)) for i, f in enumerate(fits)))
    return headers.withColumn("__rank", rank).where("__rank IS NOT NULL").groupBy("file_id", "sheet").agg(F.min_by("col_idx", F.struct("__rank", "col_idx")).alias("col_idx"))


def pick_column(headers: DataFrame, names: list[str], *, partly: bool = False) -> DataFrame:
    """file_id, sheet, col_idx: the column that equals the first of names that any
    does (letters, digits and Hangul alone); with partly, or else holds one."""
    k = header_norm(F.col("value"))
    wanted = F.array(*(header_norm(F.lit(n)) for n in names))
    exact = F.array_position(wanted, k)
    rank = F.when(exact > 0, exact)
    if partly:
        inside = F.array_position(F.transform(wanted, lambda w: F.contains(k, w)), F.lit(True))
        rank = F.coalesce(rank, F.when(inside > 0, inside + len(names)))
    return headers.withColumn("__rank", rank).where("__rank IS NOT NULL").groupBy("file_id", "sheet").agg(F.min_by("col_idx", F.struct("__rank", "col_idx")).alias("col_idx"))


def probe(cells: DataFrame, aliases: DataFrame, *, rows: int = 50) -> DataFrame:
    """cells of the sheets whose first rows hold a header; the others aren't read on."""
    found = header_rows(labelled_cells(cells.where(F.col("row_idx") <= rows), aliases))
    return cells.join(found.select("file_id", "sheet"), ["file_id", "sheet"], "left_semi")


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """Rows with any cell, blanks for nulls in text columns."""
    text = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    return df.na.drop("all").na.fill("", subset=text)


def first_sheet(cells: DataFrame) -> DataFrame:
    """cells (with sheet_idx) of each file's first sheet."""
    return cells.where("sheet_idx = 0")


def header_at(cells: DataFrame, row: int) -> DataFrame:
    """file_id, sheet, header_row of sheets whose header's place is known."""
    return cells.select("file_id", "sheet").distinct().withColumn("header_row", F.lit(row))


def records_from(cells: DataFrame, first_row: int, columns: dict[str, int]) -> DataFrame:
    """file_id, sheet, row_idx and a column for each place of a sheet without a header:
    its rows from first_row on, but for blank ones."""
    below = cells.where(F.col("row_idx") >= first_row).groupBy("file_id", "sheet", "row_idx")
    out = below.agg(*(F.max(F.when(F.col("col_idx") == i, F.col("value"))).alias(name) for name, i in columns.items()))
    return out.where(F.coalesce(*(F.nullif(F.col(name), F.lit("")) for name in columns)).isNotNull())
