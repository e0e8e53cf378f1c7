"""Rules on single cells and rows, each over all rows of a table, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.functions import levels, models, text
from partloom.operators import agent, classify, evidence, feedback, ingest, layout
from partloom.plans.bom import BOM, bom_rows
from partloom.plans.registry import query, table
from partloom.sources import sinks


def _pick(words, by, n=None):
    return F.get(F.array(*map(F.lit, words)), (by % len(words)).cast("int"))


def _sql(words, by):
    said = ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    return f"([{said}])[CAST({by} % {len(words)} AS INTEGER) + 1]"


@query(f"""WITH {BOM}, t AS (SELECT row_no, upper(name || ' ' || part_no || CASE WHEN row_no % 3 = 0 THEN ', NEW12345678/' || part_no ELSE ' short AB1' END) AS x FROM bom)
    SELECT row_no, trim(regexp_replace(regexp_replace(x, '\\b[A-Z0-9]{{8,14}}\\b', '', 'g'), '\\s+', ' ', 'g')) AS left_over FROM t""")
def without_part_numbers(spark, sf):
    said = F.concat("name", F.lit(" "), "part_no", F.when(F.col("row_no") % 3 == 0, F.concat(F.lit(", NEW12345678/"), "part_no")).otherwise(F.lit(" short AB1")))
    return bom_rows(spark, sf).select("row_no", text.without_part_nos(said).alias("left_over"))


_SEEDS, _STOP = ["Ring", "gear", "카메라"], ["the", "red"]


@query(f"""WITH {BOM}, t AS (SELECT row_no, name || ' the ' || point AS x FROM bom), h AS (SELECT row_no, x, list_filter(['Ring', 'gear', '카메라'], lambda s: contains(lower(x), lower(s))) || list_filter(regexp_extract_all(lower(x), '[a-z0-9가-힣]{{2,}}'), lambda w: w NOT IN ('the', 'red')) AS w FROM t),
    d AS (SELECT row_no, w, list_filter(range(1, len(w) + 1), lambda i: list_position(w, w[i]) = i) AS first FROM h) SELECT row_no, array_to_string(list_transform(first[1:4], lambda i: w[i]), ',') AS tags FROM d""")
def auto_tags(spark, sf):
    return bom_rows(spark, sf).select("row_no", F.array_join(text.tags(F.concat("name", F.lit(" the "), "point"), _SEEDS, _STOP, 4), ",").alias("tags"))


_DEPTHS = ["..2", ".1", " ...x3", "3", "2.7", "", "x", "-1", "4.0"]


@query(f"""WITH t AS (SELECT o_orderkey, {_sql(_DEPTHS, 'o_orderkey')} AS x FROM orders)
    SELECT o_orderkey, CAST(CASE WHEN regexp_matches(trim(x), '^\\.') THEN length(regexp_extract(trim(x), '^\\.*')) ELSE coalesce(trunc(TRY_CAST(x AS DOUBLE)), 1) END AS INTEGER) AS lenient FROM t""")
def lenient_depths(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", levels.depth_lenient(_pick(_DEPTHS, F.col("o_orderkey"))).alias("lenient"))


_CODES = ["WSED7613B", "see WSED7613C here", "MJ12345678", "chef HABC12345", "LSEL6333F and WSED7613B", "none", "xWSED7613B", "CAAA11111x"]
_OTHER = ["WSED7613B", "WSED7913B", "LSED7613B", "WSEG7613F", "WSED8213B", "short", "WSXD7616C"]


@query(f"SELECT o_orderkey, regexp_extract(upper({_sql(_CODES, 'o_orderkey')}), '\\b([WLMCH][A-Z0-9]{{8}})', 1) AS code FROM orders")
def wide_codes(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", models.wide_code(_pick(_CODES, F.col("o_orderkey"))).alias("code"))


_GRADES = ["개발 등급: B", "A급 과제", "model (C)", " d ", "등급c", "no grade", "(X) 개발등급/ D", "XA급", ""]


@query(f"""WITH t AS (SELECT o_orderkey, {_sql(_GRADES, 'o_orderkey')} AS x, CAST(o_orderkey % {len(_GRADES)} AS INTEGER) AS k FROM orders)
    SELECT o_orderkey, (['B', 'A', 'C', 'D', 'C', '', 'D', '', ''])[k + 1] AS grade FROM t""")
def grades(spark, sf):
    """By label, suffix, brackets or alone; the answers are written out."""
    return table(spark, sf, "orders").select("o_orderkey", models.grade(_pick(_GRADES, F.col("o_orderkey"))).alias("grade"))


@query(f"""WITH t AS (SELECT o_orderkey, {_sql(_OTHER, 'o_orderkey')} AS b, {_sql(_OTHER, 'o_custkey')} AS n FROM orders), g AS (SELECT *, abs(TRY_CAST(substr(b, 5, 2) AS INTEGER) - TRY_CAST(substr(n, 5, 2) AS INTEGER)) AS gap, length(b) = 9 AND length(n) = 9 AS ok FROM t)
    SELECT o_orderkey, CASE WHEN ok THEN concat_ws(',', CASE WHEN b[1] <> n[1] THEN 'product' END, CASE WHEN b[2] <> n[2] THEN 'kind' END, CASE WHEN b[3] <> n[3] THEN 'series' END, CASE WHEN b[4] <> n[4] THEN 'platform' END, CASE WHEN b[7] <> n[7] THEN 'design' END, CASE WHEN b[8] <> n[8] THEN 'grade' END, CASE WHEN b[9] <> n[9] THEN 'color' END,
        CASE WHEN substr(b, 5, 2) <> substr(n, 5, 2) THEN 'capacity:' || CASE WHEN gap = 0 THEN 'medium' WHEN gap <= 3 THEN 'small' WHEN gap <= 6 THEN 'medium' WHEN gap IS NOT NULL THEN 'large' ELSE 'medium' END END) ELSE '' END AS diffs FROM g""")
def model_differences(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(models.differences(_pick(_OTHER, F.col("o_orderkey")), _pick(_OTHER, F.col("o_custkey"))), ",").alias("diffs"))


_ASKS = ["카메라 적용 first", "plain change", "최근 트렌드", "LED bar", "none", "하네스 변경", "Offset 옵셋"]


@query(f"""WITH t AS (SELECT o_orderkey, {_sql(_ASKS, 'o_orderkey')} AS x, {_sql(_OTHER, 'o_custkey')} AS code, {_sql(['D', 'c', 'B', ''], 'o_orderkey')} AS g FROM orders), c AS (SELECT *, CASE WHEN regexp_matches(code, '^[WL]') AND length(code) = 9 THEN code ELSE '' END AS core FROM t)
    SELECT o_orderkey, upper(g) AS dev_grade, core AS core9, substr(core, 1, CASE WHEN length(core) <> 9 THEN length(core) WHEN upper(g) = 'D' THEN 7 WHEN upper(g) = 'C' THEN 6 ELSE 4 END) AS primary_prefix, substr(core, 1, 1) AS product_gate,
        len(list_filter(['최초', 'first', '최근', '트렌드', 'camera', '카메라', 'led', '하네스', '화각', '옵셋'], lambda w: contains(lower(x), w))) > 0 AS secondary FROM c""")
def search_policies(spark, sf):
    """How each request is searched: its code, how much of it must agree, whether the pool is widened."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", models.policy(_pick(_OTHER, F.col("o_custkey")), _pick(["D", "c", "B", ""], k), _pick(_ASKS, k)).alias("p")).select("o_orderkey", "p.*")


_SHEETS = ["Master", "Summary", "BOM", "작성 예시", "Sheet1", "요약", "History", "표지", "guide"]


@query(f"SELECT o_orderkey, len(list_filter([{', '.join(repr(w) for w in layout.EXCLUDED_SHEETS)}], lambda w: contains(lower({_sql(_SHEETS, 'o_orderkey')}), w))) > 0 AS excluded FROM orders")
def excluded_sheets(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", layout.is_excluded_sheet(_pick(_SHEETS, F.col("o_orderkey"))).alias("excluded"))


@query("""SELECT n_name AS file_id, CAST(3 + n_nationkey % 5 AS INTEGER) AS header_row FROM nation WHERE n_nationkey % 4 <> 3""")
def first_headers(spark, sf):
    """The first row with a word for a level and one for a part, in different rows of different files."""
    n, k = table(spark, sf, "nation"), F.col("n_nationkey")
    cell = lambda r, c, v: F.struct(r.cast("int").alias("row_idx"), F.lit(c).alias("col_idx"), v.alias("value"))
    at = 3 + k % 5
    cells = F.array(cell(F.lit(1), 0, F.lit("Level only")), cell(at, 0, _pick(["BOM Level", "LVL", "level"], k)), cell(at, 1, F.when(k % 4 == 3, "nothing").otherwise(_pick(["Base P/No", "Part Name", "부품명", "part no."], k))), cell(at + 3, 0, F.lit("Level / P/No")))
    rows = n.select(F.col("n_name").alias("file_id"), F.lit("s").alias("sheet"), F.explode(F.when(k % 4 == 3, F.slice(cells, 1, 3)).otherwise(cells)).alias("c")).select("file_id", "sheet", "c.*")
    return layout.header_by_words(rows).drop("sheet")


@query("""SELECT n_name || '.csv' AS name FROM nation WHERE n_nationkey % 3 <> 0""")
def missing_files(spark, sf):
    """Of a list of files, those that aren't there."""
    nations = table(spark, sf, "nation")
    expected = [f"{r['n_name']}.csv" for r in nations.select("n_name").collect()]  # a fixed list of 25
    return sinks.missing_files(spark, expected, nations.where("n_nationkey % 3 = 0").select(F.concat(F.lit("x/y/"), "n_name", F.lit(".csv")).alias("path")))


_SLIDES = ["개발 PJT 개요 심의 결과", "유첨3. 개발 변경점 CAVITY DOOR", "개발 등급 분류 기준 운영 기준 절차", "hello", "개발 PJT 개요 확정"]


@query(f"SELECT o_orderkey, (['OVERVIEW', 'DETAIL', 'REFERENCE', 'UNKNOWN', 'OVERVIEW'])[CAST(o_orderkey % {len(_SLIDES)} AS INTEGER) + 1] AS role FROM orders")
def slide_roles(spark, sf):
    """The answers are written out."""
    return table(spark, sf, "orders").select("o_orderkey", classify.slide_role(_pick(_SLIDES, F.col("o_orderkey"))).alias("role"))


_TABLES = [("Module | 주요 변경점", "Door | 구조 변경"), ("BASE | NEW B700 | Remark", "x"), ("우려 사항 | 대책", "y"), ("plain", "z"), ("변경 내역 (Before → After) | Reason | Concern | 부품", "w")]


@query(f"""WITH t AS (SELECT o_orderkey, CAST(o_orderkey % 5 AS INTEGER) AS k, o_custkey % 7 AS checks FROM orders)
    SELECT o_orderkey, CASE WHEN checks >= 2 THEN 'IGNORE' ELSE (['MAIN', 'DETAIL', 'RISK', 'IGNORE', 'MAIN'])[k + 1] END AS kind FROM t""")
def slide_table_types(spark, sf):
    """By the words of the header; tables of check marks are ignored."""
    k = F.col("o_orderkey")
    kind = classify.table_type(_pick([h for h, _ in _TABLES], k), _pick([e for _, e in _TABLES], k), F.lit(10), F.col("o_custkey") % 7)
    return table(spark, sf, "orders").select("o_orderkey", kind.alias("kind"))


@query("""SELECT text, any_value(sha256(text)) AS file_hash, min(doc_id) AS doc_id FROM (SELECT coalesce(text, '') AS text, doc_id FROM documents) WHERE sha256(text) NOT IN (SELECT sha256(text) FROM benchmark WHERE item_id % 2 = 0) GROUP BY text""")
def registered_files(spark, sf):
    """Contents that aren't known yet, each once."""
    known = table(spark, sf, "benchmark").where("item_id % 2 = 0").select(F.sha2("text", 256).alias("file_hash"))
    files = table(spark, sf, "documents").select(F.coalesce("text", F.lit("")).alias("text"), "doc_id").withColumn("file_hash", F.sha2("text", 256))
    return ingest.register(known.select(F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("doc_id"), "file_hash"), files).select("text", "file_hash", "doc_id")


@query(f"""WITH {BOM} SELECT doc, row_no, name, concat_ws(';', CASE WHEN nullif(new_no, '') IS NOT NULL THEN 'new_no=' || new_no END, 'qty=' || qty) AS extra FROM (SELECT doc, row_no, name, nullif(new_no, '') AS new_no, qty FROM bom)""")
def structured_and_extra(spark, sf):
    rows = bom_rows(spark, sf).select("doc", "row_no", "name", F.when(F.col("new_no") != "", F.col("new_no")).alias("new_no"), "qty")
    out = ingest.structured_and_extra(rows, ["doc", "row_no", "name"])
    pairs = F.transform(F.array_sort(F.map_entries("extra")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("doc", "row_no", "name", F.array_join(pairs, ";").alias("extra"))


_REQUESTS = ["AC motor", "fan noise", "a button", "red thing"]


@query(f"""WITH q AS (SELECT c_custkey AS query, {_sql(_REQUESTS, 'c_custkey')} AS text FROM customer), p AS (SELECT p_partkey, 'P' || p_partkey AS part_no, p_partkey % 17 AS position FROM part),
    f AS (SELECT query, text, part_no, position FROM q JOIN p ON query % 97 = p_partkey % 97), r AS (SELECT *, CASE WHEN contains(lower(text), 'motor') AND part_no = 'P5' THEN 2 WHEN contains(lower(text), 'fan') AND part_no = 'P9' THEN 1 ELSE 0 END AS way FROM f),
    b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY way DESC, position, part_no DESC) AS k FROM r) SELECT query, part_no, CASE way WHEN 2 THEN 95 WHEN 1 THEN 98 ELSE 50 END AS score FROM b WHERE k = 1""")
def matched_nodes(spark, sf):
    """The node that a rule names, else the first candidate."""
    q = table(spark, sf, "customer").select(F.col("c_custkey").alias("query"), _pick(_REQUESTS, F.col("c_custkey")).alias("text"))
    p = table(spark, sf, "part").select((F.col("p_partkey") % 97).alias("k"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("part_no"), (F.col("p_partkey") % 17).alias("position"))
    return agent.matched_at(q.withColumn("k", F.col("query") % 97), p, [("motor", "P5", 95), ("fan", "P9", 98)], place="k")


@query(f"""WITH {BOM} SELECT row_no, array_to_string(list_filter([{', '.join(repr(w) for w in feedback.CHANGE_TARGETS)}], lambda w: contains(point || ' ' || reason, w)), ',') AS targets FROM bom""")
def change_targets(spark, sf):
    return bom_rows(spark, sf).select("row_no", F.array_join(feedback.change_targets(F.concat_ws(" ", "point", "reason")), ",").alias("targets"))


@query(f"""WITH {BOM} SELECT row_no, 'old' || row_no % 3 AS was, CASE WHEN row_no % 4 = 0 THEN '' WHEN row_no % 4 = 1 THEN 'old' || row_no % 3 ELSE name END AS value FROM bom WHERE row_no % 4 > 1""")
def cell_changes(spark, sf):
    """Cells that a rewrite would change: blank and equal ones don't."""
    rows, k = bom_rows(spark, sf), F.col("row_no")
    old = F.concat(F.lit("old"), (k % 3).cast("string"))
    new = rows.select("row_no", F.when(k % 4 == 0, "").when(k % 4 == 1, old).otherwise(F.col("name")).alias("x"))
    found = sinks.cell_changes(rows.select("row_no", old.alias("x")), new, ["row_no"], ["x"])
    return found.select("row_no", old.alias("was"), "value")


@query("""WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0)
    SELECT '{"total":' || (SELECT count(*) FROM orders) || ',"sheets":[' || string_agg('{"o_orderpriority":"' || o_orderpriority || '","rows":' || n || '}', ',' ORDER BY o_orderpriority) || ']}' AS json FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority)""")
def sheet_manifest(spark, sf):
    return sinks.manifest(table(spark, sf, "orders"), ["o_orderpriority"])


@query("SELECT 'd' || doc_id AS name, sha1(coalesce(text, '')) AS sha1, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents")
def design_fingerprints(spark, sf):
    files = table(spark, sf, "documents").select(F.concat(F.lit("/x/d"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return ingest.design_fingerprints(files)


@query(f"""WITH {BOM}, f AS (SELECT doc AS module, part_type AS category, point AS text, min(row_no) AS ord FROM bom WHERE trim(point) <> '' GROUP BY doc, part_type, point)
    SELECT module, category, string_agg(text, ' / ' ORDER BY ord) AS texts FROM f GROUP BY module, category""")
def module_lists(spark, sf):
    """Change points of each module and category, each once, in order."""
    points = bom_rows(spark, sf).select(F.col("doc").alias("module"), F.col("part_type").alias("category"), F.col("row_no").alias("ord"), F.col("point").alias("text"))
    return evidence.module_lists(points).withColumn("texts", F.array_join("texts", " / "))


@query(f"WITH {BOM} SELECT doc AS file_id, CAST(row_no + 1 AS INTEGER) AS row_idx, raw_level AS level, nullif(new_no, '') AS number, name FROM bom WHERE row_no + 1 >= 10")
def positional_records(spark, sf):
    """A sheet without a header, read from row 10 on by the places of its columns."""
    rows = bom_rows(spark, sf)
    cell = lambda i, v: F.struct(F.lit(i).alias("col_idx"), v.alias("value"))
    cells = F.array(cell(1, F.col("raw_level")), cell(3, F.when(F.col("new_no") != "", F.col("new_no"))), cell(4, F.col("name")))
    sheet = rows.select(F.col("doc").alias("file_id"), F.lit("Master").alias("sheet"), (F.col("row_no") + 1).cast("int").alias("row_idx"), F.explode(cells).alias("c")).select("file_id", "sheet", "row_idx", "c.*")
    return layout.records_from(sheet, 10, {"level": 1, "number": 3, "name": 4}).drop("sheet")


@query(f"""WITH {BOM} SELECT row_no AS id, name AS text, '{{"level":' || level || ',"type":"' || part_type || '"}}' AS place, CASE WHEN row_no % 3 = 0 THEN '' ELSE qty END AS qty, '["' || base_no || '","' || new_no || '"]' AS numbers FROM bom""")
def document_meta(spark, sf):
    """Cells as a document's meta: nulls are blank, what is nested is JSON."""
    rows = bom_rows(spark, sf).select(F.col("row_no").alias("id"), F.col("name").alias("text"), F.struct("level", F.col("part_type").alias("type")).alias("place"), F.when(F.col("row_no") % 3 != 0, F.col("qty")).alias("qty"), F.array("base_no", "new_no").alias("numbers"))
    out = sinks.flat_meta(rows, ["place", "qty", "numbers"])
    return out.select("id", "text", *(F.element_at("meta", F.lit(c)).alias(c) for c in ("place", "qty", "numbers")))
