"""Queries over evidence, slides and second proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.operators import evidence, layout, merge, proposals
from partloom.plans.bom import BOM, bom_rows
from partloom.plans.registry import query, table
from partloom.plans.reports import _merge_input
from partloom.plans.review import looked_at
from partloom.plans.sheets import _cells


@query(f"""WITH RECURSIVE {BOM}, o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY row_no) AS rn FROM bom WHERE row_no % 9 <> 0),
    w AS (SELECT doc, rn, row_no, [substr(name, 1, 6)] AS p FROM o WHERE rn = 1 UNION ALL SELECT o.doc, o.rn, o.row_no, list_append(w.p[1:least(o.level - 1, len(w.p))], substr(o.name, 1, 6)) FROM w JOIN o ON o.doc = w.doc AND o.rn = w.rn + 1)
    SELECT 'M_D_' || o.doc || '_' || o.row_no AS id, o.doc, o.row_no, p[1] AS level1, '' AS feature, 'OBJECT: ' || p[1] || chr(10) || 'FEATURE: ' || chr(10) || 'BOM_PATH: ' || array_to_string(p, ' > ') || chr(10) || 'PART_NAME: ' || name || chr(10) || 'PART_NO: ' || part_no || chr(10) || 'TYPE: ' || part_type || chr(10) || 'MODEL: M' || chr(10) || 'GRADE: D' AS text FROM o JOIN w ON w.doc = o.doc AND w.row_no = o.row_no""")
def structured_documents(spark, sf):
    rows = bom_rows(spark, sf)
    odd = F.col("row_no") % 18 == 0
    marked = rows.withColumn("raw_level", F.when(odd, "0").otherwise(F.col("raw_level"))).withColumn("name", F.when((F.col("row_no") % 9 == 0) & ~odd, " ").otherwise(F.col("name")))
    return evidence.structured_documents(marked, "M", "D", width=6)


@query(f"""WITH {BOM} SELECT 'j' || row_no AS id, 'changed ' || part_type AS summary, doc AS level1, doc || ' > ' || name AS bom_path, name AS part_name, part_no FROM bom WHERE row_no % 5 <> 0 UNION ALL SELECT 'j' || row_no, 'changed ' || part_type, doc, doc || ' > ' || name, 'second', '' FROM bom WHERE row_no % 10 = 1""")
def stored_evidence(spark, sf):
    rows = bom_rows(spark, sf)
    main = F.array(F.struct(F.col("name").alias("part_name"), "part_no"), F.struct(F.lit("second").alias("part_name"), F.lit("").alias("part_no")))
    main = F.when(F.col("row_no") % 10 == 1, main).otherwise(F.slice(main, 1, 1))
    whole = F.to_json(F.struct(
        F.struct(F.concat(F.lit("changed "), "part_type").alias("summary_raw")).alias("change"), F.struct(F.col("doc").alias("level1"), F.concat("doc", F.lit(" > "), "name").alias("base_bom_path")).alias("bom"), F.struct(main.alias("main")).alias("parts")
    ))
    docs = rows.select(F.concat(F.lit("j"), F.col("row_no").cast("string")).alias("id"), F.when(F.col("row_no") % 5 == 0, "no json {").otherwise(whole).alias("rag_json"))
    return evidence.stored_evidence(docs)


@query(f"WITH {BOM} SELECT row_no, row_no % 3 <> 2 AS supported, 'what' || CASE WHEN row_no % 2 = 0 THEN chr(10) || 'MODEL=' || doc ELSE '' END AS asked FROM bom")
def supported_parts(spark, sf):
    k = F.col("row_no")
    main = F.when(k % 3 == 0, F.array(F.lit("none"), F.concat(F.lit("new "), F.upper("name")))).when(k % 3 == 1, F.array(F.substring("name", 1, 3))).otherwise(F.array(F.lit("#"), F.lit("")))
    asked = evidence.with_tokens(F.lit("what"), {"model": F.when(k % 2 == 0, F.col("doc")), "grade": F.lit("")})
    return bom_rows(spark, sf).select("row_no", evidence.supports(F.col("name"), main).alias("supported"), asked.alias("asked"))


@query(f"""WITH {BOM} SELECT 'number' AS kind, part_no AS key, row_no AS row_id FROM bom UNION ALL SELECT 'name', upper(name), min(row_no) FROM bom GROUP BY 2 UNION ALL SELECT 'path', doc, min(row_no) FROM bom GROUP BY 2""")
def snapshot_index(spark, sf):
    base = bom_rows(spark, sf).select(F.col("row_no").alias("row_id"), "part_no", "name", F.col("doc").alias("bom_path"))
    return evidence.snapshot_index(base)


@query(f"""WITH {BOM}, f AS (SELECT * FROM bom WHERE row_no % 2 = 0), s AS (SELECT * FROM bom WHERE row_no % 2 = 1), p AS (SELECT row_no, CASE WHEN row_no % 4 = 0 THEN part_no ELSE '' END AS no, CASE row_no % 4 WHEN 1 THEN 'AEC' || lpad(CAST(row_no + 1 AS VARCHAR), 8, '0') WHEN 2 THEN 'AEC' || lpad(CAST(row_no + 1 AS VARCHAR), 8, '0') ELSE '' END AS ref, name FROM bom)
    SELECT p.row_no, CASE WHEN f.part_no IS NOT NULL THEN 'number' WHEN r.part_no IS NOT NULL THEN 'remark' WHEN s2.part_no IS NOT NULL THEN 'secondary' WHEN n.part_no IS NOT NULL THEN 'name' WHEN m.part_no IS NOT NULL THEN 'secondary_name' END AS found_by, coalesce(f.part_no, r.part_no, s2.part_no, n.part_no, m.part_no) AS found_part_no
    FROM p LEFT JOIN f ON f.part_no = p.no LEFT JOIN f r ON r.part_no = p.ref LEFT JOIN s s2 ON s2.part_no = p.ref LEFT JOIN (SELECT upper(name) AS k, arg_min(part_no, row_no) AS part_no FROM f GROUP BY 1) n ON n.k = upper(p.name) LEFT JOIN (SELECT upper(name) AS k, arg_min(part_no, row_no) AS part_no FROM s GROUP BY 1) m ON m.k = upper(p.name)""")
def base_resolution(spark, sf):
    rows = bom_rows(spark, sf)
    k = F.col("row_no")
    ref = F.concat(F.lit("참고: AEC"), F.lpad((k + 1).cast("string"), 8, "0"))
    parts = rows.select("row_no", F.when(k % 4 == 0, F.col("part_no")).otherwise("").alias("number"), F.when(k % 4 == 1, ref).otherwise("see ref").alias("remark"), F.when(k % 4 == 2, ref).otherwise("").alias("more"), "name")
    lists = rows.select("row_no", "part_no", "name", k.alias("ord"))
    found = evidence.resolve_base(parts, lists.where("row_no % 2 = 0").drop("row_no"), lists.where("row_no % 2 = 1").drop("row_no"), ["remark", "more"])
    return found.select("row_no", "found_by", "found_part_no")


@query(f"""WITH {BOM}, p AS (SELECT row_no AS pid, doc AS l1, part_no, name, raw_level AS level, (['CORE', 'CASCADE', ''])[CAST(row_no % 3 AS INTEGER) + 1] AS tier, (['ADD', 'MODIFY'])[CAST(row_no % 2 AS INTEGER) + 1] AS action, 'd' || (row_no % 4) AS source_doc, list_distinct(string_split(lower(name), ' ')) AS w FROM bom),
    s AS (SELECT a.pid AS query, p.pid, CAST(len(list_intersect(p.w, a.w)) * 10 + (p.level = a.level)::INT * 5 + (p.tier = a.tier)::INT * 3 + (p.action = a.action)::INT * 2 AS INTEGER) AS score FROM p JOIN p a ON p.l1 = a.l1 WHERE a.pid % 20 = 0 AND p.part_no <> a.part_no AND p.source_doc <> a.source_doc),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, pid) AS k FROM s WHERE score > 0), n AS (SELECT *, row_number() OVER (ORDER BY query, k) AS n FROM r WHERE k <= 8)
    SELECT 'RR-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS proposal_id, query, pid, score FROM n""")
def second_proposals(spark, sf):
    return evidence.second_proposals(proposals.best_rechecks(*looked_at(spark, sf), 8))


@query("SELECT count(*) AS before, count(DISTINCT l_partkey) AS after, count(*) - count(DISTINCT l_partkey) AS gone FROM lineitem")
def merge_counts(spark, sf):
    return evidence.merge_stats(merge.merge_same_parts(_merge_input(spark, sf), key="number"))


@query("""WITH s AS (SELECT n_nationkey AS ord, 'm' || n_nationkey AS module, lower(n_name) || ' ' || (CASE n_nationkey % 3 WHEN 0 THEN 'ring' WHEN 1 THEN 'red bolt' ELSE 'widget' END) AS x FROM nation), sw AS (SELECT ord, module, unnest(list_distinct(string_split(x, ' '))) AS w FROM s), pw AS (SELECT p_partkey, unnest(list_distinct(string_split(lower(p_name), ' '))) AS w FROM part),
    c AS (SELECT p_partkey AS pid, ord, module, 2 * count(*) AS score FROM pw JOIN sw ON pw.w = sw.w WHERE length(pw.w) >= 3 GROUP BY 1, 2, 3) SELECT pid, module FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, ord) AS k FROM c) WHERE k = 1""")
def modules_by_summary(spark, sf):
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    extra = F.when(k % 3 == 0, "ring").when(k % 3 == 1, "red bolt").otherwise("widget")
    summaries = n.select(k.alias("ord"), F.concat(F.lit("m"), k.cast("string")).alias("module"), F.concat(F.lower("n_name"), F.lit(" "), extra).alias("text"))
    return evidence.module_by_summary(table(spark, sf, "part").select(F.col("p_partkey").alias("pid"), F.col("p_name").alias("text")), summaries)


@query("""SELECT 's' || c_custkey AS file, 'P' || c_custkey AS project, 'B' || c_custkey AS base_model, CASE WHEN c_custkey % 2 = 0 THEN 'N1' END AS new_model, 'D' AS grade, CASE WHEN c_custkey % 3 = 0 THEN 'Built-in Oven' WHEN c_custkey % 3 = 1 THEN 'Range' END AS product_type FROM customer""")
def slide_metadata(spark, sf):
    k = F.col("c_custkey")
    line = lambda i, t: F.struct(F.lit(i).alias("ord"), t.alias("text"))
    told = F.when(k % 3 == 0, "제품군 | Built-in Oven | x").when(k % 3 == 1, "제품군: Range").otherwise("제품군 : 동일 사업부 기준")
    lines = F.array(
        line(1, F.concat(F.lit(" PJT명 :  P"), k.cast("string"), F.lit(" | other"))), line(2, F.concat(F.lit("no | Base Model | B"), k.cast("string"))), line(3, F.when(k % 2 == 0, F.lit("개발 모델: N1"))),
        line(4, F.lit("개발 등급：D")), line(5, told), line(6, F.when(k % 3 == 0, "제품군: Some longer name of one")), line(7, F.lit("PJT명: later")),
    )
    rows = table(spark, sf, "customer").select(F.concat(F.lit("s"), k.cast("string")).alias("file"), F.explode(lines).alias("x")).select("file", "x.*")
    return evidence.slide_metadata(rows)


@query(f"WITH {BOM} SELECT doc AS file_id, CAST(row_no + 100 AS INTEGER) AS row_idx, raw_level AS bom_level_raw, name AS part_name FROM bom")
def fixed_header_records(spark, sf):
    """A first sheet whose header's row is known; rows with a level."""
    cells = layout.first_sheet(_cells(spark, sf).withColumn("sheet_idx", F.lit(0)))
    headers = layout.header_at(cells, 5)
    columns = layout.column_map(layout.labelled_cells(cells, layout.alias_table(spark)), headers)
    return layout.records(cells, headers, columns, ["bom_level_raw", "part_name"]).where("bom_level_raw IS NOT NULL").drop("sheet")
