"""Aggregates, merges, joins, loads and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.functions.text import merge_text
from partloom.operators import feedback, ingest, match, merge, proposals
from partloom.plans.bom import BOM, bom_rows
from partloom.plans.registry import any_of, query, table


@query("SELECT 'part' AS t, count(*) AS n FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def table_counts(spark, sf):
    one = lambda t: table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n")
    return one("part").unionByName(one("orders")).unionByName(one("lineitem"))


@query("SELECT c_custkey, count(o_orderkey) AS n_rows FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def rows_per_file(spark, sf):
    files = table(spark, sf, "customer").select("c_custkey")
    return ingest.rows_per_file(files, table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("SELECT c_custkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 7 = 0) ON c_custkey = o_custkey GROUP BY c_custkey HAVING count(o_orderkey) = 0")
def files_without_rows(spark, sf):
    files, rows = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").where("o_orderkey % 7 = 0")
    return ingest.rows_per_file(files, rows.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").where("n_rows = 0").select("c_custkey")


@query("SELECT coalesce(CASE WHEN lang = 'en' THEN NULL ELSE lang END, '(미분류)') AS region, count(*) AS n, count(*) FILTER (WHERE n_chars > 1000) AS n_long FROM documents GROUP BY 1")
def rows_per_region(spark, sf):
    region = F.coalesce(F.when(F.col("lang") != "en", F.col("lang")), F.lit("(미분류)"))
    return table(spark, sf, "documents").groupBy(region.alias("region")).agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("n_long"))


@query(f"WITH {BOM} SELECT class, count(*) AS n, count(DISTINCT doc) AS n_docs, count(*) FILTER (WHERE new_no = '') AS n_blank FROM bom GROUP BY class")
def rows_per_form(spark, sf):
    return bom_rows(spark, sf).groupBy("class").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("n_docs"), F.count_if(F.col("new_no") == "").alias("n_blank"))


@query("SELECT l_partkey, mode AS l_returnflag, round(n / total, 4) AS share FROM (SELECT l_partkey, l_returnflag AS mode, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_partkey) AS total, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, min(l_orderkey * 10 + l_linenumber)) AS k FROM lineitem GROUP BY l_partkey, l_returnflag) WHERE k = 1")
def majority_vote(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return proposals.vote(rows, "l_partkey", "l_returnflag", "ord")


@query("SELECT o_orderpriority, o_custkey, n, sample FROM (SELECT o_orderpriority, o_custkey, count(*) AS n, min(o_orderkey) AS sample, row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, min(o_orderkey)) AS k FROM orders GROUP BY 1, 2) WHERE k <= 5")
def top_five(spark, sf):
    return proposals.top_values(table(spark, sf, "orders"), "o_orderpriority", "o_custkey", "o_orderkey")


@query("SELECT p_name, min(p_partkey) AS first_key, arg_min(p_brand, p_partkey) AS first_brand, arg_max(p_brand, p_partkey) AS last_brand FROM part GROUP BY p_name")
def first_and_last_wins(spark, sf):
    p = table(spark, sf, "part").select("p_name", "p_partkey", "p_brand")
    first = merge.first_wins(p, ["p_name"], "p_partkey").select("p_name", F.col("p_partkey").alias("first_key"), F.col("p_brand").alias("first_brand"))
    return first.join(merge.last_wins(p, ["p_name"], "p_partkey").select("p_name", F.col("p_brand").alias("last_brand")), "p_name")


@query("""WITH n AS (SELECT l_partkey AS p_partkey, arg_max(l_returnflag, (l_orderkey, l_linenumber)) AS p_name FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY l_partkey)
    SELECT p_partkey, p_name FROM n UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM n)""")
def keyed_upsert(spark, sf):
    """A batch that repeats its keys: the last row of each counts."""
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    new = table(spark, sf, "lineitem").where("l_partkey % 3 = 0").select(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("p_name"), F.struct("l_orderkey", "l_linenumber").alias("ord"))
    return merge.upsert(p, new, ["p_partkey"], order="ord")


@query("SELECT o_custkey, min(o_orderkey) AS first_order, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY o_custkey")
def insert_only_new(spark, sf):
    """A batch that repeats its keys: the first row of each is let in."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("first_order"), "o_orderstatus")
    known = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return merge.insert_new(known, orders, ["o_custkey"], order="o_orderkey")


@query("SELECT lang || CASE WHEN k > 1 THEN '__dup' || (k - 1) ELSE '' END AS id, doc_id FROM (SELECT lang || n_chars AS lang, doc_id, row_number() OVER (PARTITION BY lang || n_chars ORDER BY doc_id) AS k FROM documents)")
def duplicate_suffixes(spark, sf):
    d = table(spark, sf, "documents").select(F.concat("lang", F.col("n_chars").cast("string")).alias("key"), "doc_id")
    return merge.suffix_duplicates(d, "key", "doc_id").select("id", "doc_id")


_PARTS = """p AS (SELECT l_orderkey * 10 + l_linenumber AS ord, 'AEC' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS number, CASE l_returnflag WHEN 'A' THEN 'CORE' WHEN 'N' THEN 'CORE_GROUP' ELSE 'CASCADE' END AS tier,
    CASE WHEN l_linestatus = 'O' THEN '신규' ELSE '참고품번' END AS sourcing, 'r' || (l_suppkey % 5) AS rsn, 'c' || (l_suppkey % 2) AS chg, 'd' || (l_orderkey % 7) AS source_doc FROM lineitem),
    o AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY CASE tier WHEN 'CORE' THEN 3 WHEN 'CORE_GROUP' THEN 2 ELSE 1 END DESC, CASE sourcing WHEN '참고품번' THEN 3 ELSE 1 END DESC, ord) AS k FROM p)"""
_FOLD = lambda c: f"array_to_string(list_transform(list_filter(list_zip(list({c} ORDER BY k), range(1, count(*) + 1)), lambda x: list_position(list({c} ORDER BY k), x[1]) = x[2]), lambda x: x[1]), ' | ')"


def _merge_input(spark, sf):
    f, st = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("AEC"), F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("number"),
        F.when(f == "A", "CORE").when(f == "N", "CORE_GROUP").otherwise("CASCADE").alias("tier"), F.when(st == "O", "신규").otherwise("참고품번").alias("sourcing"),
        F.concat(F.lit("r"), (F.col("l_suppkey") % 5).cast("string")).alias("rsn"), F.concat(F.lit("c"), (F.col("l_suppkey") % 2).cast("string")).alias("chg"), F.concat(F.lit("d"), (F.col("l_orderkey") % 7).cast("string")).alias("source_doc"),
    )


@query(f"WITH {_PARTS} SELECT number, arg_min(tier, k) AS tier, arg_min(sourcing, k) AS sourcing, arg_min(ord, k) AS ord, {_FOLD('rsn')} AS rsn, {_FOLD('chg')} AS chg, {_FOLD('source_doc')} AS source_doc, count(*) AS merged FROM o GROUP BY number")
def merge_same_parts(spark, sf):
    return merge.merge_same_parts(_merge_input(spark, sf), key="number")


@query("""WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS ord, 'AEC' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS number, CASE l_returnflag WHEN 'A' THEN 'MODIFY' WHEN 'N' THEN 'ADD' ELSE 'CHECK' END AS action, repeat('.', 1 + l_linenumber % 4) || (1 + l_linenumber % 4) AS level FROM lineitem)
    SELECT 'PNO|' || number AS dkey, arg_min(action, (CASE action WHEN 'MODIFY' THEN 0 WHEN 'ADD' THEN 1 ELSE 2 END, length(level), ord)) AS action, arg_min(level, (length(level), level)) AS level, count(*) AS merged FROM p GROUP BY number""")
def representatives(spark, sf):
    f, n = F.col("l_returnflag"), (1 + F.col("l_linenumber") % 4).cast("int")
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("AEC"), F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("number"), F.lit("n").alias("name"), F.lit("k").alias("kind"),
        F.when(f == "A", "MODIFY").when(f == "N", "ADD").otherwise("CHECK").alias("action"), F.concat(F.repeat(F.lit("."), n), n.cast("string")).alias("level"), F.lit("r").alias("reason"), F.lit("s").alias("source"),
    )
    return merge.representatives(rows).select("dkey", "action", "level", "merged")


@query(f"""WITH {BOM}, l AS (SELECT l_orderkey, l_linenumber, CASE l_partkey % 3 WHEN 0 THEN 'AEC' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') ELSE '' END AS no, CASE l_partkey % 3 WHEN 1 THEN (SELECT any_value(p_name) FROM part WHERE p_partkey = l_partkey) ELSE '' END AS nm FROM lineitem),
    byname AS (SELECT name, arg_min(raw_level, row_no) AS raw_level FROM bom GROUP BY name)
    SELECT l_orderkey, l_linenumber, CASE WHEN b.part_no IS NOT NULL THEN 'by_number' WHEN n.name IS NOT NULL THEN 'by_name' END AS found_by, coalesce(b.raw_level, n.raw_level) AS found_raw_level FROM l LEFT JOIN bom b ON b.part_no = l.no LEFT JOIN byname n ON n.name = l.nm""")
def waterfall_lookup(spark, sf):
    base = bom_rows(spark, sf).withColumn("ord", F.col("row_no"))
    names = base.select(F.col("row_no").alias("l_partkey"), "name")
    k = F.col("l_partkey") % 3
    left = table(spark, sf, "lineitem").join(names, "l_partkey", "left").select(
        "l_orderkey", "l_linenumber", F.when(k == 0, F.concat(F.lit("AEC"), F.lpad(F.col("l_partkey").cast("string"), 8, "0"))).otherwise("").alias("no"), F.when(k == 1, F.col("name")).otherwise("").alias("nm")
    )
    steps = [("by_number", F.col("no"), base, "part_no"), ("by_name", F.col("nm"), base, "name")]
    return match.waterfall(left, steps, cells=["raw_level"]).select("l_orderkey", "l_linenumber", "found_by", "found_raw_level")


@query(f"""WITH {BOM} SELECT doc, row_no, CASE WHEN new_no = '' THEN base_no ELSE new_no END AS new_no, CASE WHEN reason = '' AND row_no % 2 = 0 AND point <> '' THEN point ELSE reason END AS reason,
    (CASE WHEN new_no = '' THEN 1 ELSE 0 END) + (CASE WHEN reason = '' AND row_no % 2 = 0 AND point <> '' THEN 1 ELSE 0 END) AS n_filled FROM bom""")
def fill_blanks(spark, sf):
    out = merge.fill_blanks(bom_rows(spark, sf), {"new_no": "base_no", "reason": "point"}, allowed=F.col("row_no") % 2 == 0, blocked=("reason",))
    return out.select("doc", "row_no", "new_no", "reason", F.size("filled").alias("n_filled"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_orderkey % 97 AS doc, l_suppkey % 5 AS l1, 'R' || (l_partkey % 400) AS rsn_key, CASE WHEN l_partkey % 41 = 0 THEN 'CORE' WHEN l_partkey % 29 = 0 THEN 'CASCADE' ELSE 'EXCLUDE' END AS tier FROM lineitem),
    a AS (SELECT *, bool_or(tier <> 'EXCLUDE') OVER (PARTITION BY rsn_key) AS pas FROM p), b AS (SELECT * REPLACE (CASE WHEN tier = 'EXCLUDE' AND pas THEN 'CASCADE' ELSE tier END AS tier) FROM a), c AS (SELECT *, bool_or(tier = 'CORE') OVER (PARTITION BY rsn_key) AS core FROM b),
    d AS (SELECT * REPLACE (CASE WHEN tier = 'CASCADE' AND core THEN 'CORE_GROUP' ELSE tier END AS tier) FROM c), e AS (SELECT *, bool_or(tier IN ('CORE', 'CORE_GROUP')) OVER (PARTITION BY doc, l1) AS near FROM d), f AS (SELECT * REPLACE (CASE WHEN tier = 'EXCLUDE' AND near THEN 'CASCADE' ELSE tier END AS tier) FROM e),
    g AS (SELECT *, bool_or(tier <> 'EXCLUDE') OVER (PARTITION BY doc, l1) AS kept, (SELECT count(*) FILTER (WHERE tier <> 'EXCLUDE') < greatest(16, floor(count(*) * 0.4)) FROM f) AS few FROM f)
    SELECT l_orderkey, l_linenumber, CASE WHEN few AND tier = 'EXCLUDE' AND kept THEN 'CASCADE' ELSE tier END AS tier FROM g""")
def tier_recovery(spark, sf):
    k = F.col("l_partkey")
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_orderkey") % 97).alias("doc"), (F.col("l_suppkey") % 5).alias("l1"), F.concat(F.lit("R"), (k % 400).cast("string")).alias("rsn_key"), F.lit("x").alias("rsn"),
        F.when(k % 41 == 0, "CORE").when(k % 29 == 0, "CASCADE").otherwise("EXCLUDE").alias("tier"),
    )
    return proposals.recover_tiers(rows).select("l_orderkey", "l_linenumber", "tier")


@query(f"""WITH {BOM}, q AS (SELECT row_no, CASE WHEN row_no % 2 = 0 THEN part_no ELSE 'ZZZ' || row_no END AS new_no, CASE WHEN row_no % 3 = 0 THEN part_no ELSE '' END AS base_no, CASE WHEN row_no % 5 = 0 THEN raw_level ELSE '' END AS lv, raw_level, part_type FROM bom)
    SELECT row_no, CASE WHEN row_no % 2 = 0 THEN new_no WHEN row_no % 3 = 0 THEN base_no ELSE new_no END AS part_no, row_no % 2 = 0 OR row_no % 3 = 0 AS in_base, CASE WHEN row_no % 2 = 0 OR row_no % 3 = 0 THEN 'CHECK' ELSE 'ADD' END AS action,
    CASE WHEN lv <> '' THEN lv WHEN row_no % 2 = 0 OR row_no % 3 = 0 THEN raw_level ELSE '' END AS level, CASE WHEN lv <> '' THEN 'DB' WHEN row_no % 2 = 0 OR row_no % 3 = 0 THEN 'BASE' ELSE '' END AS level_source FROM q""")
def map_to_base(spark, sf):
    rows = bom_rows(spark, sf)
    k = F.col("row_no")
    parts = rows.select(
        "row_no", F.when(k % 2 == 0, F.col("part_no")).otherwise(F.concat(F.lit("ZZZ"), k.cast("string"))).alias("new_no"), F.when(k % 3 == 0, F.col("part_no")).otherwise("").alias("base_no"), F.lit("ADD").alias("action"),
        F.when(k % 5 == 0, F.col("raw_level")).otherwise("").alias("level"),
    )
    base = rows.select("part_no", F.col("raw_level").alias("level"), F.col("part_type").alias("kind"), "qty", k.alias("ord"))
    return proposals.map_to_base(parts, base).select("row_no", "part_no", "in_base", "action", "level", "level_source")


@query(f"""WITH {BOM}, q AS (SELECT row_no, doc, CASE WHEN row_no % 4 = 0 THEN '' ELSE raw_level END AS level FROM bom), v AS (SELECT doc, level, row_number() OVER (PARTITION BY doc ORDER BY count(*) DESC, min(row_no)) AS k FROM q WHERE level <> '' GROUP BY doc, level)
    SELECT q.row_no, CASE WHEN q.level = '' THEN coalesce(v.level, '..2') ELSE q.level END AS level, q.level = '' AS level_estimated FROM q LEFT JOIN v ON v.doc = q.doc AND k = 1""")
def level_estimates(spark, sf):
    rows = bom_rows(spark, sf).select("row_no", F.col("doc").alias("l1"), F.when(F.col("row_no") % 4 == 0, "").otherwise(F.col("raw_level")).alias("level"), F.col("row_no").alias("ord"))
    return proposals.estimate_levels(rows).select("row_no", "level", "level_estimated")


@query(f"""WITH {BOM}, p AS (SELECT row_no AS pid, CASE WHEN row_no % 4 = 0 THEN part_no ELSE '' END AS no, CASE WHEN row_no % 4 IN (1, 2) THEN name ELSE '' END AS nm, CASE WHEN row_no % 4 IN (0, 1, 3) THEN doc ELSE '' END AS hint FROM bom),
    h AS (SELECT pid, b.row_no AS r, CASE WHEN hint <> '' AND b.doc = hint THEN 0.98 ELSE 0.95 END AS c, 'PART_NO_MATCH' AS m, 0 AS s FROM p JOIN bom b ON b.part_no = no UNION ALL SELECT pid, b.row_no, 0.85, 'PART_NAME+PATH_PREFIX_MATCH', 1 FROM p JOIN bom b ON b.name = nm AND b.doc = hint
        UNION ALL SELECT pid, b.row_no, 0.7, 'PART_NAME_MATCH', 2 FROM p JOIN bom b ON b.name = nm UNION ALL SELECT pid, b.row_no, 0.55, 'PATH_MATCH_ONLY', 3 FROM p JOIN bom b ON b.doc = hint)
    SELECT p.pid, r AS base_row, coalesce(c, 0)::DOUBLE AS confidence, coalesce(m, 'NO_MATCH') AS method FROM p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY s, c DESC, r) AS k FROM h) x ON x.pid = p.pid AND k = 1""")
def base_matching(spark, sf):
    rows = bom_rows(spark, sf)
    k = F.col("row_no") % 4
    parts = rows.select(F.col("row_no").alias("pid"), F.when(k == 0, F.col("part_no")).otherwise("").alias("part_no"), F.when(k.isin(1, 2), F.col("name")).otherwise("").alias("name"), F.when(k.isin(0, 1, 3), F.col("doc")).otherwise("").alias("hint"))
    base = rows.select(F.col("row_no").alias("row_id"), "part_no", "name", F.col("doc").alias("bom_path"))
    return proposals.match_base(parts, base).select("pid", "base_row", "confidence", "method")


@query(f"WITH {BOM} SELECT row_no AS pid, CASE WHEN row_no % 10 = 0 THEN 'ADD' WHEN row_no % 3 = 0 THEN 'MODIFY' ELSE 'KEEP' END AS op, CASE WHEN row_no % 10 <> 0 AND row_no % 3 = 0 THEN 'name' ELSE '' END AS changed FROM bom")
def base_comparison(spark, sf):
    rows = bom_rows(spark, sf)
    parts = rows.select(F.col("row_no").alias("pid"), F.when(F.col("row_no") % 10 != 0, F.col("row_no")).alias("base_row"), F.when(F.col("row_no") % 3 == 0, F.concat("name", F.lit(" v2"))).otherwise(F.col("name")).alias("name"))
    return proposals.compare(parts, rows.select(F.col("row_no").alias("row_id"), "name"), ["name"]).select("pid", "op", F.array_join("changed_fields", ",").alias("changed"))


@query(f"WITH {BOM} SELECT 'R-' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END AS proposal_id, row_no AS row_id FROM (SELECT row_no, row_number() OVER (ORDER BY row_no) AS k FROM bom WHERE row_no % 21 = 0 AND base_no <> '-' AND starts_with(doc, 'Brand#1'))")
def removal_candidates(spark, sf):
    rows = bom_rows(spark, sf)
    base = rows.select(F.col("row_no").alias("row_id"), "part_no", F.col("doc").alias("bom_path"))
    return proposals.removals(base, rows.where("row_no % 21 = 0"), ["Brand#1"])


@query("""WITH p AS (SELECT upper(n_name) AS l1, l_partkey, CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END AS t, 'c' || (l_suppkey % 3) AS change, round(l_discount, 2) AS confidence FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
    q AS (SELECT l1, count(DISTINCT l_partkey) AS n_parts, array_to_string(list_sort(list(DISTINCT change)), ' | ') AS change_summary, max(confidence) AS confidence FROM p GROUP BY l1), r AS (SELECT l1, count(*) FILTER (WHERE t >= 2) AS n_core FROM (SELECT l1, l_partkey, max(t) AS t FROM p GROUP BY 1, 2) GROUP BY l1)
    SELECT 'P-' || lpad(CAST(row_number() OVER (ORDER BY q.l1) AS VARCHAR), 3, '0') AS proposal_id, q.l1, n_parts, n_core, change_summary, confidence FROM q JOIN r ON q.l1 = r.l1""")
def proposal_merge(spark, sf):
    supplier = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = table(spark, sf, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    f = F.col("l_returnflag")
    return proposals.merge_proposals(rows.select(
        F.col("n_name").alias("l1"), F.lit("").alias("l1_no"), F.col("l_partkey").cast("string").alias("number"), F.when(f == "A", "CORE").when(f == "N", "CORE_GROUP").otherwise("CASCADE").alias("tier"),
        F.lit("..2").alias("level"), F.lit("DB").alias("level_source"), F.concat(F.lit("c"), (F.col("l_suppkey") % 3).cast("string")).alias("change"), F.round("l_discount", 2).alias("confidence"),
    ))


@query(f"WITH {BOM} SELECT doc, row_no FROM bom b WHERE row_no % 8 <> 0 AND NOT EXISTS (SELECT 1 FROM bom c WHERE c.doc = b.doc AND c.row_no % 8 = 0 AND c.name = b.name)")
def untouched_children(spark, sf):
    base = bom_rows(spark, sf).select(F.col("doc").alias("parent"), "part_no", "name", "row_no")
    return proposals.untouched_children(base, base.where("row_no % 8 = 0")).select(F.col("parent").alias("doc"), "row_no")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def feedback_current(spark, sf):
    e = table(spark, sf, "events").withColumn("ord", F.struct("ts", "event_id"))
    return feedback.current(e.select("user_id", "event_type", "event_id", "value", "ord"), ["user_id", "event_type"], "ord").drop("ord")


_ANSWERS = ["다 빼", "모두 유지", "2번만 유지", "1번 3번 빼고 나머지 유지", "2, 3 삭제", "1번은 그대로", "모르겠어", "2번을 ABC12345678 로 교체 하고 2번 빼", "맞아", "3번 XY123456789 로 변경하고 3번은 그대로", "1, 2 제외"]


@query(f"""WITH a AS (SELECT conv_id * 100 + turn AS id, trim(regexp_replace(({'[' + ', '.join(f"'{t}'" for t in _ANSWERS) + ']'})[CAST((turn + conv_id) % 11 AS INTEGER) + 1] || '  ' || role, ' +', ' ', 'g')) AS t FROM conversations),
    b AS (SELECT id, t, lower(t) AS low, CASE WHEN regexp_matches(t, '[0-9]+\\s*번') THEN regexp_extract_all(t, '([0-9]+)\\s*번', 1) ELSE regexp_extract_all(t, '([0-9]+)', 1) END AS nums, regexp_extract(t, '(?i)([0-9]+)번.*?([A-Z]{{2,3}}[0-9]{{8,12}}).*?(?:바꿔|교체|대체|변경)', 1) AS who, upper(regexp_extract(t, '(?i)([0-9]+)번.*?([A-Z]{{2,3}}[0-9]{{8,12}}).*?(?:바꿔|교체|대체|변경)', 2)) AS no FROM a),
    c AS (SELECT *, unnest([1, 2, 3]) AS num FROM b), d AS (SELECT *, list_contains(nums, CAST(num AS VARCHAR)) AS named, len(nums) > 0 AS any_no FROM c),
    e AS (SELECT *, CASE WHEN {any_of('low', feedback.DROP_ALL)} THEN '제외' WHEN {any_of('low', feedback.KEEP_ALL)} THEN '유지' WHEN any_no AND contains(low, '만 유지') THEN CASE WHEN named THEN '유지' ELSE '제외' END WHEN any_no AND {any_of('low', feedback.DROP)} THEN CASE WHEN named THEN '제외' ELSE '유지' END WHEN any_no AND {any_of('low', feedback.KEEP)} THEN CASE WHEN named THEN '유지' ELSE '제외' END END AS said FROM d),
    f AS (SELECT *, CASE WHEN who = CAST(num AS VARCHAR) THEN '교체' ELSE said END AS decision FROM e WHERE said IS NOT NULL)
    SELECT id, CAST(num AS INTEGER) AS num, decision, CASE WHEN decision = '교체' THEN no END AS replace_with FROM f""")
def feedback_answers(spark, sf):
    said = F.get(F.array(*map(F.lit, _ANSWERS)), ((F.col("turn") + F.col("conv_id")) % 11).cast("int"))
    answers = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.concat(said, F.lit("  "), "role").alias("text"), F.lit(3).alias("n"))
    return feedback.group_decisions(answers).select("id", "num", "decision", "replace_with")


@query(f"""WITH {BOM}, d AS (SELECT * FROM bom WHERE row_no % 6 = 0) SELECT part_no AS number, name, CASE WHEN row_no % 6 = 0 AND row_no % 12 <> 0 THEN '제외' WHEN row_no % 12 = 0 THEN '제외' ELSE '변경' END AS kind, CASE WHEN row_no % 6 = 0 THEN 'n | [검토] why' ELSE 'n' END AS note FROM bom
    UNION ALL SELECT 'REP00000001', name, '추가', '[검토] 대체 추가' FROM d WHERE row_no % 12 = 0""")
def feedback_applied(spark, sf):
    rows = bom_rows(spark, sf)
    table_ = rows.select(F.col("part_no").alias("number"), "name", F.lit("변경").alias("kind"), F.lit("n").alias("note"))
    decisions = rows.where("row_no % 6 = 0").select(F.col("part_no").alias("number"), F.when(F.col("row_no") % 12 == 0, "교체").otherwise("제외").alias("decision"), F.lit("why").alias("reason"), F.lit("REP00000001").alias("replace_with"))
    return feedback.apply_to_table(table_, decisions)


@query(f"""WITH {BOM}, p AS (SELECT part_no AS number, name, row_no AS ord, CASE WHEN doc LIKE '%#1%' THEN 0 WHEN name LIKE '%ring%' THEN 1 ELSE 2 END AS near FROM bom), t AS (SELECT * FROM p ORDER BY near, ord LIMIT 5)
    SELECT 'Q-' || lpad(CAST(row_number() OVER (ORDER BY near, ord) AS VARCHAR), 3, '0') AS qid, number, name FROM t""")
def question_queue(spark, sf):
    rows = bom_rows(spark, sf)
    near = feedback.nearness(F.col("doc"), F.col("name"), ["#1", "ring"])
    return feedback.question_queue(rows.select(F.col("part_no").alias("number"), "name", F.col("row_no").alias("ord"), near.alias("near")))


@query("SELECT user_id, bool_and(event_type IN ('click', 'view')) AS all_reviewed FROM events GROUP BY user_id")
def all_reviewed(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.when(F.col("event_type").isin("click", "view"), "OK").otherwise("x").alias("status"))
    return feedback.all_reviewed(e, "user_id")


@query(f"WITH {BOM} SELECT doc, count(*) AS rows_total, count(*) FILTER (WHERE row_no % 3 = 0) AS rows_inserted, count(*) FILTER (WHERE row_no % 3 <> 0) AS rows_skipped, CASE WHEN count(*) FILTER (WHERE row_no % 3 = 0) > 0 THEN 'completed' ELSE 'skipped' END AS status FROM bom GROUP BY doc")
def load_log(spark, sf):
    rows = bom_rows(spark, sf)
    return ingest.load_log(rows, rows.where("row_no % 3 = 0"), ["doc"])


@query(f"""WITH {BOM} SELECT doc, row_no, '지역: 호주 | 모델: ' || CASE WHEN row_no % 2 = 0 THEN 'OLD → ' ELSE '' END || 'WSED7613B' || ' | 부품번호: ' || base_no || ' → ' || new_no || ' | 부품명: ' || name || CASE WHEN point <> '' THEN ' | 변경점: ' || point ELSE '' END || CASE WHEN reason <> '' THEN ' | 변경사유: ' || reason ELSE '' END || ' | 구분: ' || class AS embedding_text
    FROM bom WHERE new_no <> ''""")
def embedding_texts(spark, sf):
    rows = bom_rows(spark, sf).where("new_no != ''").withColumns({"region": F.lit("호주"), "base_model": F.when(F.col("row_no") % 2 == 0, "OLD"), "new_model": F.lit("WSED7613B"), "event": F.lit("")})
    return ingest.stored_rows(rows).select("doc", "row_no", "embedding_text")


@query(f"WITH {BOM} SELECT doc, row_no FROM bom WHERE CASE WHEN row_no % 2 = 0 THEN base_no <> '-' OR new_no LIKE 'NEW%' OR new_no LIKE 'AEC%' ELSE point <> '' OR reason <> '' END")
def data_row_gate(spark, sf):
    return ingest.data_rows(bom_rows(spark, sf), needs_number=F.col("row_no") % 2 == 0).select("doc", "row_no")


@query("SELECT doc_id FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50")
def keyset_page(spark, sf):
    return ingest.page_after(table(spark, sf, "documents").select("doc_id"), "doc_id", 100, 50)


@query("SELECT doc_id FROM documents WHERE n_chars > 0 AND doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)")
def pending_embeddings(spark, sf):
    have = table(spark, sf, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("embedding_text"))
    return ingest.pending(docs.join(have, "doc_id", "left")).select("doc_id")


@query("SELECT user_id, event_id, last_value(CASE WHEN event_id % 4 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS event_type FROM events")
def fill_down(spark, sf):
    from partloom.operators.layout import fill_down as down

    e = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise(" ").alias("event_type"))
    return down(e, "event_type", ["user_id"], "event_id")


@query("SELECT p_brand, CAST(count(DISTINCT upper(p_name)) AS BIGINT) AS n_names, arg_min(p_name, p_partkey) AS first_name FROM part GROUP BY p_brand")
def module_summary(spark, sf):
    """The different names of each category and the first of them."""
    names = table(spark, sf, "part").groupBy("p_brand", merge_text(F.col("p_name")).alias("m")).agg(F.min(F.struct("p_partkey", "p_name")).alias("x"))
    return names.groupBy("p_brand").agg(F.count("*").alias("n_names"), F.min("x")["p_name"].alias("first_name"))
