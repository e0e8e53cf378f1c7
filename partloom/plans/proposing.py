"""Queries over the proposal engine, rule catalogues and reports of the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.operators import classify, engine, fulltext, graph, hierarchy, match
from partloom.plans.bom import BOM, CLIMB, KINDS, STACK, bom_rows
from partloom.plans.registry import query, table

_CORE, _TARGET = ["카메라", "camera"], ["도어", "door"]
_KEY = "CASE reason WHEN '제품 치수 변경에 따른 구조 변경' THEN '구조' WHEN '카메라 모듈 개발' THEN '모듈_카메라' ELSE upper(reason) END"

#: The lines of two sheets for each brand, every fourth without a level, and what becomes of them.
_ENGINE = f"""{BOM}, l AS (SELECT row_no AS ord, 'd' || (row_no % 5) AS doc, doc AS l1, CASE WHEN base_no = '-' THEN '' ELSE base_no END AS b, CASE WHEN new_no IN ('←', 'X', '-') THEN '' ELSE new_no END AS n, name, point, reason, CASE WHEN row_no % 4 = 0 THEN '' ELSE raw_level END AS lv, {_KEY} AS rk, raw_level, qty, part_type, row_no % 2 = 0 AS held FROM bom
    UNION ALL SELECT row_no + 1000000000, 'e' || (row_no % 5), doc, CASE WHEN base_no = '-' THEN '' ELSE base_no END, CASE WHEN new_no IN ('←', 'X', '-') THEN '' ELSE new_no END, name, point, reason, CASE WHEN row_no % 4 = 0 THEN '' ELSE raw_level END, {_KEY}, raw_level, qty, part_type, row_no % 2 = 0 FROM bom WHERE row_no % 3 = 0),
    t0 AS (SELECT *, CASE WHEN (reason = '' AND point IN ('', '-')) OR (reason = '-' AND point NOT LIKE '%카메라%') THEN 'EXCLUDE' WHEN reason LIKE '%카메라%' OR point LIKE '%카메라%' THEN 'CORE' WHEN reason LIKE '%도어%' THEN 'CASCADE' ELSE 'EXCLUDE' END AS tier FROM l),
    act AS (SELECT *, CASE WHEN b = '' AND n <> '' THEN 'ADD' WHEN b <> '' AND n <> '' AND (b <> n OR tier <> 'EXCLUDE') THEN 'MODIFY' WHEN b <> '' AND n = '' THEN 'DELETE' ELSE 'KEEP' END AS action FROM t0),
    a AS (SELECT *, bool_or(tier IN ('CORE', 'CASCADE')) OVER (PARTITION BY rk) AS pas FROM act), b1 AS (SELECT * REPLACE (CASE WHEN tier = 'EXCLUDE' AND rk <> '' AND pas THEN 'CASCADE' ELSE tier END AS tier) FROM a), c AS (SELECT *, bool_or(tier = 'CORE') OVER (PARTITION BY rk) AS core FROM b1),
    d AS (SELECT * REPLACE (CASE WHEN tier = 'CASCADE' AND rk <> '' AND core THEN 'CORE_GROUP' ELSE tier END AS tier) FROM c), e AS (SELECT *, bool_or(tier IN ('CORE', 'CORE_GROUP')) OVER (PARTITION BY doc, l1) AS near FROM d), f AS (SELECT * REPLACE (CASE WHEN tier = 'EXCLUDE' AND near AND reason <> '' THEN 'CASCADE' ELSE tier END AS tier) FROM e),
    g AS (SELECT *, bool_or(tier <> 'EXCLUDE') OVER (PARTITION BY doc, l1) AS kept, (SELECT count(*) FILTER (WHERE tier <> 'EXCLUDE') < greatest(16, floor(count(*) * 0.4)) FROM f) AS few FROM f),
    h AS (SELECT * REPLACE (CASE WHEN few AND tier = 'EXCLUDE' AND kept AND reason <> '' THEN 'CASCADE' ELSE tier END AS tier) FROM g), i AS (SELECT *, CASE WHEN n <> '' THEN n ELSE b END AS no FROM h WHERE tier <> 'EXCLUDE' AND action <> 'KEEP'),
    j AS (SELECT *, CASE WHEN no <> '' THEN 'PNO|' || upper(l1) || '|' || regexp_replace(no, '[^A-Z0-9]', '', 'g') ELSE 'NAME|' || upper(l1) || '|' || upper(name) END AS identity FROM i),
    k AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY CASE tier WHEN 'CORE' THEN 3 WHEN 'CORE_GROUP' THEN 2 ELSE 1 END DESC, ord) AS k, count(*) OVER (PARTITION BY identity) AS merged FROM j),
    m AS (SELECT * FROM k WHERE k = 1), p AS (SELECT *, held AND (b <> '' OR n LIKE 'AEC%') AS in_base, held AND n LIKE 'AEC%' AS bn FROM m),
    q AS (SELECT *, CASE WHEN bn THEN n WHEN in_base THEN b ELSE no END AS part_no, CASE WHEN lv <> '' THEN lv WHEN in_base THEN raw_level ELSE '' END AS lv2, CASE WHEN lv <> '' THEN 'DB' WHEN in_base THEN 'BASE' ELSE '' END AS src, CASE WHEN in_base AND action = 'ADD' THEN 'CHECK' ELSE action END AS act2 FROM p),
    v AS (SELECT l1, lv2, row_number() OVER (PARTITION BY l1 ORDER BY count(*) DESC, min(ord)) AS k FROM q WHERE lv2 NOT IN ('', '0') GROUP BY l1, lv2),
    parts AS (SELECT q.*, CASE WHEN q.lv2 = '' THEN coalesce(v.lv2, '..2') ELSE q.lv2 END AS level, CASE WHEN q.lv2 = '' THEN 'ESTIMATED' ELSE src END AS level_source, CASE WHEN act2 = 'DELETE' THEN '' WHEN NOT in_base THEN '참고품번' ELSE '' END AS sourcing FROM q LEFT JOIN v ON v.l1 = q.l1 AND v.k = 1)"""


def _engine(spark, sf):
    rows = bom_rows(spark, sf)
    k = F.col("row_no")
    cells = [F.col("doc").alias("l1"), "base_no", "new_no", "name", F.col("point").alias("chg"), F.col("reason").alias("rsn"), F.when(k % 4 == 0, "").otherwise(F.col("raw_level")).alias("level"), "qty"]
    sheet = lambda name: F.concat(F.lit(name), (k % 5).cast("string")).alias("doc")
    lines = rows.select(k.alias("ord"), sheet("d"), *cells).unionByName(rows.where("row_no % 3 = 0").select((k + 1_000_000_000).alias("ord"), sheet("e"), *cells))
    base = rows.where("row_no % 2 = 0").select("part_no", F.col("raw_level").alias("level"), F.col("part_type").alias("kind"), "qty", k.alias("ord"))
    return engine.propose(lines, base, core=_CORE, target=_TARGET)


@query(f"WITH {_ENGINE} SELECT identity, l1, part_no, name, act2 AS action, tier, level, level_source, sourcing, in_base, merged FROM parts")
def proposed_parts(spark, sf):
    return _engine(spark, sf)[0].drop("rsn", "chg", "source_doc", "ord")


@query(f"""WITH {_ENGINE}, z AS (SELECT upper(l1) AS l1, count(DISTINCT regexp_replace(part_no, '[^A-Z0-9]', '', 'g')) AS n_parts, count(DISTINCT CASE WHEN tier IN ('CORE', 'CORE_GROUP') THEN regexp_replace(part_no, '[^A-Z0-9]', '', 'g') END) AS n_core, array_to_string(list_sort(list(DISTINCT act2)), ' | ') AS change_summary, max(CASE WHEN in_base THEN 0.9 ELSE 0.6 END)::DOUBLE AS confidence FROM parts GROUP BY 1)
    SELECT 'P-' || lpad(CAST(row_number() OVER (ORDER BY l1) AS VARCHAR), 3, '0') AS proposal_id, * FROM z""")
def proposals(spark, sf):
    return _engine(spark, sf)[1]


def _whole(spark, sf):
    """The run against a base list with an assembly for most brands, and regions told by a part's number."""
    rows = bom_rows(spark, sf)
    k = F.col("row_no")
    top = F.concat(F.lit("TOP"), "doc")
    heads = rows.where("doc NOT LIKE '%3'").groupBy("doc").agg(F.min("row_no").alias("row_no")).select(top.alias("part_no"), F.concat(F.upper("doc"), F.lit(" ASSY")).alias("name"), F.lit(".1").alias("level"), F.lit("").alias("parent"), (k - 1_000_000_000).alias("ord"))
    base = heads.unionByName(rows.where("row_no % 2 = 0").select("part_no", "name", F.lit("..2").alias("level"), top.alias("parent"), k.alias("ord")))
    digit = F.substring("part_no", -1, 1)
    hint = F.when(digit == "1", "유럽 EU").when(digit == "2", "미국 북미").otherwise("")
    return engine.whole_proposals(_engine(spark, sf)[0], base, region="미국", hint=hint)


_WHOLE = f"""{_ENGINE}, kept AS (SELECT * FROM parts WHERE right(part_no, 1) <> '1'), grp AS (SELECT l1, min(ord) AS first, count(*) AS n_changed FROM kept WHERE tier IN ('CORE', 'CORE_GROUP') GROUP BY l1),
    head AS (SELECT 'TOP' || doc AS no, upper(doc) || ' ASSY' AS name, min(row_no) AS ord FROM bom WHERE doc NOT LIKE '%3' GROUP BY doc),
    hit AS (SELECT l1, arg_min(no, ord) AS no, arg_min(name, ord) AS name FROM grp JOIN head ON contains(name, upper(l1)) OR contains(upper(l1), name) GROUP BY l1),
    top AS (SELECT grp.*, no IS NOT NULL AS in_base, coalesce(no, '') AS top_no, coalesce(name, l1) AS top_name, 'P-' || lpad(CAST(row_number() OVER (ORDER BY first) AS VARCHAR), 3, '0') AS proposal_id FROM grp LEFT JOIN hit USING (l1)),
    own AS (SELECT kept.*, proposal_id, top_no FROM kept JOIN top USING (l1)), held AS (SELECT 'TOP' || doc AS top_no, part_no, name, row_no FROM bom WHERE row_no % 2 = 0)"""


@query(f"""WITH {_WHOLE}
    SELECT proposal_id, CASE WHEN tier IN ('CORE', 'CORE_GROUP') THEN 'changed' ELSE 'indirect' END AS list, part_no, name, act2 AS action, tier, level,
        coalesce((SELECT min(row_no) FROM held WHERE held.top_no = own.top_no AND held.part_no = own.part_no), (SELECT min(row_no) FROM held WHERE held.top_no = own.top_no AND upper(held.name) = upper(own.name)), 999999) AS position FROM own
    UNION ALL SELECT proposal_id, 'existing', h.part_no, h.name, 'KEEP', '', '..2', row_no FROM held h JOIN top ON top.in_base AND top.top_no = h.top_no
    WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.l1 = top.l1 AND (own.part_no = h.part_no OR upper(own.name) = upper(h.name)))""")
def whole_run_parts(spark, sf):
    """Changed, indirect and existing parts of every proposed assembly, in the base list's order."""
    return _whole(spark, sf)[0]


@query(f"""WITH {_WHOLE}, s AS (SELECT proposal_id, array_to_string(list_sort(list(DISTINCT j.doc)), ',') AS source_docs FROM own JOIN j USING (identity) GROUP BY proposal_id)
    SELECT proposal_id, l1, top_no, top_name, in_base, FALSE AS skip, n_changed, round_even(n_changed::DOUBLE / (SELECT count(*) FROM kept WHERE tier IN ('CORE', 'CORE_GROUP')), 2) AS confidence, source_docs FROM top JOIN s USING (proposal_id)""")
def whole_run_proposals(spark, sf):
    return _whole(spark, sf)[1].withColumn("source_docs", F.array_join("source_docs", ","))


@query("""WITH r AS (SELECT n_nationkey AS position, [lower(substr(n_name, 1, 2)), lower(substr(n_name, 3, 2))] AS words, n_name AS change_point, 'R' || n_regionkey AS reason FROM nation)
    SELECT p_partkey, p_name, arg_min(change_point, position) AS change_point, arg_min(reason, position) AS reason FROM part LEFT JOIN r ON contains(p_name, words[1]) OR contains(p_name, words[2]) GROUP BY p_partkey, p_name""")
def rule_catalogue(spark, sf):
    """The first rule of a table of rules whose words a name holds."""
    n = table(spark, sf, "nation")
    word = lambda at: F.lower(F.substring("n_name", at, 2))
    rules = n.select(F.col("n_nationkey").alias("position"), F.array(word(1), word(3)).alias("words"), F.col("n_name").alias("change_point"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("reason"))
    return match.catalogue_rules(table(spark, sf, "part").select("p_partkey", "p_name"), rules, "p_name", ["change_point", "reason"])


_POINTS = lambda m: " + ".join(f"2 * contains(x, '{w}')::INT" for w in m[1]) + " + CASE WHEN " + " OR ".join(f"contains(x, '{w}')" for w in m[2]) + " THEN 2 ELSE 0 END"
_MODULES = classify.MODULE_WORDS
_SAID = ["Door camera harness", "conv fan motor blade", "LCD panel", "screw", "Door fan", "os"]


@query(f"""WITH t AS (SELECT p_partkey, upper(({'[' + ', '.join(f"'{w}'" for w in _SAID) + ']'})[CAST(p_partkey % 6 AS INTEGER) + 1] || ' ' || p_name) AS x FROM part), s AS (SELECT p_partkey, {_POINTS(_MODULES[0])} AS a, {_POINTS(_MODULES[1])} AS b, {_POINTS(_MODULES[2])} AS c FROM t)
    SELECT p_partkey, CASE WHEN greatest(a, b, c) < 3 THEN '' WHEN a = greatest(a, b, c) THEN '{_MODULES[0][0]}' WHEN b = greatest(a, b, c) THEN '{_MODULES[1][0]}' ELSE '{_MODULES[2][0]}' END AS module FROM s""")
def modules_by_words(spark, sf):
    said = F.get(F.array(*map(F.lit, _SAID)), (F.col("p_partkey") % 6).cast("int"))
    return table(spark, sf, "part").select("p_partkey", classify.module_by_words(F.concat(said, F.lit(" "), "p_name")).alias("module"))


@query(f"""WITH RECURSIVE {BOM}, {STACK}, {CLIMB}, {KINDS} SELECT change_id, CAST(distance AS INTEGER) AS distance, climb.doc || ':line:' || ancestor AS impacted_line_id, b.name FROM changes c JOIN climb ON c.doc = climb.doc AND c.row_no = climb.row_no JOIN bom b ON b.doc = climb.doc AND b.row_no = ancestor WHERE c.row_no % 20 = 1""")
def impact_paths(spark, sf):
    tables = graph.build(bom_rows(spark, sf))
    return graph.impact_path(tables["impact_edges"], tables["bom_lines"], tables["change_records"].where("row_no % 20 = 1"))


@query(f"""WITH {BOM} SELECT doc || ':line:' || row_no AS line_id, '{{"name":"' || name || '","part_type":"' || part_type || '"}}' AS raw_json FROM bom WHERE row_no % 20 = 0""")
def raw_line_lookup(spark, sf):
    line = graph.lines(bom_rows(spark, sf))
    return graph.raw_rows(line, line.where("row_no % 20 = 0"), ["name", "part_type"])


@query(f"""WITH {BOM}, {KINDS}, t AS (SELECT change_id AS id, row_no, kind, doc, list_filter(regexp_split_to_array(lower(concat_ws(' ', name, point, reason)), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS words FROM changes),
    z AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM t), p AS (SELECT id, term, len(any_value(words)) AS length, count(*) AS tf FROM (SELECT id, words, unnest(words) AS term FROM t) GROUP BY id, term), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    g AS (SELECT id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS weight FROM p JOIN f USING (term), z),
    w AS (SELECT row_no AS query, kind, doc, unnest(list_distinct(regexp_split_to_array(lower(concat_ws(' ', name, point, reason)), '[^\\p{{L}}\\p{{N}}]+'))) AS term FROM lines WHERE row_no % 20 = 0), m AS (SELECT query, any_value(kind) AS kind, any_value(doc) AS doc, id, round(sum(weight), 6) AS score FROM w JOIN g USING (term) GROUP BY query, id),
    k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS k FROM m), s AS (SELECT query, k.id AS change_id, round(score + CASE WHEN t.kind = k.kind THEN 0.2 ELSE 0 END + CASE WHEN t.doc = k.doc THEN 0.1 ELSE 0 END, 6) AS score FROM k JOIN t ON t.id = k.id WHERE k <= 50)
    SELECT query, change_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, change_id) AS k FROM s) WHERE k <= 5""")
def similar_changes(spark, sf):
    """What the full-text index finds for each request's words, raised where kind and document agree."""
    tables = graph.build(bom_rows(spark, sf))
    changes = tables["change_records"].join(tables["bom_lines"].select("line_id", "name", "point", "reason"), "line_id")
    index = fulltext.build_index(fulltext.nodes_of({"ChangeRecord": (changes, "change_id", ["name", "point", "reason"])}))
    wanted = tables["bom_lines"].where("row_no % 20 = 0").select(F.col("row_no").alias("query"), "kind", "doc", F.concat_ws(" ", "name", "point", "reason").alias("text"))
    found = fulltext.search(index, wanted, 50).select("query", F.col("id").alias("change_id"), "score")
    return graph.similar_changes(found, changes, wanted)


@query(f"""WITH RECURSIVE {BOM}, {STACK}, {CLIMB}, {KINDS}, x AS (SELECT doc, row_no, count(*) AS n FROM changes GROUP BY doc, row_no) SELECT c.doc, c.ancestor AS row_no, count(*) AS n_lines, CAST(coalesce(sum(x.n), 0) AS BIGINT) AS n_changes FROM climb c LEFT JOIN x ON x.doc = c.doc AND x.row_no = c.row_no WHERE c.ancestor % 20 = 0 AND distance <= 3 GROUP BY 1, 2""")
def subtree_impact(spark, sf):
    """Changes at and below each root, down to a depth."""
    tables = graph.build(bom_rows(spark, sf))
    line = tables["bom_lines"]
    roots = line.where("row_no % 20 = 0").select("doc", "row_no")
    return graph.subtree_impact(hierarchy.closure(line), tables["change_records"].select("doc", "row_no"), roots, depth=3)


@query(f"""WITH RECURSIVE {BOM}, {STACK}, {CLIMB}, {KINDS} SELECT 'CAMERA' AS feature, climb.doc, b.name, count(DISTINCT change_id) AS n_changes FROM changes c JOIN climb ON c.doc = climb.doc AND c.row_no = climb.row_no JOIN bom b ON b.doc = climb.doc AND b.row_no = ancestor WHERE distance > 0 AND c.point LIKE '%카메라%' GROUP BY climb.doc, b.name""")
def feature_paths(spark, sf):
    tables = graph.build(bom_rows(spark, sf))
    point = bom_rows(spark, sf).select("doc", "row_no", "point")
    changes = tables["change_records"].join(point, ["doc", "row_no"])
    return graph.feature_paths(changes, tables["impact_edges"], tables["bom_lines"], classify.feature(F.col("point")))


@query(f"""WITH RECURSIVE {BOM}, {STACK}, {KINDS}, n AS (SELECT count(*) AS lines, count(*) FILTER (WHERE kind IN ('Change', 'New', 'Delete')) AS changes FROM kinds), d AS (SELECT count(DISTINCT doc) AS docs FROM bom)
    SELECT 'bom_lines' AS label, lines AS n FROM n UNION ALL SELECT 'change_records', changes FROM n UNION ALL SELECT 'contains_line', 2 * lines FROM n UNION ALL SELECT 'source_documents', docs FROM d UNION ALL SELECT 'review_cases', docs FROM d UNION ALL SELECT 'document_case_edges', docs FROM d
    UNION ALL SELECT 'source_columns', 3 * docs FROM d UNION ALL SELECT 'canonical_fields', 11""")
def whole_graph(spark, sf):
    """All fifteen tables from one call; the counts of those that no other query has."""
    rows = bom_rows(spark, sf)
    docs = rows.select("doc").distinct()
    sheets = docs.select("doc", F.col("doc").alias("file"), F.lit("Master").alias("sheet"), F.lit("B").alias("base_model"), F.lit("N").alias("new_model"), F.lit("PP").alias("event"))
    field = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(f).alias("f")) for i, f in enumerate(["row_no", "part_name", "other"]))))
    headers = docs.select(F.col("doc").alias("document_id"), field.alias("x")).select("document_id", F.col("x.i").alias("column_index"), F.col("x.f").alias("raw_column_name"), F.col("x.f").alias("field"))
    tables = graph.build_all(rows, sheets, headers, spark)
    assert len(tables) >= 15
    return graph.counts({k: tables[k] for k in ("bom_lines", "change_records", "contains_line", "source_documents", "review_cases", "document_case_edges", "source_columns", "canonical_fields")})


@query(f"""WITH RECURSIVE {BOM}, {STACK}, m AS (SELECT doc, row_no, level, name FROM bom WHERE row_no % 7 <> 0), o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY row_no) AS rn FROM m),
    w AS (SELECT doc, rn, row_no, [name] AS p FROM o WHERE rn = 1 UNION ALL SELECT o.doc, o.rn, o.row_no, list_append(w.p[1:least(o.level - 1, len(w.p))], o.name) FROM w JOIN o ON o.doc = w.doc AND o.rn = w.rn + 1)
    SELECT b.doc, b.row_no, coalesce(array_to_string(p, ' > '), '') AS bom_path FROM bom b LEFT JOIN w ON w.doc = b.doc AND w.row_no = b.row_no""")
def module_paths(spark, sf):
    """Paths of modules where some rows have none."""
    rows = bom_rows(spark, sf).withColumn("module", F.when(F.col("row_no") % 7 == 0, " ").otherwise(F.col("name")))
    return hierarchy.module_paths(rows).select("doc", "row_no", "bom_path")


@query(f"WITH RECURSIVE {BOM}, {STACK} SELECT doc || '/' || parent AS node, string_agg(doc || '/' || row_no, ',' ORDER BY doc || '/' || row_no) AS children FROM stack WHERE parent % 20 = 0 GROUP BY doc, parent")
def successors(spark, sf):
    key = lambda c: F.concat_ws("/", "doc", F.col(c).cast("string"))
    rows = hierarchy.ancestors_by_stack(bom_rows(spark, sf))
    edges = rows.where("parent IS NOT NULL").select(key("parent").alias("src"), key("row_no").alias("dst"))
    nodes = rows.where("row_no % 20 = 0").select(key("row_no").alias("node"))
    return hierarchy.children(edges, nodes).withColumn("children", F.array_join("children", ","))


@query(f"WITH {BOM} SELECT trim(split_part(doc || ' > ' || name, '>', 1)) AS step, count(*) AS n, count(DISTINCT doc || ' > ' || name) AS n_paths, count(*) FILTER (WHERE row_no % 2 = 0) AS n_even, bool_or(class = 'NEW') AS has_new FROM bom GROUP BY 1")
def path_groups(spark, sf):
    """Cards by the first step of their path, and how good the paths are."""
    from partloom.functions.text import first_step

    rows = bom_rows(spark, sf).withColumn("path", F.concat("doc", F.lit(" > "), "name"))
    return rows.groupBy(first_step(F.col("path")).alias("step")).agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_paths"), F.count_if(F.col("row_no") % 2 == 0).alias("n_even"), F.bool_or(F.col("class") == "NEW").alias("has_new"))


@query("SELECT l_returnflag AS action, l_linestatus AS source, count(*) AS n, count(*) FILTER (WHERE l_partkey % 3 = 0) AS n_merged FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2")
def action_counts(spark, sf):
    """Counters of some actions (the change types a list shows), with how many rows were merged."""
    rows = table(spark, sf, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    return rows.groupBy(F.col("l_returnflag").alias("action"), F.col("l_linestatus").alias("source")).agg(F.count("*").alias("n"), F.count_if(F.col("l_partkey") % 3 == 0).alias("n_merged"))
