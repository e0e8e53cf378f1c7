"""Graph table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.operators import fulltext, graph
from partloom.plans.bom import BOM, CLIMB, KINDS, STACK, bom_rows, part_id_sql
from partloom.plans.registry import query, table
from partloom.session import checkpointed

_OK = "NOT IN ('', '-', 'X', 'x', '←', 'nan', 'None')"
_RAW = f"""raw AS (
    SELECT line_id || ':rawpart:' || role AS raw_part_id, number, name, part_type, role, line_id, doc, row_no, i, {part_id_sql('number')} AS part_id
    FROM (SELECT *, 0 AS i, 'base' AS role, base_no AS number FROM lines UNION ALL SELECT *, 1, 'new', new_no FROM lines UNION ALL SELECT *, 2, 'effective', effective_no FROM lines)
    WHERE number {_OK}
), parts AS (
    SELECT part_id, upper(number) AS canonical_no, name, part_type FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY doc, row_no, i) AS k FROM raw) WHERE k = 1
)"""
_ID = lambda c: f"CASE WHEN {c} {_OK} THEN {part_id_sql(c)} ELSE '' END"


@query(f"""WITH {BOM}, {KINDS} SELECT line_id, kind, effective_no, concat_ws(' | ', doc, row_no, level, part_type, nullif(base_no, ''), nullif(new_no, ''), nullif(effective_no, ''), name, kind) AS search_text FROM lines""")
def bom_lines(spark, sf):
    return graph.lines(bom_rows(spark, sf)).select("line_id", "kind", "effective_no", "search_text")


@query(f"WITH RECURSIVE {BOM}, {STACK} SELECT doc || ':line:' || parent AS parent_line_id, doc || ':line:' || row_no AS child_line_id FROM stack WHERE parent IS NOT NULL")
def bom_line_edges(spark, sf):
    return graph.line_edges(graph.lines(bom_rows(spark, sf)))


@query(f"WITH {BOM}, {KINDS}, {_RAW} SELECT raw_part_id, number, role, part_id FROM raw")
def raw_parts(spark, sf):
    return graph.raw_parts(graph.lines(bom_rows(spark, sf))).select("raw_part_id", "number", "role", "part_id")


@query(f"WITH {BOM}, {KINDS}, {_RAW} SELECT part_id, canonical_no, name, part_type, canonical_no || ' | ' || name || ' | ' || part_type AS search_text FROM parts")
def parts(spark, sf):
    return graph.build(bom_rows(spark, sf))["parts"]


@query(f"""WITH {BOM}, {KINDS} SELECT change_id, kind, {_ID('direct_no')} AS direct_part_id, CASE kind WHEN 'Delete' THEN 'base' ELSE 'new' END AS direct_role,
    {_ID('base_no')} AS base_part_id, {_ID('new_no')} AS new_part_id FROM changes""")
def change_records(spark, sf):
    return graph.build(bom_rows(spark, sf))["change_records"].select("change_id", "kind", "direct_part_id", "direct_role", "base_part_id", "new_part_id")


@query(f"""WITH {BOM}, {KINDS} SELECT change_id, 'DIRECTLY_CHANGES_PART' AS edge, {part_id_sql('direct_no')} AS part_id FROM changes WHERE direct_no {_OK}
    UNION ALL SELECT change_id, 'BASE_PART', {part_id_sql('base_no')} FROM changes WHERE base_ok UNION ALL SELECT change_id, 'NEW_PART', {part_id_sql('new_no')} FROM changes WHERE new_ok""")
def change_part_edges(spark, sf):
    return graph.build(bom_rows(spark, sf))["change_part_edges"]


@query(f"""WITH RECURSIVE {BOM}, {STACK}, {CLIMB}, {KINDS} SELECT change_id, climb.doc || ':line:' || ancestor AS impacted_line_id, CAST(distance AS INTEGER) AS distance,
    CASE distance WHEN 0 THEN 'direct' WHEN 1 THEN 'parent' ELSE 'ancestor' END AS impact_type FROM changes c JOIN climb ON c.doc = climb.doc AND c.row_no = climb.row_no""")
def impact_edges(spark, sf):
    return graph.build(bom_rows(spark, sf))["impact_edges"]


@query(f"""WITH {BOM}, {KINDS} SELECT {part_id_sql('base_no')} AS from_part_id, {part_id_sql('new_no')} AS to_part_id, doc, line_id FROM changes
    WHERE kind = 'Change' AND base_ok AND new_ok AND base_no <> new_no""")
def replacement_edges(spark, sf):
    return graph.build(bom_rows(spark, sf))["replacement_edges"]


@query(f"""WITH {BOM}, {KINDS}, {_RAW} SELECT c.doc, c.row_no, c.kind, p.canonical_no, p.name AS part_name FROM changes c LEFT JOIN parts p ON p.part_id = {_ID('direct_no')}""")
def change_list(spark, sf):
    tables = graph.build(bom_rows(spark, sf))
    return graph.change_list(tables["change_records"], tables["parts"])


@query(f"""WITH RECURSIVE {BOM}, {STACK}, {CLIMB}, {KINDS} SELECT climb.doc || ':line:' || ancestor AS impacted_line_id, count(*) AS n_changes, CAST(min(distance) AS INTEGER) AS nearest, b.doc, b.name
    FROM changes c JOIN climb ON c.doc = climb.doc AND c.row_no = climb.row_no JOIN bom b ON b.doc = climb.doc AND b.row_no = ancestor WHERE distance > 0 GROUP BY 1, b.doc, b.name""")
def impacted_assemblies(spark, sf):
    tables = graph.build(bom_rows(spark, sf))
    return graph.impacted_assemblies(tables["impact_edges"], tables["bom_lines"])


@query(f"WITH {BOM}, {KINDS} SELECT change_id FROM changes WHERE row_no % 7 = 0")
def integrity_changes_without_line(spark, sf):
    """Lines that were lost on the way are found by the records that need them."""
    tables = graph.build(bom_rows(spark, sf))
    return graph.without_lines(tables["change_records"], tables["bom_lines"].where("row_no % 7 != 0"))


@query(f"WITH {BOM}, {KINDS} SELECT change_id FROM changes WHERE row_no % 11 = 0")
def integrity_changes_without_direct_impact(spark, sf):
    tables = graph.build(bom_rows(spark, sf))
    lost = F.regexp_extract("change_id", ":([0-9]+):change$", 1).cast("int") % 11 == 0
    return graph.without_direct_impact(tables["change_records"], tables["impact_edges"].where(~(lost & (F.col("distance") == 0))))


@query(f"""WITH RECURSIVE {BOM}, {STACK} SELECT doc || ':line:' || parent AS parent_line_id, doc || ':line:' || row_no AS child_line_id FROM stack WHERE parent IS NOT NULL AND parent % 5 <> 0 AND row_no % 3 <> 0""")
def edges_with_both_ends(spark, sf):
    """Edges of a graph some of whose nodes weren't loaded."""
    line = graph.lines(bom_rows(spark, sf))
    edges = graph.line_edges(line)
    return graph.both_ends(edges, "parent_line_id", line.where("row_no % 5 != 0").select("line_id"), "child_line_id", line.where("row_no % 3 != 0").select("line_id"))


@query(f"""WITH RECURSIVE {BOM}, {STACK}, {CLIMB}, {KINDS}, {_RAW} SELECT 'bom_lines' AS label, count(*) AS n FROM lines UNION ALL SELECT 'bom_line_edges', count(*) FROM stack WHERE parent IS NOT NULL
    UNION ALL SELECT 'raw_parts', count(*) FROM raw UNION ALL SELECT 'parts', count(*) FROM parts UNION ALL SELECT 'change_records', count(*) FROM changes
    UNION ALL SELECT 'impact_edges', count(*) FROM changes c JOIN climb ON c.doc = climb.doc AND c.row_no = climb.row_no""")
def graph_counts(spark, sf):
    tables = graph.build(bom_rows(spark, sf))
    return graph.counts({k: tables[k] for k in ("bom_lines", "bom_line_edges", "raw_parts", "parts", "change_records", "impact_edges")})


@query(f"""WITH {BOM}, {KINDS}, {_RAW} SELECT 'BomLine' AS label, line_id AS id FROM lines WHERE lower(concat_ws(' | ', doc, row_no, level, part_type, base_no, new_no, effective_no, name, kind)) LIKE '%new0000001%'
    UNION ALL SELECT 'Part', part_id FROM parts WHERE lower(canonical_no || ' | ' || name || ' | ' || part_type) LIKE '%new0000001%'""")
def graph_full_text(spark, sf):
    """Texts need no tree: lines are told apart by rows, not by documents, and computed once."""
    line = checkpointed(graph.line_texts(bom_rows(spark, sf).repartition("doc", "row_no")))
    return graph.full_text({"BomLine": (line, "line_id"), "Part": (graph.parts(graph.raw_parts(line)), "part_id")}, "NEW0000001")


def _sheets(spark, sf):
    event = F.when(F.col("s_suppkey") % 2 == 0, "PP")
    return table(spark, sf, "supplier").select(F.col("s_name").alias("file"), F.lit("Master").alias("sheet"), F.concat(F.lit("M"), F.col("s_nationkey").cast("string")).alias("base_model"), F.lit("WSED7613B").alias("new_model"), event.alias("event"))


_DOCS = """d AS (SELECT *, 'doc:' || substr(sha1(s_name || '|Master'), 1, 24) AS document_id, 'M' || s_nationkey AS base_model, CASE WHEN s_suppkey % 2 = 0 THEN 'PP' ELSE '' END AS event FROM supplier),
    e AS (SELECT *, 'case:' || substr(sha1(base_model || '|WSED7613B|' || event || '|' || document_id), 1, 24) AS case_id FROM d)"""


def search_nodes(spark, sf):
    """The four labels that are searched, with the columns that hold their texts."""
    tables = graph.build(bom_rows(spark, sf)) | graph.document_tables(_sheets(spark, sf))
    line = tables["bom_lines"]
    changes = tables["change_records"].join(line.select("line_id", "point", "reason"), "line_id")
    return fulltext.nodes_of({
        "BomLine": (line, "line_id", ["search_text", "point", "reason"]), "Part": (tables["parts"], "part_id", ["search_text"]),
        "ReviewCase": (tables["review_cases"], "case_id", ["search_text"]), "ChangeRecord": (changes, "change_id", ["kind", "base_no", "new_no", "point", "reason"]),
    })


@query(f"""WITH {BOM}, {KINDS}, {_RAW}, {_DOCS}, node AS (
        SELECT 'BomLine' AS label, line_id AS id, concat_ws(' ', doc, row_no, level, part_type, base_no, new_no, effective_no, name, kind, point, reason) AS text FROM lines
        UNION ALL SELECT 'Part', part_id, concat_ws(' ', canonical_no, name, part_type) FROM parts
        UNION ALL SELECT 'ReviewCase', case_id, concat_ws(' ', s_name, 'Master', base_model, 'WSED7613B', event) FROM e
        UNION ALL SELECT 'ChangeRecord', change_id, concat_ws(' ', kind, base_no, new_no, point, reason) FROM changes
    ), word AS (
        SELECT label, id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS words FROM node
    ), size AS (SELECT label, count(*) AS n, avg(len(words)) AS mean FROM word GROUP BY label
    ), post AS (SELECT label, id, term, len(any_value(words)) AS length, count(*) AS tf FROM (SELECT *, unnest(words) AS term FROM word) GROUP BY label, id, term
    ), freq AS (SELECT label, term, count(*) AS df FROM post GROUP BY label, term
    ), weight AS (SELECT label, id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS weight FROM post JOIN freq USING (label, term) JOIN size USING (label)
    ), asked AS (
        SELECT row_no AS query, unnest(list_distinct(regexp_split_to_array(lower(concat_ws(' ', part_no, name, point, reason)), '[^\\p{{L}}\\p{{N}}]+'))) AS term FROM bom WHERE row_no % 20 = 0
    ), score AS (SELECT query, label, id, round(sum(weight), 6) AS score FROM asked JOIN weight USING (term) GROUP BY query, label, id)
    SELECT query, label, id, score, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY score DESC, id) AS k FROM score) WHERE k <= 10""")
def full_text_top_k(spark, sf):
    """Every row with a number divisible by 20 asks the four labels with its words."""
    queries = bom_rows(spark, sf).where("row_no % 20 = 0").select(F.col("row_no").alias("query"), F.concat_ws(" ", "part_no", "name", "point", "reason").alias("text"))
    return fulltext.search(fulltext.build_index(search_nodes(spark, sf)), queries, 10)


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT 'p' || o_custkey AS src, 'p' || (o_custkey + 1) AS dst FROM orders WHERE o_custkey % 30 <> 29 AND o_orderkey % 2 = 0 UNION SELECT 'p' || (c_custkey * 30 + 15), 'p' || (c_custkey * 30 + 5) FROM customer WHERE c_custkey % 2 = 0),
    s AS (SELECT 'p' || c_custkey AS node FROM customer WHERE c_custkey % 20 = 0), w AS (SELECT node, node AS reached, 0 AS distance FROM s UNION SELECT w.node, e.dst, w.distance + 1 FROM w JOIN e ON e.src = w.reached WHERE w.distance < 90)
    SELECT node, reached, CAST(min(distance) AS INTEGER) AS distance FROM w GROUP BY node, reached""")
def replacement_chains(spark, sf):
    """Chains of up to thirty replacements, some of which lead back."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    p = lambda x: F.concat(F.lit("p"), x.cast("string"))
    on = o.where("o_custkey % 30 != 29 AND o_orderkey % 2 = 0").select(p(F.col("o_custkey")).alias("from_part_id"), p(F.col("o_custkey") + 1).alias("to_part_id"))
    back = c.where("c_custkey % 2 = 0").select(p(F.col("c_custkey") * 30 + 15).alias("from_part_id"), p(F.col("c_custkey") * 30 + 5).alias("to_part_id"))
    return graph.replacement_chain(on.unionByName(back).distinct(), c.where("c_custkey % 20 = 0").select(p(F.col("c_custkey")).alias("node")))


@query(f"""WITH {BOM}, {KINDS} SELECT {part_id_sql('base_no')} AS node, {part_id_sql('base_no')} AS reached, 0 AS distance FROM changes WHERE kind = 'Change' AND base_ok AND new_ok AND base_no <> new_no
    UNION SELECT {part_id_sql('base_no')}, {part_id_sql('new_no')}, 1 FROM changes WHERE kind = 'Change' AND base_ok AND new_ok AND base_no <> new_no""")
def part_history(spark, sf):
    """What replaced each part that was replaced; new numbers aren't replaced again here."""
    edges = graph.build(bom_rows(spark, sf))["replacement_edges"]
    return graph.replacement_chain(edges, edges.selectExpr("from_part_id AS node"))


@query(f"WITH {_DOCS} SELECT document_id, s_name AS file_name, 'Master' AS sheet_name FROM e")
def source_documents(spark, sf):
    return graph.document_tables(_sheets(spark, sf))["source_documents"]


@query(f"WITH {_DOCS} SELECT case_id, base_model, 'WSED7613B' AS new_model, event, concat_ws(' | ', s_name, 'Master', base_model, 'WSED7613B', nullif(event, '')) AS search_text FROM e")
def review_cases(spark, sf):
    return graph.document_tables(_sheets(spark, sf))["review_cases"]


@query(f"WITH {_DOCS} SELECT document_id, case_id FROM e")
def document_case_edges(spark, sf):
    return graph.document_tables(_sheets(spark, sf))["document_case_edges"]


@query("""SELECT 'd' || n_regionkey || ':col:' || n_nationkey AS source_column_id, 'd' || n_regionkey AS document_id, n_name AS raw_column_name, n_nationkey AS column_index,
    CASE n_nationkey % 3 WHEN 0 THEN 'part_name' WHEN 1 THEN 'quantity' ELSE '' END AS canonical_field_key FROM nation""")
def source_columns(spark, sf):
    k = F.col("n_nationkey")
    field = F.when(k % 3 == 0, "part_name").when(k % 3 == 1, "quantity").otherwise("other")
    return graph.source_columns(table(spark, sf, "nation").select(F.concat(F.lit("d"), F.col("n_regionkey").cast("string")).alias("document_id"), k.alias("column_index"), F.col("n_name").alias("raw_column_name"), field.alias("field")))
