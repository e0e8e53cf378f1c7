"""Hierarchy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.operators import graph
from partloom.operators import hierarchy as h
from partloom.plans.bom import BOM, CLIMB, KINDS, STACK, bom_rows
from partloom.plans.registry import query, table


@query(f"WITH RECURSIVE {BOM}, {STACK} SELECT doc, row_no, depth, parent FROM stack")
def stack_parents(spark, sf):
    return h.ancestors_by_stack(bom_rows(spark, sf)).select("doc", "row_no", "depth", "parent")


@query(f"""WITH {BOM} SELECT doc, row_no, (SELECT max(a.row_no) FROM bom a WHERE a.doc = b.doc AND a.row_no < b.row_no AND a.level < b.level) AS parent FROM bom b""")
def level_parents(spark, sf):
    return h.parent_by_level(bom_rows(spark, sf)).select("doc", "row_no", "parent")


@query(f"""WITH {BOM}, p AS (SELECT doc, row_no, level, qty, (SELECT max(a.row_no) FROM bom a WHERE a.doc = b.doc AND a.row_no < b.row_no AND a.level < b.level) AS parent FROM bom b)
    SELECT p.doc, p.row_no, CASE WHEN p.row_no % 9 = 0 THEN 'GIVEN' || p.row_no ELSE a.part_no END AS parent_no
    FROM p LEFT JOIN bom a ON a.doc = p.doc AND a.row_no = p.parent""")
def explicit_parents(spark, sf):
    rows = h.parent_by_level(bom_rows(spark, sf))
    given = F.when(F.col("row_no") % 9 == 0, F.concat(F.lit("GIVEN"), F.col("row_no").cast("string"))).otherwise("")
    return h.explicit_parent(rows.withColumn("given", given), "given").select("doc", "row_no", "parent_no")


@query(f"WITH RECURSIVE {BOM}, {STACK}, {CLIMB} SELECT doc, row_no, ancestor, CAST(distance AS INTEGER) AS distance FROM climb")
def ancestor_closure(spark, sf):
    return h.closure(h.ancestors_by_stack(bom_rows(spark, sf))).select("doc", "row_no", "ancestor", "distance")


@query(f"""WITH RECURSIVE {BOM}, {STACK}, {CLIMB}, {KINDS}
    SELECT CASE distance WHEN 0 THEN 'direct' WHEN 1 THEN 'parent' ELSE 'ancestor' END AS impact_type, CAST(count(*) AS BIGINT) AS n_edges, count(DISTINCT c.change_id) AS n_changes
    FROM changes c JOIN climb ON climb.doc = c.doc AND climb.row_no = c.row_no GROUP BY 1""")
def impact_summary(spark, sf):
    impact = graph.impact_edges(graph.change_records(graph.lines(bom_rows(spark, sf))))
    return impact.groupBy("impact_type").agg(F.count("*").alias("n_edges"), F.countDistinct("change_id").alias("n_changes"))


@query(f"""WITH RECURSIVE {BOM}, {STACK}, {CLIMB} SELECT climb.doc, climb.row_no, string_agg(b.name, ' > ' ORDER BY distance DESC) AS bom_path
    FROM climb JOIN bom b ON b.doc = climb.doc AND b.row_no = climb.ancestor GROUP BY climb.doc, climb.row_no""")
def bom_paths(spark, sf):
    return h.paths(h.ancestors_by_stack(bom_rows(spark, sf)), "name").select("doc", "row_no", "bom_path")


@query(f"WITH {BOM} SELECT doc, row_no, (SELECT min(a.row_no) FROM bom a WHERE a.doc = b.doc AND a.row_no > b.row_no AND a.level <= b.level) AS subtree_end FROM bom b")
def subtree_ranges(spark, sf):
    return h.subtree_end(bom_rows(spark, sf)).select("doc", "row_no", "subtree_end")


@query(f"""WITH {BOM}, t AS (SELECT doc, row_no, coalesce((SELECT min(a.row_no) FROM bom a WHERE a.doc = b.doc AND a.row_no > b.row_no AND a.level <= b.level), 1152921504606846976) AS e, point, reason, new_no FROM bom b),
    u AS (SELECT *, EXISTS (SELECT 1 FROM bom c WHERE c.doc = t.doc AND c.row_no >= t.row_no AND c.row_no < t.e AND c.row_no % 13 = 0) AS touched FROM t)
    SELECT doc, row_no, touched, CASE WHEN touched AND cp = '-' THEN '하위 부품 변경' ELSE cp END AS change_point FROM (SELECT *, CASE WHEN row_no % 13 = 0 THEN point ELSE '-' END AS cp FROM u)""")
def change_propagation(spark, sf):
    rows = bom_rows(spark, sf).withColumn("changed", F.col("row_no") % 13 == 0)
    cells = rows.withColumns({"change_point": F.when(F.col("changed"), F.col("point")).otherwise("-"), "change_reason": F.lit("-"), "kind": F.lit("-")})
    return h.propagated_cells(h.propagate(cells, "changed")).select("doc", "row_no", "touched", "change_point")


@query(f"""WITH RECURSIVE {BOM}, {STACK}, {CLIMB}, p AS (SELECT doc, row_no, row_no % 3 AS grp FROM bom WHERE row_no % 17 = 0)
    SELECT grp, doc, row_no, FALSE AS inserted FROM p
    UNION ALL SELECT * FROM (SELECT DISTINCT p.grp, p.doc, climb.ancestor, TRUE FROM p JOIN climb ON p.doc = climb.doc AND p.row_no = climb.row_no WHERE distance > 0
        AND NOT EXISTS (SELECT 1 FROM p q WHERE q.grp = p.grp AND q.doc = p.doc AND q.row_no = climb.ancestor))""")
def missing_assemblies(spark, sf):
    rows = h.ancestors_by_stack(bom_rows(spark, sf))
    picked = rows.where("row_no % 17 = 0").select((F.col("row_no") % 3).alias("grp"), "doc", "row_no")
    return h.with_missing_assemblies(picked, h.closure(rows))


@query(f"""WITH RECURSIVE {BOM}, {STACK}, {CLIMB} SELECT DISTINCT b.doc, b.row_no, b.level FROM bom m JOIN climb ON m.doc = climb.doc AND m.row_no = climb.row_no
    JOIN bom b ON b.doc = climb.doc AND b.row_no = climb.ancestor WHERE m.row_no % 20 = 0 AND b.level <= 4""")
def tree_search(spark, sf):
    rows = h.ancestors_by_stack(bom_rows(spark, sf))
    return h.search_tree(rows, F.col("row_no") % 20 == 0, max_level=4).select("doc", "row_no", "level")


@query(f"""WITH {BOM}, s AS (SELECT name, min(row_no) AS position FROM bom WHERE doc = 'Brand#11' GROUP BY name)
    SELECT b.doc, b.row_no, coalesce(s.position, 999999) AS position FROM bom b LEFT JOIN s ON b.name = s.name""")
def skeleton_order(spark, sf):
    rows = bom_rows(spark, sf)
    return h.reorder(rows, rows.where("doc = 'Brand#11'"), "name").select("doc", "row_no", "position")


@query(f"WITH RECURSIVE {BOM}, {STACK} SELECT level, count(*) AS n, count(*) FILTER (WHERE parent IS NULL) AS n_roots, max(depth) AS max_depth FROM stack GROUP BY level")
def level_histogram(spark, sf):
    rows = h.ancestors_by_stack(bom_rows(spark, sf))
    return rows.groupBy("level").agg(F.count("*").alias("n"), F.count_if(F.col("parent").isNull()).alias("n_roots"), F.max("depth").alias("max_depth"))


@query(f"""WITH RECURSIVE {BOM}, {STACK} SELECT s.doc, s.row_no, count(c.row_no) AS child_count, count(c.row_no) > 0 AS is_assembly
    FROM stack s LEFT JOIN stack c ON c.doc = s.doc AND c.parent = s.row_no GROUP BY s.doc, s.row_no""")
def fan_out(spark, sf):
    rows = h.ancestors_by_stack(bom_rows(spark, sf)).select("doc", "row_no", "parent")
    children = rows.where("parent IS NOT NULL").groupBy("doc", F.col("parent").alias("row_no")).agg(F.count("*").alias("child_count"))
    n = F.coalesce("child_count", F.lit(0).cast("long"))
    return rows.join(children, ["doc", "row_no"], "left").select("doc", "row_no", n.alias("child_count"), (n > 0).alias("is_assembly"))


@query(f"""WITH RECURSIVE {BOM}, {STACK}, down AS (SELECT doc, row_no, row_no AS reached, 0 AS distance FROM stack WHERE row_no % 20 = 0
    UNION ALL SELECT d.doc, d.row_no, s.row_no, d.distance + 1 FROM down d JOIN stack s ON s.doc = d.doc AND s.parent = d.reached)
    SELECT doc || '/' || row_no AS node, doc || '/' || reached AS reached, CAST(distance AS INTEGER) AS distance FROM down""")
def descendants(spark, sf):
    key = lambda c: F.concat_ws("/", "doc", F.col(c).cast("string"))
    rows = h.ancestors_by_stack(bom_rows(spark, sf))
    edges = rows.where("parent IS NOT NULL").select(key("parent").alias("src"), key("row_no").alias("dst"))
    return h.walk(edges, rows.where("row_no % 20 = 0").select(key("row_no").alias("node")))


#: Levels up to 70, far beyond those that are looked at one by one.
_DEEP = "deep AS (SELECT o_custkey % 97 AS doc, o_orderkey AS row_no, CAST(1 + (o_orderkey * 7 + o_custkey) % 70 AS INTEGER) AS level, o_orderkey % 13 = 0 AS changed FROM orders)"


def _deep_rows(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select((F.col("o_custkey") % 97).alias("doc"), k.alias("row_no"), (1 + (k * 7 + F.col("o_custkey")) % 70).cast("int").alias("level"), (k % 13 == 0).alias("changed"))


@query(f"""WITH {_DEEP}, p AS (SELECT b.doc, b.row_no, max(a.row_no) AS parent FROM deep b LEFT JOIN deep a ON a.doc = b.doc AND a.row_no < b.row_no AND a.level < b.level GROUP BY b.doc, b.row_no),
    e AS (SELECT b.doc, b.row_no, min(a.row_no) AS subtree_end FROM deep b LEFT JOIN deep a ON a.doc = b.doc AND a.row_no > b.row_no AND a.level <= b.level GROUP BY b.doc, b.row_no),
    n AS (SELECT *, sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY row_no) AS upto FROM deep)
    SELECT p.doc, p.row_no, p.parent, e.subtree_end, coalesce(x.upto - CASE WHEN x.changed THEN 1 ELSE 0 END, (SELECT max(upto) FROM n m WHERE m.doc = p.doc)) > n.upto - CASE WHEN n.changed THEN 1 ELSE 0 END AS touched
    FROM p JOIN e USING (doc, row_no) JOIN n USING (doc, row_no) LEFT JOIN n x ON x.doc = p.doc AND x.row_no = e.subtree_end""")
def deep_levels(spark, sf):
    """Parents, subtrees and propagation where levels go to 70."""
    rows = _deep_rows(spark, sf)
    ends = h.subtree_end(h.parent_by_level(rows)).select("doc", "row_no", "parent", "subtree_end")
    return ends.join(h.propagate(rows, "changed").select("doc", "row_no", "touched"), ["doc", "row_no"])


#: Chains of up to 5,000 steps; every third one comes back to its middle.
_CHAINS = "e AS MATERIALIZED (SELECT o_orderkey AS src, CASE WHEN o_orderkey % 15000 = 9999 THEN o_orderkey - 3000 ELSE o_orderkey + 1 END AS dst FROM orders WHERE o_orderkey % 15000 = 9999 OR (o_orderkey % 5000 <> 4999 AND o_orderkey + 1 IN (SELECT o_orderkey FROM orders)))"


def _chain_edges(spark, sf):
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select("o_orderkey")
    back = orders.where(k % 15000 == 9999).select(k.alias("src"), (k - 3000).alias("dst"))
    on = orders.where("o_orderkey % 5000 != 4999").select(k.alias("src"), (k + 1).alias("dst")).join(orders.select(k.alias("dst")), "dst", "left_semi")
    return on.select("src", "dst").unionByName(back)


@query(f"""WITH RECURSIVE {_CHAINS}, w AS (SELECT o_orderkey AS node, o_orderkey AS reached, 0 AS length FROM orders WHERE o_orderkey % 20 = 0 AND o_orderkey IN (SELECT src FROM e UNION SELECT dst FROM e)
        UNION ALL SELECT node, dst, length + 1 FROM w JOIN e ON src = reached WHERE length < 10000),
    s AS (SELECT node, bool_and(reached IN (SELECT src FROM e)) AS cyclic, arg_max(reached, length) AS last, max(length) AS length FROM w GROUP BY node)
    SELECT node, CASE WHEN NOT cyclic THEN last END AS last, CASE WHEN NOT cyclic THEN CAST(length AS BIGINT) END AS length, cyclic FROM s""")
def chain_ends(spark, sf):
    """Where each chain of replacements ends, after how many steps."""
    return h.chain_ends(_chain_edges(spark, sf)).where("node % 20 = 0")


@query(f"""WITH RECURSIVE {_CHAINS}, w AS (SELECT o_orderkey AS node, o_orderkey AS reached, 0 AS distance FROM orders WHERE o_orderkey % 2500 = 0
        UNION ALL SELECT node, dst, distance + 1 FROM w JOIN e ON src = reached WHERE distance < 6000)
    SELECT node, reached, CAST(min(distance) AS INTEGER) AS distance FROM w GROUP BY node, reached""")
def long_chains(spark, sf):
    """All that lies on the way, thousands of steps in some rounds."""
    start = table(spark, sf, "orders").where("o_orderkey % 2500 = 0").select(F.col("o_orderkey").alias("node"))
    return h.walk(_chain_edges(spark, sf), start)


@query(f"""WITH RECURSIVE {BOM}, {STACK}, n AS (SELECT s.doc, s.row_no, s.depth, row_number() OVER (PARTITION BY s.doc ORDER BY s.row_no) AS rn, '{{"row_no":' || s.row_no || ',"name":"' || name || '","children":[' AS opening FROM stack s JOIN bom b ON b.doc = s.doc AND b.row_no = s.row_no),
    t AS (SELECT doc, rn, depth, '[' || opening AS text FROM n WHERE rn = 1 UNION ALL
        SELECT n.doc, n.rn, n.depth, t.text || CASE WHEN n.depth > t.depth THEN '' ELSE repeat(']}}', t.depth - n.depth + 1) || ',' END || n.opening FROM t JOIN n ON n.doc = t.doc AND n.rn = t.rn + 1)
    SELECT doc, arg_max(text || repeat(']}}', depth) || ']', rn) AS json FROM t GROUP BY doc""")
def nested_trees(spark, sf):
    """Each document's tree as one nested value."""
    return h.nested_tree(h.ancestors_by_stack(bom_rows(spark, sf)), ["row_no", "name"])


@query("""WITH p AS (SELECT p_brand AS doc, p_partkey AS ord, p_type AS a, split_part(p_name, ' ', 1) AS b, split_part(p_name, ' ', 2) AS c FROM part),
    c AS (SELECT doc, a, b, c, min(ord) AS ord FROM p GROUP BY doc, a, b, c), b AS (SELECT doc, a, b, min(ord) AS ord, string_agg('"' || c || '":{}', ',' ORDER BY ord) AS j FROM c GROUP BY doc, a, b),
    a AS (SELECT doc, a, min(ord) AS ord, string_agg('"' || b || '":{' || j || '}', ',' ORDER BY ord) AS j FROM b GROUP BY doc, a)
    SELECT doc, '{' || string_agg('"' || a || '":{' || j || '}', ',' ORDER BY ord) || '}' AS json FROM a GROUP BY doc""")
def path_trees(spark, sf):
    """Paths as nested objects, names in the order in which they came."""
    words = F.split("p_name", " ")
    path = F.concat_ws(" > ", "p_type", F.get(words, 0), F.get(words, 1))
    return h.tree_of_paths(table(spark, sf, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("ord"), path.alias("path")))
