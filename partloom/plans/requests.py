"""Queries over packaging, requests and hotspots."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.operators import agent, classify, encode, graph, packaging
from partloom.plans.bom import BOM, CLIMB, KINDS, STACK, bom_rows
from partloom.plans.registry import any_of, query, table

_ANY = lambda words: f"len(list_filter([{', '.join(repr(w) for w in words)}], lambda w: contains(lower(concat_ws(' ', part_type, name, point, reason)), w))) > 0"
_DOMAIN = f"CASE WHEN {_ANY(classify.CONSUMABLE_WORDS)} THEN 'C' WHEN {_ANY(classify.PRINT_WORDS)} THEN 'P' WHEN {_ANY(classify.ELECTRIC_WORDS)} THEN 'E' WHEN {_ANY(classify.MECHANIC_WORDS)} THEN 'M' ELSE 'U' END"


@query(f"""WITH {BOM}, b AS (SELECT *, CAST((row_number() OVER (PARTITION BY doc ORDER BY row_no) - 1) // 20 AS INTEGER) AS block FROM bom)
    SELECT md5(doc || chr(10) || block) AS id, doc, block, count(*) AS n_rows, string_agg(part_no || ' ' || name, chr(10) ORDER BY row_no) AS text FROM b GROUP BY doc, block""")
def block_documents(spark, sf):
    return packaging.block_documents(bom_rows(spark, sf), F.concat_ws(" ", "part_no", "name"), size=20)


@query(f"WITH {BOM} SELECT md5(doc || chr(10) || row_no) AS id, doc, row_no, concat_ws(' | ', 'No=' || part_no, 'New=' || nullif(new_no, ''), 'Why=' || nullif(reason, '')) AS text FROM bom")
def line_documents(spark, sf):
    return packaging.line_documents(bom_rows(spark, sf), {"No": F.col("part_no"), "New": F.col("new_no"), "Why": F.col("reason")})


@query(f"""WITH {BOM}, r AS (SELECT *, count(*) FILTER (WHERE level = 1) OVER (PARTITION BY doc ORDER BY row_no) AS run, {_DOMAIN} AS domain FROM bom),
    s AS (SELECT *, (row_number() OVER (PARTITION BY doc, run ORDER BY row_no) - 1) // 120 AS block FROM r), c AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY doc ORDER BY run, block) - 1 AS INTEGER) AS chunk_seq FROM s)
    SELECT doc, chunk_seq, domain, count(*) AS n_parts FROM c GROUP BY doc, chunk_seq, domain""")
def assembly_documents(spark, sf):
    return packaging.assembly_documents(bom_rows(spark, sf)).select("doc", "chunk_seq", "domain", "n_parts")


_ASKS = ["카메라 추가", "Rear cover", "스토퍼 변경", "AC motor → BLDC motor", "button", "도어", "LCD"]
_CASES = lambda of: "CASE " + " ".join(f"WHEN {any_of('x', hints)} THEN {of(rule)}" for hints, *rule in agent.EXPANSIONS if hints) + f" ELSE {of(agent.EXPANSIONS[-1][1:])} END"


@query(f"""WITH t AS (SELECT c_custkey, lower(({'[' + ', '.join(f"'{w}'" for w in _ASKS) + ']'})[CAST(c_custkey % 7 AS INTEGER) + 1] || CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' panel' WHEN 2 THEN ' of ' || c_name ELSE ' Stopper' END) AS x FROM customer)
    SELECT c_custkey, {_CASES(lambda r: f"'{r[0]}'")} AS target, CAST({_CASES(lambda r: str(len(r[1]) + len(r[2])))} AS INTEGER) AS n_words, {_CASES(lambda r: f"'{r[3]}'")} AS action, TRUE AS is_valid FROM t""")
def request_expansion(spark, sf):
    k = F.col("c_custkey")
    more = F.when(k % 4 == 0, "").when(k % 4 == 1, " panel").when(k % 4 == 2, F.concat(F.lit(" of "), "c_name")).otherwise(" Stopper")
    e = agent.expand(F.concat(F.get(F.array(*map(F.lit, _ASKS)), (k % 7).cast("int")), more))
    return table(spark, sf, "customer").select("c_custkey", e["target_assembly"].alias("target"), F.size(F.concat(e["synonyms"], e["related_keywords"])).alias("n_words"), e["action"].alias("action"), agent.verify(e)["is_valid"].alias("is_valid"))


@query(f"""WITH RECURSIVE {BOM}, {STACK}, {CLIMB}, {KINDS} SELECT b.part_type, count(DISTINCT c.change_id) AS n_changes, count(DISTINCT b.doc || '/' || b.row_no) AS n_assemblies, round(count(DISTINCT c.change_id)::DOUBLE / count(DISTINCT b.doc || '/' || b.row_no), 4) AS per_assembly
    FROM changes c JOIN climb ON c.doc = climb.doc AND c.row_no = climb.row_no JOIN bom b ON b.doc = climb.doc AND b.row_no = ancestor WHERE distance BETWEEN 1 AND 6 GROUP BY b.part_type""")
def change_hotspots(spark, sf):
    tables = graph.build(bom_rows(spark, sf))
    line = tables["bom_lines"].select(F.col("line_id").alias("impacted_line_id"), "part_type")
    hit = tables["impact_edges"].where("distance BETWEEN 1 AND 6").join(line, "impacted_line_id")
    out = hit.groupBy("part_type").agg(F.countDistinct("change_id").alias("n_changes"), F.countDistinct("impacted_line_id").alias("n_assemblies"))
    return out.withColumn("per_assembly", F.round(F.col("n_changes") / F.col("n_assemblies"), 4))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS words FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)),
    p AS (SELECT doc_id, i // 200 AS win, words[i + 1] AS word, least(200, len(words) - 200 * (i // 200)) AS size FROM (SELECT *, unnest(range(0, len(words))) AS i FROM w)),
    c AS (SELECT doc_id, win, size, word, count(*) AS n, ('0x' || substr(md5(word), 1, 16))::UBIGINT AS h FROM p GROUP BY doc_id, win, size, word),
    v AS (SELECT doc_id, win, size, CAST(h % 16 AS BIGINT) AS place, sum(CASE WHEN h >= 9223372036854775808 THEN n ELSE -n END)::DOUBLE AS x FROM c GROUP BY doc_id, win, size, h % 16),
    y AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY doc_id, win)) AS norm FROM v), z AS (SELECT doc_id, place, sum(CASE WHEN norm > 0 THEN size * x / norm ELSE 0 END) AS z FROM y GROUP BY doc_id, place),
    d AS (SELECT doc_id, place, z, sqrt(sum(z * z) OVER (PARTITION BY doc_id)) AS norm FROM z), l AS (SELECT doc_id, win, CAST(h % 1009 AS BIGINT) AS place, 1 + ln(sum(n)) AS x FROM c GROUP BY doc_id, win, h % 1009)
    SELECT doc_id, 'dense' AS head, place, round(z / norm, 4) AS weight FROM d WHERE norm > 0 AND round(z / norm, 4) <> 0 UNION ALL SELECT doc_id, 'lexical', place, round(max(x), 4) FROM l GROUP BY doc_id, place""")
def encoder_backfill(spark, sf):
    """Both heads for the documents that have no vector yet, long ones in windows."""
    have = table(spark, sf, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = table(spark, sf, "documents").select("doc_id", "text").join(have, "doc_id", "left")
    found = encode.backfill(docs, lambda: encode.hashed_encoder(16, 1009), key="doc_id", text="text", most=200, budget=4096)
    row = lambda head, place, x: F.struct(F.lit(head).alias("head"), place.cast("long").alias("place"), F.round(x.cast("double"), 4).alias("weight"))
    dense = F.filter(F.transform("embedding", lambda x, i: row("dense", i, x)), lambda r: r["weight"] != 0)
    lexical = F.transform(F.map_entries("lexical"), lambda e: row("lexical", e["key"], e["value"]))
    # both heads of a document from one pass
    return found.select("doc_id", F.explode(F.concat(dense, lexical)).alias("x")).select("doc_id", "x.*")
