"""Search, ranking and packaging queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from partloom.functions.text import tokens
from partloom.operators import contains, evidence, match, retrieval, vectors
from partloom.plans.bom import BOM, bom_rows
from partloom.plans.registry import query, table

# Queries: every row whose identifier is divisible by 20, against all rows.
_DENSE = "d AS (SELECT q.vec_id AS query, e.vec_id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) + 0.0 AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)"
_WORDS = "w AS (SELECT doc_id, w, 1 + ln(count(*)) AS x FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM documents) WHERE w <> '' GROUP BY doc_id, w)"
_SPARSE = "s AS (SELECT q.doc_id AS query, d.doc_id, round(sum(q.x * d.x), 6) AS score FROM w q JOIN w d ON q.w = d.w WHERE q.doc_id % 20 = 0 GROUP BY 1, 2)"
_SETS = "t AS (SELECT doc_id, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9가-힣\\s]+', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS w FROM documents)"


def _asked(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")


@query(f"WITH {_DENSE} SELECT query, vec_id, distance, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS k FROM d) WHERE k <= 50")
def dense_top_k(spark, sf):
    return retrieval.nearest_each(table(spark, sf, "embeddings"), _asked(spark, sf), 50)


@query(f"WITH {_DENSE} SELECT query, vec_id, distance, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS k FROM d) WHERE k <= 50")
def vector_index_exact(spark, sf):
    """The index asked until no list can have anything nearer."""
    index = vectors.build_vector_index(table(spark, sf, "embeddings"))
    return vectors.search_vectors(index, _asked(spark, sf), 50, exact=True)


@query(f"""WITH {_DENSE}, f AS (SELECT d.* FROM d JOIN documents ON doc_id = vec_id WHERE lang = 'de') SELECT query, vec_id, distance, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS k FROM f) WHERE k <= 10""")
def vector_index_filtered(spark, sf):
    """A filter on a column that the index keeps holds before the search."""
    rows = table(spark, sf, "embeddings").join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang"), "vec_id")
    index = vectors.build_vector_index(rows, keep=["lang"])
    return vectors.search_vectors(index, _asked(spark, sf), 10, where=F.col("lang") == "de", exact=True)


@query()
def vector_index_top_k(spark, sf):
    """Some lists only: its recall is measured in the tests."""
    index = vectors.build_vector_index(table(spark, sf, "embeddings"))
    return vectors.search_vectors(index, _asked(spark, sf), 50, probes=12)


@query(f"WITH {_WORDS}, {_SPARSE} SELECT query, doc_id, score, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS k FROM s) WHERE k <= 50")
def sparse_top_k(spark, sf):
    docs = table(spark, sf, "documents")
    asked = retrieval.weighed_words(docs.where("doc_id % 20 = 0"))  # not counted with the others and then chosen
    return retrieval.sparse_each(retrieval.weighed_words(docs), asked.withColumnRenamed("doc_id", "query"), 50)


@query(f"""WITH {_WORDS}, en AS (SELECT doc_id FROM documents WHERE lang = 'en'),
    d AS (SELECT q.vec_id AS query, e.vec_id AS doc_id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings e JOIN en ON e.vec_id = en.doc_id, embeddings q JOIN documents t ON t.doc_id = q.vec_id WHERE q.vec_id % 20 = 0),
    s AS (SELECT q.doc_id AS query, d.doc_id, round(sum(q.x * d.x), 6) AS score FROM w q JOIN w d ON q.w = d.w JOIN en ON en.doc_id = d.doc_id WHERE q.doc_id % 20 = 0 AND q.doc_id IN (SELECT vec_id FROM embeddings) GROUP BY 1, 2),
    r AS (SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY distance, doc_id) AS rank FROM d UNION ALL SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) FROM s),
    f AS (SELECT query, doc_id, round(sum(1.0 / (60 + rank)::DOUBLE), 9) AS score, count(*) AS n_lists FROM r WHERE rank <= 50 GROUP BY query, doc_id)
    SELECT query, f.doc_id, score, n_lists, documents.source, documents.n_chars FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS k FROM f) f JOIN documents ON documents.doc_id = f.doc_id WHERE k <= 10""")
def hybrid_search(spark, sf):
    """Both searches over the rows that filters keep, fused, with the rows' cells."""
    docs, vectors = table(spark, sf, "documents"), table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = vectors.where("doc_id % 20 = 0").join(docs.select("doc_id", "text"), "doc_id").withColumnRenamed("doc_id", "query")
    return retrieval.hybrid_each(docs, vectors, queries, filters={"lang": ["en", ""], "source": None}, cells=["source", "n_chars"])


@query(f"""WITH {_DENSE}, v AS (SELECT query, vec_id, round(1 - distance, 6) AS score FROM d), c AS (SELECT query, count(*) FILTER (WHERE score >= 0.9) AS a, count(*) FILTER (WHERE score >= 0.5) AS b, count(*) FILTER (WHERE score >= 0.1) AS c FROM v GROUP BY query),
    t AS (SELECT query, CASE WHEN a >= 22 THEN 0.9 WHEN b >= 22 THEN 0.5 WHEN c >= 22 THEN 0.1 END AS cut FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS k FROM v)
    SELECT k.query, vec_id, score FROM k JOIN t ON t.query = k.query WHERE CASE WHEN cut IS NULL THEN k <= 22 ELSE score >= cut END""")
def relaxed_threshold(spark, sf):
    return retrieval.above_each(table(spark, sf, "embeddings"), _asked(spark, sf), enough=22, cuts=(0.9, 0.5, 0.1))


@query(f"""WITH {_SETS}, s AS (SELECT q.doc_id AS query, d.doc_id, len(list_intersect(d.w, q.w)) AS n, len(d.w) + len(q.w) AS m FROM t d, t q WHERE q.doc_id % 20 = 0), r AS (SELECT query, doc_id, round(n::DOUBLE / (m - n), 6) AS score FROM s WHERE n > 0)
    SELECT query, doc_id, score, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS k FROM r) WHERE k <= 20""")
def jaccard_rerank(spark, sf):
    docs = table(spark, sf, "documents")
    return retrieval.jaccard_each(docs, docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query"), "text"), 20)


@query("""WITH a AS (SELECT doc_id, n_chars AS score, 0 AS stage FROM documents WHERE lang = 'fr' AND doc_id % 7 = 0 ORDER BY n_chars DESC, doc_id LIMIT 14), b0 AS (SELECT doc_id, n_chars AS score, 1 AS stage FROM documents WHERE lang = 'fr' ORDER BY n_chars DESC, doc_id LIMIT 20),
    b AS (SELECT * FROM a UNION ALL SELECT * FROM b0 WHERE (SELECT count(*) FROM a) < 22 AND doc_id NOT IN (SELECT doc_id FROM a)), c0 AS (SELECT doc_id, n_chars AS score, 2 AS stage FROM documents ORDER BY n_chars DESC, doc_id LIMIT 44)
    SELECT doc_id, score, CAST(stage AS INTEGER) AS stage FROM b UNION ALL SELECT doc_id, score, CAST(stage AS INTEGER) FROM c0 WHERE (SELECT count(*) FROM b) < 22 AND doc_id NOT IN (SELECT doc_id FROM b)""")
def relaxed_filters(spark, sf):
    docs = table(spark, sf, "documents").withColumn("score", F.col("n_chars"))
    narrow = retrieval.where({"lang": "fr"})
    return retrieval.relaxed_filters(docs, [(narrow & (F.col("doc_id") % 7 == 0), 14), (narrow, 20), (retrieval.where({}), 44)], enough=22)


_PLACED = "p AS (SELECT vec_id, embedding, lang, source FROM embeddings JOIN documents ON doc_id = vec_id), q AS (SELECT vec_id AS query, embedding, lang, source FROM p WHERE vec_id % 20 = 0), x AS (SELECT query, p.vec_id, round(1 - round(1 - list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6), 6) AS score, round(1 - list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS d, p.lang = q.lang AS l, p.source = q.source AS s FROM p, q)"
_TOP = lambda where, k: f"(SELECT query, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS k FROM x WHERE {where}) WHERE k <= {k})"


@query(f"""WITH {_PLACED}, a AS {_TOP('l AND s', 14)}, an AS (SELECT query, count(*) AS n FROM a GROUP BY query), b0 AS {_TOP('l', 20)},
    b AS (SELECT *, 0 AS stage FROM a UNION ALL SELECT b0.*, 1 FROM b0 LEFT JOIN an ON an.query = b0.query WHERE coalesce(n, 0) < 22 AND NOT EXISTS (SELECT 1 FROM a WHERE a.query = b0.query AND a.vec_id = b0.vec_id)),
    bn AS (SELECT query, count(*) AS n FROM b GROUP BY query), c0 AS {_TOP('TRUE', 44)}
    SELECT query, vec_id, score, stage FROM b UNION ALL SELECT c0.*, 2 FROM c0 LEFT JOIN bn ON bn.query = c0.query WHERE coalesce(n, 0) < 22 AND NOT EXISTS (SELECT 1 FROM b WHERE b.query = c0.query AND b.vec_id = c0.vec_id)""")
def relaxed_search(spark, sf):
    """Every request by its own language and source, then by its language, then by nothing."""
    rows = table(spark, sf, "embeddings").join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source"), "vec_id")
    asked = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query")
    return retrieval.relaxed_search(rows, asked, [(["lang", "source"], 14), (["lang"], 20), ([], 44)], enough=22)


@query(f"""WITH {_DENSE}, n AS (SELECT query, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS k FROM d WHERE vec_id <> query) WHERE k <= 40), {_SETS},
    s AS (SELECT n.query, n.vec_id AS doc_id, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS m FROM n JOIN t a ON a.doc_id = n.query JOIN t b ON b.doc_id = n.vec_id), r AS (SELECT query, doc_id, round(i::DOUBLE / greatest(m - i, 1), 6) AS score FROM s),
    k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS k FROM r), p AS (SELECT *, row_number() OVER (ORDER BY query, k) AS n FROM k WHERE k <= 8)
    SELECT 'RR-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS proposal_id, query, doc_id AS pid, score FROM p""")
def second_search(spark, sf):
    """Other evidence for each request: forty neighbours, the eight of them that share most words, numbered through."""
    docs, asked = table(spark, sf, "documents"), _asked(spark, sf)
    near = retrieval.nearest_each(table(spark, sf, "embeddings"), asked, 41).where("vec_id != query")
    kept = near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).where("place <= 40").select("query", F.col("vec_id").alias("doc_id"))
    texts = asked.select("query").join(docs.select(F.col("doc_id").alias("query"), "text"), "query")
    best = retrieval.reranked(kept, docs, texts, 8)
    return evidence.numbered_proposals(best.withColumnRenamed("doc_id", "pid"))


@query("""WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 16), 112)) AS start FROM d)
    SELECT doc_id, CAST(start // 112 AS INTEGER) AS chunk, CAST(len(w[start + 1 : start + 128]) AS INTEGER) AS n_tokens, array_to_string(w[start + 1 : start + 128], ' ') AS chunk_text FROM s""")
def overlap_windows(spark, sf):
    return retrieval.token_windows(table(spark, sf, "documents"), size=128, overlap=16)


@query(f"""WITH {BOM}, r AS (SELECT *, CAST(count(*) FILTER (WHERE level = 1) OVER (PARTITION BY doc ORDER BY row_no) AS BIGINT) AS run FROM bom), b AS (SELECT *, CAST((row_number() OVER (PARTITION BY doc, run ORDER BY row_no) - 1) // 4 AS INTEGER) AS block FROM r)
    SELECT doc, row_no, run, block, CAST(dense_rank() OVER (PARTITION BY doc ORDER BY run, block) - 1 AS INTEGER) AS chunk_seq FROM b""")
def assembly_chunks(spark, sf):
    return retrieval.chunk_sequence(bom_rows(spark, sf), size=4).select("doc", "row_no", "run", "block", "chunk_seq")


@query(f"""WITH {BOM} SELECT doc, CAST(row_no AS BIGINT) AS row_no, l1, base_no, new_no, chg, rsn FROM (SELECT doc, row_no, last_value(CASE WHEN level = 1 THEN part_no END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY row_no) AS l1, base_no, new_no, point AS chg, reason AS rsn, level FROM bom) WHERE level > 1 AND l1 IS NOT NULL""")
def packaged_line_parser(spark, sf):
    rows = bom_rows(spark, sf)
    line = F.when(F.col("level") == 1, F.concat(F.lit("[L1] "), "part_no", F.lit(" | Desc="), "name")).otherwise(
        F.concat(F.lit("- L1:x > L2:y | Base="), "base_no", F.lit(" New="), "new_no", F.lit(" | "), "name", F.lit(" | CHG="), "point", F.lit(" | RSN="), "reason")
    )
    parsed = retrieval.parsed_lines(rows.select("doc", "row_no", line.alias("line")), doc_id="doc", line_no="row_no").where("l1 != ''")
    return parsed.select("doc", "row_no", "l1", "base_no", "new_no", F.col("change").alias("chg"), F.col("reason").alias("rsn"))


@query("""WITH k(query, position, word) AS (VALUES ('a', 0, 'ring'), ('a', 1, 'red'), ('b', 0, 'Widget')) SELECT query, p_brand, p_name, CAST(min(position) AS INTEGER) AS position FROM part JOIN k ON contains(lower(p_name), lower(word)) GROUP BY query, p_partkey, p_brand, p_name""")
def keyword_candidates(spark, sf):
    words = spark.createDataFrame([("a", 0, "ring"), ("a", 1, "red"), ("b", 0, "Widget")], "query string, position int, word string")
    return match.keyword_candidates(table(spark, sf, "part").select("p_brand", "p_name"), words, "p_name")  # rows repeat


@query(f"WITH {BOM} SELECT b.part_no AS text, CAST(p_partkey AS VARCHAR) AS pattern FROM bom b JOIN part ON contains(b.part_no, CAST(p_partkey AS VARCHAR))")
def substring_matches(spark, sf):
    """As many patterns as rows: which numbers hold which keys."""
    keys = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("key"))
    return contains.holding(bom_rows(spark, sf), keys, "part_no", "key")


_ILIKE = "'%' || right('000' || CAST(row_no AS VARCHAR), 3) || '%' || replace(upper(name), ' ', '_') || '%'"


@query(f"""WITH {BOM}, t AS (SELECT DISTINCT concat_ws(' | ', doc, part_no, name, point) AS text FROM bom), p AS (SELECT DISTINCT {_ILIKE} AS pattern FROM bom)
    SELECT text, pattern FROM t JOIN p ON text ILIKE pattern""")
def ilike_matches(spark, sf):
    """A pattern from each row, against all rows."""
    rows = bom_rows(spark, sf)
    patterns = rows.select(F.expr(_ILIKE.replace("VARCHAR", "STRING")).alias("pattern"))
    return contains.matching(rows.select(F.concat_ws(" | ", "doc", "part_no", "name", "point").alias("text")), patterns, "text", "pattern")


@query("""SELECT p_partkey, CASE WHEN contains(p_name, 'ring') OR contains(p_name, 'bolt') THEN 'fastening' WHEN contains(p_name, 'red') THEN 'colour' WHEN contains(p_name, 'i') THEN 'other' END AS rule FROM part""")
def first_rule_match(spark, sf):
    return match.first_rule(table(spark, sf, "part").select("p_partkey", "p_name"), [(["ring", "bolt"], "fastening"), (["red"], "colour"), (["i"], "other")], F.col("p_name")).select("p_partkey", "rule")


@query("""WITH l AS (SELECT p_partkey, p_name AS described FROM part), r AS (SELECT n_nationkey AS ord, lower(substr(n_name, 1, 2)) AS l1 FROM nation) SELECT described, CAST(min(ord) AS INTEGER) AS ord, arg_min(l1, ord) AS l1 FROM l LEFT JOIN r ON contains(described, l1) OR contains(l1, described) GROUP BY p_partkey, described""")
def assembly_by_substring(spark, sf):
    left = table(spark, sf, "part").select(F.col("p_name").alias("described"))  # rows repeat
    right = table(spark, sf, "nation").select(F.col("n_nationkey").alias("ord"), F.lower(F.substring("n_name", 1, 2)).alias("l1"))
    return match.either_contains(left, right, "described", "l1", order="ord")


@query("""WITH t AS (SELECT item_id, unnest(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9가-힣\\s]+', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> ''))) AS w FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9가-힣\\s]+', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> ''))) AS w FROM documents),
    s AS (SELECT item_id, doc_id, count(*) AS score FROM t JOIN d USING (w) GROUP BY item_id, doc_id HAVING count(*) >= 3) SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s) WHERE k = 1""")
def best_by_tokens(spark, sf):
    return match.best_by_tokens(table(spark, sf, "benchmark"), table(spark, sf, "documents"), left_id="item_id", right_id="doc_id", least=3)


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 40)
    SELECT doc_id, CAST(min(stage) AS INTEGER) AS stage, CAST(arg_min(rank, stage) AS INTEGER) AS rank FROM (SELECT *, 0 AS stage FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY doc_id""")
def first_seen_union(spark, sf):
    d = table(spark, sf, "documents")
    a = d.orderBy(F.desc("n_chars"), "doc_id").limit(30).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")))
    b = d.where("lang = 'en'").orderBy("doc_id").limit(40).withColumn("rank", F.row_number().over(Window.orderBy("doc_id")))
    return retrieval.first_seen([a, b])


@query("SELECT item_id, CAST(len(list_intersect(a, b)) AS INTEGER) AS shared FROM (SELECT item_id, list_distinct(string_split(lower(regexp_replace(text, '[^A-Za-z ]', '', 'g')), ' ')) AS a, ['the', 'of', 'and', 'on'] AS b FROM benchmark)")
def token_overlap(spark, sf):
    a = tokens(F.regexp_replace("text", "[^A-Za-z ]", ""))
    return table(spark, sf, "benchmark").select("item_id", F.size(F.array_intersect(a, F.array(*map(F.lit, ["the", "of", "and", "on"])))).alias("shared"))
