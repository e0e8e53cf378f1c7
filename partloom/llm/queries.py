"""The queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.llm import exact, filter_audit, line_dedup, media, minhash, mixing, ngram_join, packing, periodic, quality, substring, toxicity, warc
from partloom.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("tkey")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.text_pictures(table(spark, sf_dir, "documents")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_through_warc(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_lines", "n_removed", "text")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("tkey")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents")).drop("component_size")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(periodic.plant_runs(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_media_columns": op4_media_columns,
    "op5_warc": op5_warc,
    "op6_packing": op6_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_minhash": op8_minhash,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_ngram_join": op11_ngram_join,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL = {
    "op5_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
        ), d AS (
            SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, hex,
                   array_to_string(list_transform(range(0, 32), lambda i:
                       substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                              1 + CAST(((('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5))::BIGINT
                                        >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest
            FROM p
        ), m AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to, CAST(NULL AS VARCHAR) AS error
        FROM m""",
    "op7_line_dedup": r"""
        WITH d AS (
            SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
        ), w AS (
            SELECT doc_id, pos, lines[pos + 1] || chr(10) || lines[pos + 2] || chr(10) || lines[pos + 3] AS w
            FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS pos FROM d WHERE len(lines) >= 3)
        ), r AS (
            SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k
            FROM w WHERE regexp_matches(w, '\S')
        ), c AS (
            SELECT DISTINCT doc_id, pos + o AS line FROM r, (VALUES (0), (1), (2)) AS t(o) WHERE k > 1
        ), k AS (
            SELECT doc_id, list(line) AS gone FROM c GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS BIGINT) AS n_lines,
               CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_transform(
                   list_filter(range(0, len(lines)), lambda i: NOT list_contains(gone, i)), lambda i: lines[i + 1]), chr(10)), '')
               END AS text
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op9_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), w AS (
            SELECT doc_id, start, array_to_string(words[start + 1 : start + 20], ' ') AS w
            FROM (SELECT doc_id, words, unnest(range(0, len(words) - 19)) AS start FROM d WHERE len(words) >= 20)
        ), r AS (
            SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY w ORDER BY doc_id, start) AS k FROM w)
            WHERE k > 1
        ), c AS (
            SELECT doc_id, list(DISTINCT place) AS gone FROM (SELECT doc_id, unnest(range(start, start + 20)) AS place FROM r) GROUP BY doc_id
        ), f AS (
            SELECT doc_id, pos, words[pos + 1] AS word
            FROM (SELECT doc_id, words, unnest(range(0, len(words))) AS pos FROM d) AS x
        ), k AS (
            SELECT f.doc_id, string_agg(word, ' ' ORDER BY pos) AS kept
            FROM f ANTI JOIN (SELECT doc_id, unnest(gone) AS pos FROM c) AS g ON f.doc_id = g.doc_id AND f.pos = g.pos
            GROUP BY f.doc_id
        )
        SELECT d.doc_id, len(words) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op10_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
        )
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)""",
    "op11_ngram_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), s AS (
            SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
                       WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                       ELSE list_distinct(list_transform(range(0, len(words) - 2), lambda i: words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3]))
                       END) AS shingle
            FROM w
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), both_sides AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
            FROM s AS x JOIN s AS y ON x.shingle = y.shingle AND x.doc_id != y.doc_id
            GROUP BY x.doc_id, y.doc_id
        ), links AS (
            SELECT a, b FROM both_sides JOIN n AS x ON a = x.doc_id JOIN n AS y ON b = y.doc_id
            WHERE 100 * k >= 90 * (x.n + y.n - k)
        ), reach(doc_id, b) AS (
            SELECT doc_id, doc_id FROM documents
            UNION
            SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.b = links.a
        )
        SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id
        FROM w LEFT JOIN n ON w.doc_id = n.doc_id
        JOIN (SELECT doc_id, min(b) AS component_id FROM reach GROUP BY doc_id) AS r ON w.doc_id = r.doc_id""",
    "op12_periodic_runs": r"""
        WITH b AS (
            SELECT doc_id, coalesce(text, '') AS text, list_concat([4294967295], flatten(list_transform(
                       string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0]))) AS bits
            FROM documents
        ), h AS (
            SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
                   xor(CAST(list_reduce(bits, lambda s, x: xor(xor(s, x) >> 1, 3988292384 * (xor(s, x) & 1))) AS BIGINT), 4294967295) AS h
            FROM b
        ), g AS (
            SELECT doc_id, words, len(words) AS n, h % 10 = 0 AND len(words) > 0 AS planted,
                   CASE WHEN len(words) > 0 THEN (h // 10) % len(words) ELSE 0 END AS a, 3 + (h // 10) % 8 AS parts
            FROM h
        ), w AS (
            SELECT doc_id, n, i, words[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % (1 + (n - a) // parts) ELSE i END] AS word
            FROM (SELECT *, unnest(range(0, n)) AS i FROM g)
        ), e AS (
            SELECT x.doc_id, y.i - x.i AS period, x.i
            FROM w AS x JOIN w AS y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
        ), s AS (
            SELECT doc_id, period, i, i - row_number() OVER (PARTITION BY doc_id, period ORDER BY i) AS island FROM e
        ), r AS (
            SELECT doc_id, start, length, min(period) AS period
            FROM (SELECT doc_id, period, min(i) AS start, count(*) + period AS length FROM s GROUP BY doc_id, period, island)
            WHERE length >= greatest(6, 4 * period)
            GROUP BY doc_id, start, length
        ), f AS (
            SELECT doc_id, count(*) AS n_runs,
                   string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said,
                   min({'less': -(CAST(length AS DOUBLE) / period), 'start': start, 'period': period, 'length': length}) AS best
            FROM r GROUP BY doc_id
        ), k AS (
            SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS kept
            FROM w ANTI JOIN (
                SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r
            ) AS c ON w.doc_id = c.doc_id AND w.i = c.i
            GROUP BY w.doc_id
        )
        SELECT g.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
               1000 * best.length // best.period AS exponent_milli,
               sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM g LEFT JOIN f ON g.doc_id = f.doc_id LEFT JOIN k ON g.doc_id = k.doc_id""",
    "op13_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), l AS (
            SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id
        ), f AS (
            SELECT doc_id, part,
                   CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
                   || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
                   || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 'C' ELSE '' END
                   || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
                   || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
            FROM d
        ), c AS (
            SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
            FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY ALL
        ), x(l) AS (
            VALUES ('A'), ('B'), ('C'), ('D'), ('E')
        ), o AS (
            SELECT v.l || w.l || x.l || y.l || z.l AS filter_order
            FROM x AS v, x AS w, x, x AS y, x AS z
            WHERE len(list_distinct([v.l, w.l, x.l, y.l, z.l])) = 5
        ), s AS (
            SELECT part, fails, good, toxic, n, filter_order, step, substr(filter_order, step, 1) AS letter,
                   CASE WHEN fails = '' THEN 6
                        ELSE list_min(list_transform(string_split(fails, ''), lambda i: instr(filter_order, i))) END AS first
            FROM c, o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)
        ), r AS (
            SELECT part, filter_order, step, letter,
                   sum(CASE WHEN first > step THEN n ELSE 0 END) AS kept,
                   sum(CASE WHEN first = step THEN n ELSE 0 END) AS removed,
                   sum(CASE WHEN first < step AND contains(fails, letter) THEN n ELSE 0 END) AS redundant,
                   sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
                   sum(CASE WHEN first = step AND good THEN n ELSE 0 END) AS good_lost,
                   sum(CASE WHEN first = step AND toxic THEN n ELSE 0 END) AS toxic_lost
            FROM s GROUP BY part, filter_order, step, letter
        )
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
               CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
        FROM r""",
}
