"""Bill-of-materials rows derived from the driver's part table, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.plans.registry import table

_CLASSES = ["Common", "Change", "Chainging", "NEW", "Delet", "공통"]
_POINTS = ["구조 변경", "-", "Spec 변경 (2000W → 950W)", "", "카메라 모듈 적용", "포장 사이즈 축소"]
_REASONS = ["제품 치수 변경에 따른 구조 변경", "-", "N/A", "카메라 모듈 개발", "도어 무게 변경으로 인한 힌지 변경", ""]


def bom_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, row_no, level, raw_level, part_no, name, part_type, base_no, new_no, class, point, reason, qty."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    no = F.concat(F.lit("AEC"), F.lpad(k.cast("string"), 8, "0"))
    level = (1 + F.col("p_size") % 6).cast("int")
    pick = lambda words, by: F.get(F.array(*map(F.lit, words)), (by % len(words)).cast("int"))
    new = pick(["←", "X", "-", "", "=", "NEW", "NEW"], k)
    return p.select(
        F.col("p_brand").alias("doc"), k.alias("row_no"), level.alias("level"), F.concat(F.repeat(F.lit("."), level), level.cast("string")).alias("raw_level"),
        no.alias("part_no"), F.col("p_name").alias("name"), F.col("p_type").alias("part_type"), F.when(k % 11 == 0, "-").otherwise(no).alias("base_no"),
        F.when(new == "=", no).when(new == "NEW", F.concat(F.lit("NEW"), F.lpad(k.cast("string"), 8, "0"))).otherwise(new).alias("new_no"),
        pick(_CLASSES, k).alias("class"), pick(_POINTS, k + F.col("p_size")).alias("point"), pick(_REASONS, k * 5 + F.col("p_size")).alias("reason"),
        pick(["1", "2.0", "1EA", "←", "-", "0.5"], k).alias("qty"),
    )


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


#: The same rows, as the first of a query's common table expressions.
BOM = f"""bom AS (
    SELECT p_brand AS doc, p_partkey AS row_no, CAST(1 + p_size % 6 AS INTEGER) AS level,
           repeat('.', 1 + p_size % 6) || CAST(1 + p_size % 6 AS VARCHAR) AS raw_level,
           'AEC' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS part_no, p_name AS name, p_type AS part_type,
           CASE WHEN p_partkey % 11 = 0 THEN '-' ELSE 'AEC' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') END AS base_no,
           CASE p_partkey % 7 WHEN 0 THEN '←' WHEN 1 THEN 'X' WHEN 2 THEN '-' WHEN 3 THEN ''
                WHEN 4 THEN 'AEC' || lpad(CAST(p_partkey AS VARCHAR), 8, '0')
                ELSE 'NEW' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') END AS new_no,
           ({_list(_CLASSES)})[CAST(p_partkey % 6 AS INTEGER) + 1] AS class,
           ({_list(_POINTS)})[CAST((p_partkey + p_size) % 6 AS INTEGER) + 1] AS point,
           ({_list(_REASONS)})[CAST((p_partkey * 5 + p_size) % 6 AS INTEGER) + 1] AS reason,
           (['1', '2.0', '1EA', '←', '-', '0.5'])[CAST(p_partkey % 6 AS INTEGER) + 1] AS qty
    FROM part
)"""

#: Depth and parent by stack, found by walking the rows one by one.
STACK = """ordered AS (
    SELECT *, row_number() OVER (PARTITION BY doc ORDER BY row_no) AS rn FROM bom
), walked AS (
    SELECT doc, rn, row_no, level, 1 AS depth FROM ordered WHERE rn = 1
    UNION ALL
    SELECT o.doc, o.rn, o.row_no, o.level, least(o.level, w.depth + 1) FROM walked w JOIN ordered o ON o.doc = w.doc AND o.rn = w.rn + 1
), stack AS (
    SELECT w.doc, w.row_no, w.level, w.depth,
           (SELECT max(a.row_no) FROM walked a WHERE a.doc = w.doc AND a.row_no < w.row_no AND a.depth = w.depth - 1) AS parent
    FROM walked w
)"""

#: All rows above each row, by climbing.
CLIMB = """climb AS (
    SELECT doc, row_no, row_no AS ancestor, 0 AS distance FROM stack
    UNION ALL
    SELECT c.doc, c.row_no, s.parent, c.distance + 1 FROM climb c JOIN stack s ON s.doc = c.doc AND s.row_no = c.ancestor WHERE s.parent IS NOT NULL
)"""

#: The graph's kind of change and effective number.
KINDS = """kinds AS (
    SELECT *, CASE WHEN lower(class) LIKE '%common%' OR class LIKE '%공통%' THEN 'Common' WHEN lower(class) LIKE '%change%' OR class LIKE '%변경%' THEN 'Change'
                   WHEN lower(class) LIKE '%delete%' OR class LIKE '%삭제%' THEN 'Delete'
                   WHEN lower(class) = 'new' OR class LIKE '%신규%' OR class LIKE '%추가%' THEN 'New' ELSE class END AS kind,
           base_no NOT IN ('', '-', 'X', 'x', '←', 'nan', 'None') AS base_ok, new_no NOT IN ('', '-', 'X', 'x', '←', 'nan', 'None') AS new_ok
    FROM bom
), lines AS (
    SELECT *, CASE WHEN new_no = '←' THEN CASE WHEN base_ok THEN base_no ELSE '' END WHEN upper(new_no) = 'X' THEN ''
                   WHEN kind IN ('Change', 'New') AND new_ok THEN new_no WHEN new_ok AND NOT base_ok THEN new_no WHEN base_ok THEN base_no ELSE '' END AS effective_no,
           doc || ':line:' || row_no AS line_id
    FROM kinds
), changes AS (
    SELECT *, line_id || ':change' AS change_id,
           CASE WHEN kind = 'Delete' THEN base_no WHEN kind IN ('Change', 'New') AND new_ok THEN new_no ELSE effective_no END AS direct_no
    FROM lines WHERE kind IN ('Change', 'New', 'Delete')
)"""


def part_id_sql(c: str) -> str:
    return f"'part:' || substr(sha1(upper(regexp_replace({c}, '\\s+', '', 'g'))), 1, 20)"
