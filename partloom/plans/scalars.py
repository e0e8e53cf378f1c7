"""Queries over scalar functions and classifiers, on rows that hold every odd spelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.functions import levels, models, text
from partloom.operators import classify as c
from partloom.plans.bom import BOM, bom_rows
from partloom.plans.registry import any_of, first_of, query, table

_ODD = ["  Conv. Motor  ASSY ", "nan", "", "A B　C", "EAU65078502 / 카메라 모듈 적용", "abc-12.3 x", "M1 / D (사우디)", "EBR12345678;AGM00000001", "←", "X", "도어 frame, LED", "None"]
_LIST = "[" + ", ".join("'" + w + "'" for w in _ODD) + "]"
_V = f"v AS (SELECT p_partkey AS id, ({_LIST})[CAST(p_partkey % 12 AS INTEGER) + 1] || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' ' || p_name END AS x FROM part)"
_SQ = "trim(regexp_replace({0}, '[\\s 　]+', ' ', 'g'))"


def _odd(spark, sf):
    p = table(spark, sf, "part")
    word = F.get(F.array(*map(F.lit, _ODD)), (F.col("p_partkey") % 12).cast("int"))
    return p.select(F.col("p_partkey").alias("id"), F.concat(word, F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit(" "), "p_name"))).alias("x"))


@query(f"""WITH {_V}, s AS (SELECT id, x, {_SQ.format('x')} AS sq FROM v), c AS (SELECT *, CASE WHEN lower(sq) = 'nan' THEN '' ELSE sq END AS cl FROM s) SELECT id, nullif(sq, '') AS cell,
    regexp_replace(lower(x), '[^0-9a-z가-힣]+', '', 'g') AS header_key, regexp_replace(upper(x), '[^A-Z0-9가-힣]', '', 'g') AS header_norm, lower(cl) AS key, upper(replace(cl, ' ', '')) AS part_no,
    regexp_replace(upper(x), '[^A-Z0-9]', '', 'g') AS part_no_strict, trim(regexp_replace(regexp_replace(upper(sq), '[^A-Z0-9가-힣 ]', '', 'g'), ' +', ' ', 'g')) AS name_key, upper(sq) AS merge_text,
    substr(sha1(x), 1, 20) AS short, md5(x) AS row_id FROM c""")
def text_normalisers(spark, sf):
    x = F.col("x")
    return _odd(spark, sf).select(
        "id", text.clean_cell(x).alias("cell"), text.header_key(x).alias("header_key"), text.header_norm(x).alias("header_norm"), text.key(x).alias("key"), text.part_no(x).alias("part_no"),
        text.part_no_strict(x).alias("part_no_strict"), text.name_key(x).alias("name_key"), text.merge_text(x).alias("merge_text"), text.short_hash(x, 20).alias("short"), text.row_id(x).alias("row_id"),
    )


@query(f"""WITH {_V}, u AS (SELECT id, x, list_distinct(regexp_extract_all(upper(x), '\\b[A-Z0-9]{{8,14}}\\b')) AS nos FROM v)
    SELECT id, array_to_string(list_sort(nos), ',') AS candidates, len(nos) AS n_candidates,
    CASE WHEN instr(x, '/') > 0 THEN nullif(trim({_SQ.format("split_part(x, '/', 1)")}), '') ELSE nullif({_SQ.format('x')}, '') END AS model,
    CASE WHEN instr(x, '/') > 0 THEN nullif(trim(regexp_replace(substr({_SQ.format('x')}, instr({_SQ.format('x')}, '/') + 1), '\\(.+?\\)', '', 'g')), '') END AS grade FROM u""")
def part_number_extraction(spark, sf):
    x = F.col("x")
    nos = text.part_no_candidates(x)
    model, grade = text.model_and_grade(x)
    return _odd(spark, sf).select("id", F.array_join(F.array_sort(nos), ",").alias("candidates"), F.size(nos).cast("long").alias("n_candidates"), model.alias("model"), grade.alias("grade"))


@query("""WITH d AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9가-힣\\s]+', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> ''))) AS w FROM documents)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM d""")
def token_sets(spark, sf):
    w = F.array_sort(text.tokens(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.md5(F.array_join(w, " ")).alias("tokens_md5"))


@query("""WITH p AS (SELECT o_orderkey AS id, o_orderpriority || '/' || o_orderstatus || ' \\ ' || (o_custkey % 7) AS x FROM orders), s AS (SELECT id, list_transform(string_split(replace(replace(x, '/', '>'), '\\', '>'), '>'), lambda t: trim(t)) AS t FROM p)
    SELECT id, array_to_string(t, ' > ') AS path, array_to_string(list_transform(range(1, len(t) + 1), lambda i: array_to_string(t[1:i], ' > ')), '|') AS prefixes FROM s""")
def path_normaliser(spark, sf):
    x = F.concat("o_orderpriority", F.lit("/"), "o_orderstatus", F.lit(" \\ "), (F.col("o_custkey") % 7).cast("string"))
    p = text.path(x)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), p.alias("path"), F.array_join(text.path_prefixes(p), "|").alias("prefixes"))


@query(f"""WITH {BOM} SELECT doc, row_no, level AS by_dots, level AS by_digits, level AS lenient, CASE qty WHEN '1' THEN '1' WHEN '2.0' THEN '2' ELSE qty END AS qty,
    CAST(CASE qty WHEN '1' THEN 1.0 WHEN '2.0' THEN 2.0 WHEN '1EA' THEN 1.0 WHEN '0.5' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS number, CASE qty WHEN '1' THEN 1 WHEN '2.0' THEN 2 WHEN '0.5' THEN 0 END AS whole,
    (['O', 'X', NULL, 'O', 'X', '?'])[CAST(row_no % 6 AS INTEGER) + 1] AS flag FROM bom""")
def levels_and_quantities(spark, sf):
    raw, q = F.col("raw_level"), F.col("qty")
    flag = F.get(F.array(*map(F.lit, ["○", "x", " - ", "Yes", "✕", "?!"])), (F.col("row_no") % 6).cast("int"))
    return bom_rows(spark, sf).select(
        "doc", "row_no", levels.depth_by_dots(raw).alias("by_dots"), levels.depth_by_digits(raw).alias("by_digits"), levels.depth_lenient(raw).alias("lenient"), levels.qty(q).alias("qty"),
        levels.number_in(q).alias("number"), levels.to_int(q).alias("whole"), levels.yes_no(flag).alias("flag"),
    )


_CODES = ["WSED7613B", "KWS9D7652WM", "cLSEL6335XE", "MCD1234567", "W12345678", "LW123456789Z", "short", ""]
_CLIST = "[" + ", ".join(f"'{w}'" for w in _CODES) + "]"


@query(f"""WITH t AS (SELECT c_custkey AS id, ({_CLIST})[CAST(c_custkey % 8 AS INTEGER) + 1] AS x, (['D', 'C', 'B', ''])[CAST(c_custkey % 4 AS INTEGER) + 1] AS g FROM customer),
    s AS (SELECT *, CASE WHEN regexp_matches(upper(x), '^[KC][WL]') THEN substr(upper(x), 2) ELSE upper(x) END AS b FROM t),
    k AS (SELECT *, CASE WHEN NOT regexp_matches(b, '^[WL]') OR length(b) < 9 THEN '' WHEN length(b) = 9 THEN b ELSE substr(b, 1, 8) || right(b, 1) END AS core FROM s)
    SELECT id, core, CASE WHEN regexp_matches(upper(x), '^[KC][WL]') THEN substr(upper(x), 1, 1) ELSE '' END AS channel, CASE WHEN length(core) <> 9 THEN core WHEN g = 'D' THEN substr(core, 1, 7) WHEN g = 'C' THEN substr(core, 1, 6) ELSE substr(core, 1, 4) END AS prefix,
    CASE WHEN length(core) = 9 THEN substr(core, 5, 2) END AS capacity, core AS found FROM k""")
def model_codes(spark, sf):
    x = F.get(F.array(*map(F.lit, _CODES)), (F.col("c_custkey") % 8).cast("int"))
    g = F.get(F.array(*map(F.lit, ["D", "C", "B", ""])), (F.col("c_custkey") % 4).cast("int"))
    core = models.core9(x)
    found = models.model_code(F.concat(F.lit("[model] "), x, F.lit(" (new)")))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), core.alias("core"), models.channel(x).alias("channel"), models.search_prefix(core, g).alias("prefix"), models.places(core)["capacity"].alias("capacity"), found.alias("found"))


@query(f"""WITH {BOM} SELECT doc, row_no, CASE WHEN new_no IN ('X', '←', '-', '?') THEN 'marker' WHEN length(reason) > 5 AND reason NOT IN ('-', '_', '/', 'N/A') THEN 'change_history' ELSE 'bom_entry' END AS row_kind,
    CASE class WHEN 'Change' THEN 'Changing' WHEN 'Chainging' THEN 'Changing' WHEN 'Delet' THEN 'Delete' ELSE class END AS classification,
    CASE WHEN class IN ('Common', '공통') THEN 'Common' WHEN class = 'NEW' THEN 'New' ELSE class END AS graph_class,
    CASE WHEN new_no = '←' THEN 'COMMON' WHEN new_no = 'X' THEN 'DELETE' WHEN new_no NOT IN ('', '-') AND base_no = '-' THEN 'NEW' WHEN new_no NOT IN ('', '-') AND new_no <> base_no THEN 'CHANGE' ELSE 'COMMON' END AS design_class,
    CASE WHEN point LIKE '%카메라%' OR reason LIKE '%카메라%' THEN 'E' WHEN reason LIKE '%도어%' THEN 'M' ELSE 'U' END AS domain,
    CASE WHEN point LIKE '%카메라%' THEN 'CAMERA' ELSE '' END AS feature,
    CASE WHEN reason IN ('', '-', 'N/A') AND point IN ('', '-') THEN 'EXCLUDE' WHEN reason LIKE '%카메라%' OR point LIKE '%카메라%' THEN 'CORE' WHEN reason LIKE '%도어%' THEN 'CASCADE' ELSE 'EXCLUDE' END AS tier FROM bom""")
def row_classifiers(spark, sf):
    k, new, base, why, what = (F.col(x) for x in ("class", "new_no", "base_no", "reason", "point"))
    return bom_rows(spark, sf).select(
        "doc", "row_no", c.row_kind(new, why).alias("row_kind"), c.classification(k).alias("classification"), c.graph_classification(k).alias("graph_class"), c.design_classification(base, new).alias("design_class"),
        c.domain(F.lit(""), what, why).alias("domain"), c.feature(what).alias("feature"), c.tier(why, F.lit(""), what, ["카메라", "camera"], ["도어", "door"]).alias("tier"),
    )


_FILES = ["북유럽_A.xlsx", "유럽 B.xlsx", "UAE 120V 60Hz.xlsx", "호주.xlsx", "x.xlsx", "그리스 CIS.xlsx"]
_FLIST = "[" + ", ".join(f"'{w}'" for w in _FILES) + "]"


@query(f"""WITH f AS (SELECT s_suppkey AS id, ({_FLIST})[CAST(s_suppkey % 6 AS INTEGER) + 1] || CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' 북미' WHEN 2 THEN ' 230V' ELSE ' ' || s_name END AS x FROM supplier), l AS (SELECT *, lower(x) AS low FROM f),
    t AS (SELECT *, CASE WHEN {any_of('low', c.US_WORDS)} AND {any_of('low', c.EU_WORDS)} THEN 'GLOBAL' WHEN {any_of('low', c.US_WORDS)} THEN 'US' WHEN {any_of('low', c.EU_WORDS)} THEN 'EU' ELSE 'UNKNOWN' END AS tag FROM l)
    SELECT id, {first_of('x', [(label, [word]) for word, label in c.REGIONS], 'NULL')} AS region, tag, CASE tag WHEN 'EU' THEN '유럽' WHEN 'US' THEN '미국' ELSE '글로벌' END AS name, tag <> 'US' AS fits_europe FROM t""")
def regions(spark, sf):
    k = F.col("s_suppkey")
    more = F.when(k % 4 == 0, "").when(k % 4 == 1, " 북미").when(k % 4 == 2, " 230V").otherwise(F.concat(F.lit(" "), "s_name"))
    x = F.concat(F.get(F.array(*map(F.lit, _FILES)), (k % 6).cast("int")), more)
    tag = c.region_tag(x)
    return table(spark, sf, "supplier").select(k.alias("id"), c.region(x).alias("region"), tag.alias("tag"), c.region_name(F.lit(""), x).alias("name"), c.region_fits(F.lit("유럽"), tag).alias("fits_europe"))


_SAID = ["이거 빼줘", "나머지 확정", "왜 이래", "공용으로 해줘", "밑으로 옮겨", "다시 찾아", "추가해", "hello", "도어에 카메라 추가", "led 삭제"]
_SLIST = "[" + ", ".join(f"'{w}'" for w in _SAID) + "]"


@query(f"""WITH t AS (SELECT event_id AS id, lower(({_SLIST})[CAST(event_id % 10 AS INTEGER) + 1] || ' ' || event_type || CASE event_id % 3 WHEN 0 THEN ' Cavity' WHEN 1 THEN ' wire 신규' ELSE '' END) AS x FROM events)
    SELECT id, {first_of('x', c.INTENTS, "'UNKNOWN'")} AS intent, {first_of('x', c.ACTIONS, "'MODIFY'")} AS action, {first_of('x', c.OBJECTS, "''")} AS target_object, {first_of('x', c.MAIN_PARTS, "''")} AS main_part,
    {first_of('x', [('신규', ['신규', '추가', 'new', 'add']), ('삭제', ['삭제', '제거', 'delete', 'remove'])], "'변경'")} AS guess FROM t""")
def intents(spark, sf):
    k = F.col("event_id")
    said = F.get(F.array(*map(F.lit, _SAID)), (k % 10).cast("int"))
    x = F.concat(said, F.lit(" "), "event_type", F.when(k % 3 == 0, " Cavity").when(k % 3 == 1, " wire 신규").otherwise(""))
    return table(spark, sf, "events").select(k.alias("id"), c.user_intent(x).alias("intent"), c.change_intent(x)["action"].alias("action"), c.change_intent(x)["target_object"].alias("target_object"), c.change_intent(x)["main_part"].alias("main_part"), c.guess_change(x).alias("guess"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linestatus WHEN 'O' THEN CASE WHEN l_returnflag = 'R' THEN '' WHEN l_returnflag = 'A' THEN '공용검토' ELSE '신규' END ELSE CASE WHEN l_returnflag = 'R' THEN '' WHEN l_returnflag = 'A' THEN '공용검토' WHEN l_partkey % 2 = 0 THEN '' ELSE '참고품번' END END AS by_base,
    CASE WHEN l_returnflag = 'R' THEN '' WHEN l_linestatus = 'O' THEN '신규' WHEN l_partkey % 3 = 0 THEN '공용검토' ELSE '신규' END AS by_name, CASE l_returnflag WHEN 'R' THEN 'DELETE' WHEN 'A' THEN 'CHANGE' ELSE 'KEEP' END AS bucket FROM lineitem""")
def sourcing(spark, sf):
    flag, has = F.col("l_returnflag"), F.col("l_linestatus") != "O"
    act = F.when(flag == "R", "DELETE").when(flag == "A", "MODIFY").otherwise("KEEP")
    no = F.when(has, "AEC00000001").otherwise("")
    name = F.when(F.col("l_partkey") % 3 == 0, "camera module").otherwise("camera module assy")
    by_name = c.sourcing_by_name(name, no, F.when(flag == "R", "REMOVE").otherwise("ADD"))
    by_base = c.sourcing_by_base(act, F.when(flag == "A", "공용 적용").otherwise(""), no, has & (F.col("l_partkey") % 2 == 0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", by_base.alias("by_base"), by_name.alias("by_name"), c.action_bucket(act).alias("bucket"))


_TYPES = ["MainAssembly", "PCBPart", "CircuitComponentPart", "MaterialPart", "BoxPart", "FastenerPart", "SoftwarePart", "sub assembly x", "", "", "pcbpart", "Manualpart", ""]
_SPECS = ["", "mold a", "Press", "cutting", "Extrusion", "diecasting", "other", "complex 1", "a mold"]
_NOTES = ["", "▲ 상위 Assy 추가", "n"]
_CHANGES = ["추가", "Delete", "", "변경(시방)", "확인", "삭제"]
_SQL_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(f"""WITH v AS (SELECT p_partkey, upper(({_SQL_LIST(_TYPES)})[CAST(p_partkey % 13 AS INTEGER) + 1]) AS t, upper(({_SQL_LIST(_SPECS)})[CAST(p_partkey % 9 AS INTEGER) + 1]) AS s, ({_SQL_LIST(_CHANGES)})[CAST(p_partkey % 6 AS INTEGER) + 1] AS c, ({_SQL_LIST(_NOTES)})[CAST(p_size % 3 AS INTEGER) + 1] AS n, p_size, substr(p_name, 1, 1) AS u FROM part),
    k AS (SELECT *, CASE WHEN contains(t, 'ASSEMBLY') THEN 'Assy' WHEN t = 'PCBPART' THEN '회로' WHEN t = 'CIRCUITCOMPONENTPART' THEN '전장' WHEN t = 'MATERIALPART' THEN '원재료' WHEN t IN ('LABELPART', 'MANUALPART', 'BOXPART') THEN '인쇄물' WHEN t = 'FASTENERPART' THEN '체결' WHEN t = 'SOFTWAREPART' THEN 'S/W'
        WHEN starts_with(s, 'MOLD') THEN '사출' WHEN regexp_matches(s, '^(PRESS|BENDING|COMPLEX)') THEN '판금' WHEN starts_with(s, 'CUTTING') THEN '절삭' WHEN starts_with(s, 'EXTRUSION') THEN '압출' WHEN starts_with(s, 'DIECASTING') THEN '주조' ELSE '기타' END AS part_type FROM v)
    SELECT p_partkey, part_type, CASE WHEN part_type = '사출' THEN '○' ELSE 'X' END AS mold, CASE WHEN c = '추가' THEN 'NEW' WHEN c IN ('삭제', 'Delete') THEN '삭제' WHEN contains(n, '▲ 상위 Assy') THEN CASE WHEN p_size % 2 = 0 THEN 'NEW' ELSE 'Changing' END WHEN c = '변경(시방)' THEN 'Changing' ELSE 'Common' END AS change_type,
    CASE WHEN upper(u) IN ('F', 'P', 'T') THEN '○' WHEN upper(u) IN ('Q', 'D', 'G', 'M', 'R', 'S', 'X') THEN 'X' ELSE '' END AS in_house FROM k""")
def master_columns(spark, sf):
    k = F.col("p_partkey")
    pick = lambda words, by=k: F.get(F.array(*map(F.lit, words)), (by % len(words)).cast("int"))
    kind = c.part_type(pick(_TYPES), pick(_SPECS))
    change = c.change_type(pick(_CHANGES), pick(_NOTES, F.col("p_size")), F.col("p_size") % 2 == 0)
    uit = F.upper(F.substring("p_name", 1, 1))
    return table(spark, sf, "part").select("p_partkey", kind.alias("part_type"), c.mold(kind).alias("mold"), change.alias("change_type"), c.in_house(uit).alias("in_house"))


_CELLS = ["W", "Oven (ex one)", "built-in oven - ", "a very long text that explains itself well", "동일 사업부 기준", "M8", "x.y", "  Oven/Micro wave\t:", "", "30+"]
_CSQL = "[" + ", ".join("'" + w.replace("\t", " ") + "'" for w in _CELLS) + "]"
_PT = "CASE WHEN ({bad}) OR (contains(t, ' ') AND length(t) > 24) OR length(t) > 40 THEN '' ELSE t END"
_BAD = " OR ".join([*(f"contains(upper(t), '{w.upper()}')" for w in text.EXPLAINING_WORDS), *(f"contains(t, '{w}')" for w in text.EXPLAINING_SIGNS)])


@query(f"""WITH v AS (SELECT o_orderkey AS id, ({_CSQL})[CAST(o_orderkey % 10 AS INTEGER) + 1] || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS x FROM orders), t AS (SELECT id, x, trim(regexp_replace(x, '\\s+', ' ', 'g'), ' -:') AS t FROM v)
    SELECT id, {_PT.format(bad=_BAD)} AS product_type, CASE upper(substr(trim(x), 1, 1)) WHEN 'W' THEN 'Built-in Oven' WHEN 'M' THEN 'Microwave Oven' ELSE 'Oven/Microwave' END AS by_model,
    CASE WHEN contains(x, '과전압') OR upper(replace(x, ' ', '')) IN ('O', 'X', '(O,X)', 'OX') THEN TRUE ELSE FALSE END AS noise FROM t""")
def product_types(spark, sf):
    k = F.col("o_orderkey")
    x = F.concat(F.get(F.array(*(F.lit(w.replace("\t", " ")) for w in _CELLS)), (k % 10).cast("int")), F.when(k % 3 == 0, "").otherwise(F.col("o_orderstatus")))
    noise = text.is_noise_change(F.lit(""), x) | text.is_noise_change(x, F.lit(""))
    return table(spark, sf, "orders").select(k.alias("id"), text.product_type(x).alias("product_type"), text.product_by_model(x).alias("by_model"), noise.alias("noise"))


@query(f"""WITH {BOM}, v AS (SELECT row_no, CASE row_no % 4 WHEN 0 THEN raw_level WHEN 1 THEN '*S*' || raw_level WHEN 2 THEN CAST(level AS VARCHAR) ELSE ' ' || raw_level || ' x' END AS x, level FROM bom)
    SELECT row_no, CASE WHEN row_no % 4 = 3 THEN 0 ELSE level END AS by_end, row_no % 4 <> 1 AS working, CASE WHEN row_no % 4 = 0 THEN level ELSE 998 END AS dots, CASE row_no % 4 WHEN 0 THEN level WHEN 1 THEN level WHEN 2 THEN level ELSE level END AS digits FROM v""")
def level_marks(spark, sf):
    k, raw = F.col("row_no"), F.col("raw_level")
    x = F.when(k % 4 == 0, raw).when(k % 4 == 1, F.concat(F.lit("*S*"), raw)).when(k % 4 == 2, F.col("level").cast("string")).otherwise(F.concat(F.lit(" "), raw, F.lit(" x")))
    return bom_rows(spark, sf).select("row_no", levels.depth_or_zero(x).alias("by_end"), levels.is_working_row(x).alias("working"), levels.dot_depth(x).alias("dots"), levels.depth_or_one(F.regexp_replace(x, " x$", "")).alias("digits"))


_SIZES = ["EU", "US", "유럽 2", "Australia"]


@query(f"""WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 5 THEN 'ab' ELSE CAST(c_custkey % 95 AS VARCHAR) END AS cap, ({'[' + ', '.join(f"'{w}'" for w in _SIZES) + ']'})[CAST(c_custkey % 4 AS INTEGER) + 1] AS region, (['W', 'm', 'C', 'X'])[CAST(c_custkey % 4 AS INTEGER) + 1] AS p, (['S', 'T'])[CAST((c_custkey // 4) % 2 AS INTEGER) + 1] AS k FROM customer),
    v AS (SELECT *, CASE WHEN regexp_full_match(cap, '[0-9]+') THEN cap::INT ELSE 0 END AS n, contains(upper(region), 'EU') OR contains(region, '유럽') AS eu FROM c)
    SELECT id, CASE WHEN p = 'W' AND k = 'S' THEN CASE WHEN eu THEN CASE WHEN n BETWEEN 65 AND 80 THEN '24' ELSE 'UNKNOWN' END WHEN n <= 30 THEN '24' WHEN n <= 60 THEN '30' ELSE '30+' END WHEN p = 'm' THEN CASE WHEN n <= 25 THEN 'SMALL' WHEN n <= 32 THEN 'MEDIUM' ELSE 'LARGE' END WHEN p = 'C' AND n > 0 THEN CAST(n AS VARCHAR) ELSE 'UNKNOWN' END AS size,
    CASE WHEN id % 3 = 0 THEN CAST(10 + n % 90 AS INTEGER) WHEN id % 3 = 1 AND n IN (24, 30, 27, 36) THEN CAST(n AS INTEGER) END AS said FROM v""")
def oven_sizes(spark, sf):
    k = F.col("c_custkey")
    pick = lambda words, by: F.get(F.array(*map(F.lit, words)), (by % len(words)).cast("int"))
    cap = F.when(k % 6 == 5, "ab").otherwise((k % 95).cast("string"))
    n = F.when(k % 6 == 5, 0).otherwise(k % 95)
    said = F.when(k % 3 == 0, F.concat((10 + n % 90).cast("string"), F.lit(" 인치 24"))).when(k % 3 == 1, F.concat(F.lit("size "), n.cast("string"), F.lit(" in"))).otherwise("none")
    size = models.oven_size(cap, pick(_SIZES, k), pick(["W", "m", "C", "X"], k), pick(["S", "T"], F.floor(k / 4)))
    return table(spark, sf, "customer").select(k.alias("id"), size.alias("size"), models.said_size(said).alias("said"))


@query(f"""WITH t AS (SELECT c_custkey AS id, ({_CLIST})[CAST(c_custkey % 8 AS INTEGER) + 1] AS x, (['등급: ', '개발 등급/', '(', 'grade '])[CAST(c_custkey % 4 AS INTEGER) + 1] || (['A', 'b', 'D', 'E', 'C'])[CAST(c_custkey % 5 AS INTEGER) + 1] || ')' AS g FROM customer),
    u AS (SELECT *, upper(x) AS u, regexp_matches(upper(x), '^[KC]?[WL][A-Z0-9]{{7,14}}$') AS ok FROM t), s AS (SELECT *, CASE WHEN length(u) >= 10 AND regexp_matches(u, '^[KC][WL]') THEN substr(u, 2) ELSE u END AS b FROM u), c AS (SELECT *, CASE WHEN length(b) > 9 THEN substr(b, 1, 8) || right(b, 1) ELSE b END AS c FROM s)
    SELECT id, CASE WHEN ok AND length(c) = 9 AND regexp_matches(c, '^[WL]') THEN c ELSE '' END AS said, CASE WHEN regexp_full_match(u, '[WL][A-Z0-9]{{8}}') THEN u ELSE '' END AS document_model, CASE WHEN id % 5 = 3 OR id % 4 = 3 THEN '' ELSE upper((['A', 'b', 'D', 'E', 'C'])[CAST(id % 5 AS INTEGER) + 1]) END AS document_grade FROM c""")
def spoken_models(spark, sf):
    k = F.col("c_custkey")
    pick = lambda words: F.get(F.array(*map(F.lit, words)), (k % len(words)).cast("int"))
    x, g = pick(_CODES), F.concat(pick(["등급: ", "개발 등급/", "(", "grade "]), pick(["A", "b", "D", "E", "C"]), F.lit(")"))
    model, grade = models.document_model_and_grade(F.concat(F.lit("for "), x, F.lit(" / "), g))
    return table(spark, sf, "customer").select(k.alias("id"), models.said_model(F.concat(F.lit("the "), x, F.lit(" now"))).alias("said"), model.alias("document_model"), grade.alias("document_grade"))


@query("""SELECT vec_id, '[' || array_to_string(list_transform(embedding[1:3], lambda x: printf('%.6f', x::DOUBLE)), ',') || ']' AS dense, '{' || (2 + vec_id % 5) || ':1.500000,' || (9 + vec_id % 5) || ':0.250000}/100' AS sparse FROM embeddings""")
def vector_texts(spark, sf):
    k = (F.col("vec_id") % 5).cast("int")
    weights = F.map_from_arrays(F.array(k + 8, k + 1, k + 3), F.array(F.lit(0.25), F.lit(1.5), F.lit(0.0)))
    return table(spark, sf, "embeddings").select("vec_id", text.vector_text(F.slice("embedding", 1, 3)).alias("dense"), text.sparse_text(weights, 100).alias("sparse"))


_SPLIT = "list_filter(list_transform(regexp_split_to_array(x, '[\n•]'), lambda t: trim(regexp_replace(t, '\\s+', ' ', 'g'))), lambda t: t <> '')"


@query(f"""WITH v AS (SELECT o_orderkey AS id, ' a  b' || chr(10) || '•' || o_orderpriority || chr(10) || chr(10) || 'z' || o_custkey AS x, o_orderkey % 2 = 0 AS even FROM orders)
    SELECT id, array_to_string({_SPLIT}, '|') AS lines, array_to_string(list_transform(list_zip({_SPLIT}, range(1, 9)), lambda p: CASE WHEN p[1] IS NULL THEN NULL ELSE p[2] || '. ' || p[1] END), '|') AS numbered,
    CASE WHEN even THEN '{{"k":1}}' ELSE 'plain' END AS fenced, CASE WHEN even THEN 'x' END AS unwrapped, md5('s|' || substr(x, 1, 600)) AS uid FROM v""")
def text_helpers(spark, sf):
    k = F.col("o_orderkey")
    x = F.concat(F.lit(" a  b\n•"), "o_orderpriority", F.lit("\n\nz"), F.col("o_custkey").cast("string"))
    said = F.when(k % 2 == 0, F.lit('so: ```json\n{"k":1} \n``` end')).otherwise(" plain ")
    wrapped = F.when(k % 2 == 0, text.wrap_json(F.lit("x"))).otherwise("x")
    numbered = F.replace(levels.numbered(text.lines(x)), F.lit("\n"), F.lit("|"))
    return table(spark, sf, "orders").select(k.alias("id"), F.array_join(text.lines(x), "|").alias("lines"), numbered.alias("numbered"), text.json_in_fence(said).alias("fenced"), text.unwrap_json(wrapped).alias("unwrapped"), text.stable_uid(F.lit("s"), x).alias("uid"))


_REMARKS = ["참고: ABC12345", "🟡 참고 : ab12c9", "ref: XY12345", "Ref. QQ9999", "none", "참고 abc"]
_NOS = ["AEC12345678", "채번필요", "TBD", "PANEL ASSY", "ABCDEF", "a-1", "", "NEED 123456", "N/A", "x1y2z3"]


@query(f"""WITH v AS (SELECT s_suppkey AS id, ({'[' + ', '.join(f"'{w}'" for w in _REMARKS) + ']'})[CAST(s_suppkey % 6 AS INTEGER) + 1] AS r, ({'[' + ', '.join(f"'{w}'" for w in _NOS) + ']'})[CAST(s_suppkey % 10 AS INTEGER) + 1] AS n FROM supplier), w AS (SELECT *, upper(n) AS u, regexp_replace(upper(n), '[^A-Z0-9]', '', 'g') AS s FROM v)
    SELECT id, coalesce(nullif(regexp_extract(r, '(?i)(?:참고\\s*[:：]|ref\\s*[:：]|ref\\.)\\s*([A-Z0-9]{{5,}})', 1), ''), '') AS referenced, u NOT IN ('채번필요', '(채번필요)', '(채번 필요)', '채번 필요', 'TBD', 'N/A', 'NAN', '') AND length(s) >= 5 AS is_real,
    n <> '' AND (s = '' OR regexp_matches(u, 'CONTROLLER|ASSEMBLY|ASSY|PANEL|SUB|MODULE|PART') OR regexp_full_match(s, '[A-Z]+')) AS placeholder, CASE WHEN n <> '' AND NOT regexp_matches(u, '채번|TBD|NEED|미정') AND s <> '' THEN s ELSE 'FALLBACK9' END AS first_real, regexp_full_match(n, '[A-Z]{{2,5}}[0-9]{{5,12}}') AS looks FROM w""")
def part_number_tests(spark, sf):
    k = F.col("s_suppkey")
    pick = lambda words: F.get(F.array(*map(F.lit, words)), (k % len(words)).cast("int"))
    n = pick(_NOS)
    return table(spark, sf, "supplier").select(k.alias("id"), text.referenced_part_no(pick(_REMARKS)).alias("referenced"), text.is_real_part_no(n).alias("is_real"), text.is_placeholder_part_no(n).alias("placeholder"), text.real_part_no(n, F.lit("fallback-9")).alias("first_real"), text.looks_like_part_no(n).alias("looks"))


_FRAGMENTS = ["good | bad thing |  x", "bad", "", "one|two"]
_MATERIALS = ["Sheet,Steel 1mm", "door", "절연 테이프", ""]


@query(f"""WITH v AS (SELECT p_partkey AS id, ({'[' + ', '.join(f"'{w}'" for w in _FRAGMENTS) + ']'})[CAST(p_partkey % 4 AS INTEGER) + 1] AS f, ({'[' + ', '.join(f"'{w}'" for w in _MATERIALS) + ']'})[CAST(p_partkey % 4 AS INTEGER) + 1] AS m, p_size, p_name FROM part)
    SELECT id, array_to_string(list_filter(list_transform(string_split(f, '|'), lambda t: trim(t)), lambda t: t <> '' AND NOT contains(t, 'bad')), ' | ') AS kept, contains(lower(m), 'sheet,steel') OR contains(m, '테이프') AS material,
    CASE WHEN contains(f, 'bad') THEN '' ELSE trim(regexp_replace(f, '\\s+', ' ', 'g')) END AS shown, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN CAST(p_size AS VARCHAR) ELSE p_size || '.5' END AS plain, CASE WHEN p_size / 50.0 > 0 AND p_size / 50.0 < 1 THEN round(1 - p_size / 50.0, 6) ELSE 0.7 END::DOUBLE AS similarity FROM v""")
def cell_helpers(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda words: F.get(F.array(*map(F.lit, words)), (k % len(words)).cast("int"))
    number = F.when(size % 3 == 1, size.cast("double")).when(size % 3 == 2, size + 0.5)
    return table(spark, sf, "part").select(k.alias("id"), text.without_fragments(pick(_FRAGMENTS), ["bad"]).alias("kept"), c.is_material(pick(_MATERIALS)).alias("material"), levels.ui_text(pick(_FRAGMENTS), ["bad"]).alias("shown"), levels.plain_number(number).alias("plain"), F.round(levels.distance_to_similarity(size / 50.0), 6).alias("similarity"))
