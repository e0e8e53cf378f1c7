"""Reviews folded message by message, over the turns of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.operators import sessions
from partloom.plans.registry import query, table

_SAID = ["", "1,3번 빼", "다 유지", "{name2} 제외해줘", "{number1} 공용으로 바꿔줘", "나머지 다 추가 확정", "{assembly3} 하위에 Gasket 추가해줘", "Gasket 재검토해줘", "{number2} 신규로 채번", "1번 빼고 2번 AEC12345678 로 교체"]
_ACTIONS = ["CHECK", "ADD", "", "MODIFY"]


def _session_tables(spark, sf):
    """Five parts for each conversation, and what its turns say of them."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.concat(F.lit("AEC"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("number"), F.col("p_name").alias("name"), F.col("p_type").alias("assembly"))
    keys = turns.select(F.col("conv_id").alias("session")).distinct().select("session", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("pid")).withColumn("key", (F.col("session") * 5 + F.col("pid")) % 200)
    action = F.get(F.array(*map(F.lit, _ACTIONS)), ((F.col("session") + F.col("pid")) % 4).cast("int"))
    parts = keys.join(p, "key").select("session", "pid", "number", "name", "assembly", action.alias("action"), F.lit("").alias("sourcing"), F.lit("shown").alias("display_no"))
    of = lambda pid, cell: F.max(F.when(F.col("pid") == pid, F.col(cell)))
    cells = parts.groupBy("session").agg(of(2, "name").alias("name2"), of(1, "number").alias("number1"), of(2, "number").alias("number2"), of(3, "assembly").alias("assembly3"))
    said = [F.lit(x.split("}")[-1]) if "{" not in x else F.concat(F.col(x[1 : x.index("}")]), F.lit(x[x.index("}") + 1 :])) for x in _SAID]
    m = ((F.col("conv_id") * 3 + F.col("turn") * 7) % 10).cast("int")
    messages = turns.join(cells, F.col("conv_id") == F.col("session")).select(
        "session", F.col("turn").alias("ord"), F.get(F.array(*said), m).alias("text"), F.when(m == 0, F.array(F.lit(1), F.lit(2), F.lit(3)).cast("array<long>")).alias("asks")
    )
    return parts, messages


_TEXT = " ".join(f"WHEN {i} THEN " + (f"'{x}'" if "{" not in x else f"{x[1:x.index('}')]} || '{x[x.index('}') + 1:]}'") for i, x in enumerate(_SAID))
_PART = "{{'pid': {0}, 'number': {1}, 'name': {2}, 'assembly': {3}, 'action': {4}, 'sourcing': {5}, 'sourcing_reason': {6}, 'display_no': {7}, 'recheck': {8}}}"
_FIRST = _PART.format("pid", "number", "name", "assembly", "action", "''", "''", "'shown'", "FALSE")
_NEXT = _PART.format(
    "p.pid", "p.number", "p.name", "p.assembly",
    "CASE WHEN (handled = 'ANSWER' AND list_contains(outs, p.pid)) OR (handled = 'EXCLUDE' AND list_contains(t, p.pid)) THEN 'EXCLUDE' WHEN handled = 'BULK' AND p.action IN ('CHECK', 'PENDING', '') THEN 'ADD' ELSE p.action END",
    "CASE WHEN handled = 'SOURCING' AND list_contains(t, p.pid) THEN src ELSE p.sourcing END",
    "CASE WHEN handled = 'SOURCING' AND list_contains(t, p.pid) THEN CASE WHEN src <> '신규' THEN '' WHEN p.number <> '' THEN '참고: ' || p.number ELSE p.sourcing_reason END ELSE p.sourcing_reason END",
    "CASE WHEN handled = 'SOURCING' AND list_contains(t, p.pid) THEN CASE WHEN src = '신규' THEN '(채번 필요)' WHEN p.number <> '' THEN p.number ELSE p.display_no END ELSE p.display_no END",
    "p.recheck OR (handled = 'RECHECK' AND coalesce(t[1] = p.pid, FALSE))",
)
_TOP = "list_max(list_transform(parts, lambda p: p.pid)) + 1"
_ADDED = _PART.format(_TOP, "''", "'Gasket'", "coalesce(list_filter(parts, lambda p: contains(upper, upper(p.assembly)))[1].assembly, parts[1].assembly)", "'ADD'", "'신규'", "''", "'(채번 필요)'", "FALSE")
_SWAPPED = _PART.format(_TOP, "'AEC12345678'", "parts[1].name", "parts[1].assembly", "'ADD'", "''", "''", "'AEC12345678'", "FALSE")
_FOLD = f"""keys AS (SELECT conv_id AS session, unnest(range(1, 6)) AS pid FROM (SELECT DISTINCT conv_id FROM conversations)),
    five AS (SELECT session, pid, 'AEC' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS number, p_name AS name, p_type AS assembly, (['CHECK', 'ADD', '', 'MODIFY'])[CAST((session + pid) % 4 AS INTEGER) + 1] AS action FROM keys JOIN part ON p_partkey = (session * 5 + pid) % 200),
    start AS (SELECT session, list({_FIRST} ORDER BY pid) AS parts FROM five GROUP BY session),
    cells AS (SELECT session, parts[2].name AS name2, parts[1].number AS number1, parts[2].number AS number2, parts[3].assembly AS assembly3 FROM start),
    msg AS (SELECT session, turn, row_number() OVER (PARTITION BY session ORDER BY turn) AS rn, m, CASE m {_TEXT} END AS text FROM (SELECT conv_id AS session, turn, (conv_id * 3 + turn * 7) % 10 AS m FROM conversations) JOIN cells USING (session)),
    walk AS (
        SELECT session, 0::BIGINT AS rn, NULL::BIGINT AS ord, parts, FALSE AS asked, NULL::VARCHAR AS handled, 0 AS n FROM start
        UNION ALL
        SELECT session, rn, turn, list_concat(list_transform(parts, lambda p: {_NEXT}), CASE WHEN handled = 'ADD' THEN [{_ADDED}] WHEN handled = 'ANSWER' AND m = 9 THEN [{_SWAPPED}] ELSE [] END),
            handled IN ('ASK', 'UNCLEAR'), handled, CASE handled WHEN 'ANSWER' THEN len(outs) WHEN 'EXCLUDE' THEN len(t) WHEN 'SOURCING' THEN len(t) WHEN 'ADD' THEN 1 WHEN 'BULK' THEN len(list_filter(parts, lambda p: p.action IN ('CHECK', 'PENDING', ''))) WHEN 'RECHECK' THEN least(len(t), 1) ELSE 0 END
        FROM (
            SELECT session, rn, turn, m, upper, parts, CASE m WHEN 1 THEN [3] WHEN 9 THEN [1, 2] ELSE [] END AS outs, CASE m WHEN 4 THEN '공용검토' WHEN 8 THEN '신규' END AS src,
                CASE WHEN m = 0 THEN 'ASK' WHEN asked THEN CASE WHEN m IN (1, 2, 9) THEN 'ANSWER' ELSE 'UNCLEAR' END ELSE (['EXCLUDE', 'UNKNOWN', 'EXCLUDE', 'SOURCING', 'BULK', 'ADD', 'RECHECK', 'SOURCING', 'EXCLUDE'])[CAST(m AS INTEGER)] END AS handled,
                list_transform(list_filter(parts, lambda p: (length(p.number) >= 5 AND contains(bare, p.number)) OR len(list_filter(string_split(upper(p.name), ' '), lambda w: length(w) >= 2 AND contains(upper, w))) > 0), lambda p: p.pid) AS t
            FROM (SELECT w.session, g.rn, g.turn, g.m, w.parts, w.asked, upper(g.text) AS upper, regexp_replace(upper(g.text), '[^A-Z0-9가-힣]', '', 'g') AS bare FROM walk w JOIN msg g ON g.session = w.session AND g.rn = w.rn + 1)
        )
    )"""


@query(f"""WITH RECURSIVE {_FOLD}, last AS (SELECT session, arg_max(parts, rn) AS parts FROM walk GROUP BY session), p AS (SELECT session, unnest(parts) AS p FROM last)
    SELECT session, p.pid, p.number, p.name, p.assembly, p.action, p.sourcing, p.sourcing_reason, p.display_no, p.recheck FROM p""")
def session_parts(spark, sf):
    """What is left of each review's parts after its last message."""
    out = sessions.fold_sessions(*_session_tables(spark, sf)).where("kind = 'part'")
    return out.select("session", "pid", "number", "name", "assembly", "action", "sourcing", "sourcing_reason", "display_no", "recheck")


@query(f"WITH RECURSIVE {_FOLD} SELECT session, ord, handled AS handled_as, CAST(n AS INTEGER) AS n_changed FROM walk WHERE rn > 0")
def session_log(spark, sf):
    """How each message was taken, in the light of those before it."""
    return sessions.fold_sessions(*_session_tables(spark, sf)).where("kind = 'log'").select("session", "ord", "handled_as", "n_changed")
