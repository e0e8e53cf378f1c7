"""Scalar functions on single odd values, beside what the queries cover."""

from pyspark.sql import functions as F

from partloom.functions import levels, models, text
from partloom.operators import classify, feedback, merge

S = lambda x: F.lit(x).cast("string")

def cases():
    return [
        (text.clean_cell(S(" a\x1c　b\xa0")), "a b"),
        (text.clean_cell(S(" \xa0")), None),
        (text.clean(S(None)), ""),
        (text.clean(S("NaN ")), ""),
        (text.referenced_part_no(S("참고: EAU65078502 사용")), "EAU65078502"),
        (text.referenced_part_no(S("ref. abc")), ""),
        (text.is_real_part_no(S("채번 필요")), False),
        (text.is_real_part_no(S("EAU65078502")), True),
        (text.is_placeholder_part_no(S("DOOR ASSY 1")), True),
        (text.is_placeholder_part_no(S("AB12")), False),
        (text.looks_like_part_no(S("AEC12345678")), True),
        (text.looks_like_part_no(S("A1")), False),
        (text.real_part_no(S("채번"), S(None), S("ab-12")), "AB12"),
        (text.reason_key(S("카메라 모듈 적용")), "모듈_카메라"),
        (text.reason_key(S("other  text")), "OTHER TEXT"),
        (text.without_part_nos(S("fan EAU65078502 new")), "FAN NEW"),
        (text.without_fragments(S("keep | drop me | also"), ["drop"]), "keep | also"),
        (text.unwrap_json(text.wrap_json(S('{"a":1}'))), '{"a":1}'),
        (text.unwrap_json(S("x")), None),
        (text.json_in_fence(S('a ```json\n{"b": 2}\n``` c')), '{"b": 2}'),
        (text.json_in_fence(S(" plain ")), "plain"),
        (text.has_keyword(S("LED module"), "led"), True),
        (text.has_keyword(S("ledger"), "led"), False),
        (text.has_keyword(S("도어핸들"), "도어"), True),
        (text.tags(S("Camera door x1"), ["CAMERA", "FAN"], ["door"]), ["CAMERA", "camera", "x1"]),
        (text.lines(S("a\n• b\n\n  c")), ["a", "b", "c"]),
        (levels.depth_by_dots(S("...3")), 3),
        (levels.depth_by_dots(S("3.0")), None),
        (levels.depth_by_digits(S("..12")), 12),
        (levels.depth_by_digits(S("..")), 2),
        (levels.depth_or_one(S("")), 1),
        (levels.depth_lenient(S("3.0")), 3),
        (levels.depth_or(S("x"), 998), 998),
        (levels.depth_or(S("..2"), 0), 2),
        (levels.to_int(S(" 3.7 ")), 3),
        (levels.to_int(S("x")), None),
        (levels.yes_no(S("◎")), "O"),
        (levels.plain_number(F.lit(float("nan"))), ""),
        (levels.plain_number(F.lit(2.0)), "2"),
        (levels.distance_to_similarity(F.lit(0.25)), 0.75),
        (levels.distance_to_similarity(F.lit(3.0)), 0.7),
        (levels.numbered(F.array(F.lit("a"), F.lit("b"))), "1. a\n2. b"),
        (levels.ui_text(S("a  secret"), ["secret"]), ""),
        (models.grade(S("개발 등급: b")), "B"),
        (models.grade(S("C급 적용")), "C"),
        (models.grade(S("model (d)")), "D"),
        (models.grade(S(None)), ""),
        (models.nine_places(S("code WSED7613B,")), "WSED7613B"),
        (models.wide_code(S("mcab12345x")), "MCAB12345"),
        (models.asks_for_reference(S("최초 적용 Camera")), True),
        (models.differences(S("WSED7613B"), S("WSED7813C")), ["color", "capacity:small"]),
        (classify.in_house(S("T")), "○"),
        (classify.row_kind(S(None), S("long enough reason")), "marker"),
        (classify.classification(S(" Chainging ")), "Changing"),
        (classify.graph_classification(S("Chainging")), "Chainging"),
        (classify.is_material(S("Tape, black")), True),
        (merge.append_texts(F.array(F.lit("a"), F.lit(""), F.lit("b"), F.lit("a"))), "a | b"),
        (feedback.change_targets(S("도어와 팬")), ["도어", "팬"]),
    ]


def test_cases(spark):
    made = cases()
    got = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(made))).first()
    assert [(i, x) for i, x in enumerate(got)] == [(i, want) for i, (_, want) in enumerate(made)]


def test_policy(spark):
    p = spark.range(1).select(models.policy(S("for KWSED7613B"), S("d"), S("led")).alias("p")).first().p
    assert (p["core9"], p["primary_prefix"], p["product_gate"], p["secondary"]) == ("WSED7613B", "WSED761", "W", True)


def test_words_of_odd_texts(spark):
    from partloom.functions.text import tokens

    texts = ["", None, " ..", "\x0b a\x1cB　c d\n\n", "가-나 가", "ZA za; Za", "ǅ-9"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(tokens(F.col("text")).alias("w"))
    assert [r.w for r in df.collect()] == [[], [], [], ["a", "b", "c", "d"], ["가", "나"], ["za"], ["9"]]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1  # told once
