"""Reviews folded message by message."""

from partloom.operators import sessions

PARTS = "session long, pid long, number string, name string, assembly string, action string, sourcing string, display_no string"


def fold(spark, texts, asks=None, parts=None):
    parts = parts or [(1, 1, "AEC12345678", "Motor Assy", "Door Assy", "CHECK", "", "-"), (1, 2, "EAD66035701", "Camera Module", "Door Assy", "", "", "-"), (1, 3, "", "Label", "Panel", "MODIFY", "", "-")]
    messages = [(1, i, t, (asks or {}).get(i)) for i, t in enumerate(texts)]
    out = sessions.fold_sessions(spark.createDataFrame(parts, PARTS), spark.createDataFrame(messages, "session long, ord long, text string, asks array<long>")).collect()
    log = [(r.handled_as, r.n_changed) for r in sorted((r for r in out if r.kind == "log"), key=lambda r: r.ord)]
    return log, {r.pid: r for r in out if r.kind == "part"}


def test_questions_wait_for_their_answer(spark):
    log, parts = fold(spark, ["", "Motor 제외해줘", "2번 빼고 3번 XYZ12345678 로 교체", "Motor 제외해줘"], {0: [1, 2, 3]})
    assert log == [("ASK", 0), ("UNCLEAR", 0), ("ANSWER", 2), ("EXCLUDE", 1)]
    assert [parts[i].action for i in (1, 2, 3)] == ["EXCLUDE"] * 3
    # the first number of a part before the new one is the one that it replaces
    assert (parts[4].number, parts[4].name, parts[4].action, parts[4].assembly) == ("XYZ12345678", "Camera Module", "ADD", "Door Assy")


def test_added_parts_can_be_named_later(spark):
    log, parts = fold(spark, ["Panel 하위에 Gasket 추가해줘", "Gasket 재검토해줘", "gasket 공용으로", "나머지 다 변경", "뭐야", "AEC-1234-5678 신규로"])
    assert log == [("ADD", 1), ("RECHECK", 1), ("SOURCING", 1), ("BULK", 2), ("QUERY", 0), ("SOURCING", 1)]
    assert (parts[4].assembly, parts[4].recheck, parts[4].sourcing, parts[4].display_no) == ("Panel", True, "공용검토", "(채번 필요)")
    assert [parts[i].action for i in (1, 2, 3)] == ["MODIFY"] * 3
    assert (parts[1].sourcing, parts[1].sourcing_reason, parts[1].display_no) == ("신규", "참고: AEC12345678", "(채번 필요)")


def test_answers(spark):
    for text, gone in (("다 빼", [1, 2, 3]), ("다 유지", []), ("1번만 유지", [2, 3]), ("1, 3 제외", [1, 3]), ("2번 맞아", [1, 3])):
        log, parts = fold(spark, ["", text], {0: [1, 2, 3]})
        assert log[1] == ("ANSWER", len(gone))
        assert [i for i in (1, 2, 3) if parts[i].action == "EXCLUDE"] == gone
    assert fold(spark, ["", "7번 빼"], {0: [1, 2]})[0][1] == ("UNCLEAR", 0)


def test_many_sessions_keep_apart(spark):
    parts = [(s, p, f"AEC0000{s:02d}{p:02d}", f"name{p}", "Door", "CHECK", "", "") for s in range(40) for p in range(1, 4)]
    rows = [(s, i, f"name{1 + (s + i) % 3} 제외해줘", None) for s in range(40) for i in range(s % 5)] + [(99, 0, "다 추가", None)]
    df = spark.createDataFrame(rows, "session long, ord long, text string, asks array<long>")
    out = sessions.fold_sessions(spark.createDataFrame(parts, PARTS), df).collect()
    gone = {(r.session, r.pid) for r in out if r.kind == "part" and r.action == "EXCLUDE"}
    assert gone == {(s, 1 + (s + i) % 3) for s in range(40) for i in range(s % 5)}
    assert sum(r.kind == "part" for r in out) == 120 and sum(r.kind == "log" for r in out) == len(rows)
    assert [(r.handled_as, r.n_changed) for r in out if r.session == 99] == [("BULK", 0)]


def test_nothing(spark):
    messages = spark.createDataFrame([], "session long, ord long, text string, asks array<long>")
    assert sessions.fold_sessions(spark.createDataFrame([], PARTS), messages).count() == 0
