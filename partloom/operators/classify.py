"""Rule classifiers: a Column of labels from Columns of cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partloom.functions.text import clean, contains_any, has_keyword, is_part_no, merge_text, once, part_no_strict, squeeze, strip

# The word lists of the rules, in the rules' order.
REGIONS = [
    ("동유럽", "동유럽"), ("싱가포르", "싱가포르"), ("모리셔스", "모리셔스"), ("사우디", "사우디"), ("이집트", "이집트"),
    ("북유럽", "북유럽"), ("북미", "북미"), ("포르투갈", "포르투갈/그리스"), ("그리스", "포르투갈/그리스"), ("호주", "호주"),
    ("UAE", "UAE"), ("이라크", "이라크"), ("CIS", "CIS"), ("유럽", "유럽"),
]
US_WORDS = ["북미", "미국", "120v", "60hz", "ul", "csa", "doe", "energy star"]
EU_WORDS = ["유럽", "eu", "ce", "230v", "50hz", "iec", "en", "ukca", "erp"]
PART_TYPE_DOMAINS = {"전장": "E", "회로": "E", "모듈": "E", "assy": "E", "ass'y": "E", "판금": "M", "사출": "M", "절삭": "M", "원재료": "M", "포장": "P", "인쇄물": "P"}
CONSUMABLE_WORDS = ["screw", "bolt", "nut", "washer", "clip", "tape", "grease", "나사", "볼트", "너트", "와셔", "클립", "테이프", "그리스"]
PRINT_WORDS = [
    "label", "라벨", "라벨지", "스티커", "manual", "매뉴얼", "설명서", "print", "인쇄", "인쇄물", "출력", "barcode", "바코드",
    "rating", "rating label", "레벨라벨", "정격라벨", "warning", "경고라벨", "carton", "박스라벨",
]
ELECTRIC_WORDS = [
    "camera", "카메라", "led", "엘이디", "조명", "pcb", "pba", "board", "보드", "회로", "harness", "하네스", "wire", "cable", "케이블",
    "sensor", "센서", "connector", "커넥터", "wifi", "bluetooth", "bt", "module", "모듈", "mic", "speaker", "스피커", "마이크",
]
MECHANIC_WORDS = [
    "door", "도어", "controller", "컨트롤러", "frame", "프레임", "cover", "커버", "panel", "패널", "bracket", "브라켓", "shelf", "선반", "랙",
    "handle", "핸들", "hinge", "힌지", "glass", "유리", "insulator", "단열", "단열재", "gasket", "가스켓", "grille", "그릴",
]
MATERIAL_WORDS = ["resin", "sheet,steel", "coil,steel", "tape", "paint", "powder", "sealant", "grease", "flux", "solder", "foam", "film", "수지", "도료", "테이프", "그리스"]
INTENTS = [
    ("BULK", ["다 추가", "나머지 확정", "전부 추가", "일괄", "전체 확정", "다 변경", "나머지 추가"]),
    ("EXCLUDE", ["제외", "빼줘", "빼", "삭제해", "없애", "제거"]),
    ("ADD", ["추가해", "넣어줘", "넣어", "빠졌", "누락"]),
    ("SOURCING", ["공용으로", "공용검토", "신규로", "채번", "참고품번"]),
    ("MOVE", ["하위로", "옮겨", "이동해", "밑으로"]),
    ("QUERY", ["뭐야", "왜", "어떤 모델", "알려줘", "확인해", "검색해", "어디서", "출처"]),
    ("RECHECK", ["재검토", "다시 찾아", "다르게 찾아", "다른 걸로", "대안", "다시 검토", "다시 추천"]),
]
OBJECTS = [("DOOR", ["도어", "door"]), ("CONTROL", ["제어", "control", "panel", "조작"]), ("OVEN", ["오븐", "oven", "캐비티", "cavity"])]
MAIN_PARTS = [
    ("CAMERA", ["카메라", "camera", "cam"]), ("LED", ["led", "조명", "램프"]), ("HARNESS", ["하네스", "harness", "wire", "배선"]),
    ("PROBE", ["probe", "프로브", "3p", "3p probe", "탐침"]),
]
ACTIONS = [("ADD", ["추가", "add", "신규", "장착"]), ("REMOVE", ["삭제", "제거", "remove"])]
FEATURES = [("CAMERA", ["camera", "카메라"]), ("LED", ["led", "조명", "램프"]), ("HARNESS", ["하네스", "harness", "wire", "배선"])]
COMMON_USE_WORDS = ["MODULE", "모듈", "SENSOR", "센서"]
OVERVIEW_WORDS = ["개발 유형", "개발 등급", "제품군", "BASE MODEL", "BASE 모델", "PJT명", "PROJECT NAME"]
DETAIL_WORDS = [
    "유첨", "개발 변경점 상세", "CAVITY", "DOOR", "CONTROLLER ASSEMBLY", "구분", "변경 내역", "BASE", "NEW", "유첨3. 개발 변경점",
    "주요 변경점", "모듈명", "OVEN+MWO", "OVEN ONLY", "OVEN+MWO+STEAM", "COMPACT OVEN",
]
REFERENCE_WORDS = ["개발 등급 분류 기준", "운영 기준", "부표", "기준", "절차", "정의", "상세", "참고"]
TABLE_BLACKLIST = ["적용여부", "과전압", "PDR", "ODR", "EVENT", "NPI", "ACTIVITY"]


def first_hit(text: Column, rules: list[tuple[str, list[str]]], otherwise: str | None = "") -> Column:
    """The label of the first rule one of whose words a text holds."""

    def label_of(t: Column) -> Column:
        out: Column | None = None
        for label, words in rules:
            hit = contains_any(t, words)
            out = F.when(hit, label) if out is None else out.when(hit, label)
        return out.otherwise(otherwise)

    return once(text, label_of)


def row_kind(new_no: Column, reason: Column) -> Column:
    marker = new_no.isNull() | new_no.isin("X", "←", "-", "?")
    history = reason.isNotNull() & (F.length(reason) > 5) & ~reason.isin("-", "_", "/", "N/A")
    return F.when(marker, "marker").when(history, "change_history").otherwise("bom_entry")


def classification(c: Column) -> Column:
    """With the spellings that sheets have; other words stay, blank is null."""

    def spelled(text: Column) -> Column:
        low = F.lower(text)
        return (
            F.when(text == "", None).when(low == "new", "NEW").when(low.isin("chainging", "changing", "change"), "Changing")
            .when(low == "common", "Common").when(low.isin("delet", "delete"), "Delete").otherwise(text)
        )

    return once(strip(c), spelled)


def graph_classification(c: Column) -> Column:
    """By parts of words, as the graph has it ("Changing" is none of them)."""

    def spelled(text: Column) -> Column:
        low = F.lower(text)
        return (
            F.when(contains_any(low, ["common", "공통"]), "Common").when(contains_any(low, ["change", "변경"]), "Change")
            .when(contains_any(low, ["delete", "삭제"]), "Delete").when((low == "new") | contains_any(low, ["신규", "추가"]), "New").otherwise(text)
        )

    return once(clean(c), spelled)


def design_classification(base_no: Column, new_no: Column) -> Column:
    """From what stands in the two part number cells."""

    def design(x: Column) -> Column:
        base, new = x["base"], x["new"]
        return (
            F.when(new == "←", "COMMON").when(F.upper(new) == "X", "DELETE").when(is_part_no(new) & ~is_part_no(base), "NEW")
            .when(is_part_no(new) & (part_no_strict(new) != part_no_strict(base)), "CHANGE").otherwise("COMMON")
        )

    return once(F.struct(clean(base_no).alias("base"), clean(new_no).alias("new")), design)


def effective_part_no(base_no: Column, new_no: Column, kind: Column) -> Column:


    def effective(x: Column) -> Column:
        base, new = x["base"], x["new"]
        return (
            F.when(new == "←", F.when(is_part_no(base), base).otherwise("")).when(F.upper(new) == "X", "")
            .when(x["kind"].isin("Change", "New") & is_part_no(new), new).when(is_part_no(new) & ~is_part_no(base), new)
            .when(is_part_no(base), base).otherwise("")
        )

    return once(F.struct(clean(base_no).alias("base"), clean(new_no).alias("new"), kind.alias("kind")), effective)


def direct_part_no(kind: Column, base_no: Column, new_no: Column, effective: Column) -> Column:
    return F.when(kind == "Delete", base_no).when(kind.isin("Change", "New") & is_part_no(new_no), new_no).otherwise(effective)


def direct_role(kind: Column) -> Column:
    return F.when(kind == "Delete", "base").when(kind.isin("Change", "New"), "new").otherwise("effective")


def region(file_name: Column) -> Column:
    return first_hit(file_name, [(label, [word]) for word, label in REGIONS], None)


def region_tag(text: Column) -> Column:


    def tag(low: Column) -> Column:
        us, eu = contains_any(low, US_WORDS), contains_any(low, EU_WORDS)
        return F.when(us & eu, "GLOBAL").when(us, "US").when(eu, "EU").otherwise("UNKNOWN")

    return once(F.lower(F.coalesce(text, F.lit(""))), tag)


def region_name(value: Column, hint: Column) -> Column:
    """A region as written, else by a hint's words."""
    low = F.lower(strip(F.coalesce(value, F.lit(""))))
    tag = region_tag(F.when(F.coalesce(hint, F.lit("")) != "", hint).otherwise(value))
    return (
        F.when(contains_any(low, ["유럽", "eu", "europe"]), "유럽").when(contains_any(low, ["미국", "북미", "us", "usa", "north america"]), "미국")
        .when(low.isin("글로벌", "global"), "글로벌").when(tag == "EU", "유럽").when(tag == "US", "미국").otherwise("글로벌")
    )


def region_fits(name: Column, tag: Column) -> Column:
    return F.when(name == "유럽", tag != "US").when(name == "미국", tag != "EU").otherwise(True)


def domain(part_type: Column, description: Column, reason: Column) -> Column:
    kind = F.lower(squeeze(F.coalesce(part_type, F.lit(""))))
    blob = F.lower(F.concat_ws(" ", kind, F.coalesce(description, F.lit("")), F.coalesce(reason, F.lit(""))))
    by_type = first_hit(kind, [(d, [word]) for word, d in PART_TYPE_DOMAINS.items()], None)
    by_word = first_hit(blob, [("C", CONSUMABLE_WORDS), ("P", PRINT_WORDS), ("E", ELECTRIC_WORDS), ("M", MECHANIC_WORDS)], "U")
    return F.coalesce(by_type, by_word)


def feature(text: Column) -> Column:
    return first_hit(F.lower(F.coalesce(text, F.lit(""))), FEATURES)


def change_intent(text: Column) -> Column:
    """What a request is about: object, action, main part."""
    low = F.lower(strip(F.coalesce(text, F.lit(""))))
    return F.struct(first_hit(low, OBJECTS).alias("target_object"), first_hit(low, ACTIONS, "MODIFY").alias("action"), first_hit(low, MAIN_PARTS).alias("main_part"))


def action(base_no: Column, new_no: Column, related: Column) -> Column:
    has_base, has_new = base_no != "", new_no != ""
    return (
        F.when(~has_base & has_new, "ADD").when(has_base & has_new & (base_no != new_no), "MODIFY").when(has_base & has_new & related, "MODIFY")
        .when(has_base & ~has_new, "DELETE").otherwise("KEEP")
    )


def is_material(description: Column) -> Column:
    return contains_any(F.lower(F.coalesce(description, F.lit(""))), MATERIAL_WORDS)


def tier(reason: Column, description: Column, change: Column, core: list[str], target: list[str]) -> Column:
    """CORE, CASCADE or EXCLUDE by the words of a change's reason."""
    r = F.lower(strip(F.coalesce(F.when(reason != "", reason), F.when(change != "", change), F.lit(""))))

    def any_of(x: Column, words: list[str]) -> Column:
        hits = [has_keyword(x[c], w) for c in ("r", "description", "change") for w in words]
        out = F.lit(False)
        for h in hits:
            out = out | h
        return out

    told = lambda x: F.when(x["r"].isin("", "nan"), "EXCLUDE").when(any_of(x, core), "CORE").when(any_of(x, target), "CASCADE").otherwise("EXCLUDE")
    return once(F.struct(r.alias("r"), description.alias("description"), change.alias("change")), told)


def sourcing_by_base(act: Column, change: Column, db_no: Column, in_base: Column) -> Column:
    has = F.coalesce(db_no, F.lit("")) != ""
    return (
        F.when(F.upper(act).isin("DELETE", "REMOVE"), "").when(F.contains(F.lower(F.coalesce(change, F.lit(""))), F.lit("공용")), "공용검토")
        .when(has & ~in_base, "참고품번").when(~has & ~in_base, "신규").otherwise("")
    )


def sourcing_by_name(name: Column, number: Column, act: Column) -> Column:
    up = F.upper(strip(F.coalesce(name, F.lit(""))))
    no = F.lower(strip(F.coalesce(number, F.lit(""))))
    module = contains_any(up, COMMON_USE_WORDS) & ~contains_any(up, ["ASSY", "ASS'Y", "ASSEMBLY"])
    return (
        F.when(F.upper(F.coalesce(act, F.lit(""))).isin("KEEP", "REMOVE", "DELETE", "삭제", "유지", ""), "")
        .when(no.isin("", "nan"), "신규").when(module, "공용검토").otherwise("신규")
    )


def action_bucket(c: Column) -> Column:
    bucket = lambda a: (
        F.when(a.isin("ADD", "MODIFY", "CHECK", "추가", "변경", "⚠️확인필요"), "CHANGE").when(a.isin("REMOVE", "DELETE", "삭제"), "DELETE")
        .when(a.isin("KEEP", "유지"), "KEEP").otherwise(a)
    )
    return once(merge_text(c), bucket)


def part_type(kind: Column, spec: Column) -> Column:
    t, s = F.upper(strip(F.coalesce(kind, F.lit("")))), F.upper(strip(F.coalesce(spec, F.lit(""))))
    return (
        F.when(F.contains(t, F.lit("ASSEMBLY")), "Assy")
        .when(t == "PCBPART", "회로").when(t == "CIRCUITCOMPONENTPART", "전장").when(t == "MATERIALPART", "원재료")
        .when(t.isin("LABELPART", "MANUALPART", "BOXPART"), "인쇄물").when(t == "FASTENERPART", "체결").when(t == "SOFTWAREPART", "S/W")
        .when(s.rlike("^MOLD"), "사출").when(s.rlike("^(PRESS|BENDING|COMPLEX)"), "판금").when(s.rlike("^CUTTING"), "절삭")
        .when(s.rlike("^EXTRUSION"), "압출").when(s.rlike("^DIECASTING"), "주조").otherwise("기타")
    )


def change_type(kind: Column, note: Column, group_has_add: Column) -> Column:
    c, n = strip(F.coalesce(kind, F.lit(""))), strip(F.coalesce(note, F.lit("")))
    return (
        F.when(c == "추가", "NEW").when((c == "삭제") | (F.upper(c) == "DELETE"), "삭제")
        .when(F.contains(n, F.lit("▲ 상위 Assy")), F.when(group_has_add, "NEW").otherwise("Changing")).when(c == "변경(시방)", "Changing").otherwise("Common")
    )


def mold(kind: Column) -> Column:
    return F.when(kind == "사출", "○").otherwise("X")


def in_house(uit: Column) -> Column:
    return F.when(uit.isin("F", "P", "T"), "○").when(uit.isin("Q", "D", "G", "M", "R", "S", "X"), "X").otherwise("")


def slide_role(text: Column) -> Column:
    """OVERVIEW, DETAIL, REFERENCE or UNKNOWN by weighted words of a slide."""
    return once(F.upper(F.coalesce(text, F.lit(""))), _slide_role)


def _slide_role(blob: Column) -> Column:
    has = lambda w: F.contains(blob, F.lit(w)).cast("int")
    total = lambda words, weight: sum((weight * has(w) for w in words), F.lit(0))
    intro = has("개발 PJT 개요")
    result = has("심의 결과")
    overview = 3 * intro + 3 * F.greatest(result, has("확정")) + total(OVERVIEW_WORDS, 1)
    detail, reference = total(DETAIL_WORDS, 2), total(REFERENCE_WORDS, 1)
    return (
        F.when((intro == 1) & (result == 1), "OVERVIEW")
        .when((overview >= F.greatest(F.lit(4), detail + 1)) & (overview >= reference), "OVERVIEW")
        .when(detail >= F.greatest(F.lit(2), reference + 1), "DETAIL").when(reference >= 2, "REFERENCE").otherwise("UNKNOWN")
    )


def table_type(header: Column, everything: Column, n_cells: Column, n_checks: Column) -> Column:
    """MAIN, DETAIL, RISK or IGNORE from a slide table's header, words and share of O/X cells."""
    h, text = F.upper(F.coalesce(header, F.lit(""))), F.upper(F.coalesce(everything, F.lit("")))
    compact = F.regexp_replace(h, "[^A-Z0-9가-힣]", "")
    has = lambda *words: contains_any(h, list(words))
    has_compact = lambda *words: contains_any(compact, list(words))
    module, changes = has("MODULE", "모듈"), has("변경점", "변경내역", "CHANGE")
    main = (
        (has("CHANGE", "변경 내역") | has_compact("변경내역"))
        & (has("->", "→", "BEFORE", "AFTER") | has_compact("변경전", "변경후"))
        & (has("REASON") | has_compact("변경사유")) & (has("CONCERN") | has_compact("걱정점", "우려")) & has_compact("PART", "부품")
    )
    detail = has("BASE") & has("NEW", "B700", "B900", "COMPACT") & (module | has("REMARK", "비고"))
    risk = (has("CONCERN") | has_compact("우려", "걱정")) & (has("COUNTER", "검증", "방안") | has_compact("대책", "대응"))
    checks = (n_cells >= 4) & (n_checks >= 0.2 * n_cells)
    return (
        F.when(contains_any(text, TABLE_BLACKLIST) | checks, "IGNORE").when(main | (module & changes), "MAIN").when(detail, "DETAIL")
        .when(risk, "RISK").otherwise("IGNORE")
    )


def user_intent(text: Column) -> Column:
    return first_hit(F.lower(strip(F.coalesce(text, F.lit("")))), INTENTS, "UNKNOWN")


def guess_change(text: Column) -> Column:
    """신규, 삭제 or 변경 from a change point's words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return first_hit(low, [("신규", ["신규", "추가", "new", "add"]), ("삭제", ["삭제", "제거", "delete", "remove"])], "변경")


# The words of the modules that a change point may belong to, and those that weigh more.
MODULE_WORDS = [
    ("Door Assembly", ["DOOR", "CAMERA", "HARNESS", "HINGE", "TRAY", "FRAME"], ["HARNESS", "TRAY", "HINGE", "CAMERA"]),
    ("Cavity", ["CAVITY", "CONV", "FAN", "MOTOR", "BLADE", "INLET", "OUTLET", "AIR"], ["CONV", "FAN", "MOTOR", "BLADE"]),
    ("Controller Assembly", ["CONTROLLER", "LCD", "PANEL", "PCB", "UI", "OS", "S/W", "SW"], ["LCD", "PCB", "PANEL", "UI", "OS"]),
]


def module_by_words(text: Column, *, least: int = 3) -> Column:
    """The module whose words a change point has most of, two points each and two
    more for a strong one; of equal ones the first, blank below ``least``."""
    points = lambda scope, words: sum((F.contains(scope, F.lit(w)).cast("int") * 2 for w in words), F.lit(0))
    scores = lambda scope: F.array(*(points(scope, words) + F.when(contains_any(scope, strong), 2).otherwise(0) for _, words, strong in MODULE_WORDS))

    def best(x: Column) -> Column:
        top, out = F.array_max(x), F.lit("")
        for i, (m, _, _) in reversed(list(enumerate(MODULE_WORDS))):
            out = F.when((F.get(x, i) == top) & (top >= least), m).otherwise(out)
        return out

    return once(once(merge_text(text), scores), best)


def change_point_meta(kind: Column, base_no: Column, new_no: Column, shared: Column, concern: Column, description: Column) -> tuple[Column, Column]:
    """What a list shows of a change point: its type and a remark."""
    from partloom.functions.text import is_real_part_no

    base, new = is_real_part_no(base_no), is_real_part_no(new_no)
    differ = base & new & (base_no != new_no)
    arrow = F.concat(F.lit("Base: "), base_no, F.lit(" → New: "), new_no)
    pending = (kind == "NEW") & (~new | contains_any(F.coalesce(description, F.lit("")), ["품번추가", "채번"]))
    label = (
        F.when(shared, F.when(kind == "NEW", "신규(품번확정) · 공용").when(kind == "Changing", "변경 · 공용").otherwise("공용"))
        .when(pending, "신규(채번필요)").when(kind == "Changing", F.when(differ, "변경(대체/사양)").otherwise("변경(구조/형상)"))
        .when(kind == "NEW", "신규(품번확정)").otherwise("")
    )
    remark = (
        F.when(shared, F.when(kind == "NEW", F.when(new, F.concat(F.lit("공용품 P/N: "), new_no)).otherwise("공용품 | 품번 확인 필요")).when((kind == "Changing") & differ, F.concat(arrow, F.lit(" (공용)"))).otherwise("공용품"))
        .when(pending, "채번 필요").when(kind == "Changing", F.when(differ, arrow).otherwise("")).when((kind == "NEW") & new, F.concat(F.lit("P/N: "), new_no)).otherwise("")
    )
    said = F.coalesce(concern, F.lit(""))
    more = F.concat(F.lit("확인필요: "), said)
    return (
        F.when(said == "", label).when(label == "", "확인필요").otherwise(F.concat(label, F.lit(" · 확인필요"))),
        F.when(said == "", remark).when(remark == "", more).otherwise(F.concat(remark, F.lit(" | "), more)),
    )


def review_flag(confidence: Column, in_base: Column) -> Column:
    """Why a part is asked about."""
    return F.when(F.coalesce(confidence, F.lit(0.0)) < 0.5, "낮은 확신도").when(~F.coalesce(in_base, F.lit(False)), "신규").otherwise("모델 차이")


def review_tags(confidence: Column, in_base: Column, past_reason: Column) -> Column:
    """The marks that a part gets for review."""
    past = F.when(F.coalesce(past_reason, F.lit("")) != "", F.concat(F.lit("🚫 "), F.substring(past_reason, 1, 20)))
    return F.array_compact(F.array(F.when(confidence < 0.5, "⚠️ 낮은 확신도"), F.when(~in_base, "🆕 신규"), past))
