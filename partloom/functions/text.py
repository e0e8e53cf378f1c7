"""Normalisation of text cells, part numbers and names: Column to Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks that stand for "no part number", and the word lists of
# the rules below.
SYMBOLS = ["", "-", "X", "x", "←", "nan", "None"]
TECH_KEYWORDS = [
    "LED", "PCB", "곡률", "구조", "렌즈", "메모리", "모듈", "방열", "브래킷", "성능", "센서", "신호", "아셈블리", "어셈블리", "이미지",
    "인덕터", "인터페이스", "저항", "전력", "전류", "전압", "카메라", "커패시터", "통신", "프로세서", "해상도",
]
PENDING_MARKS = ["채번", "TBD", "NEED", "미정"]

REFERENCES = [
    r"(?i)🟡\s*참고\s*[:：]\s*([A-Z0-9]{5,})",
    r"(?i)참고\s*[:：]\s*([A-Z0-9]{5,})",
    r"(?i)REF\s*[:：]\s*([A-Z0-9]{5,})",
    r"(?i)Ref\.\s*([A-Z0-9]{5,})",
]
NO_NUMBER_YET = ["채번필요", "(채번필요)", "(채번 필요)", "채번 필요", "TBD", "N/A", "NAN", ""]
PLACEHOLDER_WORDS = ["CONTROLLER", "ASSEMBLY", "ASSY", "PANEL", "SUB", "MODULE", "PART"]

#: Words that tell an explanation from a product type.
EXPLAINING_WORDS = ["동일 사업부", "다르면", "으로 봄", "EX:", "예:", "정의", "설명", "기준", "참고", "해당"]
EXPLAINING_SIGNS = [".", "!", "?", ";", "(ex", "예)"]

#: Every kind of white space, with the separators U+001C to U+001F.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPACE = r"[[^!-~가-힣]&&[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]+"  # most letters fail at once


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that a row computes once, however often f names it."""
    return F.get(F.transform(F.array(c), f), 0)


def squeeze(c: Column) -> Column:
    """White space to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def clean_cell(c: Column) -> Column:
    """A cell without odd white space; a blank one is null."""
    return blank_to_null(squeeze(c))


clean_header = clean_cell


def clean(c: Column) -> Column:
    """A stripped cell; null and "nan" are blank."""
    return F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?i)\Anan\z", "")


def header_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^0-9a-z가-힣]+", "")


def header_norm(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9가-힣]", "")


def key(c: Column) -> Column:
    """For comparing headers and names: squeezed, lower case."""
    return F.lower(squeeze(clean(c)))


def part_no(c: Column) -> Column:
    """Without white space, upper case."""
    return F.upper(F.regexp_replace(clean(c), SPACE, ""))


def part_no_strict(c: Column) -> Column:
    """Letters and digits alone, upper case."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")


def name_key(c: Column) -> Column:
    """Upper case, squeezed, letters, digits and Hangul."""
    return squeeze(F.regexp_replace(F.upper(squeeze(F.coalesce(c, F.lit("")))), "[^A-Z0-9가-힣 ]", ""))


def merge_text(c: Column) -> Column:
    return F.upper(squeeze(F.coalesce(c, F.lit(""))))


def path(c: Column) -> Column:
    """A path with " > " between its steps, whatever stood there."""
    steps = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"[/\\]", ">"), ">")
    return F.array_join(F.filter(F.transform(steps, squeeze), lambda s: s != ""), " > ")


def path_steps(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ">"), squeeze), lambda s: s != "")


def path_prefixes(c: Column) -> Column:
    """Every beginning of a path, shortest first."""
    steps = path_steps(c)
    n = F.size(steps)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(steps, 1, i), " > "))).otherwise(F.array().cast("array<string>"))


def search_text(*cs: Column) -> Column:
    """The cells that aren't blank, with bars between."""
    return F.concat_ws(" | ", *(blank_to_null(clean(c)) for c in cs))


def embedding_text(*, region: Column, base_model: Column, new_model: Column, event: Column, base_no: Column, new_no: Column, name: Column, point: Column, reason: Column, kind: Column) -> Column:
    """A row as a sentence of labelled parts; changes with an arrow."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    some = lambda label, c: F.when(has(c), F.concat(F.lit(f"{label}: "), c))
    arrow = lambda label, a, b: F.when(has(a) & has(b), F.concat(F.lit(f"{label}: "), a, F.lit(" → "), b)).otherwise(some(label, b))
    return F.concat_ws(
        " | ", some("지역", region), arrow("모델", base_model, new_model), some("이벤트", event), arrow("부품번호", base_no, new_no),
        some("부품명", name), some("변경점", point), some("변경사유", reason), some("구분", kind),
    )


def model_and_grade(c: Column) -> tuple[Column, Column]:
    """"M / G (note)" to M and G; without a slash there is no grade."""
    text = clean_cell(c)
    parts = F.split(text, "/", 2)
    split = F.size(parts) > 1
    model = F.when(split, blank_to_null(F.trim(F.get(parts, 0)))).otherwise(text)
    grade = F.when(split, blank_to_null(F.trim(F.regexp_replace(F.get(parts, 1), r"\(.+?\)", ""))))
    return model, grade


def short_hash(c: Column, n: int) -> Column:
    return F.substring(F.sha1(c), 1, n)


def part_id(c: Column) -> Column:
    return F.concat(F.lit("part:"), short_hash(part_no(c), 20))


def document_id(file: Column, sheet: Column) -> Column:
    return F.concat(F.lit("doc:"), short_hash(F.concat_ws("|", file, sheet), 24))


def case_id(base: Column, new: Column, event: Column, document: Column) -> Column:
    return F.concat(F.lit("case:"), short_hash(F.concat_ws("|", base, new, event, document), 24))


def row_id(*cs: Column) -> Column:
    """For packaged documents: of parts joined by line feeds."""
    return F.md5(F.concat_ws("\n", *cs))


def stable_uid(seed: Column, text: Column, n: int = 600) -> Column:
    return F.md5(F.concat_ws("|", seed, F.substring(text, 1, n)))


def lines(c: Column) -> Column:
    """A cell's lines and bullets, each squeezed."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[\n•●▪·]"), squeeze), lambda s: s != "")


def part_no_candidates(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit(r"\b([A-Z0-9]{8,14})\b"), 1))


def without_part_nos(c: Column) -> Column:
    return squeeze(F.aggregate(part_no_candidates(c), F.upper(F.coalesce(c, F.lit(""))), lambda s, p: F.replace(s, p, F.lit(""))))


def tokens(c: Column) -> Column:
    """Different lower-case words."""
    return F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9가-힣]+"), ""))


def tags(c: Column, seeds: list[str], stop: list[str], n: int = 6) -> Column:
    """Seed words that a text has, then its own words, at most n."""
    lower = F.lower(F.coalesce(c, F.lit("")))
    hits = once(lower, lambda low: F.filter(F.array(*map(F.lit, seeds)), lambda s: F.contains(low, F.lower(s))))
    own = F.filter(F.regexp_extract_all(lower, F.lit(r"([a-z0-9가-힣]{2,})"), 1), lambda w: ~w.isin(stop))
    return F.slice(F.array_distinct(F.concat(hits, own)), 1, n)


def reason_key(c: Column) -> Column:
    """The technical words of a reason in order; without any, the reason itself."""
    upper = F.trim(F.upper(F.coalesce(c, F.lit(""))))
    found = once(upper, lambda u: F.array_join(F.filter(F.array(*map(F.lit, TECH_KEYWORDS)), lambda k: F.contains(u, k)), "_"))
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.coalesce(once(found, blank_to_null), merge_text(c)))


def without_fragments(c: Column, banned: list[str]) -> Column:
    """A text of fragments between bars without those that hold a banned word."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), squeeze)
    fine = lambda p: (p != "") & ~F.exists(F.array(*map(F.lit, banned)), lambda b: F.contains(p, b))
    return F.array_join(F.filter(parts, fine), " | ")


def referenced_part_no(c: Column) -> Column:
    """The number that a remark refers to, as it is written."""
    text = F.coalesce(c, F.lit(""))
    return F.coalesce(*(blank_to_null(F.regexp_extract(text, p, 1)) for p in REFERENCES), F.lit(""))


def row_json(names: list[str]) -> Column:
    """A row's cells as JSON, keys in order, cells cleaned."""
    return F.to_json(F.struct(*(clean(F.col(n)).alias(n) for n in sorted(names))))


def wrap_json(c: Column, prefix: str = "RAGJSON:") -> Column:
    return F.concat(F.lit(prefix), c)


def unwrap_json(c: Column, prefix: str = "RAGJSON:") -> Column:
    return F.when(F.startswith(c, F.lit(prefix)), F.substring(c, len(prefix) + 1, 1 << 30))


def json_in_fence(c: Column) -> Column:
    """What stands in a fenced code block, or else the stripped text."""
    fenced = blank_to_null(F.regexp_extract(c, r"(?is)```(?:json)?\s*(.*?)\s*```", 1))
    return F.coalesce(fenced, strip(c))


def is_part_no(c: Column) -> Column:
    """Not one of the marks for none."""
    return ~clean(c).isin(SYMBOLS)


def looks_like_part_no(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(r"^[A-Z]{2,5}\d{5,12}$"), F.lit(False))


def is_real_part_no(c: Column) -> Column:
    """Five letters and digits at least, and no mark for one to come."""
    text = strip(F.coalesce(c, F.lit("")))
    return ~F.upper(text).isin(NO_NUMBER_YET) & (F.length(part_no_strict(text)) >= 5)


def is_placeholder_part_no(c: Column) -> Column:
    """Words in place of a number; a blank cell is none."""
    no_number = lambda text: contains_any(text, PLACEHOLDER_WORDS) | F.regexp_replace(text, "[^A-Z0-9]", "").rlike("^[A-Z]*$")
    return once(F.upper(strip(F.coalesce(c, F.lit("")))), lambda text: (text != "") & no_number(text))


def real_part_no(*cs: Column) -> Column:
    """The first real number among some cells, strict; blank without any."""
    found = [F.when(is_number(c), blank_to_null(part_no_strict(c))) for c in cs]
    return F.coalesce(*found, F.lit(""))


def is_number(c: Column) -> Column:
    return once(F.upper(strip(F.coalesce(c, F.lit("")))), lambda upper: (upper != "") & ~contains_any(upper, PENDING_MARKS))


def contains_any(c: Column, words: list[str]) -> Column:
    # one pattern: a lambda over the words would compute c for each of them
    quoted = (rf"\Q{w}\E" for w in (w.replace(r"\E", r"\E\\E\Q") for w in words))
    return c.rlike("|".join(quoted)) if words else F.lit(False)


def has_keyword(c: Column, word: str) -> Column:
    """An ASCII word as a whole one, any other as a part; case doesn't count."""
    lower = F.lower(F.coalesce(c, F.lit("")))
    if word.isascii():
        return lower.rlike(rf"(?<![a-z0-9])\Q{word.lower()}\E(?![a-z0-9])")
    return F.contains(lower, F.lit(word.lower()))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of different words."""
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1))


def product_type(c: Column) -> Column:
    """A product type as written; blank where the cell explains rather than names."""

    def named(text: Column) -> Column:
        long = (F.contains(text, F.lit(" ")) & (F.length(text) > 24)) | (F.length(text) > 40)
        bad = contains_any(F.upper(text), [w.upper() for w in EXPLAINING_WORDS]) | contains_any(text, EXPLAINING_SIGNS)
        return F.when(bad | long, "").otherwise(text)

    return once(F.regexp_replace(squeeze(F.coalesce(c, F.lit(""))), r"^[ \-:\t]+|[ \-:\t]+$", ""), named)


def product_by_model(c: Column) -> Column:
    """The product type that a model's first letter stands for."""
    first = F.substring(F.upper(strip(F.coalesce(c, F.lit("")))), 1, 1)
    return F.when(first == "W", "Built-in Oven").when(first == "M", "Microwave Oven").otherwise("Oven/Microwave")


def first_step(c: Column) -> Column:
    """The first step of a path."""
    return F.trim(F.get(F.split(F.coalesce(c, F.lit("")), ">"), 0))


def vector_text(c: Column, digits: int = 6) -> Column:
    """An array of numbers as "[x,y]" with fixed digits."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.format_string(f"%.{digits}f", x.cast("double"))), ","), F.lit("]"))


def sparse_text(c: Column, size: int, digits: int = 6) -> Column:
    """A map from places (from 0) to weights as "{place:weight,...}/size", places from 1 on in order; none of weight 0."""
    entries = F.filter(F.array_sort(F.map_entries(c)), lambda e: e["value"] != 0)
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.format_string(f"%d:%.{digits}f", e["key"] + 1, e["value"].cast("double"))), ","), F.lit(f"}}/{size}"))


def all_blank(*cs: Column) -> Column:
    """No cell holds more than white space."""
    return F.forall(F.array(*cs), lambda c: clean_cell(c).isNull())


def is_noise_change(module: Column, description: Column) -> Column:
    """Change points that are check boxes or of a test's table."""
    compact = F.regexp_replace(F.upper(F.coalesce(description, F.lit(""))), SPACE, "")
    return F.contains(F.coalesce(module, F.lit("")), F.lit("과전압")) | compact.isin("O", "X", "(O,X)", "OX")
