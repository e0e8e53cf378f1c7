"""Model codes and development grades, in the dialects that sources use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partloom.functions.text import blank_to_null

# Fixed value: words that ask for the wider reference pool.
REFERENCE_TRIGGERS = ["최초", "first", "최근", "트렌드", "camera", "카메라", "led", "하네스", "화각", "옵셋"]


# How documents write a development grade, in order: behind its
# label, before its suffix, in brackets, alone.
GRADE_PATTERNS = [r"(?i)(?:개발\s*등급|등급)\s*[:/ ]*\s*([ABCD])\b", r"(?i)(?<![A-Z0-9])([ABCD])\s*급(?![A-Za-z0-9가-힣])", r"(?i)\(([ABCD])\)", r"(?i)^\s*([ABCD])\s*$"]
EUROPE_WORDS = ["EU", "유럽", "EUROPE", "GLOBAL", "글로벌"]


def core9(c: Column) -> Column:
    """The nine-place code of one token: without a channel letter in front of W
    or L, and of a longer one the first eight places and the last."""
    s = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")
    body = F.when(s.rlike("^[KC][WL]"), F.substring(s, 2, 64)).otherwise(s)
    return (
        F.when(~body.rlike("^[WL]"), "")
        .when(F.length(body) == 9, body)
        .when(F.length(body) > 9, F.concat(F.substring(body, 1, 8), F.substring(body, -1, 1)))
        .otherwise("")
    )


def channel(c: Column) -> Column:
    s = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")
    return F.when(s.rlike("^[KC][WL]"), F.substring(s, 1, 1)).otherwise("")


def model_code(c: Column) -> Column:
    """The first token of a text that is a code."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?i)\b([KC]?[A-Z0-9]{9,15})\b"), 1)
    return F.coalesce(F.get(F.filter(F.transform(found, core9), lambda x: x != ""), 0), F.lit(""))


def nine_places(c: Column) -> Column:
    """The first nine-place token that starts with W or L."""
    return F.regexp_extract(F.upper(F.coalesce(c, F.lit(""))), r"\b([WL][A-Z0-9]{8})\b", 1)


def wide_code(c: Column) -> Column:
    """As nine_places, with three more first letters."""
    return F.regexp_extract(F.upper(F.coalesce(c, F.lit(""))), r"\b([WLMCH][A-Z0-9]{8})", 1)


def places(code: Column) -> Column:
    """What the places of a nine-place code stand for; null for any other."""
    at = lambda i, n=1: F.substring(code, i, n)
    names = [("product", at(1)), ("kind", at(2)), ("series", at(3)), ("platform", at(4)), ("capacity", at(5, 2)), ("design", at(7)), ("grade", at(8)), ("color", at(9))]
    return F.when(F.length(code) == 9, F.struct(*(c.alias(n) for n, c in names)))


def grade(c: Column) -> Column:
    """A development grade A to D: behind its label, before its suffix, in brackets, alone."""
    text = F.coalesce(c, F.lit(""))
    return F.upper(F.coalesce(*(blank_to_null(F.regexp_extract(text, p, 1)) for p in GRADE_PATTERNS), F.lit("")))


def search_prefix(code: Column, dev_grade: Column) -> Column:
    """How much of a code must agree: seven places for grade D, six for C, else four."""
    g = F.upper(F.trim(F.coalesce(dev_grade, F.lit(""))))
    n = F.when(F.length(code) != 9, F.length(code)).when(g == "D", 7).when(g == "C", 6).otherwise(4)
    return F.substring(code, F.lit(1), n)


def size_inch(code: Column) -> Column:
    """The capacity places as a number."""
    return F.substring(code, 5, 2).try_cast("int")


def asks_for_reference(c: Column) -> Column:
    lower = F.lower(F.coalesce(c, F.lit("")))
    return F.exists(F.array(*map(F.lit, REFERENCE_TRIGGERS)), lambda w: F.contains(lower, w))


def differences(base: Column, new: Column) -> Column:
    """Kinds of difference between two codes, with the size gap where there is one."""
    b, n = places(base), places(new)
    gap = F.abs(size_inch(base) - size_inch(new))
    size = F.when(gap == 0, "medium").when(gap <= 3, "small").when(gap <= 6, "medium").when(gap.isNotNull(), "large").otherwise("medium")
    kinds = [F.when(b[f] != n[f], F.lit(f)) for f in ("product", "kind", "series", "platform", "design", "grade", "color")]
    sized = F.when(b["capacity"] != n["capacity"], F.concat(F.lit("capacity:"), size))
    return F.filter(F.array(*kinds, sized), lambda x: x.isNotNull())


def policy(text: Column, dev_grade: Column, changes: Column) -> Column:
    """How to search for one request: its code, prefix, product gate, wider pool."""
    code = model_code(text)
    return F.struct(
        F.upper(F.trim(F.coalesce(dev_grade, F.lit("")))).alias("dev_grade"),
        code.alias("core9"),
        search_prefix(code, dev_grade).alias("primary_prefix"),
        F.substring(code, 1, 1).alias("product_gate"),
        asks_for_reference(changes).alias("secondary"),
    )


def said_model(c: Column) -> Column:
    """The first token of what someone says that is a code once its channel letter
    is gone and a longer one is cut to eight places and the last."""
    found = F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit(r"\b([KC]?[WL][A-Z0-9]{7,14})\b"), 1)
    bare = lambda s: F.when((F.length(s) >= 10) & s.rlike("^[KC][WL]"), F.substring(s, 2, 64)).otherwise(s)
    cut = lambda s: F.when(F.length(s) > 9, F.concat(F.substring(s, 1, 8), F.substring(s, -1, 1))).otherwise(s)
    codes = F.filter(F.transform(found, lambda s: cut(bare(s))), lambda s: (F.length(s) == 9) & s.rlike("^[WL]"))
    return F.coalesce(F.get(codes, 0), F.lit(""))


def document_model_and_grade(c: Column) -> tuple[Column, Column]:
    """The first nine-place code of a document and its grade: labelled or in brackets, whichever comes first."""
    text = F.coalesce(c, F.lit(""))
    both = r"(?i)(?:개발\s*등급|등급)\s*[:/ ]\s*([ABCD])\b|\(([ABCD])\)"
    return nine_places(text), F.upper(F.concat(F.regexp_extract(text, both, 1), F.regexp_extract(text, both, 2)))


def oven_size(capacity: Column, region: Column, product: Column, kind: Column) -> Column:
    """A size class from a code's capacity places, by product and region."""
    val = F.coalesce(F.when(capacity.rlike(r"^\d+$"), capacity.try_cast("int")), F.lit(0))
    product, kind = F.upper(F.coalesce(product, F.lit(""))), F.upper(F.coalesce(kind, F.lit("")))
    area = F.upper(F.coalesce(region, F.lit("")))
    europe = F.exists(F.array(*map(F.lit, EUROPE_WORDS)), lambda w: F.contains(area, w))
    oven = F.when(europe, F.when(val.between(65, 80), "24").otherwise("UNKNOWN")).when(val <= 30, "24").when(val <= 60, "30").otherwise("30+")
    return (
        F.when((product == "W") & kind.isin("S", "D", "C"), oven).when(product == "M", F.when(val <= 25, "SMALL").when(val <= 32, "MEDIUM").otherwise("LARGE"))
        .when(product.isin("C", "H") & (val > 0), val.cast("string")).otherwise("UNKNOWN")
    )


def said_size(c: Column) -> Column:
    """The inches that a text speaks of."""
    text = F.coalesce(c, F.lit(""))
    return F.coalesce(F.regexp_extract(text, r"(\d{2})\s*인치", 1).try_cast("int"), F.regexp_extract(text, r"\b(24|30|27|36)\b", 1).try_cast("int"))
