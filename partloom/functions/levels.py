"""Numbers, BOM levels and flags as they are written in sheets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partloom.functions.text import clean, squeeze, strip


def to_double(c: Column) -> Column:
    return F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double")


def to_int(c: Column) -> Column:
    """Cut towards zero; what isn't a number is null."""
    return to_double(strip(c)).try_cast("int")


def qty(c: Column) -> Column:
    """In one spelling: whole numbers without a point, marks as they are."""
    text = clean(c)
    d = text.try_cast("double")
    return F.when(d.isNull(), text).when(d == F.floor(d), F.floor(d).cast("string")).otherwise(d.cast("string"))


def number_in(c: Column) -> Column:
    """The digits and points of a cell as a number, 0 without."""
    return F.coalesce(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\d\.]+", "").try_cast("double"), F.lit(0.0))


def _dots(text: Column) -> Column:
    return F.length(F.regexp_extract(text, r"^(\.+)", 1))


def depth_by_dots(c: Column) -> Column:
    """".1", "..2" by their dots, "3" by itself, else null."""
    text = strip(c)
    return F.when(_dots(text) > 0, _dots(text)).when(text.rlike(r"^\d+$"), text.try_cast("int"))


def depth_by_digits(c: Column) -> Column:
    """The digits at the end, else the number of dots, else null."""
    text = clean(c)
    digits = F.regexp_extract(text, r"(\d+)$", 1)
    dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    return F.when(digits != "", digits.try_cast("int")).when(dots > 0, dots)


def depth_or_one(c: Column) -> Column:
    """The digits at the end, else the number of dots, one at least."""
    return F.coalesce(depth_by_digits(c), F.lit(1))


def depth_lenient(c: Column) -> Column:
    """Dots in front, else a number cut to an integer, else one."""
    text = strip(F.coalesce(c, F.lit("")))
    return F.when(_dots(text) > 0, _dots(text)).otherwise(F.coalesce(text.try_cast("double").try_cast("int"), F.lit(1)))


def depth_or(c: Column, missing: int | None) -> Column:
    """All dots of a text that starts with one, else an integer, else missing."""
    text = strip(F.coalesce(c, F.lit("")))
    dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    number = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))
    return F.when(F.startswith(text, F.lit(".")), dots).otherwise(F.coalesce(number, F.lit(missing).cast("int")))


def yes_no(c: Column) -> Column:
    """O, X, null for "-" and blank, else the first sign."""
    text = strip(c)
    first = F.substring(text, 1, 1)
    return (
        F.when((text == "") | (text == "-"), None)
        .when(first.isin("○", "●", "O", "o", "Y", "y", "◯", "◎"), "O")
        .when(first.isin("X", "x", "N", "n", "✕", "✗", "×"), "X")
        .otherwise(first)
    )


def impact_kind(distance: Column) -> Column:
    return F.when(distance == 0, "direct").when(distance == 1, "parent").otherwise("ancestor")


def plain_number(c: Column) -> Column:
    """A double as text: blank for null and NaN, whole numbers without a point."""
    return F.when(c.isNull() | F.isnan(c), "").when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def distance_to_similarity(c: Column) -> Column:
    return F.when((c > 0) & (c < 1), 1 - c).otherwise(F.lit(0.7))


def ui_text(c: Column, forbidden: list[str]) -> Column:
    """Squeezed; blank if it holds a forbidden word."""
    text = squeeze(F.coalesce(c, F.lit("")))
    bad = F.exists(F.array(*map(F.lit, forbidden)), lambda w: F.contains(text, w))
    return F.when(bad, "").otherwise(text)


def numbered(items: Column) -> Column:
    """An array as numbered lines."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def depth_or_zero(c: Column) -> Column:
    """The digits at the end, zero without any."""
    return F.coalesce(F.regexp_extract(strip(F.coalesce(c, F.lit(""))), r"(\d+)\s*$", 1).try_cast("int"), F.lit(0))


def is_working_row(c: Column) -> Column:
    """Not one of the levels that mark a substitute or a query (*S*, *Q*)."""
    level = F.upper(strip(F.coalesce(c, F.lit(""))))
    return ~(F.startswith(level, F.lit("*S*")) | F.startswith(level, F.lit("*Q*")))


def dot_depth(c: Column) -> Column:
    """For sorting: the dots of a level that starts with one, behind all others without."""
    text = F.coalesce(c, F.lit(""))
    return F.when(F.startswith(text, F.lit(".")), F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))).otherwise(998)
