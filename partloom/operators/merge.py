"""First and last wins, upserts, ordered folds and representatives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from partloom.functions.text import blank_to_null, is_number, merge_text, once, part_no_strict
from partloom.operators.classify import action_bucket

# Ranks of tiers, sources of levels, sourcing and actions.
TIER_RANK = {"CORE": 3, "CORE_GROUP": 2, "CASCADE": 1}
SOURCING_RANK = {"참고품번": 3, "공용검토": 2, "신규": 1}
ACTION_RANK = {"MODIFY": 0, "변경": 0, "ADD": 1, "추가": 1, "CHECK": 2, "⚠️확인필요": 2, "확인필요": 2}
LEVEL_SOURCE_RANK = {"DB": 3, "BASE": 2, "ESTIMATED": 1}


def rank(c: Column, ranks: dict[str, int], otherwise: int) -> Column:
    out = F.lit(otherwise)
    for word, r in reversed(ranks.items()):
        out = F.when(c == word, r).otherwise(out)
    return out


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the first by order.  A group is folded as it is
    read, never sorted whole."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("__row")).select(*keys, "__row.*").select(*df.columns)


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("__row")).select(*keys, "__row.*").select(*df.columns)


def _folded(df: DataFrame, keys: list[str], order: str | None, fold: Callable) -> DataFrame:
    """One row for each key; rows that tie by order are told apart by all their cells."""
    cells = [c for c in df.columns if c not in (*keys, order)]
    tie = [F.to_json(c) if isinstance(df.schema[c].dataType, MapType) else F.col(c) for c in cells]
    if not tie and not order:
        return df.distinct()
    row = fold(F.struct(F.lit(0), *cells), F.struct(*([order] if order else []), *(x.alias(f"t{i}") for i, x in enumerate(tie))))
    return df.groupBy(*keys).agg(row.alias("__row")).select(*keys, *(F.col(f"__row.{c}") for c in cells))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *, order: str | None = None) -> DataFrame:
    """The last row of new for each key, and the old ones whose keys new doesn't have.

    order is a column of new that isn't stored; of rows that tie, or without an
    order, the greatest by all cells stays.
    """
    last = _folded(new, keys, order, F.max_by).select(*old.columns)
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str], *, order: str | None = None) -> DataFrame:
    """The rows of new that a unique key lets in: none of old's, the first of its
    own by order, which isn't stored (of ties, or without an order, the least by
    all cells)."""
    first = _folded(new, keys, order, F.min_by)
    return first.select(*(c for c in new.columns if c != order)).join(old.select(*keys), keys, "left_anti")


def identity_key(*, l1: Column, act: Column, number: Column, name: Column, kind: Column, level: Column, row: Column) -> Column:
    """What makes two parts one: number, else name, kind and level, else nothing."""
    scope = [merge_text(l1), action_bucket(act)]
    no = F.when(is_number(number), part_no_strict(number)).otherwise("")
    by_no = once(no, lambda n: F.when(n != "", F.concat_ws("|", F.lit("PNO"), *scope, n)))
    by_name = once(merge_text(name), lambda n: F.when(n != "", F.concat_ws("|", F.lit("NAME"), *scope, n, merge_text(kind), merge_text(level))))
    return F.coalesce(by_no, by_name, F.concat_ws("|", F.lit("ROW"), *scope, row.cast("string")))


def append_texts(texts: Column) -> Column:
    """Texts joined by bars; one that what came before holds isn't repeated."""
    step = lambda a, t: F.when(F.coalesce(t, F.lit("")) == "", a).when(a == "", t).when(F.contains(a, t), a).otherwise(F.concat(a, F.lit(" | "), t))
    return F.aggregate(texts, F.lit(""), step)


def merge_same_parts(parts: DataFrame, *, key: str = "identity", order: str = "ord", texts: tuple[str, ...] = ("rsn", "chg", "source_doc")) -> DataFrame:
    """One row for each identity: the strongest tier, then sourcing, then the
    first; the texts of the others are appended to its own in their order.

    Groups are the rows of one part, which a catalogue bounds.
    """
    strength = F.struct(
        -rank(F.col("tier"), TIER_RANK, 0), -rank(F.col("sourcing"), SOURCING_RANK, 0), F.col(order).alias("o")
    )
    best = F.min_by(F.struct(*(c for c in parts.columns if c != key)), strength).alias("best")
    said = F.array_sort(F.collect_list(F.struct(strength.alias("s"), *texts))).alias("said")
    merged = parts.groupBy(key).agg(best, said, F.count("*").alias("merged"))
    cells = [c for c in parts.columns if c not in (key, *texts)]
    return merged.select(key, *(f"best.{c}" for c in cells), *(append_texts(F.col(f"said.{t}")).alias(t) for t in texts), "merged")


def representatives(rows: DataFrame, *, order: str = "ord") -> DataFrame:
    """Rows of one part (by number, else by name and kind) as one: the one of
    best action, shallowest level and most cells; with the shallowest level,
    what the others said in order, and their count.

    rows: number, name, kind, action, level, reason, source, ord.
    """
    no = F.when(is_number(F.col("number")), part_no_strict(F.col("number"))).otherwise("")
    keyed = rows.withColumn("dkey", F.when(no != "", F.concat(F.lit("PNO|"), no)).otherwise(F.concat_ws("|", F.lit("NAME"), merge_text(F.col("name")), merge_text(F.col("kind")))))
    filled = sum((F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0) for c in rows.columns), F.lit(0))
    level = F.coalesce("level", F.lit(""))
    dots = F.when(level == "", 9999).otherwise(F.length(level) - F.length(F.replace(level, F.lit("."), F.lit(""))))
    best = F.struct(rank(merge_text(F.col("action")), ACTION_RANK, 99), dots, -filled, F.col(order).alias("o"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda x: x[c])
    distinct = lambda c: F.filter(F.array_distinct(ordered(c)), lambda x: F.coalesce(x, F.lit("")) != "")
    return keyed.groupBy("dkey").agg(
        F.min_by("action", best).alias("action"), F.min_by("name", best).alias("name"), F.min_by("number", best).alias("number"),
        F.min_by(level, F.struct(dots, level)).alias("level"), distinct("reason").alias("reasons"), distinct("source").alias("sources"),
        F.count("*").alias("merged"),
    )


def fill_blanks(df: DataFrame, cells: dict[str, str], *, allowed: Column | None = None, blocked: tuple[str, ...] = ()) -> DataFrame:
    """df's blank cells from other columns (target: source); where allowed isn't
    true, the blocked targets stay blank.  filled names what was filled."""
    blank = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))).isin("", "nan", "none")
    names, out = [], {}
    for target, source in cells.items():
        take = blank(target) & ~blank(source)
        if target in blocked and allowed is not None:
            take = take & F.coalesce(allowed, F.lit(False))
        out[target] = F.when(take, F.col(source)).otherwise(F.col(target))
        names.append(F.when(take, F.lit(target)))
    return df.withColumns({**out, "filled": F.array_compact(F.array(*names))})


def suffix_duplicates(df: DataFrame, key: str, order: str, name: str = "id") -> DataFrame:
    """df with name: the key, and from its second row on __dup1, __dup2, ..."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return df.withColumn(name, F.when(n > 0, F.concat(F.col(key), F.lit("__dup"), n.cast("string"))).otherwise(F.col(key)))


def not_blank(c: Column) -> Column:
    return blank_to_null(F.trim(F.coalesce(c, F.lit(""))))
