"""Joins on what a text holds: many patterns, found by their pieces.

A pattern's literal text is cut into pieces of up to eight signs; a shorter one is
a piece as it is.  Texts that hold the pattern hold all its pieces, so its rarest
piece, looked up among the texts' pieces, leads to few texts, which are then tested.
Neither side is fetched or made part of an expression; both may have any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.session import checkpointed

PIECE = 8


def pieces(text: Column, n: Column) -> Column:
    """The different pieces of n signs of a text."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1))
    return F.array_distinct(F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.substring(text, i, n)))


def _found(texts: DataFrame, patterns: DataFrame, test: str) -> DataFrame:
    """text, pattern of the texts (text, low) for which ``test`` holds with a pattern (pattern, literals).

    A pattern without literal text meets every text; one of several literal parts
    is looked up by the rarest piece of all of them.
    """
    own = F.flatten(F.transform("literals", lambda x: pieces(x, F.least(F.length(x), F.lit(PIECE)))))
    own = F.when(F.size(own) == 0, F.array(F.lit(""))).otherwise(F.array_distinct(own))
    patterns = checkpointed(patterns.select("pattern", "literals", own.alias("pieces")))
    sizes = sorted(r["n"] for r in patterns.select(F.explode(F.transform("pieces", F.length)).alias("n")).distinct().collect())  # 0 to PIECE
    if not sizes:
        return texts.select("text", F.lit("").alias("pattern")).where("false")
    texts = checkpointed(texts, deal=True)
    every = F.flatten(F.array(*(pieces(F.col("low"), F.lit(n)) if n else F.array(F.lit("")) for n in sizes)))
    index = texts.select("text", "low", F.explode(every).alias("piece"))
    # a pattern of one piece has no choice; of others, a piece that no text holds is the rarest
    one = patterns.where("size(pieces) = 1").select("pattern", "literals", F.get("pieces", 0).alias("piece"))
    several = patterns.where("size(pieces) > 1").select("pattern", "literals", F.explode("pieces").alias("piece"))
    often = index.select("piece").join(several.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("n"))
    rarest = several.join(often, "piece", "left").groupBy("pattern").agg(F.min_by(F.struct("piece", "literals"), F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("x"))
    keys = checkpointed(one.unionByName(rarest.select("pattern", "x.literals", "x.piece")))
    held = F.forall("literals", lambda x: F.contains("low", x))  # far cheaper than most tests
    return keys.join(index, "piece").where(held).where(F.expr(test)).select("text", "pattern")


def holding(texts: DataFrame, patterns: DataFrame, text: str, pattern: str, *, any_case: bool = False) -> DataFrame:
    """text, pattern: all different pairs of a text and a pattern that it holds.

    Nulls and empty patterns are held nowhere; with any_case both are compared
    in lower case.
    """
    low = F.lower if any_case else lambda c: c
    texts = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct()
    patterns = patterns.where(F.coalesce(F.col(pattern), F.lit("")) != "").select(F.col(pattern).alias("pattern")).distinct()
    test = "contains(lower(text), lower(pattern))" if any_case else "contains(text, pattern)"
    return _found(texts.withColumn("low", low(F.col("text"))), patterns.withColumn("literals", F.array(low(F.col("pattern")))), test)


def matching(texts: DataFrame, patterns: DataFrame, text: str, pattern: str) -> DataFrame:
    """text, pattern: all different pairs for which ``text ILIKE pattern`` holds.

    In a pattern % stands for any signs, _ for one, and a backslash takes the next
    sign as it is; its literal parts are looked up.  Nulls match nothing.
    """
    texts = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct()
    patterns = patterns.where(F.col(pattern).isNotNull()).select(F.col(pattern).alias("pattern")).distinct()
    # a part ends at a sign that stands for others, and at an escaped one
    parts = F.split(F.lower("pattern"), r"\\.|[%_]")
    literals = F.array_distinct(F.filter(parts, lambda x: x != ""))
    return _found(texts.withColumn("low", F.lower("text")), patterns.withColumn("literals", literals), "text ILIKE pattern")
