"""Joins of the catalogue: waterfalls by priority, rules and keywords on names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions.text import jaccard, tokens
from partloom.operators.contains import holding
from partloom.operators.merge import first_wins
from partloom.session import checkpointed


def waterfall(left: DataFrame, steps: list[tuple[str, Column, DataFrame, str]], *, cells: list[str]) -> DataFrame:
    """left with the cells of the first step that finds a row, and found_by.

    A step: its label, left's key, a table, its key column.  Tables count by
    their first row of a key (order column ord).  Keys are equal ones, so each
    step is one hash or merge join; blank keys find nothing.
    """
    out = left
    for i, (_, key, table, column) in enumerate(steps):
        side = first_wins(table.where(F.coalesce(F.col(column), F.lit("")) != ""), [column], "ord")
        side = side.select(F.col(column).alias(f"__k{i}"), F.struct(*cells).alias(f"__hit{i}"))
        out = out.join(side, key == F.col(f"__k{i}"), "left").drop(f"__k{i}")
    hit = F.coalesce(*(F.col(f"__hit{i}") for i in range(len(steps))))
    label: Column | None = None
    for i, (name, *_) in enumerate(steps):
        label = F.when(F.col(f"__hit{i}").isNotNull(), name) if label is None else label.when(F.col(f"__hit{i}").isNotNull(), name)
    out = out.withColumn("__hit", hit).withColumn("found_by", label)
    return out.select(*left.columns, "found_by", *(F.col(f"__hit.{c}").alias(f"found_{c}") for c in cells))


def first_rule(rows: DataFrame, rules: list[tuple[list[str], str]], text: Column, *, name: str = "rule") -> DataFrame:
    """rows with the label of the first rule that has a word which text holds.

    The rules are part of the program, so they go into the expression; a rule
    table of the data's size would be joined by tokens instead.
    """
    out: Column | None = None
    for words, label in rules:
        hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return rows.withColumn(name, out)


def keyword_candidates(rows: DataFrame, keywords: DataFrame, name: str) -> DataFrame:
    """query, rows' columns, position: rows whose name holds a keyword of the query,
    whatever its case, each with the position of its first keyword; rows that repeat each stay.

    keywords: query, position, word; both tables may be of any size.
    """
    found = holding(rows, keywords, name, "word", any_case=True)
    first = found.join(keywords.select("query", "position", F.col("word").alias("pattern")), "pattern").groupBy("query", "text").agg(F.min("position").alias("position"))
    first = checkpointed(first.withColumnRenamed("text", "__text"))
    return rows.join(first, F.col(name) == F.col("__text")).select("query", *(rows[c] for c in rows.columns), "position")


def either_contains(left: DataFrame, right: DataFrame, left_text: str, right_text: str, *, order: str) -> DataFrame:
    """left with the first row of right (by order) whose text holds left's, or is held in it;
    rows of left that repeat each stay, with nulls where there is none.  Empty texts hold nothing."""
    others = [c for c in right.columns if c != order]
    own = left.where(F.col(left_text) != "").select(F.col(left_text).alias("own")).distinct()
    other = right.where(F.col(right_text) != "")
    pairs = holding(own, other, "own", right_text).select(F.col("text").alias("own"), F.col("pattern").alias("other"))
    pairs = pairs.unionByName(holding(other, own, right_text, "own").select(F.col("pattern").alias("own"), F.col("text").alias("other"))).distinct()
    best = other.groupBy(F.col(right_text).alias("other")).agg(F.min(F.struct(order, *others)).alias("hit"))
    hits = checkpointed(pairs.join(best, "other").groupBy("own").agg(F.min("hit").alias("__hit")).withColumnRenamed("own", "__own"))
    out = left.join(hits, F.col(left_text) == F.col("__own"), "left")
    return out.select(*(left[c] for c in left.columns), F.col(f"__hit.{order}").alias(order), *(F.col(f"__hit.{c}").alias(c) for c in others))


def best_by_tokens(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, text: str = "text", least: int = 1) -> DataFrame:
    """left_id, right_id, score: for each row of left the row of right that shares
    most words, ``least`` at least; ties go to the smaller right_id.

    Identifiers are whole numbers.  Cells of right meet blocks of left, which
    keep the best row of each; pairs are not put down.
    """
    from partloom.operators.retrieval import _by_words

    def sets(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.select(F.col(key).alias(name), tokens(F.col(text)).alias("words"))

    enough = lambda got, nq, nd: got * (got > least - 0.5)
    best = _by_words(sets(right, right_id, "__right"), sets(left, left_id, "query"), 1, enough, doc_id="__right")
    return best.select(*(F.col(c).cast(df.schema[key].dataType).alias(key) for c, df, key in (("query", left, left_id), ("__right", right, right_id))), F.col("score").cast("long").alias("score"))


def rerank(docs: DataFrame, query: str, k: int, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The k documents most like a query by their sets of words."""
    words = tokens(F.lit(query))
    return docs.select(doc_id, F.round(jaccard(tokens(F.col(text)), words), 6).alias("score")).orderBy(F.desc("score"), doc_id).limit(k)


def catalogue_rules(rows: DataFrame, rules: DataFrame, name: str, cells: list[str]) -> DataFrame:
    """rows with the cells of the first rule (by position) one of whose words a name
    holds, nulls where there is none; rows that repeat each stay.

    rules: position, words (array) and cells, of any number.
    """
    words = rules.select("position", *cells, F.explode("words").alias("word"))
    found = holding(rows, words, name, "word").join(words.withColumnRenamed("word", "pattern"), "pattern")
    best = checkpointed(found.groupBy("text").agg(F.min(F.struct("position", *cells)).alias("__hit")).withColumnRenamed("text", "__text"))
    out = rows.join(best, F.col(name) == F.col("__text"), "left")
    return out.select(*(rows[c] for c in rows.columns), *(F.col(f"__hit.{c}").alias(c) for c in cells))
