"""What filters remove in every order in which they can be applied.

Documents' flags are crossed with all orders of the filters (a table whose size
only the number of filters sets), each pair becomes one row for each step, and
what a step does follows from the first step at which the document fails.  The
rows are added up by part, order and step where they arise, so a shuffle carries
at most one row of each such group from each task, however the parts are skewed.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.llm.common import WORDS, materialize, n_partitions

#: Seven filters have 5,040 orders.
MOST_FILTERS = 7

#: Documents that one task replays.
TASK_ROWS = 50_000
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def replay(flags: DataFrame, filters: str, *, part: str = "part", fails: str = "fails", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """part, filter_order, step, COUNTS and shapley for every part, order and step.

    ``fails`` is a long whose i-th bit says that a document fails the i-th of
    ``filters`` (one letter each); ``good`` and ``toxic`` are booleans, null
    counting as false.  Parts have all steps, with zeros; an empty table has no
    parts.
    """
    if not 0 < len(filters) <= MOST_FILTERS or len(set(filters)) != len(filters):
        raise ValueError(f"1 to {MOST_FILTERS} different letters, not {filters!r}")
    spark = flags.sparkSession
    bit = {letter: 1 << i for i, letter in enumerate(filters)}
    orders = [(i, "".join(o), [bit[x] for x in o]) for i, o in enumerate(permutations(filters))]
    orders = spark.createDataFrame(orders, "order_no int, filter_order string, bits array<int>")
    rows = flags.select(
        F.col(part).alias("part"),
        F.col(fails).cast("int").alias("fails"),
        F.coalesce(F.col(good), F.lit(False)).alias("good"),
        F.coalesce(F.col(toxic), F.lit(False)).alias("toxic"),
    ).crossJoin(F.broadcast(orders.select("order_no", "bits")))
    fails_at = lambda i: F.col("fails").bitwiseAND(F.get("bits", F.lit(i))) != 0
    first = F.coalesce(*(F.when(fails_at(i), i + 1) for i in range(len(filters))), F.lit(len(filters) + 1))
    steps = rows.withColumn("first", first).select(
        "part", "order_no", "fails", "good", "toxic", "first", F.posexplode("bits").alias("at", "bit")
    ).withColumn("step", F.col("at") + 1)
    count = lambda holds: F.sum(F.when(holds, 1).otherwise(0))
    removed = F.col("first") == F.col("step")
    summed = steps.groupBy("part", "order_no", "step").agg(
        count(F.col("first") > F.col("step")).alias("kept"),
        count(removed).alias("removed"),
        count((F.col("first") < F.col("step")) & (F.col("fails").bitwiseAND(F.col("bit")) != 0)).alias("redundant"),
        count(F.col("fails") == F.col("bit")).alias("unique_fails"),
        count(removed & F.col("good")).alias("good_lost"),
        count(removed & F.col("toxic")).alias("toxic_lost"),
    )
    named = summed.join(F.broadcast(orders.select("order_no", "filter_order")), "order_no")
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    shapley = F.sum("removed").over(Window.partitionBy("part", letter))
    return named.select("part", "filter_order", "step", *COUNTS, shapley.alias("shapley"))


def text_flags(docs: DataFrame, conditions: dict[str, Column], *, repeats: str | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part and fails (a bit for each condition, in their order) of every row of docs.

    A condition is a Column over ``text`` (null: empty) and ``words``, true where
    a document fails.  With ``repeats`` one more bit says that a row of a smaller
    identifier has the same text, which its SHA-256 and length tell: a null
    identifier is neither smaller nor larger, and of rows that repeat identifier
    and text none fails for the others.  A null part is the empty string.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
        F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)).alias("words"),
    )
    fails = F.lit(0)
    for i, condition in enumerate(conditions.values()):
        fails = fails + F.when(condition, 1 << i).otherwise(0)
    told = rows.select("doc_id", "part", fails.alias("fails"), F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("n_bytes"))
    if repeats is None:
        return told.select("doc_id", "part", "fails")
    told = materialize(told, "flags")
    firsts = told.groupBy("digest", "n_bytes").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    # a table of its own, so that a join with a very common text can be split
    firsts = materialize(firsts.where("first < last").drop("last"), "firsts")
    later = F.when(F.col("doc_id") > F.col("first"), 1 << len(conditions)).otherwise(0)
    return told.join(firsts, ["digest", "n_bytes"], "left").select("doc_id", "part", (F.col("fails") + later).alias("fails"))


def quality_conditions() -> dict[str, Column]:
    """Too short, too repetitive, too many capitals, signs of markup or code."""
    capitals = F.regexp_count("text", F.lit("[A-Z]"))
    n = F.size("words")
    return {
        "A": n < 200,
        "B": F.size(F.array_distinct("words")) * 100 < n * 50,
        "C": capitals.cast("long") * 100 > F.char_length("text").cast("long") * 2,
        "D": F.col("text").rlike("[#$%&*|]"),
    }


def audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column] | None = None, *, repeats: str | None = "E", **columns: str) -> DataFrame:
    """replay over documents with their labels.

    Of a document's rows in labels, one that says quality or toxic 1 counts;
    identifiers that are null or unlabelled are neither good nor toxic.  Rows of
    docs that repeat each other all count.  Other columns are not read, whatever
    their names.
    """
    conditions = quality_conditions() if conditions is None else conditions
    flags = text_flags(docs, conditions, repeats=repeats, **columns)
    tasks = max(n_partitions(docs.sparkSession), -(-docs.count() // TASK_ROWS))
    says = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic")
    )
    # few bytes become many rows: dealt by rows, not by bytes
    return replay(flags.join(says, "doc_id", "left").repartition(tasks), "".join(conditions) + (repeats or ""))
