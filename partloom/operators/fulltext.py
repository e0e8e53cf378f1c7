"""Full-text search over labelled nodes: an inverted index as tables, and BM25 top k.

The index is three tables: postings (a row for each word of each node, with its
weight), blocks (a word's postings dealt by identifier into blocks of a bounded
size, each with its largest weight) and corpora (a row for each label).  A search
asks many texts at once and is exact.

Words are rare or frequent by how many nodes of a label hold them.  Nodes with a rare
word of a query are few and are scored one by one.  All others score by their frequent
words alone, so nodes with equal weights of all frequent words that are asked are one
class, and queries with the same frequent words are one request: classes meet
requests, and of the best classes each request takes the k first nodes.

That search starts from the words that can add most, which gives each request a score
that its k best classes reach at least.  Words that all together stay below that score
find no classes of their own any more, blocks that can't reach it are not read, and
only classes that still can are looked up in the postings of frequent words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partloom.session import checkpointed

K1, B = 1.2, 0.75

#: Postings of one word in one block, about.
BLOCK = 4096

#: A word that at most so many nodes of a label hold is rare there.
RARE = 64

#: Scores are compared by six digits; bounds leave room for that.
_ROOM = 1e-5


def words_of(text: Column) -> Column:
    """The words of a text in lower case: letters and digits of any script."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


@dataclass
class Index:
    postings: DataFrame  # label, term, block, id, weight
    blocks: DataFrame  # label, term, block, df, most (the block's largest weight)
    corpora: DataFrame  # label, n, mean_length


def nodes_of(tables: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """label, id, text of several tables: their key, and the columns that are searched."""
    out = None
    for label, (df, key, fields) in tables.items():
        one = df.select(F.lit(label).alias("label"), F.col(key).cast("string").alias("id"), F.concat_ws(" ", *(F.col(c).cast("string") for c in fields)).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def build_index(nodes: DataFrame, *, block: int = BLOCK, path: str | None = None) -> Index:
    """The index of nodes (label, id, text), each label a corpus of its own.

    With a path it is kept there, postings partitioned by label, for open_index;
    else in the folder that the cluster shares.  Nodes without words count in
    their corpus' size and mean, and are never found.
    """
    counted = nodes.select("label", "id", words_of(F.col("text")).alias("words")).withColumn("length", F.size("words"))
    counted = checkpointed(counted)
    corpora = checkpointed(counted.groupBy("label").agg(F.count("*").alias("n"), F.avg("length").alias("mean_length")))
    found = counted.select("label", "id", "length", F.explode("words").alias("term")).groupBy("label", "id", "length", "term").agg(F.count("*").alias("tf"))
    found = checkpointed(found)
    df = checkpointed(found.groupBy("label", "term").agg(F.count("*").alias("df")))
    rare = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = rare * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    number = F.pmod(F.xxhash64("id"), F.ceil(F.col("df") / block)).cast("int")
    postings = found.join(df, ["label", "term"]).join(F.broadcast(corpora), "label")  # corpora: a row for each label
    postings = postings.select("label", "term", number.alias("block"), "id", "df", weight.alias("weight"))
    if path is None:
        postings = checkpointed(postings)
        blocks = checkpointed(_blocks(postings))
        return Index(postings.drop("df"), blocks, corpora)
    postings.write.partitionBy("label").parquet(f"{path}/postings")
    spark = nodes.sparkSession
    _blocks(spark.read.parquet(f"{path}/postings")).write.parquet(f"{path}/blocks")
    corpora.write.parquet(f"{path}/corpora")
    return open_index(spark, path)


def _blocks(postings: DataFrame) -> DataFrame:
    return postings.groupBy("label", "term", "block").agg(F.first("df").alias("df"), F.max("weight").alias("most"))


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that build_index kept."""
    return Index(spark.read.parquet(f"{path}/postings").drop("df"), spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/corpora"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    """The k best (by six digits, then id) of each query and label, with their rank.

    Tasks keep k of each group before any shuffle.
    """
    order = Window.partitionBy("query", "label").orderBy(F.desc("score"), "id")
    return scores.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _first_of_equal(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """rows with their place by id among those of equal keys, up to k."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def search(index: Index, queries: DataFrame, k: int, *, labels: list[str] | None = None, seeds: int = BLOCK, rare: int = RARE) -> DataFrame:
    """query, label, id, score, rank: the k best nodes of each label for each of
    queries (query, text).

    A query's words count once; one without known words finds nothing.  ``seeds``
    is about how many postings give a request its first bound; words of at most
    ``rare`` nodes are rare.
    """
    blocks = index.blocks if labels is None else index.blocks.where(F.col("label").isin(labels))
    said = checkpointed(queries.select("query", F.explode(F.array_distinct(words_of(F.col("text")))).alias("term")))
    df = blocks.groupBy("label", "term").agg(F.max("df").alias("df")).join(said.select("term").distinct(), "term", "left_semi")
    df = checkpointed(df)  # the asked words of each label
    asked = checkpointed(said.join(df, "term"))  # query, label, term, df
    often = df.where(F.col("df") > rare).select("label", "term")

    # nodes by their weights of frequent words
    weights = F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("weights")
    nodes = checkpointed(index.postings.join(often, ["label", "term"]).groupBy("label", "id").agg(weights))
    firsts = checkpointed(_first_of_equal(nodes, ["label", "weights"], k))
    heads = firsts.where("place = 1").select("label", F.col("id").alias("head"), "weights")
    members = firsts.join(heads, ["label", "weights"]).select("label", "head", "id")

    # queries by their frequent words
    terms = F.array_sort(F.collect_list(F.when(F.col("df") > rare, F.col("term")))).alias("terms")
    wanted = checkpointed(asked.groupBy("query", "label").agg(terms))
    requests = checkpointed(wanted.where(F.size("terms") > 0).groupBy("label", "terms").agg(F.min("query").alias("request")))

    found = _search(_index_of(heads), requests.select(F.col("request").alias("query"), "label", F.explode("terms").alias("term")), k, seeds)
    found = found.select(F.col("query").alias("request"), "label", F.col("id").alias("head"), "score").join(members, ["label", "head"])
    found = _best(found.select(F.col("request").alias("query"), "label", "id", "score"), k).select(F.col("query").alias("request"), "label", "id", "score")
    usual = wanted.join(requests, ["label", "terms"]).select("query", "label", "request").join(checkpointed(found), ["label", "request"])

    # nodes with a rare word: its weight and those of the frequent words
    few = asked.where(F.col("df") <= rare).select("query", "label", "term").join(index.postings.drop("block"), ["label", "term"])
    few = few.groupBy("query", "label", "id").agg(F.sum("weight").alias("own"))
    few = few.join(wanted, ["query", "label"]).join(nodes, ["label", "id"], "left")
    shared = F.filter(F.coalesce("weights", F.array().cast(nodes.schema["weights"].dataType)), lambda w: F.array_contains("terms", w["term"]))
    score = F.aggregate(shared, F.col("own"), lambda got, w: got + w["weight"])
    few = few.select("query", "label", "id", score.alias("score"))

    # a node of both has its own words too where it scores more
    scores = usual.select("query", "label", "id", "score").unionByName(few).groupBy("query", "label", "id").agg(F.max("score").alias("score"))
    return _best(scores, k).select("query", "label", "id", "score", "rank")


def _index_of(heads: DataFrame) -> Index:
    """An index of classes (label, head, weights)."""
    held = checkpointed(heads.select("label", F.col("head").alias("id"), F.explode("weights").alias("w")).select("label", "id", "w.*"))
    df = held.groupBy("label", "term").agg(F.count("*").alias("df"))
    number = F.pmod(F.xxhash64("id"), F.ceil(F.col("df") / BLOCK)).cast("int")
    postings = checkpointed(held.join(df, ["label", "term"]).select("label", "term", number.alias("block"), "id", "df", "weight"), "label", "id")
    return Index(postings.drop("df"), checkpointed(_blocks(postings)), heads.select("label").distinct())


def _search(index: Index, asked: DataFrame, k: int, seeds: int) -> DataFrame:
    """query, label, id, score: the k best of each query (query, label, term)."""
    asked = checkpointed(asked.join(index.blocks, ["label", "term"]), deal=True)  # query, label, term, block, df, most
    terms = asked.groupBy("query", "label", "term").agg(F.max("df").alias("df"), F.max("most").alias("most"))
    of = Window.partitionBy("query", "label")  # a query's words
    down = of.orderBy(F.desc("most"), "term").rowsBetween(Window.unboundedPreceding, -1)
    terms = terms.withColumn("before", F.coalesce(F.sum("df").over(down), F.lit(0)))

    # a bound from the words of the largest weights
    first = asked.join(terms.where(F.col("before") < seeds).select("query", "label", "term"), ["query", "label", "term"], "left_semi")
    scored = first.join(index.postings, ["label", "term", "block"]).groupBy("query", "label", "id").agg(F.sum("weight").alias("score"))
    bound = _best(scored, k).groupBy("query", "label").agg(F.when(F.count("*") == k, F.min("score") - _ROOM).otherwise(0.0).alias("bound"))

    # words that reach it together find nodes; the others only add to them
    up = of.orderBy("most", F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    told = terms.join(bound, ["query", "label"]).withColumns({"finds": F.sum("most").over(up) >= F.col("bound"), "all": F.sum("most").over(of)})
    told = checkpointed(told.withColumn("rest", F.sum(F.when(~F.col("finds"), F.col("most")).otherwise(0.0)).over(of)))
    finders = asked.join(told.where("finds").select("query", "label", "term", "bound", "all", "rest", F.col("most").alias("top")), ["query", "label", "term"])
    # a node in such a block has at most the block's weight and all other words'
    finders = finders.where(F.col("all") - F.col("top") + F.col("most") >= F.col("bound")).select("query", "label", "term", "block", "bound", "rest")
    found = finders.join(index.postings, ["label", "term", "block"]).groupBy("query", "label", "id").agg(F.sum("weight").alias("weight"), F.first("bound").alias("bound"), F.first("rest").alias("rest"))
    found = checkpointed(found.where(F.col("weight") + F.col("rest") >= F.col("bound")).select("query", "label", "id", "weight"))
    adders = told.where(~F.col("finds")).select("query", "label", "term")
    more = found.select("query", "label", "id").join(adders, ["query", "label"]).join(index.postings.drop("block"), ["label", "term", "id"])
    scores = found.unionByName(more.select("query", "label", "id", "weight")).groupBy("query", "label", "id").agg(F.sum("weight").alias("score"))
    return _best(scores, k).select("query", "label", "id", "score")
