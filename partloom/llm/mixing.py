"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold
them).  Each pattern supplies its words once for nothing, a second time at a
cost, a third at a higher one: convex costs, so the flow repeats nothing
before all is used.  Each source may take a document up to max_repeats times.
The small graph of patterns and sources is solved on the driver; which
documents of a pattern go where follows from their place in a seeded order,
computed on the cluster.

In a table whose rows have one source each, sources overlap where they hold the
same text: these rows are one document of several sources.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.llm.common import SPACES, WORDS, column_of, materialize, unused_names

Source = str | None


def in_order(sources: set[Source]) -> list[Source]:
    """By code point, null last."""
    return sorted(sources - {None}) + [None] * (None in sources)


def targets(sizes: dict[Source, int], weights: dict[Source, float], share: float = 1.0, max_repeats: int = 3) -> dict[Source, float]:
    """Shares of all words by weight, none above max_repeats times its source's size."""
    rest, weight = share * sum(sizes.values()), float(sum(weights.values()))
    out: dict[Source, float] = {}
    for s in sorted(sizes, key=lambda s: (sizes[s] * max_repeats / weights[s], s is None, s or "")):
        cap = float(max_repeats * sizes[s])
        if weights[s] * rest >= cap * weight:
            out[s] = cap
            rest -= cap
            weight -= weights[s]
        else:
            out[s] = weights[s] * rest / weight
    return out


def flow(supply: dict[str, int], members: dict[str, list[Source]], quota: dict[Source, int], max_repeats: int = 3) -> dict[tuple[str, Source], int]:
    """Words that each pattern gives each of its sources at least cost.

    Successive cheapest augmenting paths; the e-th use of a pattern's words
    costs e - 1 each, whichever source takes them, and no source takes them more
    than max_repeats times.
    """
    of: dict[Source, list[str]] = defaultdict(list)
    for p, sources in members.items():
        for s in sources if supply[p] else ():
            of[s].append(p)
    given: dict[tuple[str, Source], int] = defaultdict(int)
    used: dict[str, int] = defaultdict(int)
    need = dict(quota)

    def room(p: str, s: Source) -> int:
        return max_repeats * supply[p] - given[p, s]

    def augment(s0: Source) -> bool:
        # cheapest way to more words for s0: from a pattern's spare words, or by
        # taking a pattern's words from another source, which then takes others
        via, queue = {}, deque([s0])
        best = None
        while queue and (best is None or best[0]):
            s = queue.popleft()
            for p in of[s]:
                if not room(p, s):
                    continue
                epoch = used[p] // supply[p]
                if best is None or epoch < best[0]:
                    best = (epoch, s, p)
                for other in members[p]:
                    if other != s0 and other not in via and given[p, other] > 0:
                        via[other] = (s, p)
                        queue.append(other)
        if best is None:
            return False
        _, s, p = best
        amount = min(need[s0], supply[p] - used[p] % supply[p], room(p, s))
        at = s
        while at != s0:
            before, q = via[at]
            amount = min(amount, given[q, at], room(q, before))
            at = before
        used[p] += amount
        given[p, s] += amount
        at = s
        while at != s0:
            before, q = via[at]
            given[q, at] -= amount
            given[q, before] += amount
            at = before
        need[s0] -= amount
        return True

    for s in in_order(set(quota)):
        while need[s] > 0 and augment(s):
            pass
    return {k: v for k, v in given.items() if v > 0}


class Mix(NamedTuple):
    rows: DataFrame
    sizes: dict[Source, int]
    targets: dict[Source, float]


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    size_col: str = "size",
    sources_col: str = "sources",
    weights: dict[Source, float] | None = None,
    share: float = 1.0,
    max_repeats: int = 3,
    seed: int = 0,
    max_patterns: int = 100_000,
    count_once: bool = True,
    keep: tuple[str, ...] = (),
) -> Mix:
    """Its rows: doc_id, size, sources, taken_by (a source for each copy that is taken).

    Sources without given weights weigh 1, 2, 3, repeating, in order of their
    names.  Null sources are one source of their own; a document without any
    source is not taken; a null size is 0.  What is shared out counts a document
    once, or with count_once off for each source that holds it.  Patterns and
    sources are few beside the rows; more than max_patterns raise an error
    rather than flood the driver.  Documents are ordered by a seeded digest of
    the identifier, ties by identifier and size; rows that repeat all of these
    may trade places.  keep names columns of docs that come along.  An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    name = F.array_join(F.transform("sources", lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("-"))), "\x00")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("size"),
        F.array_sort(F.array_distinct(F.coalesce(F.col(sources_col), F.array().cast("array<string>")))).alias("sources"),
        *keep,
    ).select("*", name.alias("pattern"), digest.alias("digest"))
    rows = materialize(rows.withColumn("bin", F.substring("digest", 1, 3)), "mix")

    found = rows.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("words"))
    found = found.limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    supply = {r["pattern"]: r["words"] for r in found}
    members = {r["pattern"]: in_order(set(r["sources"])) for r in found}
    names = in_order({s for m in members.values() for s in m})
    weights = weights or {s: float(1 + i % 3) for i, s in enumerate(names)}
    sizes = _sizes(supply, members)
    held = sum(sizes.values())
    total = sum(supply[p] for p, m in members.items() if m) if count_once else held
    wanted = targets(sizes, weights, share * total / held if held else share, max_repeats)
    quota = {s: math.floor(w + 0.5) for s, w in wanted.items()}
    given = flow(supply, members, quota, max_repeats)
    parts = []
    for p, m in members.items():
        upto, ends = 0, []
        for s in m:
            if given.get((p, s)):
                upto += given[p, s]
                ends.append((s, upto))
        parts.append((p, supply[p], ends))
    plan = spark.createDataFrame(parts, "pattern string, words long, ends array<struct<source: string, upto: long>>")

    in_bin = Window.partitionBy("pattern", "bin").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    bins = Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("pattern", "bin").agg(F.sum("size").alias("n"))
    starts = starts.select("pattern", "bin", F.coalesce(F.sum("n").over(bins), F.lit(0)).alias("start"))
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(in_bin), F.lit(0))).join(starts, ["pattern", "bin"])
    placed = placed.join(F.broadcast(plan), "pattern")  # at most max_patterns rows
    middle = F.col("start") + F.col("before") + F.col("size") / 2
    copies = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(1), F.size("sources")) * max_repeats - 1),
        lambda e: F.get(F.filter("ends", lambda x: e * F.col("words") + middle < x["upto"]), 0),
    )
    taken = F.when(F.col("size") > 0, F.transform(F.filter(copies, lambda x: x.isNotNull()), lambda x: x["source"]))
    out = placed.select("doc_id", "size", "sources", *keep, F.coalesce(taken, F.array().cast("array<string>")).alias("taken_by"))
    return Mix(out, sizes, wanted)


def _sizes(supply: dict[str, int], members: dict[str, list[Source]]) -> dict[Source, int]:
    out: dict[Source, int] = defaultdict(int)
    for p, m in members.items():
        for s in m:
            out[s] += supply[p]
    return dict(out)


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def mix_rows(rows: DataFrame, **options) -> Mix:
    """Its rows: row, doc_id, source, size, copies, for rows of one source each.

    rows: row (unlike any other), doc_id, source, size, unit (equal for equal
    texts).  Of each unit the first row of each source makes up one document of
    all these sources, if there are several; every other row is a document of
    its own source.
    """
    rows = materialize(rows.select("row", "doc_id", "source", "size", "unit"), "holdings")
    held = rows.where("size > 0").groupBy("unit", "source").agg(F.min(F.struct("row", "doc_id")).alias("h"), F.max("size").alias("size"))
    holder = lambda row, doc: F.struct("source", F.col(row).alias("row"), F.col(doc).alias("doc_id"))
    # one holder for each source
    shared = held.groupBy("unit").agg(F.collect_list(holder("h.row", "h.doc_id")).alias("holders"), F.max("size").alias("size"))
    shared = materialize(shared.where(F.size("holders") > 1), "shared")
    alone = rows.join(shared.select(F.explode("holders.row").alias("row")), "row", "left_anti")
    whole = alone.select(F.col("doc_id").cast("string").alias("doc_id"), "size", F.array(holder("row", "doc_id")).alias("holders")).unionByName(
        shared.select(F.col("unit").alias("doc_id"), "size", "holders")
    )
    mixed = mix(whole.withColumn("sources", F.col("holders.source")), count_once=False, keep=("holders",), **options)
    out = mixed.rows.select("size", "taken_by", F.explode("holders").alias("h"))
    copies = F.size(F.filter("taken_by", lambda s: s.eqNullSafe(F.col("h.source")))).alias("copies")
    return Mix(out.select("h.row", "h.doc_id", "h.source", "size", copies), mixed.sizes, mixed.targets)


def _holdings(docs: DataFrame) -> DataFrame:
    """mix_rows' input: texts are equal if their words are."""
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " "))
    return docs.select("row", "doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"), F.md5(words).alias("unit"))


def mix_documents(docs: DataFrame, *, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for documents of one source each.

    A null text has no
    words; a null source is the last source.  Rows that repeat an identifier
    are documents of their own.  An empty table gives an empty result; other
    columns are not read.
    """
    tagged = docs.select("doc_id", "text", "source").withColumn("row", F.monotonically_increasing_id())
    mixed = mix_rows(_holdings(tagged), seed=seed)
    rows = [(s, n, mixed.targets[s]) for s, n in mixed.sizes.items()]
    by_source = docs.sparkSession.createDataFrame(rows, "s string, source_size long, target double")
    joined = mixed.rows.join(F.broadcast(by_source), F.col("s").eqNullSafe(F.col("source")))  # bounded as the patterns are
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def take_mix(docs: DataFrame, *, seed: int = 0) -> DataFrame:
    """docs' own columns, each row as often as the mix takes it.

    A row without words (a null text too) is not taken; a null source is a
    source of its own; rows that repeat each other each have copies of their
    own.  An empty table gives an empty result.
    """
    row, name, times, copy = unused_names(docs, "row", "taken", "copies", "copy")
    tagged = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "tagged")
    held = tagged.select(F.col(row).alias("row"), "doc_id", "source", "text")
    mixed = mix_rows(_holdings(held), seed=seed).rows
    taken = mixed.where("copies > 0").select(F.col("row").alias(name), F.sequence(F.lit(1), "copies").alias(times))
    joined = tagged.join(taken, F.col(row) == F.col(name))
    return joined.withColumn(copy, F.explode(times)).select(*map(column_of, docs.columns))
