"""Documents whose word shingles are alike, joined by adaptive multi-match prefixes.

All shingles have one order, those that fewer documents hold first.  In it, two
sets with at least so many shingles in common share at least m of them within
their first ``n - need + m`` shingles each, where ``need`` is the least overlap
that a set of n shingles can have with one it links to.  A longer prefix (a larger
m) costs more entries to look at, yet lets through fewer pairs to verify.  Each
document takes the m of least cost, which is estimated from the counts of its
own shingles, and a pair goes on only if its prefixes share as many shingles as
the smaller of its two m.

Counts come from one sketch of all texts, whose size is fixed.  They decide
the order and the cost alone: with any order the results are the same.

Documents with equal sets are one node.  Nodes meet in buckets: those that share a
prefix shingle and are of like size, in classes so wide that sets that link are
in one class or in two next to each other.  Of a bucket's nodes the most connected is
the centre, and the others are compared with it alone; then nodes of a bucket
that are still in different components are compared with each other.  So no link
between components is lost, while a large group of copies or near copies costs one
comparison for each member.  Before whole sets are compared, a pair passes tests that no
link fails: sizes, parities of the sets, shared prefix shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.blooms import bloom_of
from partloom.llm.common import materialize, small_batches, text_key
from partloom.llm.minhash import components, set_codes
from partloom.llm.words import Bloom, gathered, mix, one_array, run_codes, word_codes

#: The sketch's cells, 8 MB whatever the input.
CELL_BITS = 21
_PIECE = 1 << 14

#: The longest prefixes ask for so many shared shingles.
MOST_MATCHES = 6

#: Verifying costs so much for each shingle of a set, where looking at an entry costs one.
VERIFY = 0.05

#: Bytes of text that a task holds at once.
_TEXTS = 3_000_000


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted set of every text's shingles: runs of ``size`` words, A to Z in
    lower case; fewer words are one shingle, none are an empty set."""
    codes, lengths = word_codes(pc.ascii_lower(texts))
    runs = run_codes(codes, size)
    at = 0
    for n in lengths.tolist():
        if n >= size:
            own = np.sort(runs[at : at + n - size + 1])
            new = np.empty(len(own), bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            yield own[new]
        elif n:
            yield mix(run_codes(codes[at : at + n], n) + np.uint64(n))
        else:
            yield np.empty(0, np.uint64)
        at += n


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def count_sketch(docs: DataFrame, size: int) -> np.ndarray:
    """How many sets hold the shingles of each cell, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << CELL_BITS, np.uint32)
        for table in gathered(batches, _TEXTS):
            found = np.concatenate(list(shingle_sets(one_array(table["text"]), size)))
            own += np.bincount(_cells(found), minlength=1 << CELL_BITS).astype(np.uint32)
        pieces = [(i, own[i : i + _PIECE]) for i in range(0, len(own), _PIECE)]
        pieces = [(i, p.tobytes()) for i, p in pieces if p.any()]
        if pieces:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pieces], pa.int64()), pa.array([p for _, p in pieces], pa.binary())], ["at", "piece"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_PIECE, np.int64)
        for batch in batches:
            for piece in batch["piece"]:
                total += np.frombuffer(piece.as_buffer(), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["at", "piece"])

    schema = "at long, piece binary"
    out = np.zeros(1 << CELL_BITS, np.int64)
    for at, piece in docs.select("text").mapInArrow(count, schema).groupBy("at").applyInArrow(add, schema).collect():
        out[at : at + _PIECE] = np.frombuffer(piece, np.int64)
    return out


def estimates(sketch: np.ndarray) -> np.ndarray:
    """Of each cell, the sets that hold one of its shingles beside those that fall on it by chance."""
    total = int(sketch.sum())
    return np.maximum(1, sketch - (total - sketch) // (len(sketch) - 1)).astype(np.uint32)


def parities(own: np.ndarray) -> np.ndarray:
    """Longs whose bits say whether an odd number of a set's shingles fall on them, about as
    many bits as shingles: a power of two, so that a longer one folds onto a shorter one."""
    width = 1 << max(6, (len(own) - 1).bit_length())
    at = (mix(own ^ np.uint64(0x3C3C3C3C)) & np.uint64(width - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=width) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n shingles with one that it links to."""
    return -(-percent * n // 100)


def adaptive_prefix(own: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The prefix of a sorted set, in the common order, and how many shared shingles it asks for.

    A pair that shares m shingles is met m times, so of the entries that a prefix
    looks at, at most one in m is a candidate.
    """
    n = len(own)
    need = needed(n, percent)
    most = n - need + min(MOST_MATCHES, need)
    # by count, then by shingle, which is the order of own
    key = (counts[_cells(own)].astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    if most < n:
        key = np.partition(key, most - 1)[:most]
    key.sort()
    entries = np.cumsum((key >> np.uint64(32)).astype(np.float64) - 1)[n - need :]
    m = np.arange(1, len(entries) + 1)
    best = int(np.argmin(entries * (1 + VERIFY * n / m))) + 1
    return own[(key[: n - need + best] & np.uint64(0xFFFFFFFF)).astype(np.int64)], best


_SIGNED = "doc_id long, key long, n int, node binary, m int, prefix array<long>, bits array<long>"


def signed_sets(docs: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """A row for each of docs: the size of its set, node (a code of the whole set),
    the prefix with the shared shingles it asks for, and the set's parities."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # of a fixed size

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, _TEXTS):
            k = table.num_rows
            sets = list(shingle_sets(one_array(table["text"]), size))
            n = np.array([len(s) for s in sets], np.int64)
            row, flat = np.repeat(np.arange(k), n), np.concatenate(sets)
            bits = [parities(s) for s in sets]
            prefixes = [adaptive_prefix(s, shared.value, percent) if len(s) else (s, 1) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(p) for p, _ in prefixes])])
            yield pa.RecordBatch.from_arrays(
                [
                    one_array(table["doc_id"]),
                    one_array(table["key"]),
                    pa.array(n.astype(np.int32)),
                    set_codes(row, flat, np.ones(len(flat), np.int64), k),
                    pa.array([m for _, m in prefixes], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([p for p, _ in prefixes]).view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(b) for b in bits])]), pa.int32()), pa.array(np.concatenate(bits))),
                ],
                ["doc_id", "key", "n", "node", "m", "prefix", "bits"],
            )

    return docs.select("doc_id", "key", "text").mapInArrow(sign, _SIGNED)


def _whole_sets(docs: DataFrame, keys: Bloom, size: int) -> DataFrame:
    """node, shingles (sorted) of the documents whose key the filter has."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, _TEXTS):
            own = one_array(table["key"]).to_numpy(zero_copy_only=False)
            table = table.filter(pa.array(keys.has(own.view(np.uint64)))).combine_chunks()
            if k := table.num_rows:
                sets = list(shingle_sets(one_array(table["text"]), size))
                n = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets)
                node = set_codes(np.repeat(np.arange(k), n), flat, np.ones(len(flat), np.int64), k)
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                yield pa.RecordBatch.from_arrays([node, pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64)))], ["node", "shingles"])

    return docs.select("key", "text").mapInArrow(extract, "node binary, shingles array<long>")


def _may_link(x: str, y: str, percent: int) -> Column:
    """Sizes and parities of the rows x and y allow a link; never false for one.

    A parity that differs has a shingle that only one of the two sets holds.
    """
    of = lambda side, name: F.col(f"{side}.{name}")
    width = F.least(F.size(of(x, "bits")), F.size(of(y, "bits")))
    fold = lambda bits: F.when(F.size(bits) == width, bits).otherwise(F.zip_with(F.slice(bits, F.lit(1), width), F.slice(bits, width + 1, width), lambda p, q: p.bitwiseXOR(q)))
    differ = F.aggregate(F.zip_with(fold(of(x, "bits")), fold(of(y, "bits")), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, d: n + d)
    n = of(x, "n").cast("long") + of(y, "n")
    # sizes further apart than twice can't be folded in one step, nor link
    return _sizes(of(x, "n"), of(y, "n"), percent) & (differ * (100 + percent) <= n * (100 - percent))


def _sizes(x: Column, y: Column, percent: int) -> Column:
    return F.least(x, y).cast("long") * 100 >= F.greatest(x, y).cast("long") * percent


def _buckets(nodes: DataFrame, percent: int) -> DataFrame:
    """token, class, node, n, own of the nodes that share a prefix shingle with another
    one of like size.

    Sets that link have sizes of at least percent to 100, so they are of one class or
    of two next to each other: each node stands in its own class and in the next one.
    """
    postings = nodes.select("node", "n", F.explode("prefix").alias("token"))
    shared = postings.groupBy("token").agg(F.count("*").alias("nodes")).where("nodes > 1").select("token")
    own = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(min(percent, 99) / 100)) + 1e-9).cast("int")
    members = postings.join(shared, "token").withColumn("own", own).select("token", "node", "n", "own", F.explode(F.array(own, own + 1)).alias("class"))
    members = materialize(members, "join-members")
    # of a class, or some of it and some of the one before
    alike = members.groupBy("token", "class").agg(F.count("*").alias("nodes"), F.max("own").alias("top")).where("nodes > 1 AND top = class").select("token", "class")
    return materialize(members.join(alike, ["token", "class"]), "join-buckets")


def _probable(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs that may link and share enough of their prefixes."""

    def beside(pairs: DataFrame, *cells: str) -> DataFrame:
        side = lambda x: nodes.select(F.col("node").alias(x), F.struct(*cells).alias(f"of_{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b")

    # the short parities first: few pairs need the prefixes
    like = materialize(beside(pairs, "n", "bits").where(_may_link("of_a", "of_b", percent)).select("a", "b"), "join-like")
    matches = F.size(F.array_intersect("of_a.prefix", "of_b.prefix")) >= F.least("of_a.m", "of_b.m")
    return beside(like, "m", "prefix").where(matches).select("a", "b")


def _linked(rows: DataFrame, pairs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b of the pairs whose whole sets are similar."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = materialize(wanted.join(nodes.select("node", "doc_key"), "node"), "join-wanted")
    sets = _whole_sets(rows, bloom_of(wanted, "doc_key"), size)
    sets = materialize(sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "join-sets")
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.where(both * (100 + percent) >= (F.size("sa") + F.size("sb")) * F.lit(percent).cast("long")).select("a", "b")


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id, component_size for every row of docs.

    Two documents link when their sets of ``size``-word shingles (A to Z in lower case) have
    100 * intersection >= percent * union.  A document of fewer words has one
    shingle; one without words, or with a null text, has none, links with nothing
    and is a component of its own.  component_id is the smallest identifier that
    links lead to (a null one doesn't count; null if there is no other).  Rows
    that repeat each other are documents of their own; other columns are not read,
    whatever their names; an empty table gives an empty result.
    """
    if not 50 <= percent <= 100:
        raise ValueError(f"percent of {percent}, not 50 to 100")
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("tkey"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("key", F.xxhash64("doc_id", "tkey"))
    signed = materialize(signed_sets(rows, estimates(count_sketch(rows, size)), size, percent), "join-signed")
    nodes = signed.where("n > 0").groupBy("node").agg(F.min("key").alias("doc_key"), *(F.first(c).alias(c) for c in ("n", "m", "prefix", "bits")))
    nodes = materialize(nodes, "join-nodes")
    buckets = _buckets(nodes, percent)

    sizes = buckets.groupBy("token", "class").agg(F.count("*").alias("nodes"))
    degree = buckets.join(sizes, ["token", "class"]).groupBy("node").agg(F.sum("nodes").alias("degree"))
    centres = buckets.join(degree, "node").groupBy("token", "class").agg(F.max(F.struct("degree", "node", "n")).alias("centre"), F.count("*").alias("nodes"))
    others = buckets.join(centres, ["token", "class"]).where(F.col("node") != F.col("centre.node"))
    others = others.select("token", "class", "node", "n", "own", F.col("centre.node").alias("b"), F.col("centre.n").alias("bn"), (F.col("nodes") > 2).alias("more"))
    others = materialize(others, "join-others")
    to_centre = others.where(_sizes(F.col("n"), F.col("bn"), percent)).select(F.col("node").alias("a"), "b").distinct()
    first = materialize(_probable(to_centre, nodes, percent), "join-pairs")
    links = materialize(_linked(rows, first, nodes, size, percent), "join-links")
    met = materialize(buckets.select("node").distinct(), "join-met")
    labels = components(met, links)

    # nodes of a bucket that are still apart; what there is with its centre is known
    named = others.where("more").select("token", "class", "node", "n", "own").join(labels, "node")
    apart = named.groupBy("token", "class").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 != l1").select("token", "class")
    still = materialize(named.join(apart, ["token", "class"]).join(nodes.select("node", "m", "bits"), "node"), "join-open")
    pairs = still.alias("x").join(still.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.class") == F.col("y.class")))
    once = F.greatest("x.own", "y.own") == F.col("x.class")  # two of the class before meet there
    pairs = pairs.where((F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & once & _may_link("x", "y", percent))
    # such a pair has met no centre together, so all buckets of both are among these
    matches = pairs.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count("*").alias("matches"), F.first(F.least("x.m", "y.m")).alias("least"))
    second = materialize(matches.where("matches >= least").select("a", "b"), "join-open-pairs")
    if not second.isEmpty():
        more = _linked(rows, second, nodes, size, percent)
        labels = components(met, materialize(links.unionByName(more), "join-all-links"))

    label = F.when(F.col("n") > 0, F.coalesce("label", "node"))
    of_rows = signed.select("doc_id", "n", "node").join(labels, "node", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), label.alias("label"))
    of_rows = materialize(of_rows, "join-labels")
    heads = of_rows.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("head"), F.count("*").alias("size"))
    heads = materialize(heads, "join-heads")  # so that a join with a very large component can be split
    return of_rows.join(heads, "label", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("head")).alias("component_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("component_size"),
    )
