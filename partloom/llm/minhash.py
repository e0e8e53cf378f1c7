"""Near-duplicate detection with ProbMinHash.

A document is its five-word shingles with weights.  Every shingle has an
exponential process of arrivals at the rate of its weight; each arrival goes to
the next place of the shingle's own order of registers, and a register keeps the
earliest.  A shingle stops as soon as its next arrival is behind all registers.
Two signatures agree in a register with the probability Jaccard similarity of
the weighted shingles.  Bands of registers propose pairs, which are verified by
the same similarity, computed exactly on their whole shingles.

Weights are one, where the probability Jaccard similarity is the plain one of the
sets of shingles, or with by_counts how often each shingle occurs.  Either way
what is signed is what decides: weights by counts would miss links between sets
that a block which one text repeats a hundred times outweighs.

Documents with equal weighted shingles are one node.  In each bucket of a band
the most connected node is the centre, and the others are verified against it
alone.  What that leaves open, nodes of a bucket that are still in different
classes, is compared pair by pair within the bucket: by sizes and parities,
which no link fails, and what is left by whole sets.  So no link within a bucket
is lost, while a large group of copies or near-copies costs one comparison for
each member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.llm.blooms import MOST_BITS, bloom_of
from partloom.llm.common import column_of, materialize, small_batches, text_key, unused_names
from partloom.llm.words import Bloom, gathered, mix, one_array, run_codes, word_codes

REGISTERS = 193  # a prime, so that every step walks through all registers
BANDS, ROWS = 32, 6
PARITIES = 1536  # bits of a set's parities, 64 to a long


def shingles(codes: np.ndarray, lengths: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, shingle, count of every different shingle of each text, in order of
    both; a text of fewer words is one shingle, one without words has none."""
    rows, found = [], []
    at = 0
    for row, n in enumerate(lengths.tolist()):
        if n:
            own = run_codes(codes[at : at + n], min(n, size))
            rows.append(np.full(len(own), row))
            found.append(own if n >= size else mix(own + np.uint64(n)))
        at += n
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    row, shingle = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(new)
    return row[at], shingle[at], np.diff(np.append(at, len(row)))


def prob_minhash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """n x m signatures: in each register the element that arrived first."""
    earliest = np.full(n * m, np.inf)
    winner = np.zeros(n * m, np.uint64)
    step = 1 + (mix(element ^ np.uint64(0xA5A5A5A5)) % np.uint64(m - 1)).astype(np.int64)
    place = (mix(element ^ np.uint64(0x5A5A5A5A)) % np.uint64(m)).astype(np.int64)
    seed, time = element, np.zeros(len(element))
    for i in range(m):
        # the i-th of m places without replacement comes at a rate of m - i parts in m
        seed = mix(seed + np.uint64(0x9E3779B97F4A7C15))
        u = ((seed >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
        time = time - np.log(u) / weight * (m / (m - i))
        at = row * m + place
        np.minimum.at(earliest, at, time)
        won = earliest[at] == time
        winner[at[won]] = element[won]
        # early termination: later arrivals can't win any register
        live, inverse = np.unique(row, return_inverse=True)
        last = earliest.reshape(n, m)[live].max(axis=1)
        on = time < last[inverse]
        if not on.any():
            break
        row, element, weight, seed, time = row[on], element[on], weight[on], seed[on], time[on]
        step, place = step[on], (place[on] + step[on]) % m
    return winner.reshape(n, m)


_SIGNED = "doc_id long, tkey long, row long, key long, n int, repeats boolean, node binary, bands array<long>, bits array<long>"


def band_codes(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    sig = prob_minhash(row, shingle, weight, k)
    band = np.zeros((k, BANDS), np.uint64)
    for r in range(ROWS):
        band = mix(band * np.uint64(31) + sig[:, r : BANDS * ROWS : ROWS] + np.arange(BANDS, dtype=np.uint64))
    return band


def _weighted(texts: pa.Array, size: int, by_counts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, shingle, count = shingles(*word_codes(texts), size)
    return row, shingle, count if by_counts else np.ones(len(row), np.int64)


def signatures(docs: DataFrame, size: int, by_counts: bool) -> DataFrame:
    """A row for each of docs: n shingles, whether one weighs more than one, node
    (a code of all shingles and their weights), the codes of its bands and the
    set's parities."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, 2_000_000):
            k = table.num_rows
            row, shingle, weight = _weighted(one_array(table["text"]), size, by_counts)
            n = np.bincount(row, minlength=k)
            band = band_codes(row, shingle, weight.astype(np.float64), k)
            bits = parities(row, shingle, k)
            lists = lambda x, width: pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * width), pa.array(x.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [
                    *(one_array(table[c]) for c in ("doc_id", "tkey", "row", "key")),
                    pa.array(n.astype(np.int32)),
                    pa.array(np.bincount(row[weight > 1], minlength=k) > 0),
                    set_codes(row, shingle, weight, k),
                    lists(band, BANDS),
                    lists(bits, PARITIES // 64),
                ],
                ["doc_id", "tkey", "row", "key", "n", "repeats", "node", "bands", "bits"],
            )

    return docs.select("doc_id", "tkey", "row", "key", "text").mapInArrow(sign, _SIGNED)


def parities(row: np.ndarray, shingle: np.ndarray, k: int) -> np.ndarray:
    """k x PARITIES / 64 longs: of each bit, whether an odd number of the set's shingles fall on it."""
    at = row * PARITIES + (mix(shingle ^ np.uint64(0x3C3C3C3C)) % np.uint64(PARITIES)).astype(np.int64)
    odd = (np.bincount(at, minlength=k * PARITIES) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(k, PARITIES), axis=1).view(np.int64)


def set_codes(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, k: int) -> pa.Array:
    """Two 64-bit codes, in sixteen bytes, of each of k documents' shingles and weights."""
    sums = np.zeros((2, k), np.uint64)
    said = mix(shingle + mix(count.astype(np.uint64)))
    np.add.at(sums[0], row, said)
    np.add.at(sums[1], row, mix(said ^ np.uint64(0xC3C3C3C3)))
    both = np.stack([mix(sums[0] ^ np.bincount(row, minlength=k).astype(np.uint64)), mix(sums[1])], axis=1)
    return pa.array([both[i].tobytes() for i in range(k)], pa.binary())


def shingle_sets(docs: DataFrame, keys: Bloom, size: int, by_counts: bool) -> DataFrame:
    """node, shingles (sorted), counts (null where all weights are one) of the documents whose key the filter has."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, 2_000_000):
            own = one_array(table["key"]).to_numpy(zero_copy_only=False)
            table = table.filter(pa.array(keys.has(own.view(np.uint64)))).combine_chunks()
            if k := table.num_rows:
                row, shingle, count = _weighted(one_array(table["text"]), size, by_counts)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=k))]), pa.int32())
                once = np.bincount(row[count > 1], minlength=k) == 0
                sets = pa.ListArray.from_arrays(ends, pa.array(shingle.view(np.int64)))
                counts = pc.if_else(pa.array(once), pa.scalar(None, pa.list_(pa.int32())), pa.ListArray.from_arrays(ends, pa.array(count.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([set_codes(row, shingle, count, k), sets, counts], ["node", "shingles", "counts"])

    return docs.select("key", "text").mapInArrow(extract, "node binary, shingles array<long>, counts array<int>")


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Of two sorted sets with weights: for each shared element one over the sum,
    over all elements, of the larger of the two sides' weights by its own."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = wa[i].astype(float), wb[j].astype(float)
    order = np.argsort(x / y)
    x, y = x[order], y[order]
    ratio = x / y
    # elements of a ratio as large or larger count by x, smaller ones by y
    first = np.searchsorted(ratio, ratio, side="left")
    upto_y = np.concatenate([[0.0], np.cumsum(y)])[first]
    from_x = x.sum() - np.concatenate([[0.0], np.cumsum(x)])[first]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    return float((1 / ((only_a + from_x) / x + (only_b + upto_y) / y)).sum())


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: the least node that edges (a, b) connect each node to.

    Every round hooks each label to the least label next to it and then follows
    labels to their own; rounds end when nothing changes.
    """
    labels = materialize(nodes.select("node", F.col("node").alias("label")), "labels")
    edges = edges.select("a", "b")
    while True:
        a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        across = materialize(edges.join(a, "a").join(b, "b").where("la != lb").select(
            F.greatest("la", "lb").alias("label"), F.least("la", "lb").alias("to")
        ), "hooks")
        if across.isEmpty():
            return labels
        hook = across.groupBy("label").agg(F.min("to").alias("to"))
        # hooks lead to smaller labels, so following them ends
        hook = materialize(hook, "hook")
        while True:
            onward = hook.select(F.col("label").alias("to"), F.col("to").alias("next"))
            jumped = materialize(hook.join(onward, "to", "left").select("label", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "hook")
            hook = jumped.select("label", "to")
            if jumped.where("moved").isEmpty():
                break
        labels = materialize(labels.join(hook, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def _verified(pairs: DataFrame, sets: DataFrame, least: float, by_counts: bool) -> DataFrame:
    """a, b of the pairs that are similar."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"), F.col("counts").alias(f"c{x}"))
    both = F.size(F.array_intersect("sa", "sb"))
    plain = both >= least * (F.size("sa") + F.size("sb") - both)
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    ones = F.col("ca").isNull() & F.col("cb").isNull()
    if not by_counts:
        return joined.where(plain).select("a", "b")
    joined = joined.withColumn("ones", ones).where(~F.col("ones") | plain)
    carried = [F.when(~F.col("ones"), F.col(c)).alias(c) for c in ("sa", "ca", "sb", "cb")]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = batch["ones"].to_numpy(zero_copy_only=False).copy()
            for i in np.flatnonzero(~linked):
                sets_of = [batch[c][int(i)].values.to_numpy() for c in ("sa", "sb")]
                counts = [batch[c][int(i)].values for c in ("ca", "cb")]
                weights = [np.ones(len(s)) if c is None else c.to_numpy() for s, c in zip(sets_of, counts, strict=True)]
                linked[i] = probability_jaccard(sets_of[0], weights[0], sets_of[1], weights[1]) >= least - 1e-9
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(linked))

    return joined.select("a", "b", "ones", *carried).mapInArrow(decide, "a binary, b binary")


def _alike(least: float) -> Column:
    """Of rows x and y: sizes and parities allow the similarity; never false for a link.

    Where weights are more than one, sets don't bound the similarity, so all are
    allowed.  A parity that differs has a shingle of its own that only one set holds, so
    at least so many shingles are not shared; of sizes that add up to n, a
    similarity leaves room for (1 - least) / (1 + least) * n of them.
    """
    differ = F.lit(0)
    for i in range(PARITIES // 64):
        differ = differ + F.bit_count(F.get("x.bits", i).bitwiseXOR(F.get("y.bits", i)))
    sizes = F.least("x.n", "y.n") + 1e-6 >= least * F.greatest("x.n", "y.n")
    # a hair of slack for rounding
    return F.col("x.repeats") | F.col("y.repeats") | sizes & (differ * (1 + least) <= (1 - least) * (F.col("x.n") + F.col("y.n")) + 1e-6)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8, by_counts: bool = False) -> DataFrame:
    """doc_id, tkey, class_id, class_size, n_shingles, kept for every row of docs.

    Two documents are linked if the probability Jaccard similarity of their
    ``size``-word shingles is ``least`` or more, all weights one (which is the plain
    Jaccard similarity of the sets) or with by_counts weighted by how often each
    occurs; classes are what links connect.  class_id is the smallest identifier of the class, and its row is kept (null
    comes last; of rows that repeat it, one).  A document of fewer words is one
    shingle; one without words, or with a null text, is a class of its own.
    Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text_key(F.col(text_col)).alias("tkey"),
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("key", F.xxhash64("doc_id", "tkey"))
    signed = materialize(signatures(rows, size, by_counts), "signatures")
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    # nodes: documents with the same weighted shingles
    nodes = signed.where("n > 0").groupBy("node").agg(
        F.min("key").alias("doc_key"), F.first("n").alias("n"), F.first("repeats").alias("repeats"), F.first("bands").alias("bands"), F.first("bits").alias("bits")
    )
    nodes = materialize(nodes, "nodes")
    banded = nodes.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = materialize(banded.join(shared, "key"), "members")
    degree = members.groupBy("node").agg(F.sum("members").alias("degree"))
    ranked = members.select("key", "node").join(degree, "node")
    centres = ranked.groupBy("key").agg(F.max(F.struct("degree", "node"))["node"].alias("centre"))
    to_centre = members.join(centres, "key").where("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    to_centre = materialize(to_centre, "to-centre")

    wanted = members.select("node").distinct().join(nodes.select("node", "doc_key"), "node")
    wanted = materialize(wanted, "candidates")
    sets = shingle_sets(rows, bloom_of(wanted, "doc_key", MOST_BITS), size, by_counts)
    sets = materialize(sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "shingles")
    first = materialize(_verified(to_centre, sets, least, by_counts), "links")
    labels = components(wanted, first)

    # what is still apart within a bucket
    open_to = members.select("key", "node").join(labels, "node")
    apart = open_to.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 != l1").select("key")
    still = open_to.join(apart, "key").join(nodes.select("node", "n", "repeats", "bits"), "node")
    still = materialize(still, "open")
    pairs = still.alias("x").join(still.alias("y"), F.col("x.key") == F.col("y.key"))
    apart = (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label"))
    left = pairs.where(apart & _alike(least)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    second = _verified(materialize(left, "open-pairs"), sets, least, by_counts)
    linked = materialize(first.unionByName(second), "all-links")
    labels = components(wanted, linked)

    class_of = signed.join(labels, "node", "left").select(
        "doc_id", "tkey", "row", F.col("n").cast("long").alias("n_shingles"),
        # without words: a class of its own
        F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label"),
    )
    class_of = materialize(class_of, "classes")
    heads = class_of.where("label IS NOT NULL").groupBy("label").agg(F.min(at).alias("head"), F.count("*").alias("class_size"))
    heads = materialize(heads, "heads")  # so that a join with a very large class can be split
    named = class_of.join(heads, "label", "left")
    return named.select(
        "doc_id",
        "tkey",
        F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        "n_shingles",
        (F.col("label").isNull() | (F.col("row") == F.col("head.row"))).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs' own columns: one row of each class of near-duplicates.

    That of the smallest identifier, null last; rows without words each stay,
    but of rows that repeat identifier and text one.  An empty table gives an
    empty one.
    """
    doc, tkey, key, rank = unused_names(docs, "id", "tkey", "key", "rank")
    kept = near_duplicates(docs, **options).where("kept").select(F.col("doc_id").alias(doc), F.col("tkey").alias(tkey)).distinct()
    keyed = docs.withColumn(key, text_key(F.col("text")))
    joined = keyed.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(tkey)))
    # of rows that repeat identifier and text one is kept
    number = F.row_number().over(Window.partitionBy(doc, tkey).orderBy(key))
    return joined.withColumn(rank, number).where(F.col(rank) == 1).select(*map(column_of, docs.columns))
