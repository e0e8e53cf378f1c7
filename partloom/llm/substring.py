"""Substring dedup by prefix-partitioned suffix trees.

The suffixes of all documents, one for each word that ``size`` words follow,
form one tree; texts that repeat lie below its internal nodes of depth
``size``.  The tree is never built whole.  Prefixes of variable length split
the suffixes into groups that fit a task, and each group is a subtree:

1. Suffixes travel together where they can: of the windows of ``size`` words
   that share an anchor, the six-word prefix of least code within each, the
   words are shipped once, as a fragment.  Equal windows have equal anchors.  A
   prefix that the corpus holds once is a leaf, and its fragment is not shipped.
2. Fragments go to groups by their anchor's prefix.  Under a prefix that may
   have too many words for one group, equal fragments are folded first.  If they
   are still too many, the prefix is split: each of its windows becomes a suffix
   of its own, and its prefix is lengthened until what shares it fits.  What
   still doesn't at full length is one window many times over, which an
   aggregate folds.
3. A group sorts its suffixes word by word, by doubling: the ranks of runs of 1,
   2, 4, ... words.  The common prefixes of neighbours in that order give the
   internal nodes, and those of depth ``size`` the leaves that repeat.  All
   leaves of such a node but the earliest are repeats; windows that overlap
   merge to maximal ones.

Each batch of a map task folds its own equal fragments first, so a passage that
a third of all documents share reaches its group once from each batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.blooms import MOST_BITS, bloom_of
from partloom.llm.common import materialize, n_partitions, small_batches, text_key
from partloom.llm.words import Bloom, gathered, mix, one_array, run_codes, word_codes

PREFIX = 6
_BLOCK = 1 << 22  # words looked at together; anchors hold their place in 24 bits
_PLACE = np.uint64((1 << 24) - 1)
_LAST = (1 << 63) - 1  # the order of a null identifier
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
GROUP_WORDS = 1_000_000


class Runs(NamedTuple):
    """Runs of consecutive windows of one document that share an anchor."""

    row: np.ndarray  # which of the documents
    start: np.ndarray  # the first window's first word in its document
    n: np.ndarray  # windows
    prefix: np.ndarray  # the anchor's code
    at: np.ndarray  # the first window's place among all codes

    def where(self, mask: np.ndarray) -> Runs:
        return Runs(*(x[mask] for x in self))


def anchors(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each window's anchor, and the codes of all six-word prefixes."""
    n = len(codes) - size + 1
    prefixes = run_codes(codes, PREFIX)
    anchor = np.empty(max(0, n), np.int64)
    span = size - PREFIX + 1  # prefixes within a window
    for lo in range(0, n, _BLOCK):
        hi = min(n, lo + _BLOCK)
        x = prefixes[lo : hi + span - 1]
        # the least code, the leftmost of equals: equal windows choose alike
        least = (x & ~_PLACE) | np.arange(len(x), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(x) - span + 1], least[span - width :])
        anchor[lo:hi] = lo + (least & _PLACE).astype(np.int64)
    return anchor, prefixes


def anchor_runs(codes: np.ndarray, lengths: np.ndarray, size: int) -> Runs:
    """The runs of documents whose words' codes stand in a row."""
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(len(lengths)), lengths)
    anchor, prefixes = anchors(codes, size)
    n = len(anchor)
    # windows lie in one document; between two documents there are some that don't
    within = np.arange(n) + size <= ends[row[:n]]
    new = within.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~within[:-1]
    at = np.flatnonzero(new)
    per = np.add.reduceat(within.astype(np.int64), at) if len(at) else np.empty(0, np.int64)
    return Runs(row[at], at - (ends - lengths)[row[at]], per, prefixes[anchor[at]], at)


def span_codes(codes: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Codes of the n words from each place lo on."""
    powers = np.full(len(codes), _BASE, np.uint64)
    powers[:1] = 1
    powers = np.cumprod(powers)
    back = np.full(len(codes), _INVERSE, np.uint64)
    back[:1] = 1
    back = np.cumprod(back)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes) * powers)])
    return mix((upto[lo + n] - upto[lo]) * back[lo] + n.astype(np.uint64))


def earliest_of(group: np.ndarray, heads: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether each member (in order of group, which begins at heads) has the least (doc, start) of its group."""
    if not len(group):
        return np.empty(0, bool)
    least_doc = doc == np.minimum.reduceat(doc, heads)[group]
    least_start = np.minimum.reduceat(np.where(least_doc, start, np.iinfo(np.int64).max), heads)
    return least_doc & (start == least_start[group])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def prefix_counts(docs: DataFrame, size: int) -> DataFrame:
    """prefix, n: how often each anchor's prefix occurs, of those that recur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            runs = anchor_runs(*word_codes(one_array(table["text"])), size)
            prefix, n = np.unique(runs.prefix, return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(prefix), pa.array(n)], ["prefix", "n"])

    counts = docs.select("text").mapInArrow(count, "prefix long, n long")
    return counts.groupBy("prefix").agg(F.sum("n").alias("n")).where("n > 1")


_FRAGMENTS = "doc long, tkey long, lo int, n int, prefix long, hot boolean, words array<int>"


def _firsts(code: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether each fragment has the least (doc, start) of those with its code."""
    order = np.argsort(code)
    new = np.ones(len(order), bool)
    new[1:] = code[order][1:] != code[order][:-1]
    first = np.empty(len(order), bool)
    first[order] = earliest_of(np.cumsum(new) - 1, np.flatnonzero(new), doc[order], start[order])
    return first


def fragments(docs: DataFrame, size: int, leaves: Bloom, often: Bloom) -> DataFrame:
    """A row for each run whose anchor's prefix recurs: doc, tkey, lo, n windows,
    prefix, whether that is among those that occur often, and the words' 32-bit
    codes.  Where an equal run of the same batch comes earlier, words is null:
    all of its windows repeat."""

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            codes, lengths = word_codes(one_array(table["text"]))
            runs = anchor_runs(codes, lengths, size)
            runs = runs.where(leaves.has(runs.prefix))
            if not len(runs.row):
                continue
            width = runs.n + size - 1
            doc = one_array(table["doc"]).to_numpy(zero_copy_only=False)[runs.row]
            first = _firsts(span_codes(codes, runs.at, width), doc, runs.start)
            offsets = np.concatenate([[0], np.cumsum(np.where(first, width, 0))])
            place = np.arange(offsets[-1]) + np.repeat((runs.at - offsets[:-1])[first], width[first])
            words = codes.astype(np.uint32).view(np.int32)[place]
            words = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(words), mask=pa.array(~first))
            rows = pa.array(runs.row)
            yield pa.RecordBatch.from_arrays(
                [
                    one_array(table["doc"]).take(rows),
                    one_array(table["tkey"]).take(rows),
                    pa.array(runs.start.astype(np.int32)),
                    pa.array(runs.n.astype(np.int32)),
                    _signed(runs.prefix),
                    pa.array(often.has(runs.prefix)),
                    words,
                ],
                ["doc", "tkey", "lo", "n", "prefix", "hot", "words"],
            )

    return docs.select("doc", "tkey", "text").mapInArrow(ship, _FRAGMENTS)


def folded(asked: DataFrame, groups: int) -> DataFrame:
    """Fragments (as fragments has them), with words null where an equal one comes earlier."""

    def fold(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        words, n = one_array(table["words"]), one_array(table["n"]).to_numpy()
        offsets = words.offsets.to_numpy().astype(np.int64)
        codes = words.flatten().to_numpy().view(np.uint32).astype(np.uint64)
        code = span_codes(codes, offsets[:-1] - offsets[0], np.diff(offsets)) ^ mix(n.astype(np.uint64))
        first = _firsts(code, one_array(table["doc"]).to_numpy(), one_array(table["lo"]).to_numpy().astype(np.int64))
        at = table.schema.get_field_index("words")
        # nulls without copying the words of those that stay
        kept = pc.if_else(pa.array(first), words, pa.scalar(None, words.type))
        return table.set_column(at, "words", kept).drop_columns(["grp"])

    dealt = asked.withColumn("grp", F.pmod(F.xxhash64("words"), F.lit(groups)).cast("int"))
    return dealt.repartition(groups, "grp").groupBy("grp").applyInArrow(fold, _FRAGMENTS)


def run_ranks(words: np.ndarray, size: int) -> list[np.ndarray]:
    """For 1, 2, 4, ... words, up to size: the rank of each place's run among all runs of that many."""
    levels = [np.unique(words, return_inverse=True)[1].astype(np.uint64)]
    while 2 << len(levels) - 1 <= size:
        half, width = levels[-1], 1 << len(levels) - 1
        pair = half[:-width] << np.uint64(32) | half[width:]
        levels.append(np.unique(pair, return_inverse=True)[1].astype(np.uint64))
    return levels


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """How many words from places a and b on are equal, size at most (both have as many)."""
    depth = np.zeros(len(a), np.int64)
    for i in reversed(range(len(levels))):
        at = np.flatnonzero(depth + (1 << i) <= size)
        same = levels[i][a[at] + depth[at]] == levels[i][b[at] + depth[at]]
        depth[at[same]] += 1 << i
    return depth


class Subtree(NamedTuple):
    """A group's suffixes in the order of their words, and how much each shares with the one before."""

    order: np.ndarray
    common: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, starts: np.ndarray, size: int) -> Subtree:
        levels = run_ranks(words, size)
        last = levels[-1]
        # the longest run and the one that ends with the window: together all of it
        order = np.argsort(last[starts] << np.uint64(32) | last[starts + size - (1 << len(levels) - 1)])
        common = np.zeros(len(order), np.int64)
        at = starts[order]
        common[1:] = common_prefix(levels, at[:-1], at[1:], size)
        return cls(order, common)

    def nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The internal node of a depth (or the leaf) above each suffix in order, and where each begins."""
        new = self.common < depth
        return np.cumsum(new) - 1, np.flatnonzero(new)


def subtree_repeats(table: pa.Table, size: int) -> pa.Table:
    """Of one group's fragments: doc, tkey, lo, and the bits of the windows that repeat earlier ones."""
    table = table.combine_chunks()
    words, n = one_array(table["words"]), one_array(table["n"]).to_numpy()
    which = np.repeat(np.arange(len(n)), n)
    bit = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    offsets = words.offsets.to_numpy().astype(np.int64)
    tree = Subtree.of(words.flatten().to_numpy().view(np.uint32), (offsets[:-1] - offsets[0])[which] + bit, size)
    node, heads = tree.nodes(size)
    which, bit = which[tree.order], bit[tree.order]
    doc, lo = one_array(table["doc"]).to_numpy(), one_array(table["lo"]).to_numpy()
    later = ~earliest_of(node, heads, doc[which], lo[which] + bit)
    repeats = np.bincount(which, np.where(later, np.int64(1) << bit, 0), len(n)).astype(np.int32)
    out = table.select(["doc", "tkey", "lo"]).append_column("repeats", pa.array(repeats))
    return out.filter(pa.array(repeats != 0))


def lengthened(hot: DataFrame, size: int, most_words: int) -> tuple[DataFrame, DataFrame | None]:
    """Fragments under prefixes that fit a group, and the windows of those that
    don't at any length (doc, tkey, lo, words), each many times the same."""
    fit = hot.where("false")
    for length in [*range(PREFIX + 4, size, 4), size]:
        heavy = hot.groupBy("prefix").agg(F.sum(F.size("words")).alias("w"))
        heavy = materialize(heavy.where(F.col("w") > most_words).select("prefix"), "heavy")
        if heavy.isEmpty():
            return fit.unionByName(hot), None
        fit = fit.unionByName(hot.join(heavy, "prefix", "left_anti"))
        # suffixes of their own, under longer prefixes
        one = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.alias("i"), F.slice("words", i + 1, F.lit(size)).alias("w")))
        hot = hot.join(heavy, "prefix", "left_semi").select("doc", "tkey", "lo", F.explode(one).alias("x"))
        hot = hot.select(
            "doc", "tkey", (F.col("lo") + F.col("x.i")).alias("lo"), F.lit(1).alias("n"),
            F.xxhash64(F.lit(length), F.slice("x.w", 1, length)).alias("prefix"), F.col("x.w").alias("words"),
        )
        hot = materialize(hot, "lengthened")
    return fit, hot.select("doc", "tkey", "lo", "words")


def repeats(docs: DataFrame, *, size: int = 20, most_bits: int = MOST_BITS, group_words: int = GROUP_WORDS) -> DataFrame:
    """doc, tkey, spans (array of lo, repeats): where windows repeat earlier ones.

    docs: doc (the order), tkey, text.  Bit i of repeats tells of the window
    that starts at lo + i.  A prefix may hold a quarter of group_words.  The two
    filters have at most most_bits each; fuller ones let more through, which
    costs time and changes nothing else.
    """
    if not PREFIX < size <= PREFIX + 30:
        raise ValueError(f"size is {size}, not {PREFIX + 1} to {PREFIX + 30}")
    spark = docs.sparkSession
    counts = materialize(prefix_counts(docs, size), "prefixes")
    leaves = bloom_of(counts, "prefix", most_bits)
    total = counts.agg(F.sum("n")).first()[0] or 0
    groups = max(n_partitions(spark), -(-total * (size + 5) // group_words))
    often = counts.where(F.col("n") * (size + 5) > group_words // 4)
    shipped = materialize(fragments(docs, size, leaves, bloom_of(often, "prefix", most_bits)), "suffixes")
    asked, gone, same = shipped.where("words IS NOT NULL"), shipped.where("words IS NULL"), None
    columns = ["doc", "tkey", "lo", "n", "prefix", "words"]
    fit = asked.where("NOT hot").select(columns)
    if not often.isEmpty():
        again = materialize(folded(asked.where("hot"), groups), "folded")
        gone = gone.unionByName(again.where("words IS NULL"))
        more, same = lengthened(again.where("words IS NOT NULL").select(columns), size, group_words // 4)
        fit = fit.unionByName(more)
    dealt = fit.withColumn("grp", F.pmod(F.xxhash64("prefix"), F.lit(groups)).cast("int")).drop("prefix")

    def tree(table: pa.Table) -> pa.Table:
        return subtree_repeats(table, size)

    found = dealt.repartition(groups, "grp").groupBy("grp").applyInArrow(tree, "doc long, tkey long, lo int, repeats int")
    whole = (F.pow(F.lit(2.0), "n") - 1).cast("int").alias("repeats")
    found = found.unionByName(gone.select("doc", "tkey", "lo", whole))
    if same is not None:
        first = same.groupBy("words").agg(F.min(F.struct("doc", "lo")).alias("first"))
        later = same.join(first, "words").where(F.struct("doc", "lo") != F.col("first"))
        found = found.unionByName(later.select("doc", "tkey", "lo", F.lit(1).alias("repeats")))
    return found.groupBy("doc", "tkey").agg(F.collect_set(F.struct("lo", "repeats")).alias("spans"))


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 20, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs.

    Every word covered by a window of ``size`` words that also starts earlier
    (in a smaller identifier, or earlier in the same document) is removed;
    windows are judged on the input.  Words are what stands between ASCII white
    space.  A null text has no words; a null identifier comes last.  Rows that
    repeat an identifier are one place each: a window at the same start under
    the same identifier is not earlier.  with_text adds the kept words, joined
    by a space.  Other columns are not read; an empty table gives an empty
    result.  size is from 7 to 36; others raise an error.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"),
        text_key(F.col(text_col)).alias("tkey"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    spans = repeats(rows, size=size)
    joined = rows.join(spans, ["doc", "tkey"], "left").select("doc_id", F.col("text").cast("binary").alias("text"), "spans.lo", "spans.repeats")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, lo, bits in zip(batch["text"].to_pylist(), batch["lo"], batch["repeats"], strict=True):
                words = text.split()  # bytes part at ASCII white space alone
                n = len(words)
                if lo.is_valid:
                    lo, bits = lo.values.to_numpy(), bits.values.to_numpy()
                    at = (lo[:, None] + np.arange(31))[(bits[:, None] >> np.arange(31) & 1).astype(bool)]
                    starts = np.bincount(at, minlength=n + 1) - np.bincount(at + size, minlength=n + 1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(starts)[:n] == 0).tolist()]
                kept = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept))
            n, gone, digest, kept = zip(*out, strict=True) if out else ((), (), (), ())
            columns = [batch["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary()).cast(pa.string())] * with_text, names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    return joined.mapInArrow(cut, schema)
