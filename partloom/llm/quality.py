"""Quality classifier by importance resampling.

Two generative models of hashed word and word-pair counts are fitted: one of
target texts (labelled as good), one of the whole raw corpus.  A document's
log importance weight is the log ratio of its likelihoods, as a mean over its
n-grams times a fixed length, so that long texts don't win by length.  Gumbel
noise on the log weights and a top-k make the resampling without replacement.
The cut that sets k is chosen on labelled documents weighed by a target model
that didn't see them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import kth_largest, labelled_sample, materialize, small_batches, text_key, uniform

_TOKENS = re.compile(r"\w+|[^\w\s]+")
_AGAIN = 0x5F3759DF  # the code of a token that repeats the one before it


class _Codes(dict):
    """Token to 32-bit code, remembered."""

    def __missing__(self, token: str) -> int:
        code = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return code


def ngrams(text: str, buckets: int, codes: dict[str, int]) -> np.ndarray:
    """Buckets of a text's tokens and pairs of tokens (words, runs of signs)."""
    tokens = _TOKENS.findall(text)
    h = np.fromiter(map(codes.__getitem__, tokens), np.uint64, len(tokens))
    again = h[1:] == h[:-1]
    h = h.copy()
    h[1:][again] = _AGAIN
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) >> np.uint64(17)
    return (np.concatenate([h, pairs]) % np.uint64(buckets)).astype(np.int64)


FOLDS = 4


def ngram_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, part, n: n-gram counts over target documents (true target) of each fold
    (parts 0 to FOLDS - 1), and over all documents (part FOLDS)."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, codes = np.zeros((FOLDS + 1, buckets), np.int64), _Codes()
        for batch in batches:
            for text, target, fold in zip(*(batch[c].to_pylist() for c in ("text", "target", "fold")), strict=True):
                counts = np.bincount(ngrams(text, buckets, codes), minlength=buckets)
                totals[FOLDS] += counts
                if target:
                    totals[fold] += counts
            if len(codes) > 300_000:
                codes.clear()
        part, bucket = np.nonzero(totals)
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(part), pa.array(totals[part, bucket])], ["bucket", "part", "n"])

    counts = docs.select("text", "target", "fold").mapInArrow(count, "bucket long, part long, n long")
    return counts.groupBy("bucket", "part").agg(F.sum("n").alias("n"))


def log_ratios(counts: DataFrame, buckets: int, alpha: float = 1.0) -> np.ndarray:
    """log(target / raw) by bucket: a row for each fold, by the target documents of
    the others, and one by all; a row without target texts is zero."""
    table = np.zeros((FOLDS + 1, buckets))
    for bucket, part, n in counts.collect():  # at most a row for each bucket and part
        table[part, bucket] = n
    log = lambda x: np.log(x + alpha) - np.log(x.sum() + alpha * buckets)
    target = table[:FOLDS].sum(axis=0)
    out = np.zeros((FOLDS + 1, buckets))
    for i, seen in enumerate([*(target - table[:FOLDS]), target]):
        if seen.any():
            out[i] = log(seen) - log(table[FOLDS])
    return out


def _cut(scores: list[tuple[float, bool]], cost: float) -> float:
    """The least cut that loses least: a good document below it costs so many bad ones above."""
    scores = sorted(scores)
    good = sum(g for _, g in scores)
    if good == len(scores):
        return -np.inf
    bad_above, good_below, best, at = len(scores) - good, 0, float(len(scores) - good), -np.inf
    for i, (x, g) in enumerate(scores):
        good_below += g
        bad_above -= not g
        ends = i + 1 == len(scores) or scores[i + 1][0] > x
        if ends and good_below * cost + bad_above < best:
            best = good_below * cost + bad_above
            at = (x + scores[i + 1][0]) / 2 if i + 1 < len(scores) else np.nextafter(x, np.inf)
    return at


def resample(
    docs: DataFrame,
    labels: DataFrame,
    *,
    k: int | None = None,
    buckets: int = 1 << 14,
    length: float = 64.0,
    shrink: float = 16.0,
    max_labelled: int = 20_000,
    good_cost: float = 5.0,
    seed: int = 0,
) -> DataFrame:
    """doc_id, tkey, n_ngrams, log_weight, score, kept for every row of docs.

    The target model and the cut are fitted on at most max_labelled labelled
    documents (labels: doc_id, quality; 1 is good), the cut on their weights out
    of fold; the raw model counts every document.  k, unless given, is the number of documents whose log weight
    reaches the cut that separates labelled good from bad best, a good one
    lost costing good_cost bad ones kept.  score is the log weight with Gumbel
    noise from a seeded hash of the identifier; kept are the k largest and
    their ties.  A null text is an empty one; a text without n-grams weighs 0.
    Without labels, all are kept.  Rows that repeat an identifier and text are
    scored alike.
    """
    spark = docs.sparkSession
    sample = labelled_sample(labels, ["quality"], max_labelled, seed)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("tkey"), F.coalesce("text", F.lit("")).alias("text")
    )
    sample = materialize(sample.select(F.col("doc_id").alias("labelled"), (F.col("quality") > 0).alias("target")), "quality-labels")
    marked = rows.join(F.broadcast(sample), F.col("doc_id") == F.col("labelled"), "left").drop("labelled")
    marked = marked.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int"))
    table = spark.sparkContext.broadcast(log_ratios(ngram_counts(marked, buckets), buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, ratios = _Codes(), table.value
        for batch in batches:
            found = [ngrams(t, buckets, codes) for t in batch["text"].to_pylist()]
            weight = lambda x, part: length * float(ratios[part][x].sum()) / (len(x) + shrink)
            weights = [weight(x, FOLDS) for x in found]
            held = [None if t is None else weight(x, f) for x, t, f in zip(found, batch["target"].to_pylist(), batch["fold"].to_pylist(), strict=True)]
            if len(codes) > 300_000:
                codes.clear()
            columns = [batch["doc_id"], batch["tkey"], batch["target"], pa.array([len(x) for x in found], pa.int64()), pa.array(weights, pa.float64()), pa.array(held, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tkey", "target", "n_ngrams", "log_weight", "held"])

    scored = marked.select("doc_id", "tkey", "target", "fold", "text").mapInArrow(
        weigh, "doc_id long, tkey long, target boolean, n_ngrams long, log_weight double, held double"
    )
    noise = -F.log(-F.log(uniform("doc_id", "tkey", seed=seed + 1)))
    scored = materialize(scored.withColumn("score", F.col("log_weight") + noise), "quality-scores")
    if k is None:
        # at most max_labelled identifiers; rows that repeat one count once
        known = scored.where(F.col("target").isNotNull()).groupBy("doc_id").agg(F.min("held"), F.first("target")).drop("doc_id")
        cut = _cut([tuple(r) for r in known.collect()], good_cost)
        k = scored.where(F.col("log_weight") >= F.lit(float(cut))).count()
    least = kth_largest(scored, "score", k)
    kept = F.lit(False) if least is None else F.col("score") >= F.lit(least)
    return scored.select("doc_id", "tkey", "n_ngrams", "log_weight", "score", kept.alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs' own rows and columns without the documents that resampling rejects."""
    kept = resample(docs, labels, **options).where("kept")
    kept = kept.select(F.col("doc_id").alias("__id"), F.col("tkey").alias("__tkey")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (text_key(F.col("text")) == F.col("__tkey"))
    return docs.join(kept, same, "left_semi")
