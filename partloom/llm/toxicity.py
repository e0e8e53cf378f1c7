"""Toxicity by a chain of linear classifiers.

Categories are predicted in a fixed order.  Each has a logistic regression over
hashed features of the whole text (its words and their beginnings) and the log
odds of all earlier categories.  For training, those odds come from models that
didn't see the document (out of fold); at prediction, from the final models.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import labelled_sample, materialize, small_batches

_WORDS = re.compile(r"[^\W\d_]+")
FEATURES = 1 << 17
FOLDS = 4


def categories() -> list[tuple[str, Column]]:
    """The query's chain, general signs first: each a condition on the labels."""
    low, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return [("low_quality", low), ("toxic_junk", low & toxic), ("toxic", toxic)]


class _Features(dict):
    """Lower-case word to the hashed features it brings, remembered."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        parts = {word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n)}
        found = self[word] = tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) % FEATURES for p in sorted(parts))
        return found


def features(text: str, known: _Features) -> np.ndarray:
    """Sorted hashed features that a text has."""
    words = set(_WORDS.findall(text.lower()))
    found = set(chain.from_iterable(map(known.__getitem__, words)))
    out = np.fromiter(found, np.int32, len(found))
    out.sort()
    return out


def log_odds(p: np.ndarray) -> np.ndarray:
    return np.clip(np.log(p) - np.log1p(-p), -6, 6)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 60, memory: int = 7) -> np.ndarray:
    """Limited-memory quasi-Newton descent with a halving line search."""
    value, grad = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, y, rho in reversed(pairs):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * y
        if pairs:
            s, y, rho = pairs[-1]
            q /= rho * (y @ y)
        for (s, y, rho), a in zip(pairs, reversed(alphas), strict=True):
            q += (a - rho * (y @ q)) * s
        slope, t = grad @ q, 1.0 if pairs else 1 / max(1.0, float(np.abs(grad).sum()))
        if slope <= 1e-12:
            break
        for _ in range(30):
            new, new_grad = f(x - t * q)
            if new <= value - 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = -t * q, new_grad - grad
        done = value - new < 1e-6 * max(1.0, abs(value))
        x, value, grad = x - t * q, new, new_grad
        if s @ y > 1e-12:
            pairs = [*pairs[1 - memory :], (s, y, 1 / (s @ y))] if len(pairs) >= memory else [*pairs, (s, y, 1 / (s @ y))]
        if done:
            break
    return x


class Linear:
    """Logistic regression over hashed features, dense columns and a constant."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights

    @staticmethod
    def fit(cols: list[np.ndarray], dense: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> Linear:
        d = dense.shape[1]
        start = np.zeros(FEATURES + d + 1)
        if y.all() or not y.any():
            start[-1] = log_odds(np.array([(y.sum() + 0.1) / (len(y) + 0.2)]))[0]
            return Linear(start)
        flat = np.concatenate(cols)
        # a feature of fewer than two documents can't help with others
        common = np.bincount(flat, minlength=FEATURES)[flat] >= 2
        rows = np.repeat(np.arange(len(cols)), [len(c) for c in cols])[common]
        flat, inverse = np.unique(flat[common], return_inverse=True)
        n = len(flat)
        share = np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5

        def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
            z = np.bincount(rows, w[inverse], len(y)) + dense @ w[n:-1] + w[-1]
            p = sigmoid(z)
            value = np.mean(share * (np.logaddexp(0, z) - y * z)) + ridge / 2 * (w[:-1] @ w[:-1])
            g = share * (p - y) / len(y)
            grad = np.concatenate([np.bincount(inverse, g[rows], n), dense.T @ g, [g.sum()]])
            grad[:-1] += ridge * w[:-1]
            return value, grad

        w = minimise(loss, np.zeros(n + d + 1))
        start[flat], start[FEATURES:] = w[:n], w[n:]
        return Linear(start)

    def predict(self, cols: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        z = np.array([self.weights[c].sum() for c in cols]) + dense @ self.weights[FEATURES:-1] + self.weights[-1]
        return sigmoid(z)


def _fit_fold(names: list[str], fold: int, pdf: pd.DataFrame) -> pd.DataFrame:
    """The last of names: a model without one fold's rows, and what it says of
    them; for fold -1 the model of all rows."""
    pdf = pdf.sort_values("doc_id")
    cols = [np.asarray(c, np.int32) for c in pdf["cols"]]
    dense = log_odds(pdf[[f"p_{n}" for n in names[:-1]]].to_numpy(float).reshape(len(pdf), -1))
    y = pdf[names[-1]].to_numpy(float)
    held = (pdf["fold"] == fold).to_numpy()
    seen = np.flatnonzero(~held)
    if not len(seen):
        model = Linear.fit(cols, dense, np.zeros(len(pdf)))
    else:
        model = Linear.fit([cols[i] for i in seen], dense[seen], y[seen])
    if fold < 0:
        return pd.DataFrame({"doc_id": [None], "p": [None], "weights": [model.weights.astype(np.float32)]})
    out = np.flatnonzero(held)
    p = model.predict([cols[i] for i in out], dense[out]) if len(out) else np.empty(0)
    return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[out], "p": p, "weights": None})


def train(docs: DataFrame, labels: DataFrame, chain_of: list[tuple[str, Column]], *, max_labelled: int = 8_000, seed: int = 0) -> tuple[list[np.ndarray], float]:
    """The chain's final weights, and the cut on the last category's probability
    that gives the best F1 out of fold.

    At most max_labelled labelled documents are used, half of them of the last
    category if there are so many, so a fit is one task of a bounded size; folds
    fit side by side.  For the cut, the others count as often as there are more
    of them among all labels than in the sample.
    """
    spark = docs.sparkSession
    columns = [c for c in labels.columns if c != "doc_id"]
    last = F.coalesce(chain_of[-1][1], F.lit(False))
    half = max_labelled // 2
    sample = labelled_sample(labels.where(last), columns, half, seed).unionByName(labelled_sample(labels.where(~last), columns, half, seed))
    sample = sample.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in columns))
    sample = sample.select(F.col("doc_id").alias("labelled"), *[c.cast("double").alias(n) for n, c in chain_of])
    sample = materialize(sample, "toxic-labels")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(sample), F.col("doc_id") == F.col("labelled")).drop("labelled")
    names = [n for n, _ in chain_of]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Features()
        for batch in batches:
            cols = pa.array([features(t, known) for t in batch["text"].to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(batch[n] for n in names), cols], ["doc_id", *names, "cols"])

    schema = "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", cols array<int>"
    data = rows.mapInArrow(extract, schema).dropDuplicates(["doc_id"])
    data = materialize(data.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(FOLDS)).cast("int")), "toxic-features")
    weights: list[np.ndarray] = []
    cut = 0.5
    for i, name in enumerate(names):
        upto = names[: i + 1]
        fits = data.withColumn("without", F.explode(F.sequence(F.lit(-1), F.lit(FOLDS - 1)))).groupBy("without")

        def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return _fit_fold(upto, key[0], pdf)  # noqa: B023  pickled in this round

        fitted = materialize(fits.applyInPandas(fit, "doc_id long, p double, weights array<float>"), f"toxic-{name}")
        found = fitted.where("weights IS NOT NULL").select("weights").first()
        weights.append(np.array(found[0], np.float64) if found else np.zeros(FEATURES + i + 1))
        held = fitted.where("weights IS NULL").select("doc_id", F.col("p").alias(f"p_{name}"))
        data = data.join(held, "doc_id")
    if weights:
        known = data.select(f"p_{names[-1]}", names[-1]).collect()  # at most max_labelled
        p, y = np.array([r[0] for r in known]), np.array([r[1] for r in known])
        others = labels.where(~last & F.col("doc_id").isNotNull()).count() / max(1, int((1 - y).sum()))
        cut = best_cut(p, y, np.where(y > 0, 1.0, max(1.0, others)))
    return weights, cut


def best_cut(p: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The cut of best F1, halfway to the next score below; 0.5 without positives."""
    if not y.sum():
        return 0.5
    order = np.argsort(-p)
    p, y = p[order], y[order]
    w = np.ones(len(y)) if weight is None else weight[order]
    hits = np.cumsum(y * w)
    f1 = 2 * hits / (np.cumsum(w) + (y * w).sum())
    i = int(np.argmax(f1))
    return float((p[i] + p[i + 1]) / 2) if i + 1 < len(p) else float(p[i])


def classify(docs: DataFrame, labels: DataFrame, *, chain_of: list[tuple[str, Column]] | None = None, **options) -> DataFrame:
    """doc_id, p_<category> for each of the chain, flagged for every row of docs.

    flagged: the last category's probability reaches the cut of best F1 out of
    fold.  A null text is an empty one; rows that repeat an identifier are
    scored each by its own text; an empty table gives an empty result.  Without labels every probability is a
    half and nothing is flagged.  labels' columns but doc_id are what the
    chain's conditions speak of.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chain_of = chain_of or categories()
    names = [n for n, _ in chain_of]
    weights, cut = train(docs, labels, chain_of, **options)
    models = spark.sparkContext.broadcast([w.astype(np.float32) for w in weights])
    trained = any(w.any() for w in weights)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Features()
        for batch in batches:
            cols = [features(t, known) for t in batch["text"].to_pylist()]
            dense = np.zeros((len(cols), 0))
            for w in models.value:
                p = Linear(w).predict(cols, dense)
                dense = np.column_stack([dense, log_odds(p)])
            if len(known) > 200_000:
                known.clear()
            odds = sigmoid(dense)
            flagged = pa.array((odds[:, -1] >= cut) & trained)
            columns = [pa.array(odds[:, i], pa.float64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns, flagged], ["doc_id", *(f"p_{n}" for n in names), "flagged"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, " + ", ".join(f"p_{n} double" for n in names) + ", flagged boolean"
    return rows.mapInArrow(predict, schema)
