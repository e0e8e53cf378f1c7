"""Classifiers on documents held out, and their parts."""

import random

import numpy as np
import pytest
from helpers import SF

from partloom.llm import quality, toxicity
from partloom.llm.common import kth_largest, labelled_sample


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    good = [f"g{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        bad, toxic = i % 7 == 0, i % 5 == 0
        w = [rng.choice(good) for _ in range(rng.choice([10, 60, 200]))]
        if bad:
            w = [x + rng.choice(["%%%", "&&&"]) for x in w]
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["slurry", "insultword", "rudes"]))
        rows.append((i, " ".join(w), "x"))
        if i % 2:
            labels.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").cache()
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def test_quality_held_out(labelled):
    docs, labels = labelled
    got = {r.doc_id: r.kept for r in quality.resample(docs, labels).collect()}
    held = [i for i in range(0, 400, 2)]
    assert np.mean([got[i] == (i % 7 != 0) for i in held]) > 0.97


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    got = {r.doc_id: r.flagged for r in toxicity.classify(docs, labels).collect()}
    held = [i for i in range(0, 400, 2)]
    assert np.mean([got[i] == (i % 5 == 0) for i in held]) > 0.97


def test_on_the_tables(spark):
    """Fitted on half of the real labels, held against the other half."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fitted = labels.where("doc_id % 2 = 0")
    held = {r.doc_id: r for r in labels.where("doc_id % 2 = 1").collect()}
    kept = {r.doc_id: r.kept for r in quality.resample(docs, fitted).collect()}
    assert np.mean([kept[i] for i, r in held.items() if r.quality == 1]) > 0.95
    assert np.mean([kept[i] for i, r in held.items() if r.quality == 0]) < 0.35
    # smaller tables have a few toxic documents alone
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    held = {r.doc_id: r for r in labels.where("doc_id % 2 = 1").collect()}
    flagged = {r.doc_id: r.flagged for r in toxicity.classify(docs.join(labels, "doc_id", "left_semi"), labels.where("doc_id % 2 = 0")).collect()}
    toxic, clean = (np.mean([flagged[i] for i, r in held.items() if r.toxic == t]) for t in (1, 0))
    assert toxic > 0.75 and clean < 0.05, (toxic, clean)


def test_quality_by_brute_force(labelled):
    """Models, weights, noise and the k largest, n-gram by n-gram."""
    import math
    import re
    import zlib
    from collections import Counter

    from pyspark.sql import functions as F

    from partloom.llm.common import text_key, uniform

    docs, labels = labelled
    good = {r.doc_id for r in labels.collect() if r.quality}
    got = {r.doc_id: r for r in quality.resample(docs, labels, k=50, buckets=512, seed=3).collect()}

    def grams(text):
        tokens = re.findall(r"\w+|[^\w\s]+", text)
        codes = [zlib.crc32(t.encode()) for t in tokens]
        codes = [0x5F3759DF if i and c == codes[i - 1] else c for i, c in enumerate(codes)]
        pairs = [((a * 0x9E3779B97F4A7C15 + b) % (1 << 64)) >> 17 for a, b in zip(codes, codes[1:], strict=False)]
        return [x % 512 for x in codes + pairs]

    rows = docs.select("doc_id", "text", (-F.log(-F.log(uniform("doc_id", text_key(F.col("text")), seed=4)))).alias("noise")).collect()
    found = {r.doc_id: grams(r.text) for r in rows}
    target, raw = Counter(x for i in good for x in found[i]), Counter(x for g in found.values() for x in g)
    ratio = {b: math.log((target[b] + 1) / (target.total() + 512)) - math.log((raw[b] + 1) / (raw.total() + 512)) for b in range(512)}
    score = {}
    for r in rows:
        weight = 64 * sum(ratio[x] for x in found[r.doc_id]) / (len(found[r.doc_id]) + 16)
        assert got[r.doc_id].log_weight == pytest.approx(weight) and got[r.doc_id].n_ngrams == len(found[r.doc_id])
        score[r.doc_id] = weight + r.noise
    cut = sorted(score.values(), reverse=True)[49]
    assert all(got[i].kept == (x >= cut - 1e-9) for i, x in score.items())


def test_cut_is_chosen_out_of_fold():
    """Counts by fold: a fold's own ratios leave its documents out."""
    counts = [(0, 0, 5), (1, 1, 3), (0, quality.FOLDS, 7), (1, quality.FOLDS, 4), (2, quality.FOLDS, 1)]

    class Rows:
        def collect(self):
            return counts

    r = quality.log_ratios(Rows(), 3)
    log = lambda x: np.log(np.array(x) + 1.0) - np.log(sum(x) + 3.0)
    raw = log([7, 4, 1])
    assert np.allclose(r[0], log([0, 3, 0]) - raw) and np.allclose(r[1], log([5, 0, 0]) - raw)
    assert np.allclose(r[2], log([5, 3, 0]) - raw) and np.allclose(r[quality.FOLDS], log([5, 3, 0]) - raw)


def newton(x, y, share, ridge):
    """Weights (the last one free of ridge) that minimise the weighted logistic loss, by dense Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 0
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (share * (p - y)) / len(y) + penalty * w
        hess = (x * (share * p * (1 - p))[:, None]).T @ x / len(y) + np.diag(penalty + 1e-12)
        w = w - np.linalg.solve(hess, grad)
    return w


def test_chain_by_brute_force(spark):
    """Every model of the chain again, densely: odds of earlier ones out of fold for
    training, of the final models for prediction."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(sorted({rng.choice(words) for _ in range(rng.randint(1, 5))}))) for i in range(120)]
    first = {i: int("w1" in t.split() or rng.random() < 0.15) for i, t in rows}
    second = {i: int(first[i] and "w2" in t.split() or rng.random() < 0.1) for i, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, first[i], second[i]) for i, _ in rows], "doc_id long, a int, b int")
    chain = [("a", F.col("a") == 1), ("b", F.col("b") == 1)]
    got = {r.doc_id: r for r in toxicity.classify(docs, labels, chain_of=chain).collect()}

    known = toxicity._Features()
    cols = {i: toxicity.features(t, known).tolist() for i, t in rows}
    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit(0), "doc_id"), F.lit(toxicity.FOLDS)).alias("f")).collect()}

    def fit(ids, y, odds):
        often = {f: sum(f in cols[i] for i in ids) for f in {f for i in ids for f in cols[i]}}
        kept = sorted(f for f, n in often.items() if n >= 2)
        x = lambda ids: np.array([[*(f in cols[i] for f in kept), *(o[i] for o in odds), 1.0] for i in ids], float)
        t = np.array([y[i] for i in ids], float)
        share = np.where(t, 0.5 / t.mean(), 0.5 / (1 - t.mean())) ** 0.5
        w = newton(x(ids), t, share, 1e-4)
        return lambda ids, odds: dict(zip(ids, 1 / (1 + np.exp(-np.array([[*(f in cols[i] for f in kept), *(o[i] for o in odds), 1.0] for i in ids], float) @ w)), strict=True))

    ids = [i for i, _ in rows]
    logit = lambda p: {i: float(np.clip(np.log(x) - np.log1p(-x), -6, 6)) for i, x in p.items()}
    held_odds, final_odds, final = [], [], []
    for y in (first, second):
        held = {}
        for f in range(toxicity.FOLDS):
            out = [i for i in ids if fold[i] == f]
            held |= fit([i for i in ids if fold[i] != f], y, held_odds)(out, held_odds)
        p = fit(ids, y, held_odds)(ids, final_odds)
        final.append(p)
        held_odds, final_odds = [*held_odds, logit(held)], [*final_odds, logit(p)]
    for name, p in zip(("p_a", "p_b"), final, strict=True):
        assert max(abs(got[i][name] - p[i]) for i in ids) < 0.06
        assert np.mean([abs(got[i][name] - p[i]) for i in ids]) < 0.015


def test_gumbel_top_k(labelled):
    docs, labels = labelled
    got = quality.resample(docs, labels, k=37).collect()
    cut = sorted((r.score for r in got), reverse=True)[36]
    assert [r.kept for r in got] == [r.score >= cut for r in got]
    again = quality.resample(docs, labels, k=37).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert not any(r.kept for r in quality.resample(docs, labels, k=0).collect())


@pytest.mark.parametrize("which", ["odd_docs", "no_docs"])
def test_odd_inputs(spark, which, request):
    docs = request.getfixturevalue(which)
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(5, 1, 0), (8, 0, 1), (None, 1, 1), (9, None, None), (10, 1, 0), (10, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (no_labels, some):
        assert quality.resample(docs, labels).count() == docs.count()
        assert toxicity.classify(docs, labels).count() == docs.count()
    assert quality.resample(docs, no_labels).where("NOT kept").count() == 0
    assert toxicity.classify(docs, no_labels).where("flagged").count() == 0
    assert quality.keep_quality(docs, no_labels).columns == docs.columns
    assert quality.keep_quality(docs, no_labels).count() == docs.count()


def test_later_models_see_earlier_ones():
    """A category that only the first one's odds tell is learnt through the chain."""
    rng = np.random.default_rng(0)
    y = rng.random(400) < 0.4
    dense = (np.where(y, 2.0, -2.0) + rng.normal(0, 1, 400))[:, None]
    cols = [rng.integers(0, 50, 5).astype(np.int32) for _ in range(400)]
    model = toxicity.Linear.fit(cols[:300], dense[:300], y[:300].astype(float))
    p = model.predict(cols[300:], dense[300:])
    assert ((p > 0.5) == y[300:]).mean() > 0.9
    one = toxicity.Linear.fit(cols, dense, np.zeros(400))
    assert one.predict(cols, dense).max() < 0.01


def test_minimise():
    a = np.array([1.0, 10.0, 100.0])
    x = toxicity.minimise(lambda v: (0.5 * (a * (v - 3) ** 2).sum(), a * (v - 3)), np.zeros(3))
    assert np.allclose(x, 3, atol=1e-2)


def test_best_cut():
    assert toxicity.best_cut(np.array([0.9, 0.8, 0.2]), np.array([1, 1, 0])) == pytest.approx(0.5)
    assert toxicity.best_cut(np.array([0.9]), np.array([0])) == 0.5


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.choice([0.5, rng.gauss(0, 1), 7.0]) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    want = sorted(values, reverse=True)
    for k in (1, 2, 1700, 2500, 5000):
        assert kth_largest(df, "x", k, bins=16, enough=50) == want[k - 1]
    assert kth_largest(df, "x", 0) is None and kth_largest(df, "x", 5001) is None


def test_labelled_sample(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = labelled_sample(labels, ["quality"], 30)
    assert got.count() == 30
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, labelled_sample(labels, ["quality"], 30).collect()))
