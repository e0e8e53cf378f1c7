"""The n-gram Jaccard join against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from conftest import SCHEMA, words

from partloom.llm import ngram_join

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=3):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def slow_components(docs, size=3, percent=90):
    """Sorted (doc_id, n_shingles, component_id, component_size) by comparing all pairs."""
    sets = [shingles(d.text, size) for d in docs]
    head = list(range(len(docs)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            head[find(i)] = find(j)
    of = {}
    for i, d in enumerate(docs):
        of.setdefault(find(i), []).append(d.doc_id)
    least = {k: min((i for i in ids if i is not None), default=None) for k, ids in of.items()}
    return sorted(((d.doc_id, len(sets[i]), least[find(i)], len(of[find(i)])) for i, d in enumerate(docs)), key=str)


def fast(docs, **options):
    return sorted(map(tuple, ngram_join.similar_documents(docs, **options).collect()), key=str)


@pytest.mark.parametrize("which, size, percent", [("odd_docs", 3, 90), ("some_docs", 3, 90), ("some_docs", 2, 55), ("some_docs", 5, 100)])
def test_against_all_pairs(which, size, percent, request):
    docs = request.getfixturevalue(which)
    assert fast(docs, size=size, percent=percent) == slow_components(docs.collect(), size, percent)


@pytest.fixture(scope="module")
def edited(spark):
    """Many texts of one origin with more or less edits, on both sides of the
    threshold; texts that are almost one common passage; chains of small steps."""
    rng = random.Random(11)
    base = words(rng, 150, 900).split(" ")
    texts = []
    for i in range(90):
        own = list(base)
        for j in rng.sample(range(150), rng.randrange(6)):
            own[j] = f"e{i}x{j}"
        texts.append(" ".join(own))
    passage = words(rng, 60, 900)
    texts += [passage + " " + words(rng, rng.randrange(12), 9000) for _ in range(60)]
    step = words(rng, 80, 900).split(" ")
    for i in range(25):
        step[3 * i] = f"s{i}"
        texts.append(" ".join(step))
    texts += [words(rng, rng.randrange(1, 60), 40) for _ in range(60)]
    texts += texts[:20]
    rng.shuffle(texts)
    return spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in enumerate(texts)], SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("percent", [70, 80, 90, 95])
def test_on_both_sides_of_the_threshold(edited, percent):
    assert fast(edited, percent=percent) == slow_components(edited.collect(), 3, percent)


def test_longer_prefixes_are_asked_for(edited, monkeypatch):
    """Cheap entries and dear checks make prefixes longer; results stay."""
    monkeypatch.setattr(ngram_join, "VERIFY", 50.0)
    rows = edited.selectExpr("doc_id", "doc_id AS key", "text")
    counts = ngram_join.estimates(ngram_join.count_sketch(rows, 3))
    m = [r.m for r in ngram_join.signed_sets(rows, counts, 3, 90).collect()]
    assert max(m) > 1 and min(m) == 1
    assert fast(edited) == slow_components(edited.collect())


def test_prefixes_of_links_share_enough():
    """Whatever the counts and each side's choice."""
    rng = np.random.default_rng(2)
    counts = rng.integers(1, 200, 1 << ngram_join.CELL_BITS).astype(np.uint32)
    linked = 0
    for _ in range(400):
        x = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 120)).astype(np.uint64))
        y = np.unique(np.concatenate([rng.choice(x, max(1, int(len(x) * rng.uniform(0.85, 1))), replace=False), rng.integers(0, 1 << 62, rng.integers(0, 9)).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 90 * (len(x) + len(y) - both):
            linked += 1
            (px, mx), (py, my) = (ngram_join.adaptive_prefix(s, counts, 90) for s in (x, y))
            assert len(np.intersect1d(px, py)) >= min(mx, my)
    assert linked > 100


@pytest.mark.parametrize("percent", [60, 90])
def test_tests_pass_all_links(percent, spark):
    """Sizes, classes and parities, of sets of all sizes."""
    rng = np.random.default_rng(5)
    rows, linked = [], []
    for i in range(300):
        x = np.unique(rng.integers(0, 1 << 62, int(2 ** rng.uniform(0, 11))).astype(np.uint64))
        y = np.unique(np.concatenate([rng.choice(x, max(1, int(len(x) * rng.uniform(0.7, 1))), replace=False), rng.integers(0, 1 << 62, rng.integers(0, 1 + len(x) // 8)).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        linked.append(100 * both >= percent * (len(x) + len(y) - both))
        rows.append((i, (len(x), ngram_join.parities(x).tolist()), (len(y), ngram_join.parities(y).tolist())))
    df = spark.createDataFrame(rows, "i int, x struct<n: int, bits: array<long>>, y struct<n: int, bits: array<long>>")
    passed = {r.i for r in df.where(ngram_join._may_link("x", "y", percent)).collect()}
    assert {i for i, is_link in enumerate(linked) if is_link} <= passed
    assert 50 < sum(linked) and len(passed) < 290


def test_sketch_counts_all(some_docs):
    rows = some_docs.select("text")
    sketch = ngram_join.count_sketch(rows, 3)
    assert sketch.sum() == sum(len(shingles(r.text)) for r in rows.collect())


def test_empty(no_docs):
    assert ngram_join.similar_documents(no_docs).collect() == []
    with pytest.raises(ValueError):
        ngram_join.similar_documents(no_docs, percent=40)
