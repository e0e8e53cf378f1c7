"""Near-duplicates against all pairs, and what the signatures estimate."""

import re
from collections import Counter

import numpy as np
import pytest

from partloom.llm import minhash
from partloom.llm.words import mix


def by_counts(x, y):
    """The probability Jaccard similarity by its definition."""
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in x if i in y)


def classes(docs, least=0.8, counted=False):
    """Identifier and text to the smallest identifier of its class, by all pairs of texts."""
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[d, t] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None
    keys = list(sets)
    up = {k: k for k in keys}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and (by_counts(x, y) >= least - 1e-9 if counted else len(x.keys() & y.keys()) >= least * len(x.keys() | y.keys())):
                up[find(a)] = find(b)
    small = {}
    for k in keys:
        small.setdefault(find(k), []).append(k[0])
    least_of = {r: min((i for i in ids if i is not None), default=None) for r, ids in small.items()}
    n_classes = len({find(k) for k in keys if sets[k]})
    return {k: least_of[find(k)] if sets[k] else k[0] for k in keys}, n_classes


@pytest.mark.parametrize("counted", [False, True])
@pytest.mark.parametrize("which", ["odd_docs", "some_docs"])
def test_against_all_pairs(which, counted, request):
    docs = request.getfixturevalue(which)
    if counted:
        docs = docs.where("coalesce(length(text), 0) < 20000")
    want, n_classes = classes([(r.doc_id, r.text) for r in docs.collect()], counted=counted)
    keyed = docs.select("doc_id", "text").collect()
    got = minhash.near_duplicates(docs, by_counts=counted).collect()
    assert sorted((str(d), str(want[d, t])) for d, t in keyed) == sorted((str(r.doc_id), str(r.class_id)) for r in got)
    kept = sum(r.kept for r in got)
    without = sum(1 for d, t in keyed if not (t or "").strip(" \t\n\r\x0b\x0c"))
    assert kept == n_classes + without


def test_open_pairs_are_found(spark):
    """Links that no centre sees: a chain of texts, each like the next alone."""
    w = [f"c{i}" for i in range(400)]
    texts = [" ".join(w[i * 18 : i * 18 + 180]) for i in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.class_id for r in minhash.near_duplicates(df).collect()} == {0}


@pytest.mark.parametrize("times", [2, 10, 100])
def test_repeated_lines_lose_no_link(spark, times):
    """Near copies (sets at 0.81) whose own lines are repeated, and a chain of them in shared buckets."""
    texts = []
    for k in range(12):
        shared = [f"s{k}x{i}" for i in range(260)]
        for own in "ab":
            texts.append(" ".join(shared + [f"{own}{k}x{i}" for i in range(26)] * times))
    core = [f"core{i}" for i in range(300)]
    block = [[f"u{j}x{i}" for i in range(26)] * times for j in range(13)]
    texts += [" ".join(core + block[j] + block[j + 1]) for j in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, _ = classes(list(enumerate(texts)))
    assert len(set(want.values())) == 13
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()} == {d: c for (d, _), c in want.items()}


def test_edits_in_repeated_lines(spark):
    """Texts of one line many times over, with a few words changed: alike by their
    counts, not as sets; and others that only share a line that each repeats a little."""
    line = [f"l{i}" for i in range(25)]
    texts = [" ".join(line * 40)]
    for k in range(6):
        w = line * 40
        for j in range(3):
            w[(k * 131 + j * 317) % 1000] = f"edit{k}x{j}"
        texts.append(" ".join(w))
    texts += [" ".join(line * 2 + [f"own{k}x{i}" for i in range(60)]) for k in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, _ = classes(list(enumerate(texts)), counted=True)
    assert set(want.values()) == {0, 7, 8, 9, 10}
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df, by_counts=True).collect()} == {d: c for (d, _), c in want.items()}
    assert len({r.class_id for r in minhash.near_duplicates(df).collect()}) == len(texts)


def test_probability_jaccard_by_definition():
    rng = np.random.default_rng(3)
    for _ in range(60):
        x = {int(k): int(rng.integers(1, 5)) for k in rng.choice(30, rng.integers(1, 20), replace=False)}
        y = {int(k): int(rng.integers(1, 5)) for k in rng.choice(30, rng.integers(1, 20), replace=False)}
        a, b = np.array(sorted(x)), np.array(sorted(y))
        got = minhash.probability_jaccard(a, np.array([x[k] for k in a]), b, np.array([y[k] for k in b]))
        assert got == pytest.approx(by_counts(x, y))
        ones = minhash.probability_jaccard(a, np.ones(len(a)), b, np.ones(len(b)))
        assert ones == pytest.approx(len(x.keys() & y.keys()) / len(x.keys() | y.keys()))


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9, 0.95])
def test_recall_by_similarity(spark, similarity):
    """Every one of many pairs of a similarity just above is linked."""
    n, texts = 200, []
    own = int(n * (1 - similarity) / (1 + similarity) / 2) * 2  # words that each has for itself
    for k in range(150):
        shared = [f"s{k}x{i}" for i in range(n + 4)]
        for side in "ab":
            texts.append(" ".join(shared + [f"{side}{k}x{i}" for i in range(own // 2)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    assert all(got[2 * k] == got[2 * k + 1] == 2 * k for k in range(150))


def test_parities_never_refuse_a_link():
    """The parities that differ are at most the shingles that only one set has."""
    for n, own in [(3, 1), (40, 4), (300, 30), (5000, 600)]:
        ids = mix(np.arange(n + 2 * own, dtype=np.uint64) + np.uint64(n))
        a, b = ids[: n + own], np.concatenate([ids[:n], ids[n + own :]])
        bits = minhash.parities(np.repeat([0, 1], n + own), np.concatenate([a, b]), 2)
        assert 0 < np.bitwise_count(bits[0] ^ bits[1]).sum() <= 2 * own


def test_empty_and_stage(no_docs, odd_docs):
    assert minhash.near_duplicates(no_docs).collect() == []
    kept = minhash.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert 0 < kept.count() < odd_docs.count()


def test_signatures_estimate_probability_jaccard():
    n = 300
    ids = mix(np.arange(2 * n, dtype=np.uint64))
    a, b = ids[:n], ids[60 : n + 60]
    wa, wb = np.ones(n), np.ones(n)
    row = np.repeat([0, 1], n)
    sig = minhash.prob_minhash(row, np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 389)
    assert abs((sig[0] == sig[1]).mean() - 240 / 360) < 0.1
    # weights: J_P of {x: 3, y: 1} and {x: 1, y: 1}
    w = np.concatenate([np.tile([3.0, 1.0], 100), np.tile([1.0, 1.0], 100)])
    e = mix(np.arange(200, dtype=np.uint64) + np.uint64(9000))
    sig = minhash.prob_minhash(np.repeat(np.arange(2), 200), np.concatenate([e, e]), w, 2, 389)
    # an x element's arrivals against all others' in either set: 1 / 200, a y element's 1 / 400
    assert abs((sig[0] == sig[1]).mean() - (100 / 200 + 100 / 400)) < 0.1
