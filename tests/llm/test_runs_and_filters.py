"""Periodic runs and the filter audit against brute force."""

import random
import re
from fractions import Fraction
from itertools import permutations
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from partloom.llm import filter_audit, periodic

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(words, shortest=6, repeats=4):
    found = {}
    for p in range(1, len(words) // repeats + 1):
        start = None
        for i in range(len(words) - p + 1):
            same = i < len(words) - p and words[i] == words[i + p]
            if same and start is None:
                start = i
            elif not same and start is not None:
                if i - start + p >= max(shortest, repeats * p):
                    found.setdefault((start, i - start + p), p)
                start = None
    return sorted((s, n, p) for (s, n), p in found.items())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([2, 3, 4]), st.sampled_from([1, 6, 9]))
def test_runs_of_few_words(words, repeats, shortest):
    assert periodic.find_runs(np.array(words, np.int32), shortest, repeats) == slow_runs(words, shortest, repeats)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 12)), max_size=6))
def test_runs_of_repeated_blocks(blocks):
    words = [w for block, times in blocks for w in block * times]
    assert periodic.find_runs(np.array(words, np.int32)) == slow_runs(words)


def test_long_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(periodic, "_BLOCK", 500)
    rng = np.random.default_rng(3)
    unit = rng.integers(0, 1000, 700)
    words = np.concatenate([rng.integers(0, 1000, 900), np.tile(unit, 5), np.tile([1, 2], 400), np.full(600, 7), np.tile(np.repeat([3, 4], 5), 40)])
    assert periodic.find_runs(words) == slow_runs(words.tolist())


def test_one_word_alone():
    """Every period fits; only the first is looked at closely."""
    n = 200_000
    assert periodic.find_runs(np.zeros(n, np.int32)) == [(0, n, 1)]


@pytest.mark.parametrize("which", ["odd_docs", "some_docs"])
def test_periodic_documents(which, request):
    docs = request.getfixturevalue(which)
    key = F.xxhash64(F.col("text").isNull(), "text").alias("key")
    got = {(r.doc_id, r.key): r for r in periodic.periodic_runs(docs.select("*", key), keep=("doc_id", "key")).collect()}
    assert sum(1 for _ in docs.collect()) == periodic.periodic_runs(docs).count()
    n_with = 0
    for r in docs.select("doc_id", "text", key).collect():
        words = WORDS.findall(r.text or "")
        out = got[r.doc_id, r.key]
        runs = slow_runs(words) if len(words) < 5000 else [tuple(x) for x in out.runs]
        n_with += bool(runs)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert (out.n_words, out.n_runs, [tuple(x) for x in out.runs]) == (len(words), len(runs), runs)
        assert out.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert (out.best and tuple(out.best)) == best
    assert n_with or which == "some_docs"


def test_planted_runs(some_docs, odd_docs):
    for docs in (some_docs, odd_docs):
        was = {(str(r.doc_id), r.text) for r in docs.collect() if r.doc_id is None or crc32(str(r.doc_id).encode()) % 10 or not WORDS.findall(r.text or "")}
        now = periodic.plant_runs(docs).collect()
        assert len(now) == docs.count()
        assert not (was - {(str(r.doc_id), r.text) for r in now})
    texts = {r.doc_id: r.text for r in some_docs.collect()}
    planted = 0
    for r in periodic.plant_runs(some_docs).collect():
        h, words = crc32(str(r.doc_id).encode()), WORDS.findall(texts[r.doc_id])
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a, planted = g % n, planted + 1
            p = 1 + (n - a) // (3 + g % 8)
            assert WORDS.findall(r.text) == [words[i if i < a else a + (i - a) % p] for i in range(n)]
    assert planted


def test_periodic_empty(no_docs):
    assert periodic.periodic_runs(no_docs).collect() == []
    assert periodic.plant_runs(no_docs).collect() == []


def slow_audit(docs, labels):
    says = {}
    for i, q, t in labels:
        old = says.get(i, (0, 0))
        says[i] = (max(old[0], q or 0), max(old[1], t or 0))
    least = {}
    for d in docs:
        if d.doc_id is not None:
            least[d.text or ""] = min(least.get(d.text or "", d.doc_id), d.doc_id)
    rows = []
    for d in docs:
        text = d.text or ""
        words = WORDS.findall(text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text)}
        fails |= {"D": bool(re.search("[#$%&*|]", text)), "E": d.doc_id is not None and least[text] < d.doc_id}
        rows.append((d.source or "", {x for x in fails if fails[x]}, *(says.get(d.doc_id, (0, 0)) if d.doc_id is not None else (0, 0))))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, x in enumerate(order, 1):
                removed = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                fail = [r for r in rows if r[0] == part and x in r[1]]
                out[part, order, step] = [len(left), len(removed), sum(any(y in r[1] for y in order[: step - 1]) for r in fail), sum(len(r[1]) == 1 for r in fail), sum(r[2] for r in removed), sum(r[3] for r in removed)]
                shapley[part, x] = shapley.get((part, x), 0) + len(removed)
    return sorted((p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items())


@pytest.mark.parametrize("which", ["odd_docs", "some_docs"])
def test_audit(which, request, spark):
    docs = request.getfixturevalue(which)
    rng = random.Random(3)
    said = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 120, 2)] + [(4, 1, 0), (6, None, None), (None, 1, 1)]
    labels = spark.createDataFrame(said, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", *filter_audit.COUNTS, "shapley"]
    assert sorted(map(tuple, got.collect())) == slow_audit(docs.collect(), [x for x in said if x[0] is not None])


def test_audit_of_other_filters(some_docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(some_docs, labels, {"x": F.size("words") < 50, "y": F.length("text") < 500}, repeats=None, part_col="lang").collect()
    docs = some_docs.collect()
    x = {d.doc_id for d in docs if len(WORDS.findall(d.text)) < 50}
    y = {d.doc_id for d in docs if len(d.text) < 500}
    assert sorted((r.filter_order, r.step, r.removed, r.shapley) for r in got) == [
        ("xy", 1, len(x), len(x) + len(x - y)), ("xy", 2, len(y - x), len(y) + len(y - x)),
        ("yx", 1, len(y), len(y) + len(y - x)), ("yx", 2, len(x - y), len(x) + len(x - y)),
    ]


def test_audit_empty(no_docs, spark):
    assert filter_audit.audit(no_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
    with pytest.raises(ValueError):
        filter_audit.replay(no_docs, "ABCDEFGH")
