"""Substring dedup against brute force."""

import hashlib
import re

import numpy as np
import pytest

from partloom.llm import substring
from partloom.llm.words import Bloom

LAST = (1 << 63) - 1


def brute(docs, size=20):
    first = {}
    split = [(LAST if d is None else d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for (d, w), (own, _) in zip(split, docs, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (d, i):
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((own, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("which", ["odd_docs", "some_docs", "no_docs"])
def test_against_brute_force(which, request):
    docs = request.getfixturevalue(which)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((tuple(r) for r in substring.dedup_substrings(docs).collect()), key=str) == want


def test_frequent_prefixes_and_full_filters(some_docs):
    """Every prefix a frequent one, and a filter so small that it lets all through."""
    from pyspark.sql import functions as F

    from partloom.llm.common import text_key

    rows = some_docs.select(F.col("doc_id").alias("doc"), text_key(F.col("text")).alias("tkey"), "text")
    spans = lambda **k: sorted((r.doc, sorted(i for lo, bits in r.spans for i in range(lo, lo + 31) if bits >> (i - lo) & 1)) for r in substring.repeats(rows, **k).collect())
    want = spans()
    assert want
    assert spans(group_words=4_000) == want
    assert spans(group_words=64) == want
    assert spans(most_bits=1 << 10) == want


def test_sizes(some_docs):
    for size in (6, 37):
        with pytest.raises(ValueError):
            substring.dedup_substrings(some_docs, size=size)
    want = brute([(r.doc_id, r.text) for r in some_docs.collect()], 7)
    assert sorted((tuple(r) for r in substring.dedup_substrings(some_docs, size=7).collect()), key=str) == want
    want = brute([(r.doc_id, r.text) for r in some_docs.collect()], 36)
    assert sorted((tuple(r) for r in substring.dedup_substrings(some_docs, size=36).collect()), key=str) == want


def test_with_text(spark):
    w = " ".join(f"t{i}" for i in range(30))
    df = spark.createDataFrame([(1, f"a {w}"), (2, f"{w} b")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in substring.dedup_substrings(df, with_text=True).collect()}
    assert got == {1: f"a {w}", 2: "b"}


def test_runs_of_equal_windows_agree():
    """Equal windows lie at the same place of their anchors, whatever stands around them."""
    rng = np.random.default_rng(1)
    common = rng.integers(0, 50, 40).astype(np.uint64)
    a = np.concatenate([rng.integers(0, 50, 17).astype(np.uint64), common])
    b = np.concatenate([rng.integers(0, 50, 5).astype(np.uint64), common, common])
    runs = substring.anchor_runs(np.concatenate([a, b]), np.array([len(a), len(b)]), 20)
    prefix = {}
    for row, start, n, p, at in zip(*runs, strict=True):
        assert at == start + (len(a) if row else 0)
        for i in range(start, start + n):
            words = tuple((b if row else a)[i : i + 20])
            assert prefix.setdefault(words, p) == p
    assert runs.n.sum() == len(a) + len(b) - 38
    assert len(prefix) < runs.n.sum() - 40


@pytest.mark.parametrize("size", [7, 8, 20, 23, 36])
def test_subtrees(size):
    """Suffixes in order, common prefixes and deep nodes against sorting tuples."""
    rng = np.random.default_rng(size)
    words = rng.integers(0, 3, 400).astype(np.uint32)
    words[200:300] = words[50:150]
    starts = rng.permutation(len(words) - size + 1)
    tree = substring.Subtree.of(words, starts, size)
    spelled = [tuple(words[s : s + size]) for s in starts[tree.order]]
    assert spelled == sorted(spelled)
    for x, y, n in zip(spelled, spelled[1:], tree.common[1:], strict=False):
        assert n == next((i for i in range(size) if x[i] != y[i]), size)
    node, heads = tree.nodes(size)
    assert len(heads) == len(set(spelled)) and [spelled[h] for h in heads] == sorted(set(spelled))
    assert all((x == y) == (m == n) for x, y, m, n in zip(spelled, spelled[1:], node, node[1:], strict=False))


def test_spans_by_their_words():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 4, 300).astype(np.uint64)
    lo, n = rng.integers(0, 200, 4000), rng.integers(1, 6, 4000)
    code = substring.span_codes(codes, lo, n)
    said = {}
    for c, i, k in zip(code, lo, n, strict=True):
        assert said.setdefault(c, tuple(codes[i : i + k])) == tuple(codes[i : i + k])
    assert len(said) == len({tuple(codes[i : i + k]) for i, k in zip(lo, n, strict=True)})


def test_bloom():
    codes = np.arange(1000, dtype=np.uint64) * np.uint64(7919)
    bloom = Bloom(Bloom.size(1000, 1 << 20))
    bloom.add(codes)
    assert bloom.has(codes).all()
    assert bloom.has(codes + np.uint64(1)).mean() < 0.05
