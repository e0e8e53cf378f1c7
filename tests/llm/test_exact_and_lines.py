"""Exact dedup and line dedup against brute force."""

import hashlib
import re
from collections import defaultdict

import pyarrow as pa
import pytest

from partloom.llm import exact, line_dedup


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("which", ["odd_docs", "some_docs"])
@pytest.mark.parametrize("bits", [1, 3])
def test_exact(which, bits, request):
    docs = request.getfixturevalue(which)
    groups = defaultdict(list)
    for r in docs.collect():
        groups[norm(r.text)].append(r.doc_id)
    got = exact.exact_dedup(docs, bits=bits).collect()
    assert len(got) == docs.count()
    kept = defaultdict(int)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_hash[r.text_sha256]
        assert r.keep_id == min((i for i in ids if i is not None), default=None)
        assert r.group_size == len(ids)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_merges_of_runs():
    """Several sorted runs become one, equal digests one entry with the least identifier;
    digests that collide but for the second hash or the length stay apart."""
    import random

    rng = random.Random(1)
    runs, want = [], defaultdict(list)
    for r in range(5):
        entries = []
        for i in range(40):
            key = (bytes([rng.randrange(4)]) * 32, rng.randrange(2), rng.randrange(2))
            entries.append((*key, int(rng.random() < 0.2), rng.randrange(9), r * 100 + i, rng.randint(1, 3)))
            want[key].append(entries[-1])
        runs.append(exact.folded(sorted(entries)))
    batches = [pa.RecordBatch.from_arrays(exact._block(r, 7, e), ["run", "shard", *exact._CELLS]) for r, e in enumerate(runs)]
    got = exact.merged(pa.Table.from_batches(batches)).to_pylist()[0]
    assert list(zip(*(got[c] for c in exact._CELLS), strict=True)) == [(*min(want[k])[:-1], sum(e[-1] for e in want[k])) for k in sorted(want)]


def test_exact_empty(no_docs):
    assert exact.exact_dedup(no_docs).collect() == []


def cut_lines(docs, size=3):
    """(id, text) -> kept text; first by (id with null last, text hash, place)."""
    seen = defaultdict(set)
    for d, t, k in docs:
        if t is not None:
            lines = t.split("\n")
            for i in range(len(lines) - size + 1):
                w = "\n".join(lines[i : i + size])
                if w.strip():
                    seen[w].add((d is None, d or 0, k, i))
    out = {}
    for d, t, k in docs:
        if t is None:
            out[d, t] = None
            continue
        lines, gone = t.split("\n"), set()
        for i in range(len(lines) - size + 1):
            w = "\n".join(lines[i : i + size])
            if w.strip() and min(seen[w]) < (d is None, d or 0, k, i):
                gone.update(range(i, i + size))
        out[d, t] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


@pytest.mark.parametrize("which", ["odd_docs", "some_docs"])
def test_lines(which, request):
    from pyspark.sql import functions as F

    from partloom.llm.common import text_key

    docs = request.getfixturevalue(which)
    keyed = [(r.doc_id, r.text, r.k) for r in docs.select("doc_id", "text", text_key(F.col("text")).alias("k")).collect()]
    want = sorted((str(d), str(cut_lines(keyed)[d, t])) for d, t, _ in keyed)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == want


def test_lines_null_and_empty(spark, no_docs):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a\nb\nc"), (4, "a\nb\nc")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: (None, 0, 0), 2: ("", 1, 0), 3: ("a\nb\nc", 3, 0), 4: ("", 3, 3)}
    assert line_dedup.dedup_lines(no_docs).collect() == []
