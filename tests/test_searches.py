"""Searches against brute force: full text, vectors, words, substrings, named parts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.operators import contains, feedback, fulltext, retrieval, vectors


@pytest.fixture(scope="module")
def nodes(spark):
    """Two labels; some words are in nearly every text, others in one."""
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [("A" if i % 3 else "B", f"n{i}", " ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 25)))) for i in range(500)]
    rows += [("A", "same1", "w0 w299"), ("A", "same2", "W0, w299!"), ("B", "empty", ""), ("B", "none", None)]
    return spark.createDataFrame(rows, "label string, id string, text string").cache()


def slow_bm25(rows, text, k):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = []
    for label in {r.label for r in rows}:
        own = [(r.id, words(r.text)) for r in rows if r.label == label]
        mean = sum(len(w) for _, w in own) / len(own)
        df = Counter(w for _, ws in own for w in set(ws))
        scores = []
        for i, ws in own:
            tf = Counter(ws)
            s = sum(math.log(1 + (len(own) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in set(words(text)) if tf[w])
            if s > 0:
                scores.append((-round(s, 6), i))
        out += [(label, i, round(-s, 6), rank) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("block, seeds", [(4096, 4096), (7, 3)])
def test_full_text(nodes, spark, block, seeds):
    index = fulltext.build_index(nodes, block=block)
    texts = ["w0 w1 w2", "w0 w299 w150", "w5", "nothing known", "", None, "w0 w0 w0", " ".join(f"w{i}" for i in range(0, 300, 7))]
    queries = spark.createDataFrame(list(enumerate(texts)), "query int, text string")
    got = fulltext.search(index, queries, 5, seeds=seeds).collect()
    rows = nodes.collect()
    want = {(q, *x) for q, text in enumerate(texts) for x in slow_bm25(rows, text, 5)}
    assert {(r.query, r.label, r.id, round(r.score, 6), r["rank"]) for r in got} == want
    one = fulltext.search(index, queries, 5, labels=["B"])
    assert one.select("label").distinct().collect()[0].label == "B"


def test_full_text_is_kept(nodes, spark, tmp_path):
    fulltext.build_index(nodes, path=f"{tmp_path}/index")
    queries = spark.createDataFrame([(1, "w0 w299")], "query int, text string")
    again = fulltext.search(fulltext.open_index(spark, f"{tmp_path}/index"), queries, 2, labels=["A"]).orderBy("rank").collect()
    assert [r.id for r in again] == ["same1", "same2"]
    nothing = fulltext.build_index(nodes.where("false"))
    assert fulltext.search(nothing, queries, 3).count() == 0


@pytest.fixture(scope="module")
def space(spark):
    """Vectors around some centres, of which one holds a third."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    own = np.where(rng.random(3000) < 0.33, 0, rng.integers(0, 30, 3000))
    x = centres[own] + 0.6 * rng.normal(size=(3000, 24))
    rows = [(i, v.tolist(), int(i % 7)) for i, v in enumerate(x)] + [(9000, None, 0)]
    return spark.createDataFrame(rows, "vec_id int, embedding array<float>, kind int").repartition(4).cache()


def test_vector_index(space, spark, tmp_path):
    """Recall with few lists, and all of the neighbours where exact ones are asked for."""
    queries = space.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")
    truth = retrieval.nearest_each(space, queries, 50).cache()
    index = vectors.build_vector_index(space, keep=["kind"], path=f"{tmp_path}/index")
    found = vectors.search_vectors(index, queries, 50, probes=14).cache()
    assert found.groupBy("query").count().where("count != 50").count() == 0
    assert vectors.recall(found, truth).agg(F.avg("recall")).first()[0] >= 0.9
    exact = vectors.search_vectors(vectors.open_vector_index(spark, f"{tmp_path}/index"), queries, 50, probes=4, exact=True)
    assert sorted(map(tuple, exact.select("query", "vec_id", "rank").collect())) == sorted(map(tuple, truth.select("query", "vec_id", "rank").collect()))
    some = retrieval.nearest_each(space.where("kind = 3"), queries, 20)
    filtered = vectors.search_vectors(index, queries, 20, probes=4, where=F.col("kind") == 3, exact=True)
    assert sorted(map(tuple, filtered.select("query", "vec_id", "rank").collect())) == sorted(map(tuple, some.select("query", "vec_id", "rank").collect()))
    none = vectors.search_vectors(index, queries.limit(1), 5, where=F.col("kind") == 99)
    assert none.count() == 0


def test_index_of_nothing(space):
    index = vectors.build_vector_index(space.where("false"))
    assert vectors.search_vectors(index, space.select(F.col("vec_id").alias("query"), "embedding").limit(3), 5).count() == 0


def test_cells_and_blocks(space):
    """However rows and queries are dealt, each pair meets once."""
    import pyarrow as pa

    rows, queries = space.select("vec_id"), space.where("vec_id < 40").select(F.col("vec_id").alias("query"))
    run = lambda r, q: pa.table({"n": pa.array([r.num_rows * q.num_rows], pa.int64())})
    for n_rows, n_queries in ((100, 7), (10_000, 10_000)):
        assert retrieval.gridded(rows, queries, run, "n long", row_id="vec_id", n_rows=n_rows, n_queries=n_queries).agg(F.sum("n")).first()[0] == 3001 * 40


def test_word_searches(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choices("abcdefghij", k=rng.randrange(0, 12)))) for i in range(120)] + [(500, None)]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    queries = df.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query"), "text")
    got = {(r["query"], r.doc_id, r.score) for r in retrieval.jaccard_each(df, queries, 7).collect()}
    want, sets = set(), {i: set((t or "").split()) for i, t in docs}
    for q in range(0, 120, 20):
        scored = [(-math.floor(len(sets[q] & s) / len(sets[q] | s) * 1e6 + 0.5) / 1e6, i) for i, s in sets.items() if sets[q] & s]
        want |= {(q, i, -s) for s, i in sorted(scored)[:7]}
    assert got == want
    words = retrieval.weighed_words(df)
    sparse = retrieval.sparse_each(words, words.withColumnRenamed("doc_id", "query"), 3).collect()
    counts = {i: Counter((t or "").split()) for i, t in docs}
    for r in sparse:
        a, b = counts[r["query"]], counts[r.doc_id]
        assert abs(r.score - sum((1 + math.log(a[w])) * (1 + math.log(b[w])) for w in a if b[w])) < 1e-5


def test_sparse_search_skips_what_norms_rule_out(spark, monkeypatch):
    """Long documents first, then only what may reach the k-th best of them; rows of one identifier are one document."""
    import pyarrow as pa

    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices(["b", "ring", "c3", "d", "e"] + [f"w{j}" for j in range(30)], k=rng.choice([1, 2, 5, 80])))) for i in range(300)] + [(7, "ring RING b"), (400, None), (401, "..")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    words = retrieval.weighed_words(df)
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan  # texts are shuffled, not their words
    counts = {}
    for i, t in docs:
        counts.setdefault(i, Counter()).update(re.findall("[a-z0-9]+", (t or "").lower()))
    assert {r.doc_id: {w: round(x, 9) for w, x in zip(r.words, r.weights, strict=True)} for r in words.collect()} == {i: {w: round(1 + math.log(n), 9) for w, n in c.items()} for i, c in counts.items() if c}
    monkeypatch.setattr(retrieval, "HEADS", 20)
    got = {(r["query"], r["rank"]): (r.doc_id, round(r.score, 6)) for r in retrieval.sparse_each(words, words.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query"), 5).collect()}
    want = {}
    for q in range(0, 300, 20):
        score = {i: math.floor(sum((1 + math.log(n)) * (1 + math.log(c[w])) for w, n in counts[q].items() if c[w]) * 1e6 + 0.5) / 1e6 for i, c in counts.items()}
        want |= {(q, k + 1): (i, round(score[i], 6)) for k, i in enumerate(sorted((i for i in score if score[i] > 0), key=lambda i: (-score[i], i))[:5])}
    assert got == want
    # a row whose norm, here a false one, rules it out isn't looked at
    lists = lambda x, t: pa.array(x, pa.list_(t))
    rows = pa.table({"doc_id": [1, 2, 3, 4], "words": lists([[5], [5], [5, 6], [6]], pa.int64()), "weights": lists([[9.0], [8.0], [99.0, 1.0], [1.0]], pa.float64()), "norm": [9.0, 8.0, 0.5, 0.4]})
    asked = pa.table({"query": [70], "words": lists([[5]], pa.int64()), "weights": lists([[2.0]], pa.float64()), "norm": [2.0], "least": [0.0]})
    found = retrieval.largest_in(rows, asked, 2, "doc_id", chunk=2)
    assert (found["doc_id"].to_pylist(), found["score"].to_pylist()) == ([1, 2], [-18.0, -16.0])


def test_substrings(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abC가_%") for _ in range(n))
    texts = [text(rng.randrange(0, 12)) for _ in range(150)] + [None, ""]
    patterns = [text(rng.randrange(0, 5)) for _ in range(120)] + [None, ""]
    t, p = spark.createDataFrame([(x,) for x in texts], "t string"), spark.createDataFrame([(x,) for x in patterns], "p string")
    for any_case in (False, True):
        low = (lambda s: s.lower()) if any_case else (lambda s: s)
        want = {(x, y) for x in texts if x is not None for y in patterns if y and low(y) in low(x)}
        got = [tuple(r) for r in contains.holding(t, p, "t", "p", any_case=any_case).collect()]
        assert set(got) == want and len(got) == len(want)
    like = lambda y: re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in y), re.I | re.S)
    want = {(x, y) for x in texts if x is not None for y in patterns if y is not None and like(y).fullmatch(x)}
    got = [tuple(r) for r in contains.matching(t, p, "t", "p").collect()]
    assert set(got) == want and len(got) == len(want)
    assert contains.holding(t, p.where("false"), "t", "p").count() == 0
    assert contains.holding(t.where("false"), p, "t", "p").count() == 0


def test_named_parts(spark):
    parts = spark.createDataFrame([("AEC12345678", "Motor Assy", 1), ("EAD66035701", "Camera Module", 1), ("X1", "Door, inner", 2), (None, None, 2)], "number string, name string, s int")
    texts = ["swap aec12345678 and the camera", "swap AEC-1234-5678", "xAEC12345678y", "the ASSY for it", "doors", "", None]
    df = spark.createDataFrame([(i, t, 1 + i // 4) for i, t in enumerate(texts)], "text_id int, text string, s int")
    got = {tuple(r) for r in feedback.named_parts(df, parts).collect()}
    assert got == {(0, "AEC12345678", "part_no"), (0, "EAD66035701", "part_name"), (1, "AEC12345678", "part_no"), (2, "AEC12345678", "part_no"), (4, "X1", "part_name")}
    scoped = {tuple(r) for r in feedback.named_parts(df, parts, scope="s").collect()}
    assert scoped == got
    assert {tuple(r) for r in feedback.named_parts(df.withColumn("s", F.lit(2)), parts, scope="s").collect()} == {(4, "X1", "part_name")}


def test_word_searches_shuffle_little(spark):
    """Tables are dealt out in few cells and blocks; any cut gives the same."""
    import pyarrow as pa

    assert retrieval.WORD_ROWS >= 32_768 and retrieval.WORD_QUERIES >= 16_384
    rng = np.random.default_rng(3)
    sets = [rng.choice(40, rng.integers(1, 9), replace=False) for _ in range(90)]
    table = pa.table({"words": pa.array([s.tolist() for s in sets], pa.list_(pa.int64())), "weights": pa.array([(s * 0.5).tolist() for s in sets], pa.list_(pa.float64()))})
    dense = np.zeros((90, 40))
    for i, s in enumerate(sets):
        dense[i, s] = s * 0.5
    for at_once in (50, 1 << 22):  # also fewer sums than one query has
        got = np.concatenate([x for _, x in retrieval._products(table, table.slice(0, 30), at_once)])
        assert np.allclose(got, dense[:30] @ dense.T)


def test_best_rows_come_without_pairs(spark):
    import inspect

    from partloom.operators import match

    left = spark.createDataFrame([(1, "a b c d"), (2, "x y"), (3, None), (4, "a b z")], "item int, text string")
    right = spark.createDataFrame([(9, "d c b"), (7, "B c d e"), (8, "a b"), (5, None)], "doc long, text string")
    got = match.best_by_tokens(left, right, left_id="item", right_id="doc", least=2)
    assert sorted(map(tuple, got.collect())) == [(1, 7, 3), (4, 8, 2)]
    assert "distinct" not in inspect.getsource(match.best_by_tokens)  # no table of pairs
