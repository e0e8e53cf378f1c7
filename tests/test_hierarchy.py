"""Hierarchies against plain simulations of their rules."""

import random

from pyspark.sql import functions as F

from partloom.operators import hierarchy as h


def random_rows(seed, docs=40):
    r = random.Random(seed)
    return [(f"d{d}", i, r.randint(1, 6), r.random() < 0.2) for d in range(docs) for i in range(r.randint(1, 25))]


def by_stack(levels):
    stack, out = [], []
    for i, level in enumerate(levels):
        while len(stack) >= level:
            stack.pop()
        out.append((len(stack) + 1, stack[-1] if stack else None, stack[::-1]))
        stack.append(i)
    return out


def by_level(levels):
    return [max((j for j in range(i) if levels[j] < x), default=None) for i, x in enumerate(levels)]


def docs_of(rows):
    out = {}
    for d, _, level, changed in rows:
        out.setdefault(d, []).append((level, changed))
    return out


def test_both_parents(spark):
    rows = random_rows(1)
    df = spark.createDataFrame(rows, "doc string, row_no int, level int, changed boolean")
    stack = {(r.doc, r.row_no): (r.depth, r.parent, r.ancestors) for r in h.ancestors_by_stack(df).collect()}
    level = {(r.doc, r.row_no): r.parent for r in h.parent_by_level(df).collect()}
    differ = 0
    for d, xs in docs_of(rows).items():
        levels = [x for x, _ in xs]
        for i, (a, b) in enumerate(zip(by_stack(levels), by_level(levels), strict=True)):
            assert stack[d, i] == a
            assert level[d, i] == b
            differ += a[1] != b
    assert differ  # the two readings aren't one


def test_level_jumps(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([1, 3, 5, 3])], "doc string, row_no int, level int")
    assert [r.parent for r in h.ancestors_by_stack(df).orderBy("row_no").collect()] == [None, 0, 1, 1]
    assert [r.parent for r in h.parent_by_level(df).orderBy("row_no").collect()] == [None, 0, 1, 0]


def test_any_depth(spark):
    """Levels up to 60, beyond 64, negative ones and chains of 150 against the plain rules."""
    r = random.Random(3)
    sheets = [[r.randint(1, 60) for _ in range(80)] for _ in range(6)] + [[r.randint(-3, 200) for _ in range(80)] for _ in range(4)] + [list(range(1, 151))]
    for part in (sheets[:6], sheets[6:10], sheets[10:]):
        rows = [(f"d{d}", i, x, i % 9 == 4) for d, xs in enumerate(part) for i, x in enumerate(xs)]
        df = spark.createDataFrame(rows, "doc string, row_no int, level int, changed boolean")
        parent = {(x.doc, x.row_no): x.parent for x in h.parent_by_level(df).collect()}
        end = {(x.doc, x.row_no): x.subtree_end for x in h.subtree_end(df).collect()}
        touched = {(x.doc, x.row_no): x.touched for x in h.propagate(df, "changed").collect()}
        for d, xs in enumerate(part):
            for i, want in enumerate(by_level(xs)):
                assert parent[f"d{d}", i] == want
                last = next((j for j in range(i + 1, len(xs)) if xs[j] <= xs[i]), None)
                assert end[f"d{d}", i] == last
                assert touched[f"d{d}", i] == any(j % 9 == 4 for j in range(i, len(xs) if last is None else last))
        if min(min(xs) for xs in part) > 0:
            stack = {(x.doc, x.row_no): (x.depth, x.parent, x.ancestors) for x in h.ancestors_by_stack(df).collect()}
            for d, xs in enumerate(part):
                assert [stack[f"d{d}", i] for i in range(len(xs))] == by_stack(xs)


def test_propagation(spark):
    rows = random_rows(2)
    df = spark.createDataFrame(rows, "doc string, row_no int, level int, changed boolean")
    got = {(r.doc, r.row_no): r.touched for r in h.propagate(df, "changed").collect()}
    for d, xs in docs_of(rows).items():
        parents, touched = by_level([x for x, _ in xs]), [c for _, c in xs]
        for i in sorted(range(len(xs)), key=lambda i: -xs[i][0]):
            if touched[i] and parents[i] is not None:
                touched[parents[i]] = True
        assert [got[d, i] for i in range(len(xs))] == touched


def test_walk_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {(r.reached, r.distance) for r in h.walk(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_walk_has_no_depth_limit(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(130)], "src int, dst int").coalesce(1)
    start = spark.createDataFrame([(0,)], "node int")
    got = {(r.reached, r.distance) for r in h.walk(edges, start).collect()}
    assert got == {(i, i) for i in range(131)}
    assert h.walk(edges, start, max_depth=3).count() == 4


def test_jumps_double(spark):
    """A chain of 5,000 steps takes 14 rounds."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(5000)], "src int, dst int").coalesce(1)
    jumps = h.Jumps(edges)
    got = jumps.follow(spark.createDataFrame([(0, 0, 0)], "node int, reached int, distance int"))
    assert {(r.reached, r.distance) for r in got.collect()} == {(i, i) for i in range(5001)}
    assert len(jumps.tables) <= 15


def test_walk_over_forks_and_cycles(spark):
    """Against a search step by step: stretches, forks, ways of different length, cycles."""
    import random

    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(60)] + [(60, 30), (10, 70), (70, 71), (71, 40), (5, 90), (90, 5)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(6)]
    to = {}
    for a, b in pairs:
        to.setdefault(a, set()).add(b)
    want = set()
    for s in (0, 35, 200):
        seen, level, d = {s}, {s}, 0
        while level:
            want |= {(s, x, d) for x in level}
            level = {y for x in level for y in to.get(x, ())} - seen
            seen |= level
            d += 1
    start = spark.createDataFrame([(0,), (35,), (200,)], "node int")
    got = h.walk(spark.createDataFrame(pairs, "src int, dst int").coalesce(1), start)
    assert {tuple(r) for r in got.collect()} == want


def test_chain_ends(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 9), (9, 8)], "src int, dst int").coalesce(1)
    got = {tuple(r) for r in h.chain_ends(edges).collect()}
    assert got == {(1, 3, 2, False), (2, 3, 1, False), (3, 3, 0, False), (7, None, None, True), (8, None, None, True), (9, None, None, True)}
    assert h.chain_ends(edges.where("false")).count() == 0


def test_nested_values(spark):
    import json

    rows = spark.createDataFrame([("d", 1, 1, 'a "x"'), ("d", 2, 2, "b"), ("d", 3, 5, None), ("d", 4, 1, "c"), ("e", 1, 3, "alone")], "doc string, row_no int, level int, name string")
    got = {r.doc: json.loads(r.json) for r in h.nested_tree(h.ancestors_by_stack(rows), ["name"]).collect()}
    leaf = lambda n: {"name": n, "children": []}
    assert got["d"] == [{"name": 'a "x"', "children": [{"name": "b", "children": [leaf(None)]}]}, leaf("c")]
    assert got["e"] == [leaf("alone")]
    paths = spark.createDataFrame([("g", 1, "b > c"), ("g", 2, "a"), ("g", 3, "b > d > e"), ("g", 4, " b > c > z "), ("g", 5, ""), ("g", 6, None)], "doc string, ord int, path string")
    tree = h.tree_of_paths(paths).collect()
    assert [(r.doc, json.loads(r.json)) for r in tree] == [("g", {"b": {"c": {"z": {}}, "d": {"e": {}}}, "a": {}})]
    assert list(json.loads(tree[0].json)) == ["b", "a"]
    assert h.nested_tree(h.ancestors_by_stack(rows.where("false")), ["name"]).count() == 0


def test_row_numbers(spark):
    from partloom.operators.ordering import row_numbers

    df = spark.range(0, 1000, 3).repartition(7)
    got = row_numbers(df, "id").collect()
    assert {r.number: r.id for r in got} == {i + 1: 3 * i for i in range(334)}
    assert row_numbers(df.where("false"), "id").count() == 0


def test_paths_are_cut(spark):
    df = spark.createDataFrame([("a", 0, 1, "long name"), ("a", 1, 2, "part")], "doc string, row_no int, level int, name string")
    got = h.paths(h.ancestors_by_stack(df), "name", width=4).orderBy("row_no").collect()
    assert [r.bom_path for r in got] == ["long", "long > part"]


def test_empty(spark):
    df = spark.createDataFrame([], "doc string, row_no int, level int")
    assert h.ancestors_by_stack(df).count() == 0
    assert h.closure(h.ancestors_by_stack(df)).withColumn("x", F.lit(1)).count() == 0


def test_no_frame_is_summed_up_for_each_row(spark, capsys):
    for levels in (6, 70):  # few and many
        rows = spark.range(500).selectExpr("id % 3 AS doc", "id AS row_no", f"CAST(id * 31 % {levels} AS INT) AS level", "id % 13 = 0 AS changed")
        h.propagate(rows, "changed").explain()
        assert "unboundedfollowing" not in capsys.readouterr().out.replace(" ", "").lower().replace("rowframe,unboundedpreceding$(),unboundedfollowing$()", "")
