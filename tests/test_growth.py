"""What large tables showed: work that grows faster than its input, and a rule that small tables didn't reach."""

import os

import pytest
from helpers import SF, against_duckdb

from partloom import session
from partloom.operators import contains, fulltext
from partloom.sources import committed, rewrite


@pytest.fixture
def tables(tmp_path):
    """A folder that has sf0.001's tables, and others where a test writes them."""
    for file in os.listdir(SF):
        os.symlink(f"{SF}/{file}", tmp_path / file)

    def put(name, df):
        path = tmp_path / f"{name}.parquet"
        path.unlink()
        df.toPandas().to_parquet(path)

    put.folder = str(tmp_path)
    return put


def test_rewritten_cells_of_long_workbooks(spark, tables):
    import __spark_entry__

    part = spark.read.parquet(f"{SF}/part.parquet")
    tables("part", part.unionByName(part.withColumn("p_partkey", part["p_partkey"] + 1_000_000)))
    name = "workbook_rewrite"  # a change a million rows on is in a row that is there
    against_duckdb(__spark_entry__.queries()[name](spark, tables.folder), __spark_entry__.oracle_sql()[name], tables.folder)


def test_a_rewrite_looks_at_changes_once():
    class Counted(dict):
        looks = 0

        def __iter__(self):
            Counted.looks += 1
            return super().__iter__()

    out = []
    sheet = rewrite._Sheet({(r, 1): f"new{r}" for r in range(1, 900, 2)}, [], out.append)
    sheet.rows = Counted(sheet.rows)
    rows = "".join(f'<row r="{r}"><c r="A{r}"><v>{r}</v></c></row>' for r in range(1, 600, 3))
    sheet.feed(f"<worksheet><sheetData>{rows}</sheetData></worksheet>".encode(), True)
    assert sheet.n == 450 and b"".join(out).count(b"<row ") == len(set(range(1, 900, 2)) | set(range(1, 600, 3)))
    assert Counted.looks < 10


def test_loads_write_no_folder_for_each_file(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(3000).selectExpr("CAST(id % 1000 AS STRING) AS file", "id AS v").repartition(3)
    for _ in range(2):
        committed.load_files(rows, path, {"last": rows["v"] != 2999})
    assert sum(len(names) for _, _, names in os.walk(f"{path}/rows")) < 50
    got = committed.loaded_rows(spark, path, "v long")
    assert (got.count(), got.where("file = '999'").count()) == (2997, 0)
    log = committed.load_log(spark, path).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in log} == {"completed": 999, "loaded before": 999, "failed": 2}
    os.rename(f"{path}/log", f"{path}/lost")  # a load that broke off before its log
    assert committed.loaded_rows(spark, path, "v long").isEmpty()


def test_equal_nodes_and_queries_meet_once(spark, monkeypatch):
    """Neither the pairs of equal nodes and equal queries nor their candidates are put down."""
    kept = []

    def counted(df, *args, **kw):
        out = session.checkpointed(df, *args, **kw)
        kept.append(out.count())
        return out

    nodes = spark.createDataFrame([("A", f"n{i:03}", f"red bolt own{i}" if i % 2 else "hot ring") for i in range(800)], "label string, id string, text string")
    index = fulltext.build_index(nodes)
    queries = spark.createDataFrame([(i, f"red bolt own{i}") for i in range(400)], "query int, text string")
    monkeypatch.setattr(fulltext, "checkpointed", counted)
    got = fulltext.search(index, queries, 3).orderBy("query", "rank").collect()
    assert max(kept) < 3000
    firsts = ["n001", "n003", "n005"]
    for q in (0, 9):
        own = f"n{q:03}"
        want = [own, *[x for x in firsts if x != own]][:3] if q % 2 else firsts
        assert [r["id"] for r in got if r["query"] == q] == want


def test_patterns_are_looked_up_by_long_or_rare_pieces(spark, monkeypatch):
    """Frequent beginnings of numbers and frequent words don't make each pattern meet all texts."""
    kept = []

    def counted(df, *args, **kw):
        out = session.checkpointed(df, *args, **kw)
        kept.append([r.asDict() for r in out.collect()])
        return out

    monkeypatch.setattr(contains, "checkpointed", counted)
    texts = spark.range(1000, 1400).selectExpr("concat('AEC0000', id, ' plate') AS t", "concat('0000', id) AS p", "concat('%', id, '%PLATE%') AS l")
    for find, pattern in ((contains.holding, "p"), (contains.matching, "l")):
        assert find(texts, texts, "t", pattern).count() == 400
        keys = [r["piece"] for r in kept[-1]]
        assert len(set(keys)) == 400 and all(sum(k in f"aec0000{i} plate" for i in range(1000, 1400)) == 1 for k in keys[:5])


def test_second_looks_of_equal_rows_meet_once(spark):
    """Links between classes, expanded, are all pairs; a number from two sources tells rows apart."""
    from partloom.operators import proposals

    rows = [(i, "A", f"P{i % 90}", f"w{i % 3} x", f".{i % 2}", "CORE", "ADD", f"d{i % 4}" if i % 7 else "") for i in range(200)]
    parts = spark.createDataFrame(rows, "pid int, l1 string, part_no string, name string, level string, tier string, action string, source_doc string")
    asked = parts.where("pid % 5 = 0").withColumnRenamed("pid", "query")
    links, requests, members = proposals.recheck_classes(parts, asked)
    got = [tuple(r) for r in links.join(requests, "request").join(members, "part").select("query", "pid", "score").collect()]
    want = {}
    for a in rows[::5]:
        for p in rows:
            if p[2] != a[2] and (not p[7] or not a[7] or p[7] != a[7]):
                want[a[0], p[0]] = 10 * len({*p[3].split()} & {*a[3].split()}) + 5 * (p[4] == a[4]) + 5
    assert len(got) == len(want) and {(q, p): s for q, p, s in got} == want
    best = [tuple(r) for r in proposals.best_rechecks(parts, asked, 8).collect()]
    ranked = {q: sorted((-s, p) for (x, p), s in want.items() if x == q)[:8] for q in range(0, 200, 5)}
    assert sorted(best) == sorted((q, p, -s) for q, some in ranked.items() for s, p in some)
    copies = parts.where("pid % 90 = 1 AND pid % 4 = 1").crossJoin(spark.range(50)).selectExpr("CAST(1000 + id AS INT) AS pid", "l1", "concat('Q', id) AS part_no", "name", "level", "tier", "action", "source_doc")
    links, _, _ = proposals.recheck_classes(copies.unionByName(copies.selectExpr("pid + 500 AS pid", "l1", "concat('R', pid) AS part_no", "name", "level", "tier", "action", "'d9' AS source_doc")), copies.withColumnRenamed("pid", "query"))
    assert links.count() == 1


def test_named_parts_of_equal_names_meet_once(spark):
    from partloom.operators import feedback

    parts = spark.createDataFrame([(f"AEC{i:08}", ["red bolt", "bolt, red", "hot ring"][i % 3]) for i in range(300)], "number string, name string")
    texts = spark.createDataFrame([(i, "a red one" if i % 2 else f"ring aec-{i:08}") for i in range(100)], "text_id int, text string")
    numbers, links, own, members = feedback.named_classes(texts, parts)
    assert (numbers.count(), links.count(), own.count(), members.count()) == (50, 51, 100, 300)
    got = feedback.named_parts(texts, parts).groupBy("way").count().collect()
    overlap = sum(i % 3 == 2 for i in range(0, 100, 2))  # named by both ways: the number counts
    assert {r["way"]: r["count"] for r in got} == {"part_no": 50, "part_name": 50 * 200 + 50 * 100 - overlap}


def _computed(df, column):
    """How often a plan's projection names a column, and whether a lambda does, which would compute it for each element."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]
    return plan.count(f"{column}#"), any(f"{column}#" in x.split("lambda")[0] for x in plan.split("lambdafunction(")[1:])


def test_rules_compute_their_text_once(spark):
    from pyspark.sql import functions as F

    from partloom.functions import text
    from partloom.operators import classify

    cells = spark.createDataFrame([(" LED 추가 ", "b", "c")], "said string, what string, why string").repartition(1)
    said, what, why = F.col("said"), F.col("what"), F.col("why")
    for rule in (classify.user_intent(said), classify.guess_change(said), classify.feature(said), classify.graph_classification(said), text.product_type(said), text.clean(said), text.contains_any(F.upper(said), ["A", "B"])):
        assert _computed(cells.select(rule.alias("x")), "said") == (1, False)
    assert _computed(cells.select(classify.domain(said, what, why).alias("x")), "why") == (1, False)
    got = cells.select(text.contains_any(said, [r"a\Eb", "추가"]), text.contains_any(said, []), text.contains_any(F.lit(None).cast("string"), ["a"])).head()
    assert tuple(got) == (True, False, None)


def test_display_folds_without_patterns(spark):
    """Ranks and buckets are told of each row before rows are folded."""
    from partloom.operators import proposals

    columns = ["group_no", "ord", "l1", "number", "name", "kind", "action", "level", "tier", "remark", "source", "reason"]
    rows = [(1, 1, "L", "(채번 필요)", "n", "k", "추가", "..2", "cascade", "see", "d1", ""), (1, 2, "L", "", "N ", "k", "modify", "..2", "CORE ", "", "d1", "r"), (1, 3, "L", "TBD", "n", "k", "check", "..2", "core", "참고 1", "d2", "r2"), (2, 4, "L", "", "n", "k", "추가", "..2", "", "", "", "")]
    out = proposals.display_table(spark.createDataFrame(rows, columns))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, "L", "TBD", "n", "k", "변경", "..2", "core", "참고 1 | see", "d2 | d1", "r2", 3), (2, 4, "L", "", "n", "k", "추가", "..2", "", "", "", "", 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    folds = [line for line in plan.split("\n") if "aggregate(" in line]
    assert folds and not any("regexp_replace" in line.split("aggregate(")[1].split(" AS ")[0] for line in folds)


def test_searches_hold_bounded_pairs(spark, monkeypatch):
    """What comes out of a cell and a block at once, and how many of them a task sorts, is bounded."""
    from partloom.operators import retrieval

    asked = []
    gridded = retrieval.gridded

    def noted(*args, **kw):
        asked.append((args[3], kw.get("n_rows", 8192) * kw.get("n_queries", 2048)))
        return gridded(*args, **kw)

    monkeypatch.setattr(retrieval, "gridded", noted)
    monkeypatch.setattr(retrieval, "GROUPS", 1)
    rows = spark.range(600).selectExpr("id AS vec_id", "array(CAST(id % 7 AS FLOAT), CAST(1 AS FLOAT)) AS embedding")
    queries = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query")
    got = retrieval.above_each(rows, queries, enough=22, cuts=(0.9, 0.5, 0.1))
    assert [n for schema, n in asked if "score" in schema] and all(n <= 1 << 21 for schema, n in asked if "score" in schema)
    assert got.count() > 30 * 22
    near = retrieval.nearest_each(rows, queries, 5)
    monkeypatch.setattr(retrieval, "GROUPS", 1000)
    usual = retrieval.nearest_each(rows, queries, 5)
    assert "REPARTITION_BY_NUM" not in usual._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(retrieval, "GROUPS", 1)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        many = retrieval.nearest_each(rows, queries, 5)
        assert "REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, many.collect())) == sorted(map(tuple, near.collect())) == sorted(map(tuple, usual.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_backfill_encodes_a_text_once(spark, tables):
    """Both heads of a document come from one pass over Arrow columns."""
    import __spark_entry__

    df = __spark_entry__.queries()["encoder_backfill"](spark, tables.folder)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "MapInPandas" not in plan


def test_chains_are_followed_in_ranges_first(spark, monkeypatch):
    """Pointers double over the nodes alone that other ranges lead to; chains across ranges, rings and ends come out."""
    from partloom.operators import hierarchy

    put = []

    def counted(df, *args, **kw):
        out = session.checkpointed(df, *args, **kw)
        put.append(out.count())
        return out

    monkeypatch.setattr(hierarchy, "checkpointed", counted)
    ways = {i: i + 1 for i in range(4000) if i % 1000 != 999} | {1999: 1500, 2999: 10, 5000: 3, 5001: 5001, 5002: 3999, 6000: 6001, 6001: 6000}
    edges = spark.createDataFrame([*ways.items(), (5, 700), (7000, None)], "src long, dst long").repartition(3)
    got = {r["node"]: (r["last"], r["length"], r["cyclic"]) for r in hierarchy.chain_ends(edges).collect()}
    want = {}
    for node in {*ways, *ways.values(), 7000}:
        at, steps = node, 0
        while at in ways and steps <= len(ways):
            at, steps = ways[at], steps + 1
        want[node] = (None, None, True) if at in ways else (at, steps, False)
    assert got == want
    assert sum(n < 50 for n in put) >= len(put) - 2 and len(put) < 12
    names = edges.selectExpr("concat('n', src) AS src", "concat('n', dst) AS dst")
    got = {r["node"]: (r["last"], r["length"], r["cyclic"]) for r in hierarchy.chain_ends(names.where("src <> 'n5'").unionByName(names.where("src = 'n5' AND dst = 'n6'"))).collect()}
    assert got == {f"n{k}": (last and f"n{last}" if last != 0 else "n0", n, c) for k, (last, n, c) in want.items()}


def test_lines_are_classified_once(spark):
    """Sets of kept lines are looked up in a table, not in rules that are computed again for each look."""
    from partloom.operators import engine

    lines = spark.createDataFrame([(i, "d", "l", "A1", f"B{i}", "n", "c", "카메라" if i % 2 else "r", "..2", "1") for i in range(20)], "ord int, doc string, l1 string, base_no string, new_no string, name string, chg string, rsn string, level string, qty string")
    out = engine.changed_parts(lines, core=["카메라"], target=["도어"])
    assert "카메라" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 20


def test_texts_of_lines_need_no_tree(spark):
    """A full-text search over lines isn't bound to one task for each document."""
    from pyspark.sql import functions as F

    from partloom.operators import graph
    from partloom.plans.bom import bom_rows

    rows = bom_rows(spark, "/root/testdata/sf0.001").withColumn("level", F.when(F.col("row_no") % 9 != 0, F.col("level")))  # some have none
    texts, lines = graph.line_texts(rows), graph.lines(rows)
    assert "Window" not in texts._jdf.queryExecution().executedPlan().toString()
    columns = ["line_id", "doc", "row_no", "kind", "effective_no", "search_text"]
    got = {tuple(r) for r in texts.select(columns).collect()}
    assert got == {tuple(r) for r in lines.select(columns).collect()} and len(got) == texts.count() > 0


def test_walks_jump_between_ranges_only(spark, monkeypatch):
    """Chains, merging ways, cycles in a range and across ranges, and forks, as walked step by step."""
    import random

    from partloom.operators import hierarchy

    rng = random.Random(9)
    edges = {(i, i + 1) for i in range(400) if i % 100 != 99} | {(199, 150), (300, 20), (350, 340), (600, 99), (601, 250), (602, 250), (601, 20)} | {(i, rng.randrange(700, 760)) for i in range(700, 760)}
    start = list(range(0, 400, 50)) + [600, 601, 602, 701, 733, 999]
    after = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    want = set()
    for node in start:
        seen, now, far = {node: 0}, [node], 0
        while now:
            far += 1
            now = [b for a in now for b in after.get(a, []) if b not in seen]
            seen |= dict.fromkeys(now, far)
        want |= {(node, r, d) for r, d in seen.items()}
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    asked = spark.createDataFrame([(n,) for n in start], "node long")
    for pairs in (1 << 22, 40):
        monkeypatch.setattr(hierarchy, "BETWEEN", pairs)
        got = [tuple(r) for r in hierarchy.walk(df, asked).collect()]
        assert set(got) == want and len(got) == len(want)
    chain = spark.range(5000).selectExpr("id AS src", "id + 1 AS dst")
    jumps = hierarchy.Jumps(chain)
    assert jumps.follow(spark.createDataFrame([(0, 0, 0)], "node long, reached long, distance int")).count() == 5001
    assert sum(t.count() for t in jumps.tables) < 50 and len(jumps.tables) < 5  # not a table of 5,000 for each power of two


def test_named_parts_query_gives_every_pair(spark):
    import re

    from partloom.plans.bom import bom_rows
    from partloom.plans.catalogue import QUERIES

    rows = [(r.row_no, r.part_no, r.name.upper()) for r in bom_rows(spark, SF).collect()]
    want = set()
    for k, no, name in rows:
        if k % 20 == 0:
            text = f"THE PART {no[:3]}-{no[3:]} OR SO" if k % 60 == 0 else f"X{no}Y AND THE {name}" if k % 60 == 20 else name
            bare = re.sub("[^A-Z0-9]", "", text)
            want |= {(k, p, "part_no" if p in bare else "part_name") for _, p, n in rows if p in bare or any(w in text for w in n.split() if len(w) > 1 and w not in ("ASS", "ASSY", "THE", "FOR"))}
    found = QUERIES["named_parts"](spark, SF)
    got = list(map(tuple, found.select("text_id", "part", "way").collect()))
    assert found.columns == ["text_id", "part", "way"] and len(got) == len(want) and set(got) == want


def test_named_parts_of_one_name_are_dealt_out(spark, monkeypatch):
    from pyspark.sql import functions as F

    from partloom.operators import feedback

    monkeypatch.setattr(feedback, "NAMED_PAIRS", 1000)
    parts = spark.createDataFrame([(f"AEC{i:08}", "red bolt", i % 2) for i in range(200)], "number string, name string, s int")
    rows = [(i % 90, "a red one" if i % 3 else f"bolt aec-{i:08}", s) for i in range(100) for s in (0, 1)]
    texts = spark.createDataFrame(rows, "text_id int, text string, s int")
    found = feedback.named_parts(texts.drop("s"), parts.drop("s"))
    want = {(i % 90, f"AEC{i:08}") for i in range(0, 100, 3)}
    got = {(r.text_id, r.part): r.way for r in found.collect()}
    assert found.count() == len(got) == 90 * 200
    assert {k for k, way in got.items() if way == "part_no"} == want
    assert found.where("way = 'part_name'").select(F.spark_partition_id()).distinct().count() > 1
    scoped = feedback.named_parts(texts, parts, scope="s")
    assert scoped.count() == scoped.select("text_id", "part").distinct().count() == 90 * 200


def _shuffled_records(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_word_searches_do_not_shuffle_their_tables(spark):
    """Blocks of queries go to where the rows lie: what is shuffled is k rows for each query and task."""
    from partloom.operators import retrieval

    sets = [sorted({(i * 7 + j * j) % 50 for j in range(1 + i % 9)}) for i in range(2000)]
    docs = spark.createDataFrame([(i, [f"w{w}" for w in s]) for i, s in enumerate(sets)] + [(3000, [])], "doc_id long, words array<string>")
    queries = docs.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query")
    before = _shuffled_records(spark)
    found = retrieval._by_words(docs, queries, 3, lambda got, nq, nd: got / (nq + nd - got), doc_id="doc_id", n_rows=300, n_queries=4)
    got = [(r["query"], r["rank"], r.doc_id, r.score) for r in found.collect()]
    want = []
    for q in range(0, 2000, 50):
        scored = sorted((-int(len({*sets[q]} & {*s}) / len({*sets[q]} | {*s}) * 1e6 + 0.5) / 1e6, i) for i, s in enumerate(sets) if {*sets[q]} & {*s})
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:3])]
    assert sorted(got) == want
    assert _shuffled_records(spark) - before < 4000  # dealt to each of ten blocks, rows alone would be 20,000


def test_cells_of_rows_are_bounded_by_words():
    import pyarrow as pa

    from partloom.operators import retrieval

    n = retrieval.WORDS // 2048 + 1  # words of a row: two pieces of 1024 rows are too many
    batch = pa.record_batch({"words": pa.array([[1] * n] * 3000, pa.list_(pa.int64()))})
    assert [c.num_rows for c in retrieval._cells(iter([batch]), 1 << 20)] == [1024, 1976]
    small = pa.record_batch({"words": pa.array([[1]] * 3000, pa.list_(pa.int64()))})
    assert [c.num_rows for c in retrieval._cells(iter([small, small]), 2500)] == [2048, 1976, 1976]
    assert list(retrieval._cells(iter([small.slice(0, 0)]), 2500)) == []


def test_sparse_search_does_not_shuffle_its_tables(spark, monkeypatch):
    """Neither texts nor counted words: long documents go to the queries, blocks of queries to the others."""
    import math

    from partloom.operators import retrieval

    monkeypatch.setattr(retrieval, "WORD_QUERIES", 4)
    monkeypatch.setattr(retrieval, "HEADS", 20)
    texts = {i: " ".join(f"w{(i * 7 + j * j) % 50}" for j in range(1 + i % 9)) for i in range(2000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    words = retrieval.weighed_words(docs)
    assert "Exchange" not in words._jdf.queryExecution().executedPlan().toString()
    before = _shuffled_records(spark)
    found = retrieval.sparse_each(words, words.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query"), 3)
    got = [(r["query"], r["rank"], r.doc_id, round(r.score, 6)) for r in found.collect()]
    counts = {i: {w: t.split().count(w) for w in t.split()} for i, t in texts.items()}
    want = []
    for q in range(0, 2000, 50):
        x = {i: math.floor(sum((1 + math.log(n)) * (1 + math.log(c[w])) for w, n in counts[q].items() if w in c) * 1e6 + 0.5) / 1e6 for i, c in counts.items()}
        want += [(q, k + 1, i, round(x[i], 6)) for k, i in enumerate(sorted((i for i in x if x[i] > 0), key=lambda i: (-x[i], i))[:3])]
    assert sorted(got) == want
    assert _shuffled_records(spark) - before < 4000  # dealt to each of ten blocks, rows alone would be 20,000


def test_repeated_identifiers_of_many_rows_are_one_document(spark, monkeypatch):
    from partloom.operators import retrieval

    rows = [(i % 300, f"a{i % 300} b b" if i < 300 else "b c") for i in range(340)] + [(None, "b"), (None, "b x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tell = lambda: {r.doc_id: {w: round(x, 4) for w, x in zip(r.words, r.weights, strict=True)} for r in retrieval.weighed_words(docs).collect()}
    few = tell()
    assert few[5] == {"a5": 1.0, "b": 2.0986, "c": 1.0} and few[None] == {"b": 1.6931, "x": 1.0} and len(few) == 301
    monkeypatch.setattr(retrieval, "REPEATED", 3)  # too many to send to all: all are shuffled
    assert tell() == few
