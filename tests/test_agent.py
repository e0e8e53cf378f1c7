"""Requests to parts, and vectors from an encoder."""

from pyspark.sql import functions as F

from partloom.operators import agent, encode

PARTS = [("EAU65078502", "Motor Assembly,AC"), ("5900W1N004D", "Fan,Convection"), ("ABC1", "Screw")]
KNOWN = [("motor", "EAU65078502", 95), ("fan", "5900W1N004D", 98)]


def match(spark, text):
    requests = spark.createDataFrame([("q", text)], "query string, text string")
    parts = spark.createDataFrame(PARTS, "part_no string, name string")
    found = agent.candidates(requests, parts).join(requests, "query")
    return tuple(agent.matched(found, KNOWN).first())


def test_expansion_and_matches(spark):
    e = spark.range(1).select(agent.expand(F.lit("AC motor → BLDC motor")).alias("e")).first().e
    assert set(e.asDict()) == {"target_assembly", "synonyms", "related_keywords", "action"}
    assert match(spark, "AC motor → BLDC motor") == ("q", "EAU65078502", 95)
    assert match(spark, "ac fan shape") == ("q", "5900W1N004D", 98)
    assert match(spark, "button") == ("q", "ABC1", 50)


def test_backfill(spark):
    rows = spark.createDataFrame([(1, "a b", None), (2, "", None), (3, "c", [1.0]), (4, None, None)], "k long, embedding_text string, embedding array<float>")
    load = lambda: encode.hashed_encoder(8)
    assert [r.k for r in encode.backfill(rows, load, key="k").collect()] == [1]
    got = encode.backfill(rows, load, key="k", force=True).collect()
    assert sorted(r.k for r in got) == [1, 3]
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in got)
    assert all(x > 0 for r in got for x in r.lexical.values())


def test_long_texts_are_encoded_in_windows():
    calls = []

    def load(texts):
        calls.append([len(t.split()) for t in texts])
        return encode.hashed_encoder(8)(texts)

    texts = ["a b c d e f g", "x", "y z", "a a", "p q r s t u v w x y z"]
    dense, sparse = encode.encode_texts(texts, load, most=4, budget=8)
    assert all(max(c) * len(c) <= 8 and max(c) <= 4 for c in calls)
    assert sum(map(sum, calls)) == sum(len(t.split()) for t in texts)
    parts = encode.hashed_encoder(8)(["a b c d", "e f g"])
    both = [4 * x + 3 * y for x, y in zip(*parts[0], strict=True)]
    norm = sum(x * x for x in both) ** 0.5
    assert all(abs(x - y / norm) < 1e-9 for x, y in zip(dense[0], both, strict=True))
    assert sparse[0] == parts[1][0] | parts[1][1]
    assert dense[1] == encode.hashed_encoder(8)(["x"])[0][0]
    assert list(encode.by_length([], 5)) == [] and sorted(sum(encode.by_length([9, 1, 9], 5), [])) == [0, 1, 2]


def test_equal_requests_meet_their_parts_once(spark):
    requests = spark.range(300_000).selectExpr("id AS query", "IF(id % 3 = 0, NULL, IF(id % 3 = 1, 'AC motor', 'red')) AS text", "id % 2 AS place")
    parts = spark.range(40_000).selectExpr("id % 2 AS place", "concat('P', id) AS part_no", "id % 17 AS position")
    got = agent.matched_at(requests, parts, [("motor", "P5", 95)], place="place")  # six billion pairs, one by one
    assert {(r.place, r.text, r.part_no, r.score, r.n) for r in got.join(requests, "query").groupBy("place", "text", "part_no", "score").agg(F.count("*").alias("n")).collect()} == {
        (p, t, "P5" if p and t == "AC motor" else f"P{best[p]}", 95 if p and t == "AC motor" else 50, 50_000) for best in [{p: max((str(i) for i in range(40_000) if i % 34 == 17 * p), key=str) for p in (0, 1)}] for p in (0, 1) for t in (None, "AC motor", "red")
    }
