"""Mixes against their targets and a linear bound; packed pieces against the tokenizer."""

import random
import zlib

import numpy as np
import pytest

from partloom.llm import mixing, packing
from partloom.llm.queries import tokenizer_path


def test_targets():
    sizes = {"a": 1000, "b": 10, "c": 500, None: 40}
    got = mixing.targets(sizes, {"a": 1.0, "b": 2.0, "c": 3.0, None: 1.0})
    assert got["b"] == 30 and got[None] == 120
    assert got["a"] == pytest.approx((1550 - 150) / 4) and got["c"] == pytest.approx(3 * (1550 - 150) / 4)
    assert sum(got.values()) == pytest.approx(1550)
    assert mixing.targets({}, {}) == {}


def cheapest(supply, members, quota, repeats):
    """Least cost of the largest flow, by trying all splits."""
    patterns = list(members)
    best = {}

    def go(i, need, cost):
        if i == len(patterns):
            met = sum(quota.values()) - sum(need.values())
            best[met] = min(best.get(met, 1 << 60), cost)
            return
        p = patterns[i]
        for used in range(supply[p] * repeats * len(members[p]) + 1):
            price = sum(n // supply[p] for n in range(used)) if supply[p] else 0
            for split in splits(used, len(members[p])):
                if max(split) > supply[p] * repeats:
                    continue
                left = dict(need)
                for s, x in zip(members[p], split, strict=True):
                    left[s] -= x
                if all(v >= 0 for v in left.values()):
                    go(i + 1, left, cost + price)

    def splits(n, k):
        if k == 1:
            yield (n,)
            return
        for x in range(n + 1):
            for rest in splits(n - x, k - 1):
                yield (x, *rest)

    go(0, dict(quota), 0)
    most = max(best)
    return most, best[most]


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_cheapest(seed):
    rng = random.Random(seed)
    members = {"p": ["a"], "q": ["a", "b"], "r": ["b", "c"]}
    supply = {p: rng.randint(0, 3) for p in members}
    quota = {s: rng.randint(0, 4) for s in "abc"}
    got = mixing.flow(supply, members, quota, 2)
    used = {p: sum(v for (q, _), v in got.items() if q == p) for p in members}
    price = sum(sum(n // supply[p] for n in range(used[p])) for p in members if supply[p])
    assert all(v <= 2 * supply[p] for (p, _), v in got.items())
    assert (sum(got.values()), price) == cheapest(supply, members, quota, 2)


def test_documents(odd_docs, some_docs, no_docs):
    for docs in (odd_docs, some_docs):
        got = mixing.mix_documents(docs).collect()
        assert len(got) == docs.count()
        by = {}
        for r in got:
            assert r.taken % r.size == 0 if r.size else r.taken == 0
            assert r.taken <= 3 * r.size
            x = by.setdefault(r.source, [0, 0, r.source_size, r.target, 0])
            x[0] += r.size
            x[1] += r.taken
            x[4] = max(x[4], r.size)
        for size, taken, source_size, target, longest in by.values():
            assert size == source_size and target <= 3 * size + 1e-9
            assert abs(taken - target) <= 2 * longest + 1
        assert sum(x[3] for x in by.values()) == pytest.approx(sum(x[0] for x in by.values()))
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix_documents(docs).collect()))
    assert mixing.mix_documents(no_docs).collect() == []


def test_overlapping_sources(spark):
    rows = [(i, 10, ["a"] if i < 50 else ["a", "b"] if i < 80 else ["b", None] if i < 90 else []) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, size long, sources array<string>")
    got = mixing.mix(df, weights={"a": 1.0, "b": 1.0, None: 1.0})
    taken = {}
    for r in got.rows.collect():
        assert set(r.taken_by) <= set(r.sources) and all(r.taken_by.count(s) <= 3 for s in r.sources)
        for s in r.taken_by:
            taken[s] = taken.get(s, 0) + r.size
    for s, target in got.targets.items():
        assert abs(taken[s] - target) <= 20
    with pytest.raises(ValueError, match="patterns"):
        mixing.mix(df, max_patterns=2)


def test_shared_texts_are_documents_of_several_sources(spark):
    """Two sources hold the same texts; a third has its own.  By the flow they split
    what they share before either repeats it, at the least cost there is."""
    rows = [(i, f"x{i} y {'z ' * (i % 5)}", "a") for i in range(40)]
    rows += [(100 + i, f"x{i}  y {'z ' * (i % 5)}\n", "b") for i in range(40)]
    rows += [(200 + i, f"own{i} y", "b") for i in range(20)] + [(300 + i, f"c{i} c", "c") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix_documents(df).collect()
    unit = {d: " ".join(t.split()) for d, t, _ in rows}
    taken, used, size = {}, {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        used[unit[r.doc_id]] = used.get(unit[r.doc_id], 0) + r.taken // r.size
        size[unit[r.doc_id]] = r.size
        assert r.taken <= 3 * r.size
    target = {r.source: r.target for r in got}
    for s in "abc":
        assert abs(taken[s] - target[s]) <= 8
    # the query's own patterns, by the flow and by trying every split between a and b
    words = {"ab": sum(len(unit[i].split()) for i in range(40)), "b": 40, "c": 60}
    quota = {s: int(target[s] + 0.5) for s in "abc"}
    price = lambda n, w: sum(min(w, n - e * w) * e for e in range(9) if n > e * w)
    given = mixing.flow(words, {"ab": ["a", "b"], "b": ["b"], "c": ["c"]}, quota)
    spent = sum(price(sum(v for (q, _), v in given.items() if q == p), w) for p, w in words.items())
    tried = [price(quota["a"] + x, words["ab"]) + price(quota["b"] - x, 40) for x in range(quota["b"] + 1) if x <= 3 * words["ab"] and quota["b"] - x <= 120]
    assert spent == min(tried) + price(quota["c"], 60)
    cost = sum(n * (n - 1) // 2 * size[u] for u, n in used.items())
    assert abs(cost - spent) <= 40
    # without the flow, each source by itself takes what the other takes too
    alone = price(quota["a"], words["ab"]) + price(quota["b"], words["ab"] + 40)
    assert spent != alone


def test_stage_takes_rows(odd_docs, no_docs, spark):
    same = spark.createDataFrame([(1, "ten words of text that all of these rows hold", "a")] * 60, "doc_id long, text string, source string")
    assert mixing.take_mix(same).count() == 60
    other = spark.createDataFrame([(i, "ten words of text that all of these rows hold", "b" if i % 2 else None) for i in range(60)], "doc_id long, text string, source string")
    counts = {r.source: r["count"] for r in mixing.take_mix(other).groupBy("source").count().collect()}
    assert counts == {"b": 20, None: 40}
    out = mixing.take_mix(odd_docs)
    assert out.columns == odd_docs.columns and out.count() > 0
    assert mixing.take_mix(no_docs).count() == 0


@pytest.mark.parametrize("which", ["odd_docs", "some_docs", "no_docs"])
def test_pieces(which, request):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(which)
    tok = Tokenizer.from_file(tokenizer_path())
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append([*tok.encode(r.text or "", add_special_tokens=False).ids, 1])
    rows = packing.pack(docs, tokenizer_path(), shard_bytes=60_000, with_ids=True).collect()
    sequences, pieces = {}, {}
    for r in rows:
        assert r.length == len(r.ids) > 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 2048 or (at < 2048 and at & (at - 1) == 0)
    assert set(pieces) == set(texts)
    for d, own in pieces.items():
        assert sum(r.length for r in own) == sum(map(len, texts[d]))
        for r in own:
            assert any(r.ids == ids[r.start : r.start + r.length] and r.doc_tokens == len(ids) for ids in texts[d])
        if len(texts[d]) == 1:
            assert sorted(i for r in own for i in range(r.start, r.start + r.length)) == list(range(len(texts[d][0])))


def test_encoder_is_the_tokenizer():
    import pyarrow as pa

    texts = ["", "The. THE!! don't I'll", "x0y 0 00 0.", "\x1ca\x1db", "a b café ́x", "ΟΔΟΣ. İstanbul.", "<|endoftext|> <|startoftext|>x.", "日本語。テスト, ab", "ﬁn. Å. ½. ²3 😀. 👩‍👩‍👧!", "a\tb\nc\x0bd\x0ce\rf"]
    for max_words in (5, 1000):
        encoder = packing.WordEncoder(tokenizer_path(), max_words)
        for _ in range(2):
            got = encoder.encode(pa.array(texts))
            want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
            assert [g.tolist() for g in got] == [[*w.ids, 1] for w in want]


def test_scores_by_the_formula():
    """BM25 term by term, and every pick of a window the best that is left."""
    import math

    rng = np.random.default_rng(4)
    docs = [rng.integers(10, 80, rng.integers(3, 60)).astype(np.uint16) for _ in range(40)]
    stats = packing.Statistics.of(docs)
    index = packing.Bm25(docs, stats, None)
    mean, df = np.mean([len(d) for d in docs]), {t: sum(t in d for d in docs) for t in range(80)}

    def score(q, d):
        total = 0.0
        for t in set(q.tolist()) & set(d.tolist()):
            tf = int((d == t).sum())
            total += math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        return total

    for i in range(0, 40, 7):
        assert np.allclose(index.scores(i), [score(docs[i], d) for d in docs], rtol=1e-4)
    unused = np.ones(40, bool)
    unused[::3] = False
    index.keep(unused)
    assert np.allclose(index.scores(5), [score(docs[5], d) if u else 0 for d, u in zip(docs, unused, strict=True)], rtol=1e-4)
    used, rest = set(), None
    for window in packing.windows(docs, size=128):
        seed = window[0][0]
        assert rest is None or seed == rest
        taken = [d for d, start, _ in window[1:] if start == 0]
        used |= {seed}
        for d in taken:
            left = [score(docs[seed], docs[x]) for x in range(40) if x not in used]
            assert score(docs[seed], docs[d]) >= max(left) * (1 - 1e-4)
            used |= {d}
        d, start, n = window[-1]
        rest = d if start + n < len(docs[d]) else None


def test_neighbours_share_words():
    rng = np.random.default_rng(1)
    topics = [rng.permutation(2000)[:60] + 100 for _ in range(8)]
    docs = [rng.choice(topics[i % 8], 500).astype(np.uint16) for i in range(64)]
    together = sum(len({d % 8 for d, _, _ in w}) == 1 for w in packing.windows(docs, 8))
    assert together >= 8


def test_neighbours_come_from_all_documents(spark):
    """Pairs that share rare words end in one shard, though there are many shards."""
    rng = np.random.default_rng(2)
    common = ["the", "of", "and", "on", "be", "is", "that", "with"]
    rare = ["zebra", "quartz", "violin", "walrus", "cactus", "anchor", "pepper", "magnet", "saddle", "turnip", "goblet", "lantern"]
    texts = [" ".join([*rng.choice(common, 120), *rng.permutation([rare[k % 12]] * 9), *rng.choice(common, 120)]) for k in range(24)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    shard = {r.doc_id: r.sequence_id >> 24 for r in packing.pack(df, tokenizer_path(), shard_bytes=6000).collect()}
    assert len(set(shard.values())) > 3
    assert sum(shard[k] == shard[k + 12] for k in range(12)) >= 8


def test_sequence_numbers_of_many_partitions():
    import pyarrow as pa

    far = packing.sequence_number(((600_000 << 12) | 4095), (1 << 24) - 1)
    assert pa.array([far], pa.int64())[0].as_py() == far
    assert packing.sequence_number((1 << 39) - 1, 0) < 1 << 63
