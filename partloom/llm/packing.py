"""Lexical retrieval packing.

Documents are tokenized once, and the statistics of BM25 are counted over all of
them.  They are sorted by their rarest terms that occur elsewhere, so that those
that share them lie together, and cut into shards of a bounded number of bytes.
A seed document opens a window; all its terms ask the shard's inverted index for
its best unused neighbours, by the weights that they have in the whole table, and
these fill the window greedily.  The one that doesn't fit is cut, and its rest
opens the next window, so windows are full but for the shard's last, which is
cut into powers of two.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import materialize, small_batches, text_key
from partloom.llm.words import gathered, one_array

END_ID = 1
WINDOW = 2048
SHARD_BYTES = 8_000_000

#: Signs that are a token of their own behind a word of letters alone.
_SIGNS = list(",.!?;:")


class WordEncoder:
    """Token ids of whole texts by way of their words.

    The tokenizer drops white space and never merges across it, nor across the
    border of letters and signs, and it lowers case.  So a text's ids are its
    words' ids in a row, and a word of letters and one sign is two known parts.
    Each part is encoded once; its ids are kept as little-endian 16-bit bytes.
    The cache stops growing at max_words: frequent words came early.
    """

    def __init__(self, path: str, max_words: int = 700_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_words = max_words
        self.cache: dict[str, bytes] = {}
        # parts are encoded many to a string, set apart by a digit that is always one id
        ids = self.tokenizer.encode("0", add_special_tokens=False).ids
        self.gap = ids[0] if len(ids) == 1 else None

    def _learn(self, parts: list[str], together: int = 100) -> dict[str, bytes]:
        known: dict[str, bytes] = {}
        alone = [w for w in parts if "0" in w or self.gap is None]
        if self.gap is not None:
            parts = [w for w in parts if "0" not in w]
            groups = [parts[i : i + together] for i in range(0, len(parts), together)]
            for i in range(0, len(groups), 100):
                some = groups[i : i + 100]
                found = self.tokenizer.encode_batch_fast([" 0 ".join(g) for g in some], add_special_tokens=False)
                for group, e in zip(some, found, strict=True):
                    ids = np.array(e.ids, "<u2")
                    cuts = np.flatnonzero(ids == self.gap) * 2
                    if len(cuts) != len(group) - 1:
                        alone += group
                        continue
                    data = ids.tobytes()
                    for w, lo, hi in zip(group, [0, *(cuts + 2).tolist()], [*cuts.tolist(), len(data)], strict=True):
                        known[w] = data[lo:hi]
        for i in range(0, len(alone), 1000):
            for w, e in zip(alone[i : i + 1000], self.tokenizer.encode_batch_fast(alone[i : i + 1000], add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, "<u2").tobytes()
        return known

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, with the end id."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        # a word of letters with a sign behind it is two parts; ASCII parts are lower case
        signed = pc.match_substring_regex(words, r"^\pL+[,.!?;:]$")
        cores = pc.if_else(signed, pc.utf8_slice_codeunits(words, 0, -1), words)
        cores = pc.if_else(pc.string_is_ascii(cores), pc.ascii_lower(cores), cores).dictionary_encode()
        signs = pc.if_else(signed, pc.utf8_slice_codeunits(words, -1), "")
        parts = [*cores.dictionary.to_numpy(zero_copy_only=False).tolist(), *_SIGNS]
        data = list(map(self.cache.get, parts))
        new = self._learn([p for p, ids in zip(parts, data, strict=True) if ids is None])
        data = [new[p] if ids is None else ids for p, ids in zip(parts, data, strict=True)]
        data.append(np.array([END_ID], "<u2").tobytes())
        if len(self.cache) + len(new) <= self.max_words:
            self.cache |= new
        sizes = np.fromiter(map(len, data), np.int32, len(data)) // 2
        flat, starts = np.frombuffer(b"".join(data), "<u2"), np.cumsum(sizes, dtype=np.int32) - sizes
        # every word's parts in a row, and the end id behind each text
        core_of = cores.indices.to_numpy(zero_copy_only=False)
        sign_of = pc.index_in(signs, pa.array(_SIGNS)).fill_null(-1).to_numpy(zero_copy_only=False)
        sign_of = np.where(sign_of >= 0, sign_of + len(cores.dictionary), -1)
        lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        word = coded.indices.to_numpy(zero_copy_only=False)
        behind = sign_of[word]
        n_parts = 1 + (behind >= 0)
        at = np.repeat(core_of[word], n_parts)
        last = np.cumsum(n_parts)
        at[last[behind >= 0] - 1] = behind[behind >= 0]
        text_ends = np.concatenate([[0], last])[np.cumsum(lengths)]
        at = np.insert(at, text_ends, len(data) - 1)
        n = sizes[at]
        ends = np.cumsum(n, dtype=np.int32)
        ids = flat[np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(starts[at] - ends + n, n)]
        return np.split(ids, ends[text_ends + np.arange(len(lengths))][:-1]) if len(lengths) else []


@lru_cache(1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Statistics:
    """What BM25 knows of a table: number of documents, their mean length, documents by term."""

    def __init__(self, n: int, mean: float, df: np.ndarray) -> None:
        self.mean = max(1.0, mean)
        self.df = df
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        # terms in order of rarity; those that no other document has come last
        order = np.lexsort((np.arange(len(df)), np.where(df > 1, df, np.iinfo(np.int64).max)))
        self.rarity = np.empty(len(df), np.int64)
        self.rarity[order] = np.arange(len(df))

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Statistics:
        return cls(len(docs), float(np.mean([len(d) for d in docs])) if docs else 0.0, document_counts(*_flat(docs)))

    def rarest(self, ids: np.ndarray, lengths: np.ndarray, terms: int = 6) -> np.ndarray:
        """The ranks of each document's rarest terms that occur elsewhere; a row has the last rank where terms are fewer."""
        ranks = np.unique(_keyed(self.rarity[ids], lengths)).astype(np.int64)
        starts = np.searchsorted(ranks, np.arange(len(lengths) + 1) << 16)
        at = starts[:-1, None] + np.arange(terms)
        out = np.full(at.shape, len(self.df) - 1)
        there = at < starts[1:, None]
        out[there] = ranks[at[there]] & 0xFFFF
        return out


def document_counts(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many documents have each term."""
    return np.bincount(np.unique(_keyed(ids, lengths)) & 0xFFFF, minlength=1 << 16)


def _keyed(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Document and id as one number, the shorter the faster to sort."""
    kind = np.uint32 if len(lengths) <= 1 << 16 else np.int64
    return np.repeat(np.arange(len(lengths), dtype=kind) << kind(16), lengths) | ids.astype(kind)


def _flat(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.empty(0, np.uint16), *docs]), np.fromiter(map(len, docs), np.int64, len(docs))


class Bm25:
    """An inverted index of a shard's documents: of each term the documents that have
    it, with their weights.

    A term that an eighth of the documents have is a row with a weight for every one of
    them, any other one a list.  A query adds up its own terms' rows and lists.
    """

    def __init__(self, docs: list[np.ndarray], stats: Statistics, query_terms: int | None, k1: float = 1.2, b: float = 0.75) -> None:
        self.n, self.stats, self.query_terms = len(docs), stats, query_terms
        ids, sizes = _flat(docs)
        found, tf = np.unique(_keyed(ids, sizes), return_counts=True)
        terms = (found & 0xFFFF).astype(np.intp)
        n_terms = np.bincount(found >> 16, minlength=self.n)
        self.own_starts = np.cumsum(n_terms) - n_terms
        self.asked = np.split(terms, self.own_starts[1:]) if docs else []
        norm = k1 * (1 - b + b * sizes.astype(np.float32) / np.float32(stats.mean))
        tf = tf.astype(np.float32)
        self.own = stats.idf[terms] * tf * (k1 + 1) / (tf + np.repeat(norm, n_terms))
        of = np.repeat(np.arange(self.n), n_terms)
        common = np.flatnonzero(8 * np.bincount(terms, minlength=1 << 16) >= max(self.n, 1))
        self.row = np.full(1 << 16, -1)
        self.row[common] = np.arange(len(common))
        in_row = self.row[terms] >= 0
        self.rows = np.zeros((len(common), self.n), np.float32)
        self.rows[self.row[terms[in_row]], of[in_row]] = self.own[in_row]
        listed = np.flatnonzero(~in_row)
        listed = listed[np.argsort(terms[listed].astype(np.uint16), kind="stable")]
        self.places = np.arange(self.n)
        self._lists(terms[listed], of[listed], self.own[listed])

    def _lists(self, terms: np.ndarray, docs: np.ndarray, weights: np.ndarray) -> None:
        self.terms, self.docs, self.weights = terms, docs, weights
        self.first = np.searchsorted(terms, np.arange((1 << 16) + 1))

    def keep(self, unused: np.ndarray) -> None:
        """Drop the documents that are used from rows and lists."""
        on = unused[self.places]
        self.places, self.rows = self.places[on], self.rows[:, on]
        on = unused[self.docs]
        self._lists(self.terms[on], self.docs[on], self.weights[on])

    def scores(self, doc: int) -> np.ndarray:
        """Of every document that is kept; others have 0."""
        asked = self.asked[doc]
        if self.query_terms is not None and len(asked) > self.query_terms:
            at = self.own_starts[doc]
            asked = asked[np.argpartition(self.own[at : at + len(asked)], -self.query_terms)[-self.query_terms :]]
        row = self.row[asked]
        asked = asked[row < 0]
        begin = self.first[asked]
        size = self.first[asked + 1] - begin
        at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        out = np.bincount(self.docs[at], self.weights[at], minlength=self.n).astype(np.float32)
        out[self.places] += self.rows[row[row >= 0]].sum(axis=0)
        return out


def windows(docs: list[np.ndarray], query_terms: int | None = None, size: int = WINDOW, stats: Statistics | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (document, start, length); every list but those of the rest fills a window."""
    left = []
    for i, d in enumerate(docs):
        whole = len(d) // size * size
        for start in range(0, whole, size):
            yield [(i, start, size)]
        left.append((i, whole, len(d) - whole))
    left = [x for x in left if x[2]]
    index = Bm25([docs[i] for i, _, _ in left], stats or Statistics.of(docs), query_terms)
    unused = np.ones(len(left), bool)
    window: list[tuple[int, int, int]] = []
    room, next_seed = size, 0
    rest: tuple[int, int, int, int] | None = None  # place in left, and what was cut off
    while rest or next_seed < len(left):
        if rest:
            seed, doc, start, n = rest
        else:
            seed = next_seed
            doc, start, n = left[seed]
        unused[seed] = False
        window, room, rest = [(doc, start, n)], size - n, None
        scores = None
        while room:
            while next_seed < len(left) and not unused[next_seed]:
                next_seed += 1
            if next_seed == len(left):
                break
            if scores is None:
                if 1.4 * np.count_nonzero(unused) < len(index.places):
                    index.keep(unused)
                scores = np.where(unused, index.scores(seed), -1)
            best = int(np.argmax(scores))
            if scores[best] <= 0:
                best = next_seed
            scores[best], unused[best] = -1, False
            doc, start, n = left[best]
            window.append((doc, start, min(n, room)))
            if n > room:
                rest = (best, doc, start + room, n - room)
            room -= min(n, room)
        while next_seed < len(left) and not unused[next_seed]:
            next_seed += 1
        if not room:
            yield window
        else:
            yield from _powers(window, size - room)


def _powers(window: list[tuple[int, int, int]], total: int) -> Iterator[list[tuple[int, int, int]]]:
    """A short window as sequences whose lengths are powers of two, longest first."""
    pieces = list(window)
    for bit in reversed(range(total.bit_length())):
        room = 1 << bit & total
        part = []
        while room:
            doc, start, n = pieces.pop(0)
            take = min(n, room)
            part.append((doc, start, take))
            room -= take
            if take < n:
                pieces.insert(0, (doc, start + take, n - take))
        if part:
            yield part


def sequence_number(shard: int, k: int) -> int:
    """A shard's k-th sequence.  A partition has at most 4,096 shards; 2**27
    partitions and 2**24 sequences of a shard stay within 63 bits."""
    return shard << 24 | k


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_bytes: int = SHARD_BYTES,
    query_terms: int | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    tokenizer is the path of a tokenizers file of at most 65,536 ids that drops
    white space.  A query has all terms of its document, or so many that weigh
    most.  sequence_id >> 24 tells shards apart.  A null text is an empty one and has the end id alone.  Rows
    that repeat an identifier are documents of their own.  with_ids adds the
    piece's ids.  An empty table gives an empty result; other columns are not
    read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tkey", text_key(F.col("text")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            texts = one_array(table["text"])
            ids = pa.array([i.tobytes() for i in _encoder(tokenizer).encode(texts)], pa.binary())
            size = pc.add(pc.cast(pc.binary_length(texts), pa.int64()), 16)
            yield pa.RecordBatch.from_arrays([one_array(table["doc_id"]), one_array(table["tkey"]), size, ids], ["doc_id", "tkey", "size", "ids"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << 16, np.int64)
        for batch in batches:
            df += document_counts(*_flat(_arrays(batch.column(0))))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    coded = materialize(rows.mapInArrow(encode, "doc_id long, tkey long, size long, ids binary"), "tokens")
    n, total, tokens = coded.agg(F.count("*"), F.sum("size"), F.sum(F.octet_length("ids") / 2)).first()
    df = np.zeros(1 << 16, np.int64)
    for term, k in coded.select("ids").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = k  # at most 65,536 rows
    stats = Statistics(n, (tokens or 0) / max(1, n), df)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = stats.rarest(*_flat(_arrays(batch.column("ids"))))
            keys = [pa.array(r[:, 0] << 32 | r[:, 1] << 16 | r[:, 2]) for r in (ranks[:, :3], ranks[:, 3:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *keys], [*batch.schema.names, "r1", "r2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, names, ids = TaskContext.get().partitionId() << 12, 0, [], []
        for batch in batches:
            for name, size, d in zip(batch.column("doc_id").to_pylist(), batch.column("size").to_pylist(), _arrays(batch.column("ids")), strict=True):
                if held and held + size > 1.5 * shard_bytes:
                    yield pieces(number, names, ids)
                    number, held, names, ids = number + 1, 0, [], []
                names.append(name)
                ids.append(d)
                held += size
        if names:
            yield pieces(number, names, ids)

    def pieces(number: int, names: list[int | None], ids: list[np.ndarray]) -> pa.RecordBatch:
        out = []
        for k, window in enumerate(windows(ids, query_terms, stats=stats)):
            offset = 0
            for i, start, n in window:
                piece = ids[i][start : start + n].astype("<u4")
                row = (names[i], start, n, zlib.crc32(piece.tobytes()), len(ids[i]), sequence_number(number, k), offset)
                out.append((*row, piece.astype(np.int32)) if with_ids else row)
                offset += n
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], columns)

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = ", ".join(f"{c} {'array<int>' if c == 'ids' else 'long'}" for c in columns)
    keyed = coded.mapInArrow(rarest, "doc_id long, tkey long, size long, ids binary, r1 long, r2 long")
    order = ["r1", "r2", "tkey", "doc_id"]
    shards = max(1, math.ceil((total or 0) / shard_bytes))
    # a row number tells copies apart, so that many equal documents spread over shards too
    keyed = keyed.withColumn("row", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(shards, *order, "row").sortWithinPartitions(*order, "row")
    return dealt.mapInArrow(run, schema)


def _arrays(ids: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u2") for b in ids.to_pylist()]
