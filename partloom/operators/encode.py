"""Dense vectors and lexical weights for texts from any encoder, in one pass.

An encoder gives both heads for a list of texts and is loaded once in each worker.
Batches are made of texts of like length, by a budget of words, so short texts don't
wait for long ones; a text beyond the encoder's length is cut into windows, which count by
their words in its dense vector and by their largest weight in its lexical one.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of each text its dense vector and its words' weights by their numbers.
Encoded = tuple[list[list[float]], list[dict[int, float]]]
Encoder = Callable[[list[str]], Encoded]

#: Texts that a worker sorts by length at once.
_HELD = 2_048


@lru_cache(maxsize=1 << 16)
def _code(word: str) -> int:
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")


def hashed_encoder(size: int = 64, words: int = 1_000_003) -> Encoder:
    """Word counts hashed to a unit vector, and one plus the log of each word's count:
    for tests, and where no model is at hand."""

    def encode(texts: list[str]) -> Encoded:
        dense, sparse = [], []
        for text in texts:
            v, counts = [0.0] * size, Counter(map(_code, text.lower().split()))
            lexical: dict[int, float] = {}
            for h, n in counts.items():
                v[h % size] += n if h >> 63 else -n
                lexical[h % words] = lexical.get(h % words, 0) + n
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            dense.append([x / norm for x in v])
            sparse.append({w: 1 + math.log(n) for w, n in lexical.items()})
        return dense, sparse

    return encode


def windows(text: str, most: int) -> list[str]:
    """A text's parts of at most so many words; a text within that is one, as it is."""
    words = text.split()
    return [text] if len(words) <= most else [" ".join(words[i : i + most]) for i in range(0, len(words), most)]


def by_length(sizes: list[int], budget: int) -> Iterator[list[int]]:
    """Places of sizes, like ones together, so many that the longest times their number
    stays within a budget (one at least)."""
    batch: list[int] = []
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        if batch and max(sizes[i], 1) * (len(batch) + 1) > budget:
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch


def encode_texts(texts: list[str], encode: Encoder, *, most: int, budget: int) -> Encoded:
    """Both heads of each text, whatever its length."""
    parts = [(i, part) for i, text in enumerate(texts) for part in windows(text, most)]
    sizes = [len(part.split()) for _, part in parts]
    dense: list[np.ndarray | None] = [None] * len(texts)
    sparse: list[dict[int, float]] = [{} for _ in texts]
    pieces = Counter(i for i, _ in parts)
    for batch in by_length(sizes, budget):
        found = encode([parts[j][1] for j in batch])
        for j, vector, weights in zip(batch, *found, strict=True):
            i = parts[j][0]
            v = np.asarray(vector, np.float64) * (sizes[j] if pieces[i] > 1 else 1)
            dense[i] = v if dense[i] is None else dense[i] + v
            for w, x in weights.items():
                if x > 0:
                    sparse[i][int(w)] = max(float(x), sparse[i].get(int(w), 0.0))
    scaled = [v / (np.linalg.norm(v) or 1.0) if pieces[i] > 1 else v for i, v in enumerate(dense)]
    return [v.tolist() for v in scaled], sparse


def backfill(rows: DataFrame, load: Callable[[], Encoder], *, key: str, text: str = "embedding_text", vector: str = "embedding", sparse: str = "lexical", most: int = 512, budget: int = 8_192, force: bool = False) -> DataFrame:
    """key, vector, sparse (weights above 0 by the words' numbers) of the rows that have a
    text and no vector yet (all with a text if force)."""
    wanted = rows.where((F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0) & (F.lit(force) | F.col(vector).isNull()))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for batch in batches:
            for i in range(0, batch.num_rows, _HELD):
                part = batch.slice(i, _HELD)
                vectors, weights = encode_texts(part[text].to_pylist(), encode, most=most, budget=budget)
                words, values = (np.fromiter((x for w in weights for x in of(w)), kind) for of, kind in ((dict.keys, np.int32), (dict.values, np.float32)))
                ends = np.cumsum([0, *map(len, weights)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part[key], pa.array(vectors, pa.list_(pa.float32())), pa.MapArray.from_arrays(ends, words, values)], [key, vector, sparse])

    return wanted.select(key, text).mapInArrow(run, f"`{key}` {kind}, `{vector}` array<float>, `{sparse}` map<int,float>")
