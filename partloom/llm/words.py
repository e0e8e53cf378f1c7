"""Words of whole texts as 64-bit codes, and codes of runs of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)


def gathered(batches: Iterator[pa.RecordBatch], texts_bytes: int = 6_000_000) -> Iterator[pa.Table]:
    """Batches put together until their texts reach so many bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b["text"].nbytes for b in held) >= texts_bytes:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def one_array(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all words (between ASCII white space), and each text's number of words."""
    split = pc.ascii_split_whitespace(texts)
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    codes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    at = coded.indices.to_numpy(zero_copy_only=False)
    if "" in words:  # beside leading and trailing white space
        real = at != words.index("")
        ends = np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], np.cumsum(lengths)])]
        lengths, at = np.diff(ends), at[real]
    return codes[at] if len(words) else np.empty(0, np.uint64), lengths


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit codes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """Codes of every n words in a row: a polynomial in the words' codes, scattered."""
    out = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for i in range(n):
        out = out * _ODD + codes[i : i + len(out)]
    return mix(out)


class Bloom:
    """A filter of a bounded number of bits: never misses a code it was given."""

    PROBES = 4

    def __init__(self, bits: int, data: np.ndarray | None = None) -> None:
        self.bits = bits
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    @staticmethod
    def size(n: int, most: int) -> int:
        """About twelve bits a code, a power of two, at most so many."""
        return min(most, 1 << max(16, (12 * n - 1).bit_length()))

    def _probes(self, codes: np.ndarray) -> np.ndarray:
        a, b = mix(codes), mix(codes ^ _ODD) | np.uint64(1)
        steps = np.arange(self.PROBES, dtype=np.uint64)[:, None]
        return (a + steps * b) & np.uint64(self.bits - 1)

    def add(self, codes: np.ndarray) -> None:
        at = self._probes(codes).ravel()
        np.bitwise_or.at(self.data, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))

    def has(self, codes: np.ndarray) -> np.ndarray:
        at = self._probes(codes)
        return ((self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def word_places(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words, of each word of all texts its place among these, and
    each text's number of words: equal places are equal words, no codes involved."""
    split = pc.ascii_split_whitespace(texts)
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:  # beside leading and trailing white space
        real = at != empty
        ends = np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], np.cumsum(lengths)])]
        lengths, at = np.diff(ends), at[real]
    return coded.dictionary, at, lengths
