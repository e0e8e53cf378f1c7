"""Periodic runs of words, found by probing harmonic grids.

A run of period p that repeats four times holds three grid pairs (jp, (j+1)p) in
a row, whose words are equal.  So for each p only the words at multiples of p are
compared, n/p tests and n log n in all; what survives these and some tests between
is extended to both sides by comparing arrays in growing chunks.  Grid points that
lie in a run of period p, or of a period that divides p, are skipped: they can
lead to no other run of smallest period p.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import WORDS, small_batches
from partloom.llm.words import gathered, one_array, word_places

Run = tuple[int, int, int]

#: Grid points that are tested at once.
_BLOCK = 1 << 20


def _grids(n: int, repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Periods and grid points of all pairs, in blocks of ascending periods none
    of which is a multiple of another one in its block."""
    low = 1
    while repeats * low <= n:
        periods = np.arange(low, min(2 * low - 1, n // repeats) + 1)
        pairs = (n - 1) // periods
        block = (np.cumsum(pairs) - 1) // _BLOCK
        for b in range(int(block[-1]) + 1):
            own = block == b
            if own.any():
                p = np.repeat(periods[own], pairs[own])
                first = np.repeat(np.cumsum(pairs[own]) - pairs[own], pairs[own])
                yield p, (np.arange(len(p)) - first) * p
        low *= 2


def _survivors(words: np.ndarray, p: np.ndarray, at: np.ndarray, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid points from which on repeats - 1 pairs in a row are equal, and some words between them."""
    equal = words[at] == words[at + p]
    row = equal
    for k in range(1, repeats - 1):
        row = row[:-1] & equal[k:]
    if repeats > 2:
        row &= p[: len(row)] == p[repeats - 2 :]
    hit = np.flatnonzero(row)
    p, at = p[hit], at[hit]
    for part in (3, 7, 11, 14):
        between = at + (repeats - 2) * p * part // 16
        on = words[between] == words[between + p]
        p, at = p[on], at[on]
    return p, at


def _extend(words: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """The largest range around at whose words equal those p later."""
    n, end, chunk = len(words) - p, at, 32
    while end < n:
        upto = min(n, end + chunk)
        same = words[end:upto] == words[end + p : upto + p]
        if not same.all():
            end += int(same.argmin())
            break
        end, chunk = upto, min(2 * chunk, 1 << 16)
    start, chunk = at, 32
    while start > 0:
        downto = max(0, start - chunk)
        same = words[downto:start] == words[downto + p : start + p]
        if not same.all():
            start -= int(same[::-1].argmin())
            break
        start, chunk = downto, min(2 * chunk, 1 << 16)
    return start, end


def find_runs(words: np.ndarray, shortest: int = 6, repeats: int = 4) -> list[Run]:
    """(start, length, period) of every run, by start and period.

    A run is a stretch with the smallest period p and at least ``shortest`` and
    ``repeats * p`` words (repeats: 2 or more) that neither neighbour extends.
    """
    n = len(words)
    found: dict[tuple[int, int], int] = {}
    until = np.zeros(n, np.int64)  # the end of the run that reaches furthest from a word, and its period
    period = np.ones(n, np.int64)
    for p, at in _grids(n, repeats):
        p, at = _survivors(words, p, at, repeats)
        if not len(at):
            continue
        fresh = (until[at] <= at + p) | (p % period[at] != 0)
        p, at = p[fresh], at[fresh]
        key, k = p * (n + 1) + at, 0
        while k < len(key):
            q = int(p[k])
            start, end = _extend(words, int(at[k]), q)
            length = end + q - start
            # with a smaller period it has been found before, as the same stretch
            if length >= max(shortest, repeats * q) and (start, length) not in found:
                found[start, length] = q
                further = until[start : start + length] < start + length
                until[start : start + length][further] = start + length
                period[start : start + length][further] = q
            k = int(np.searchsorted(key, q * (n + 1) + max(end, int(at[k]) + 1)))
    return sorted((start, length, q) for (start, length), q in found.items())


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest length by period; of equal ones the first, then that of the smallest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


_FOUND = "n_words long, n_runs long, best struct<start: long, length: long, period: long>, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), shortest: int = 6, repeats: int = 4) -> DataFrame:
    """The columns of keep, n_words, n_runs, best, runs and collapsed for every row of docs.

    ``runs`` has each run's first word, length and smallest period, by start and
    period; ``best`` is the one of the greatest length by period, null without
    runs.  ``collapsed`` is the text's words, joined by one space, without those
    that a run holds after its first period.  A null text has no words; one
    without runs keeps all.  Rows that repeat each other are treated alike; an
    empty table gives an empty result.  Columns of docs beside keep are not read,
    whatever their names.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(c) for c in keep)).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            dictionary, at, lengths = word_places(one_array(table["text"]))
            kept = np.ones(len(at), bool)
            runs, n_runs, best, begin = [], [], [], 0
            for n in lengths.tolist():
                own = find_runs(at[begin : begin + n], shortest, repeats)
                for start, length, q in own:
                    kept[begin + start + q : begin + start + length] = False
                runs += own
                n_runs.append(len(own))
                best.append(strongest(own))
                begin += n
            ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            cells = np.array(runs, np.int64).reshape(-1, 3)
            names = ["start", "length", "period"]
            listed = pa.ListArray.from_arrays(ends(n_runs), pa.StructArray.from_arrays([pa.array(cells[:, i]) for i in range(3)], names))
            left = np.add.reduceat(np.append(kept, False).astype(np.int64), np.cumsum(lengths) - lengths) * (lengths > 0)
            words = pa.ListArray.from_arrays(ends(left), dictionary.take(pa.array(at[kept])))
            yield pa.RecordBatch.from_arrays(
                [
                    one_array(table["row"]),
                    pa.array(lengths),
                    pa.array(n_runs, pa.int64()),
                    pa.array([None if b is None else dict(zip(names, b, strict=True)) for b in best], listed.type.value_type),
                    listed,
                    pc.binary_join(words, " "),
                ],
                ["row", "n_words", "n_runs", "best", "runs", "collapsed"],
            )

    kept_type = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(search, f"row {kept_type}, {_FOUND}")
    return out.select("row.*", "n_words", "n_runs", "best", "runs", "collapsed")


def plant_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and text_col, the latter with a periodic end in about a tenth of the documents.

    With h the CRC-32 of the identifier's decimal digits and g = floor(h / 10): of n words, where
    h % 10 = 0, each from the a-th on becomes word a + (i - a) % p, for a = g % n
    and p = 1 + floor((n - a) / (3 + g % 8)).  A row without identifier, or
    without words, stays as it is.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORDS), F.lit(0))
    n = F.size("words")
    a = F.pmod("g", n)
    p = F.lit(1) + F.floor((n - a) / (F.pmod("g", F.lit(8)) + 3))
    told = docs.select(F.col(id_col), F.col(text_col), g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    told = told.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p))
    word: Column = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int")))
    text = F.when(n > 0, F.array_join(word, " ")).otherwise(F.col(text_col))
    return told.select(F.col(id_col), text.alias(text_col))
