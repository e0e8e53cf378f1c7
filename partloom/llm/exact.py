"""Exact dedup: a tree merge of sorted digest runs.

Every input partition becomes sorted runs of (digest, length, second hash,
smallest identifier, count), each cut into blocks by digest shard: a block is one
row, whose entries stand in order.  Runs meet in binomial rounds: in round r the
blocks of one shard whose run numbers agree above bit ``bits * r`` go to one
place and are merged there, several ways at once, without being sorted anew.
Entries whose digest, length and second hash all agree fold into one with the
smallest identifier at every level, so a group of copies, however large, reaches
a merge as one entry from each run.  Shards are so many that no block outgrows a
task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import SPACES, materialize, n_partitions, small_batches

#: An entry's cells in the order that sorts it; the first three tell texts apart.
_CELLS = {"digest": pa.binary(), "n_bytes": pa.int64(), "check": pa.int64(), "no_id": pa.int32(), "id": pa.int64(), "row": pa.int64(), "n": pa.int64()}
_SQL = {pa.binary(): "binary", pa.int64(): "long", pa.int32(): "int"}
_BLOCK = "run int, shard int, " + ", ".join(f"{c} array<{_SQL[t]}>" for c, t in _CELLS.items())
SHARD_ENTRIES = 100_000
RUN_ENTRIES = 50_000


def folded(entries: Iterable[tuple]) -> list[tuple]:
    """Of entries in order, the first of each text with the count of all."""
    out = []
    for _, same in groupby(entries, key=lambda e: e[:3]):
        first, *rest = same
        out.append((*first[:-1], first[-1] + sum(e[-1] for e in rest)))
    return out


def _block(run: int, shard: int, entries: list[tuple]) -> list[pa.Array]:
    cells = zip(*entries, strict=True)
    return [pa.array([run], pa.int32()), pa.array([shard], pa.int32()), *(pa.array([list(x)], pa.list_(t)) for x, t in zip(cells, _CELLS.values(), strict=True))]


def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a bounded number of rows as blocks by shard."""

    def blocks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        run = table["run"][0].as_py()
        entries = sorted(zip(*(table[c].to_pylist() for c in ("shard", *_CELLS)), strict=True))
        for shard, own in groupby(entries, key=lambda e: e[0]):
            yield pa.RecordBatch.from_arrays(_block(run, shard, folded(e[1:] for e in own)), ["run", "shard", *_CELLS])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= RUN_ENTRIES:
            yield from blocks(held)
            held = []
    if held:
        yield from blocks(held)


def merged(table: pa.Table) -> pa.Table:
    """The blocks of one shard as one."""
    blocks = [list(zip(*(table[c][i].as_py() for c in _CELLS), strict=True)) for i in range(table.num_rows)]
    arrays = _block(table["run"][0].as_py(), table["shard"][0].as_py(), folded(heapq.merge(*blocks)))
    return pa.Table.from_arrays(arrays, ["run", "shard", *_CELLS])


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = 3) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Texts are equal when identical after every run of ASCII white space has
    become one space; a null text is an empty one.  Equality is verified by the
    SHA-256, the length and a second hash of the normalised text.  The row with
    the smallest identifier stays; a null identifier sorts last; of rows that
    repeat identifier and text exactly one stays.  Other columns are not read,
    whatever their names.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark, 10_000)
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm")).select(
        "doc_id",
        F.sha2("norm", 256).alias("digest"),
        F.octet_length("norm").cast("long").alias("n_bytes"),
        F.xxhash64("norm").alias("check"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "digests")
    last, n = rows.agg(F.max("run"), F.count("*")).first()
    n_runs = (last or 0) + 1
    shards = max(n_partitions(spark), -(-n // SHARD_ENTRIES))
    level = rows.select(
        "run",
        F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"),
        F.unhex("digest").alias("digest"),
        "n_bytes",
        "check",
        F.col("doc_id").isNull().cast("int").alias("no_id"),
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        "row",
        F.lit(1).cast("long").alias("n"),
    ).mapInArrow(sorted_runs, _BLOCK)
    while True:
        level = level.withColumn("run", F.shiftright("run", bits)).groupBy("shard", "run").applyInArrow(merged, _BLOCK)
        n_runs = -(-n_runs // (1 << bits))
        if n_runs <= 1:
            break
    groups = level.select(F.explode(F.arrays_zip(*_CELLS)).alias("e")).select(
        F.lower(F.hex("e.digest")).alias("digest"),
        "e.n_bytes",
        "e.check",
        F.when(F.col("e.no_id") == 0, F.col("e.id")).alias("keep_id"),
        F.col("e.row").alias("keep_row"),
        F.col("e.n").alias("group_size"),
    )
    return rows.join(groups, ["digest", "n_bytes", "check"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
