"""Filters over a column, built on the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from partloom.llm.words import Bloom

_CHUNK = 1 << 16

#: The filter's size limit: 16 MB, whatever the input.
MOST_BITS = 1 << 27


def bloom_of(df: DataFrame, column: str, most_bits: int = MOST_BITS) -> Bloom:
    """A filter that has every value of a long column.

    Its size grows with the values up to most_bits; beyond, it lets more
    through, which its users must bear.  Partitions fill their own filters,
    whose pieces are joined by place.
    """
    bits = Bloom.size(df.count(), most_bits)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(bits)
        for batch in batches:
            own.add(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        pieces = [(i, own.data[i : i + _CHUNK]) for i in range(0, len(own.data), _CHUNK)]
        pieces = [(i, p.tobytes()) for i, p in pieces if p.any()]
        if pieces:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pieces], pa.int64()), pa.array([p for _, p in pieces], pa.binary())], ["at", "piece"])

    def join(piece: pa.Table) -> pa.Table:
        whole = np.bitwise_or.reduce([np.frombuffer(p, np.uint8) for p in piece["piece"].to_pylist()], axis=0)
        return pa.table({"at": piece["at"][:1], "piece": pa.array([whole.tobytes()], pa.binary())})

    schema = "at long, piece binary"
    joined = df.select(column).mapInArrow(fill, schema).groupBy("at").applyInArrow(join, schema)
    out = Bloom(bits)
    for at, piece in joined.collect():  # at most most_bits / 8 bytes
        out.data[at : at + len(piece)] = np.frombuffer(piece, np.uint8)
    return out
