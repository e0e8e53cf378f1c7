"""A partitioned index of vectors: lists around centroids, built once and kept as tables.

Centroids are fitted on a bounded sample; every vector goes to the list of its
nearest one.  Lists are partitions of the table, so a search reads those alone that
its queries probe.  A search is approximate with a number of probes, or exact: then
it goes on with the lists whose radius leaves room for something nearer than what the
probes found.  Either way the distances are those of the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.operators.retrieval import _ranked, _unit, gridded, nearest_in
from partloom.session import checkpointed

#: Vectors that centroids are fitted on at most, picked by a seeded hash.
SAMPLE = 16_384

#: Lists at most; with more vectors, lists grow longer.
MOST_LISTS = 1_024

_ROWS, _QUERIES = 8_192, 2_048

#: Queries whose distances to all centroids are held at once.
_AT_ONCE = 512


@dataclass
class VectorIndex:
    vectors: DataFrame  # list, vec_id, embedding and what filters need
    centroids: np.ndarray
    lists: DataFrame  # list, n, radius (largest distance to the centroid)
    vec_id: str
    vector: str


def fit_centroids(vectors: DataFrame, n_lists: int, *, vec_id: str = "vec_id", vector: str = "embedding", rounds: int = 8, sample: int = SAMPLE, seed: int = 0) -> np.ndarray:
    """Centroids of length one, by rounds of k-means over at most ``sample`` vectors."""
    rows = vectors.where(F.col(vector).isNotNull()).select(F.xxhash64(F.lit(seed), vec_id).alias("at"), vec_id, vector)
    picked = rows.orderBy("at", vec_id).limit(sample).toArrow()
    if not picked.num_rows:
        return np.empty((0, 1))
    x = _unit(picked[vector])
    centroids = x[:n_lists].copy()
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
    return centroids


def build_vector_index(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", keep: list[str] | None = None, n_lists: int | None = None, path: str | None = None) -> VectorIndex:
    """The index of all rows with a vector, with the columns of keep for filters.

    About the square root of their number is the number of lists.  With a path it is
    kept there, partitioned by list, for open_vector_index; else in the folder that the
    cluster shares.
    """
    keep = keep or []
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(vec_id).cast("long").alias(vec_id), vector, *keep)
    if n_lists is None:
        n_lists = int(min(MOST_LISTS, max(1, round(rows.count() ** 0.5))))
    centroids = fit_centroids(rows, n_lists, vec_id=vec_id, vector=vector)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _unit(pa.chunked_array([batch[vector]])) @ centroids.T
                own = near.argmax(axis=1)
                away = np.sqrt(np.maximum(0, 2 - 2 * near.max(axis=1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(away)], [*batch.schema.names, "list", "away"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.mapInArrow(assign, f"{types}, list int, away double")
    if path is None:
        dealt = checkpointed(dealt)
        lists = checkpointed(dealt.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("radius")))
        return VectorIndex(dealt.drop("away"), centroids, lists, vec_id, vector)
    spark = vectors.sparkSession
    dealt.write.partitionBy("list").parquet(f"{path}/vectors")
    kept = spark.read.parquet(f"{path}/vectors")
    kept.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("radius")).write.parquet(f"{path}/lists")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").write.parquet(f"{path}/centroids")
    return open_vector_index(spark, path, vec_id=vec_id, vector=vector)


def open_vector_index(spark: SparkSession, path: str, *, vec_id: str = "vec_id", vector: str = "embedding") -> VectorIndex:
    """An index that build_vector_index kept."""
    centroids = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # MOST_LISTS at most
    return VectorIndex(spark.read.parquet(f"{path}/vectors").drop("away"), np.array([r["centroid"] for r in centroids]), spark.read.parquet(f"{path}/lists"), vec_id, vector)


def _to_centroids(queries: DataFrame, centroids: np.ndarray, vector: str) -> DataFrame:
    """query, vector, lists: all lists of each query, nearest centroid first, with their distances."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (b.slice(i, _AT_ONCE) for b in batches for i in range(0, b.num_rows, _AT_ONCE))
        for batch in slices:
            if batch.num_rows:
                unit = _unit(pa.chunked_array([batch[vector]]))
                away = np.sqrt(np.maximum(0, 2 - 2 * unit @ centroids.T)) if len(centroids) else np.empty((len(unit), 0))
                order = np.argsort(away, axis=1, kind="stable")
                ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(centroids))
                cells = pa.StructArray.from_arrays([pa.array(order.astype(np.int32).ravel()), pa.array(np.take_along_axis(away, order, 1).ravel())], ["list", "away"])
                yield pa.RecordBatch.from_arrays([batch["query"], batch[vector], pa.ListArray.from_arrays(ends, cells)], ["query", vector, "lists"])

    kind = queries.schema[vector].dataType.simpleString()
    return queries.mapInArrow(near, f"query long, {vector} {kind}, lists array<struct<list: int, away: double>>")


def _in_lists(index: VectorIndex, rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query, vec_id, distance: the k nearest in each cell of the lists that queries (query, vector, list) ask."""
    wanted = asked.groupBy("list").agg(F.count("*").alias("q")).join(index.lists, "list")
    size = wanted.select("list", F.ceil(F.col("n") / _ROWS).alias("n_cells"), F.ceil(F.col("q") / _QUERIES).alias("n_blocks"))
    size = checkpointed(size)
    sizes = size.collect()  # MOST_LISTS at most
    probed = [r["list"] for r in sizes]
    rows = rows.where(F.col("list").isin(probed)).select("list", index.vec_id, index.vector).join(F.broadcast(size), "list")
    cells = asked.join(F.broadcast(size), "list")
    groups = sum(r["n_cells"] * r["n_blocks"] for r in sizes)
    vec_id, vector = index.vec_id, index.vector
    run = lambda r, q: nearest_in(r, q, k, vec_id, vector)
    return gridded(rows, cells, run, f"query long, {index.vec_id} long, distance double", row_id=index.vec_id, by=("list",), groups=groups)


def search_vectors(index: VectorIndex, queries: DataFrame, k: int, *, probes: int = 8, where: Column | None = None, exact: bool = False) -> DataFrame:
    """query, vec_id, distance, rank: for each of queries (query, vector) the k nearest
    of the rows that ``where`` keeps, in the lists of the ``probes`` nearest centroids.

    A query that finds fewer than k there, as under a narrow filter, asks the other
    lists too.  With exact, queries also ask every further list that may have
    something nearer: the result is that of all vectors.
    """
    rows = index.vectors if where is None else index.vectors.where(where)
    asked = queries.where(F.col(index.vector).isNotNull()).select(F.col("query").cast("long").alias("query"), index.vector)
    near = checkpointed(_to_centroids(asked, index.centroids, index.vector))
    first = near.select("query", index.vector, F.explode(F.slice("lists", 1, probes)["list"]).alias("list"))
    found = checkpointed(_in_lists(index, rows, first, k))
    last = _ranked(found, k, "distance", index.vec_id).groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("last"))
    rest = near.select("query", index.vector, F.posexplode("lists").alias("at", "cell")).where(F.col("at") >= probes)
    rest = rest.select("query", index.vector, "cell.list", "cell.away").join(last, "query", "left").join(F.broadcast(index.lists.select("list", "radius")), "list")
    few = F.coalesce(F.col("n") < k, F.lit(True))
    # distances between unit vectors; what is left after rounding stays in reach
    reach = F.col("away") - F.col("radius") <= F.sqrt(2 * F.col("last") + 2e-6) + 1e-6
    more = rest.where(few | reach if exact else few).select("query", index.vector, "list")
    return _ranked(found.unionByName(_in_lists(index, rows, more, k)), k, "distance", index.vec_id)


def recall(found: DataFrame, truth: DataFrame, *, vec_id: str = "vec_id") -> DataFrame:
    """query, recall: which part of the true neighbours (query, vec_id) were found."""
    hit = truth.select("query", vec_id).join(found.select("query", vec_id).withColumn("hit", F.lit(1)), ["query", vec_id], "left")
    return hit.groupBy("query").agg((F.count("hit") / F.count("*")).alias("recall"))
