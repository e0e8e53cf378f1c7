"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, and the words between it (fixed by the query contracts).
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Driver and executors all reach it.  Where it is unset and the master is
    local (tests, a single machine), a temporary one is made and set; on a
    cluster that is an error, as each machine would write to its own disk.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset; name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="partloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/partloom-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage: what follows survives lost executors without
    recomputing what came before, and sees one fixed set of rows.
    """
    path = f"{_run_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete every table that this application has materialized; results that
    haven't been written elsewhere can't be read any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Hand Python workers at most so many rows at once: texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own that no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column_of(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_key(text: Column) -> Column:
    """Tells rows apart that repeat an id with another text; null has one too."""
    return F.xxhash64(text.isNull(), text)


def uniform(*cols: Column | str, seed: int) -> Column:
    """A number in (0, 1) fixed by the columns and the seed."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.shiftrightunsigned(h, 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_sample(labels: DataFrame, columns: list[str], rows: int, seed: int = 0) -> DataFrame:
    """doc_id and columns of at most rows labelled documents, picked by a seeded hash.

    Null identifiers and labels don't count; of contradicting labels the largest holds.
    """
    whole = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.max(c).alias(c) for c in columns)).dropna()
    return whole.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows)


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 2048, enough: int = 4096) -> float | None:
    """The k-th largest value of a column without nulls, by narrowing histograms.

    Each round counts the values of one range in so many bins; only when few
    values are left are they fetched.  None if there are fewer than k.
    """
    values = df.select(F.col(column).cast("double").alias("x"))
    lo, hi, n = values.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if k < 1 or n < k:
        return None
    while n > enough and lo < hi:
        width = (hi - lo) / bins
        if not width > 0:
            break
        at = F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)).alias("bin")
        counts = values.where(F.col("x").between(lo, hi)).groupBy(at)
        found = sorted(counts.agg(F.count("x"), F.min("x"), F.max("x")).collect(), reverse=True)
        for _, n, low, high in found:
            if n >= k:
                lo, hi = low, high
                break
            k -= n
    if lo == hi:
        return lo
    return values.where(F.col("x").between(lo, hi)).orderBy(F.desc("x")).limit(k).agg(F.min("x")).first()[0]
