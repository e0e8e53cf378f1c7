"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, once per application.

    A cluster's workers have neither the driver's folder nor its path, so the
    package's sources go along as a small archive.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="partloom-code-")) / "partloom.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent).as_posix())
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)
    return spark


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's path below the one that all of the cluster sees.

    That is the one of spark.checkpoint.dir; where none is set and the master is
    local, as in tests, a temporary one.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir is unset; name a folder that driver and executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="partloom-"))
    return f"{sc.getCheckpointDir().rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, *dealt: str, deal: bool = False) -> DataFrame:
    """df, computed once and kept as a table in a shared folder.

    With deal, or columns to deal by, as one file for each shuffle partition: a table
    of few bytes, which would else be one file and one task, may have many partners.
    """
    if deal or dealt:
        df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *dealt)
    path = shared_folder(df.sparkSession, "partloom")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
