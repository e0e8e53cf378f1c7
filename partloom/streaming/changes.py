"""The same questions over rows as they arrive.

The source material has no streams; these let a growing folder of loads feed
the batch operators with Structured Streaming's own state and watermarks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, folder: str, schema: StructType | str, *, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once(rows: DataFrame, key: str, time: str, *, late: str = "1 day") -> DataFrame:
    """rows without repeats of a key that come within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def changes_per_window(rows: DataFrame, *, time: str, kind: str, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, kind, n: counts of each kind in each window of time."""
    counted = rows.withWatermark(time, late).groupBy(F.window(time, every), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), kind, "n")


def upsert_each(stream: DataFrame, target: str, keys: list[str], order: str, checkpoint: str):
    """Every batch's last row of each key appended to a table of versions; readers take the last."""
    from partloom.operators.merge import last_wins

    def put(batch: DataFrame, _: int) -> None:
        last_wins(batch, keys, order).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
