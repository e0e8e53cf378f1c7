"""Row numbers over a whole table without one task that holds all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.session import checkpointed


def row_numbers(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """df with its rows' numbers from 1 on in an order without ties.

    Ranges of the order are sorted and numbered side by side; only their sizes
    meet in one place.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id())
    ranged = checkpointed(ranged)  # ranges are sampled anew at every evaluation
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__range", before.alias("__before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    numbered = ranged.join(F.broadcast(starts), "__range").withColumn(name, (F.col("__before") + own).cast("long"))
    return numbered.drop("__range", "__before")
