from pyspark.sql import functions as F

from partloom.operators.merge import last_wins
from partloom.streaming import changes


def test_windows_and_upserts(spark, tmp_path):
    rows = [("k1", "New", "2024-01-01 00:10:00", 1), ("k1", "Change", "2024-01-01 00:20:00", 2), ("k2", "New", "2024-01-01 01:10:00", 1)]
    df = spark.createDataFrame(rows, "key string, kind string, t string, v int").withColumn("t", F.to_timestamp("t"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = changes.arriving(spark, f"{tmp_path}/in", df.schema)
    counts = changes.changes_per_window(stream, time="t", kind="kind")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(str(r.start), r.kind, r.n) for r in spark.table("counts").collect()} == {("2024-01-01 00:00:00", "New", 1), ("2024-01-01 00:00:00", "Change", 1), ("2024-01-01 01:00:00", "New", 1)}
    q = changes.upsert_each(changes.arriving(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/out", ["key"], "v", f"{tmp_path}/ck")
    q.awaitTermination(60)
    last = last_wins(spark.read.parquet(f"{tmp_path}/out"), ["key"], "v")
    assert {(r.key, r.kind) for r in last.collect()} == {("k1", "Change"), ("k2", "New")}
    q = changes.once(changes.arriving(spark, f"{tmp_path}/in", df.schema), "key", "t").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("once").count() == 2
