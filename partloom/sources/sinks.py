"""Where results go: CSV tables with fixed headers, JSON manifests, keyed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.operators.merge import upsert


def write_csvs(tables: dict[str, DataFrame], folder: str, columns: dict[str, list[str]]) -> None:
    """A folder of CSV files for each table, columns in the given order, blanks for nulls."""
    for name, df in tables.items():
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns[name]]
        df.select(*cells).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/{name}")


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV table with its header; every column text, blanks kept."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    read = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", "\x00")
    return read.csv(path).select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns))


def manifest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row, json: the counts of each file and sheet, in order."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("rows"))
    entries = F.array_sort(F.collect_list(F.struct(*keys, "rows")))
    return counts.agg(F.to_json(F.struct(F.sum("rows").alias("total"), entries.alias("sheets"))).alias("json"))


def missing_files(spark: SparkSession, expected: list[str], present: DataFrame) -> DataFrame:
    """name: the expected files that present (path) doesn't have."""
    names = spark.createDataFrame([(e,) for e in expected], "name string")
    have = present.select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return names.join(have, "name", "left_anti")


def store_documents(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Documents (id, text, meta map) after an upsert; blank meta values are kept as blanks."""
    plain = new.withColumn("meta", F.transform_values("meta", lambda _, v: F.coalesce(v, F.lit(""))))
    return plain if old is None else upsert(old, plain, ["id"])


def flat_meta(df: DataFrame, cells: list[str]) -> DataFrame:
    """df without cells, and meta: a map of theirs as text, blank for nulls and JSON for what is nested."""
    simple = ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp")
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    text = lambda c: F.col(c).cast("string") if kind[c] in simple or kind[c].startswith("decimal") else F.to_json(F.col(c))
    meta = F.create_map(*(x for c in cells for x in (F.lit(c), F.coalesce(text(c), F.lit("")))))
    return df.select(*(c for c in df.columns if c not in cells), meta.alias("meta"))


def tree_json(rows: DataFrame) -> DataFrame:
    """doc, json: each tree's rows in order, for a viewer."""
    nodes = F.array_sort(F.collect_list(F.struct("row_no", "parent", "level", "name")))
    return rows.groupBy("doc").agg(F.to_json(nodes).alias("json"))


def cell_changes(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, column, value: the cells that a rewrite would change, and no blank ones."""
    n = new.select(*keys, *(F.col(c).alias(f"__n_{c}") for c in columns))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("was"), F.col(f"__n_{c}").alias("value")) for c in columns))
    out = old.join(n, keys).select(*keys, F.explode(cells).alias("x")).select(*keys, "x.*")
    return out.where((F.coalesce("value", F.lit("")) != "") & ~F.col("was").eqNullSafe(F.col("value"))).drop("was")
