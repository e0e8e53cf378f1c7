"""Rows as documents for retrieval: by assembly and domain, by block, by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions.text import row_id
from partloom.operators.classify import domain
from partloom.operators.retrieval import chunk_sequence


def _joined(order: str, text: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x["t"]), "\n")


def assembly_documents(rows: DataFrame, *, size: int = 120) -> DataFrame:
    """id, doc, chunk_seq, domain, l1_key, n_parts, text: a document for each domain
    of each assembly's rows, at most ``size`` of them.

    rows: doc, row_no, level, part_type, name, base_no, new_no, point, reason.
    """
    real = lambda c: F.when(~F.col(c).isin("", "-", "X", "x", "←"), F.col(c))
    label = F.coalesce(real("new_no"), real("base_no"), F.when(F.col("name") != "", F.col("name")), F.lit("ITEM"))
    kind = domain(F.col("part_type"), F.col("name"), F.concat_ws(" ", "point", "reason"))
    line = F.concat(F.lit("- L"), F.col("level").cast("string"), F.lit(":"), label, F.lit(" | Base="), F.col("base_no"), F.lit(" New="), F.col("new_no"), F.lit(" | "), F.col("name"), F.lit(" | CHG="), F.col("point"), F.lit(" | RSN="), F.col("reason"))
    chunked = chunk_sequence(rows.withColumns({"domain": kind, "label": label, "line": line}), size=size)
    # an assembly's own row may be in another domain, so its key comes from the run
    heads = chunked.groupBy("doc", "run").agg(F.min_by("label", F.struct((F.col("level") != 1), "row_no")).alias("l1_key"))
    parts = chunked.join(heads, ["doc", "run"]).groupBy("doc", "chunk_seq", "domain", "l1_key").agg(F.count("*").alias("n_parts"), _joined("row_no", F.col("line")).alias("body"))
    text = F.concat(F.lit("[DOMAIN] "), F.col("domain"), F.lit("\n[L1] "), F.col("l1_key"), F.lit("\n"), F.col("body"))
    key = row_id(F.col("doc"), F.col("chunk_seq").cast("string"), F.col("l1_key"), F.col("domain"))
    return parts.select(key.alias("id"), "doc", "chunk_seq", "domain", "l1_key", "n_parts", text.alias("text"))


def block_documents(rows: DataFrame, text: Column, *, doc: str = "doc", order: str = "row_no", size: int = 200) -> DataFrame:
    """id, doc, block, n_rows, text: every ``size`` rows of a sheet as one document."""
    from pyspark.sql import Window

    block = F.floor((F.row_number().over(Window.partitionBy(doc).orderBy(order)) - 1) / size).cast("int")
    out = rows.withColumn("block", block).groupBy(F.col(doc).alias("doc"), "block").agg(F.count("*").alias("n_rows"), _joined(order, text).alias("text"))
    return out.select(row_id(F.col("doc"), F.col("block").cast("string")).alias("id"), "doc", "block", "n_rows", "text")


def line_documents(rows: DataFrame, cells: dict[str, Column]) -> DataFrame:
    """id, doc, row_no, text: a document for each row, its filled cells with their names."""
    said = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}="), c)) for name, c in cells.items()]
    return rows.select(row_id(F.col("doc"), F.col("row_no").cast("string")).alias("id"), "doc", "row_no", F.concat_ws(" | ", *said).alias("text"))
