"""Registering files, loading rows once, the log of loads, reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions.text import embedding_text, looks_like_part_no
from partloom.operators.classify import row_kind
from partloom.operators.merge import insert_new


def fingerprints(files: DataFrame) -> DataFrame:
    """path, file_hash, file_size of files read as binaryFile."""
    return files.select("path", F.sha2("content", 256).alias("file_hash"), F.col("length").alias("file_size"))


def design_fingerprints(files: DataFrame) -> DataFrame:
    """name, sha1, n_bytes of design documents (path, content)."""
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha1("content").alias("sha1"), F.octet_length("content").cast("long").alias("n_bytes"))


def register(known: DataFrame, files: DataFrame) -> DataFrame:
    """The files whose content isn't known yet, each content once."""
    return insert_new(known, files, ["file_hash"])


def data_rows(rows: DataFrame, *, needs_number: Column) -> DataFrame:
    """Rows that are parts: named, and with a number, or where the layout has none, a change."""
    numbered = looks_like_part_no(F.col("new_no")) | looks_like_part_no(F.col("base_no"))
    changed = (F.coalesce(F.col("point"), F.lit("")) != "") | (F.coalesce(F.col("reason"), F.lit("")) != "")
    return rows.where((F.coalesce(F.col("name"), F.lit("")) != "") & F.when(needs_number, numbered).otherwise(changed))


def stored_rows(rows: DataFrame) -> DataFrame:
    """rows with their kind and the text to embed."""
    text = embedding_text(
        region=F.col("region"), base_model=F.col("base_model"), new_model=F.col("new_model"), event=F.col("event"), base_no=F.col("base_no"), new_no=F.col("new_no"),
        name=F.col("name"), point=F.col("point"), reason=F.col("reason"), kind=F.col("class"),
    )
    return rows.withColumns({"row_kind": row_kind(F.col("new_no"), F.col("reason")), "embedding_text": text})


def structured_and_extra(df: DataFrame, structured: list[str]) -> DataFrame:
    """df's structured columns, and the others that aren't null as a map."""
    others = [c for c in df.columns if c not in structured]
    pairs = F.create_map(*(x for c in others for x in (F.lit(c), F.col(c).cast("string")))) if others else F.create_map().cast("map<string,string>")
    return df.select(*(c for c in structured if c in df.columns), F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("extra"))


def load_log(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rows_total, rows_inserted, rows_skipped, status of each sheet."""
    total = rows.groupBy(*keys).agg(F.count("*").alias("rows_total"))
    kept = stored.groupBy(*keys).agg(F.count("*").alias("rows_inserted"))
    inserted = F.coalesce("rows_inserted", F.lit(0).cast("long"))
    out = total.join(kept, keys, "left")
    return out.select(*keys, "rows_total", inserted.alias("rows_inserted"), (F.col("rows_total") - inserted).alias("rows_skipped"), F.when(inserted > 0, "completed").otherwise("skipped").alias("status"))


def rows_per_file(files: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Every file with its number of rows, none too, the most first."""
    n = rows.groupBy(key).agg(F.count("*").alias("n_rows"))
    return files.join(n, key, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("long"))).orderBy(F.desc("n_rows"), key)


def pending(rows: DataFrame) -> DataFrame:
    """Rows with a text to embed and no vector yet."""
    return rows.where("embedding_text IS NOT NULL AND length(embedding_text) > 0 AND embedding IS NULL")


def page_after(rows: DataFrame, key: str, last: int, n: int) -> DataFrame:
    """The next n rows by key."""
    return rows.where(F.col(key) > last).orderBy(key).limit(n)


def load_once(files: DataFrame, rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows of files none of whose rows fails a check, and a log of every file
    (file, n_rows, failed, status): a file is loaded whole or not at all."""
    bad = F.coalesce(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()))
    flags = rows.withColumn("__bad", bad).groupBy("file").agg(F.count("*").alias("n_rows"), F.min("__bad").alias("failed"))
    log = files.select("file").join(flags, "file", "left").select(
        "file", F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"), "failed", F.when(F.col("failed").isNotNull(), "failed").when(F.col("n_rows") > 0, "completed").otherwise("skipped").alias("status")
    )
    return rows.join(log.where("status = 'completed'").select("file"), "file", "left_semi"), log


def union_first(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows of several tables with whatever columns they have, the first table's row for each key."""
    every = None
    for i, df in enumerate(frames):
        part = df.withColumn("__table", F.lit(i))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    others = [c for c in every.columns if c not in (key, "__table")]
    row = F.min_by(F.struct(F.lit(0), *others), F.struct("__table", *others)).alias("__row")
    return every.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).agg(row).select(key, *(F.col(f"__row.{c}") for c in others))


def unless_loaded(have: DataFrame, new: DataFrame) -> DataFrame:
    """new, or nothing if anything is loaded already."""
    return new.where("false") if not have.isEmpty() else new


def evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both, under the columns of both; what a table lacks is null there."""
    return old.unionByName(new, allowMissingColumns=True)
