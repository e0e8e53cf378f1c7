"""Line dedup over overlapping windows of three lines, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import column_of, materialize, text_key, unused_names


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """doc_id, tkey, removed (array of line numbers) of documents that lose lines.

    A window is ``size`` consecutive lines (parts between line feeds, compared
    as they are) of one document, not all blank.  Of the windows that are equal
    anywhere in docs, the first by (identifier with null last, text hash,
    position) stays; the lines of every later one are removed, overlapping
    windows merged.
    """
    lines = F.split(column_of(text_col), "\n", -1)
    window = lambda i: F.array_join(F.slice("lines", i + 1, F.lit(size)), "\n")
    windows = (
        docs.select(column_of(id_col).cast("long").alias("doc_id"), text_key(column_of(text_col)).alias("tkey"), lines.alias("lines"))
        .where(F.size("lines") >= size)
        .select("doc_id", "tkey", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("lines") - size), window)).alias("pos", "w"))
        .where(F.col("w").rlike(r"\S"))
        .select(
            F.xxhash64("w").alias("h1"),
            F.xxhash64(F.lit("second"), "w").alias("h2"),
            F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey", "pos").alias("at"),
        )
    )
    windows = materialize(windows, "windows")
    firsts = windows.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    firsts = firsts.where(F.col("first") < F.col("last")).drop("last")
    later = windows.join(firsts, ["h1", "h2"]).where(F.col("first") < F.col("at"))
    starts = later.groupBy("at.doc_id", "at.tkey").agg(F.collect_set("at.pos").alias("starts"))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (size - 1)))))
    return starts.select("doc_id", "tkey", covered.alias("removed"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """All of docs' columns, with the text cut, and n_lines, n_removed.

    A null text stays null with no lines; a text of fewer lines than a window
    stays as it is; a text all of whose lines repeat becomes empty, and its row
    stays.  Rows that repeat identifier and text are one document and are cut
    alike.  An empty table gives an empty one.  Columns of docs named n_lines or
    n_removed are replaced; others come through, whatever their names.
    """
    kept_columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    key, doc, tkey, gone, parts = unused_names(docs, "key", "id", "tkey", "removed", "lines")
    cut = repeated_lines(docs, id_col=id_col, text_col=text_col, size=size)
    cut = cut.select(F.col("doc_id").alias(doc), F.col("tkey").alias(tkey), F.col("removed").alias(gone))
    text = column_of(text_col)
    lines = F.split(text, "\n", -1)
    rows = docs.select(*(column_of(c) for c in kept_columns), text_key(text).alias(key))
    out = rows.join(cut, column_of(id_col).cast("long").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(tkey)), "left")
    out = out.withColumn(parts, lines)  # behind the join, which carries the text alone
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    left = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    return out.select(
        *(left.alias(c) if c == text_col else column_of(c) for c in kept_columns),
        F.when(text.isNull(), 0).otherwise(F.coalesce(F.size(parts), F.lit(0))).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
    )
