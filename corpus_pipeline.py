"""The corpus pipeline: STAGES in order, each over what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.llm import line_dedup, minhash, mixing, packing, quality
from partloom.llm.common import materialize, table
from partloom.llm.queries import tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps, with all their columns.

    A null text counts as empty and weighs 0; rows that repeat identifier and
    text fare alike; an empty table gives an empty one.
    """
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of repeated three-line windows, their lengths anew.

    A null text stays null; a text that is cut to nothing stays as an empty row;
    an empty table gives an empty one.
    """
    cut = line_dedup.dedup_lines(docs)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest identifier.

    Documents without words each stay (of rows that repeat identifier and text
    one); an empty table gives an empty one.
    """
    return minhash.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them.

    Those without words are not taken; a null source is one of its own; rows
    that repeat each other have copies of their own; an empty table gives an
    empty one.
    """
    return mixing.take_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences.

    A null text is the end id alone; each copy that the mix took is a document
    of its own; an empty table gives an empty result.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_filter),
    ("MinHash near-dedup", near_duplicate_filter),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: The stages' seeded choices and tokenizers can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over documents; what lies between is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage{i}")
    return docs
