"""Queries by name, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def any_of(column: str, words: list[str]) -> str:
    """SQL: a text holds one of some words."""
    return "(" + " OR ".join(f"contains({column}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def first_of(column: str, rules: list[tuple[str, list[str]]], otherwise: str) -> str:
    """SQL: the label of the first rule one of whose words a text holds."""
    return "CASE " + " ".join(f"WHEN {any_of(column, words)} THEN '{label}'" for label, words in rules) + f" ELSE {otherwise} END"
