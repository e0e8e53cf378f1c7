"""Stages of the pipeline on tables whose columns have the stages' own names."""

import pytest
from pyspark.sql import functions as F

from partloom.llm import line_dedup, minhash, mixing

NAMES = ["id", "__id", "key", "__key", "tkey", "__tkey", "removed", "__removed", "lines", "__lines", "copies", "__copies", "taken", "__taken", "copy", "__copy", "rank", "__rank", "row", "__mix_row", "KEPT", "a.b"]


@pytest.fixture(scope="module")
def clashing(odd_docs):
    mark = F.concat(F.lit("mine "), F.coalesce("text", F.lit("none")).substr(1, 20))
    return odd_docs.drop("run", "digest", "node").select("*", *(F.concat(mark, F.lit(f" {n}")).alias(n) for n in NAMES))


@pytest.mark.parametrize("stage", [line_dedup.dedup_lines, minhash.keep_one_of_each, mixing.take_mix])
def test_stage(stage, clashing):
    got = stage(clashing)
    plain = clashing.select("doc_id", "text", "lang", "source", "n_chars")
    extra = [c for c in got.columns if c in ("n_lines", "n_removed")]
    assert got.columns == [*clashing.columns, *extra]
    rows = lambda df: sorted((tuple(r[c] for c in (*plain.columns, *extra)) for r in df.collect()), key=str)
    assert rows(got) == rows(stage(plain))
    for r in got.collect():
        for n in NAMES:
            assert r[n].startswith("mine ") and r[n].endswith(f" {n}")
