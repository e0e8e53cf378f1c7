"""Evidence of past changes: documents of a base list, what a stored document says,
slides' metadata, and second proposals from other evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.functions.text import merge_text, part_no_strict, path, product_type, referenced_part_no, squeeze, tokens
from partloom.operators import match
from partloom.operators.classify import feature
from partloom.operators.hierarchy import ancestors_by_stack, paths
from partloom.operators.ordering import row_numbers

#: What a stored document holds of a change.
DOCUMENT = "doc_id string, change struct<summary_raw: string, target_object: string, action: string>, bom struct<level1: string, base_bom_path: string>, parts struct<main: array<struct<part_name: string, part_no: string>>>"
# The labels of a slide's project data, and the points of a product type's name.
SLIDE_LABELS = {"project": ["PJT명", "PROJECT NAME"], "base_model": ["BASE MODEL", "BASE 모델"], "new_model": ["NEW MODEL", "개발 모델"], "grade": ["개발 등급"], "product_type": ["제품군", "PRODUCT TYPE"]}


def structured_documents(rows: DataFrame, model: str, grade: str, *, width: int = 40) -> DataFrame:
    """id, doc, row_no, level1, feature, text: a document for each named row of a base
    list below level 0, with its path of names (each cut to ``width``).

    rows: doc, row_no, raw_level (as many dots as its depth), name, part_no, part_type.
    """
    dots = F.length(F.regexp_extract(F.coalesce("raw_level", F.lit("")), r"^(\.*)", 1))
    named = rows.where("trim(coalesce(name, '')) != '' AND coalesce(raw_level, '') != '0'").withColumn("level", F.greatest(dots, F.lit(1)))
    pathed = paths(ancestors_by_stack(named), "name", width=width)
    level1 = F.get(F.split("bom_path", " > "), 0)
    kind = feature(F.col("name"))
    said = [("OBJECT", level1), ("FEATURE", kind), ("BOM_PATH", F.col("bom_path")), ("PART_NAME", F.col("name")), ("PART_NO", F.col("part_no")), ("TYPE", F.col("part_type")), ("MODEL", F.lit(model)), ("GRADE", F.lit(grade))]
    text = F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), F.coalesce(c, F.lit(""))) for k, c in said))
    key = F.concat_ws("_", F.lit(model), F.lit(grade), "doc", F.col("row_no").cast("string"))
    return pathed.select(key.alias("id"), "doc", "row_no", level1.alias("level1"), kind.alias("feature"), text.alias("text"))


def stored_evidence(docs: DataFrame, *, json: str = "rag_json") -> DataFrame:
    """id, summary, level1, bom_path, part_name, part_no: the main parts that stored
    documents name; one that isn't JSON gives no rows."""
    x = F.from_json(json, DOCUMENT)
    return docs.select("id", x.alias("x")).select(
        "id", F.col("x.change.summary_raw").alias("summary"), F.col("x.bom.level1").alias("level1"), F.col("x.bom.base_bom_path").alias("bom_path"), F.explode("x.parts.main").alias("p")
    ).select("id", "summary", "level1", "bom_path", "p.part_name", "p.part_no")


def supports(name: Column, main_parts: Column) -> Column:
    """Whether one of a document's main parts holds a name or is held in it."""
    n = merge_text(name)
    return (n != "") & F.exists(F.transform(main_parts, merge_text), lambda m: (m != "") & (F.contains(m, n) | F.contains(n, m)))


def snapshot_index(base: DataFrame) -> DataFrame:
    """kind, key, row_id: the first row of each number, name and path of a base list."""
    keys = [("number", part_no_strict(F.col("part_no"))), ("name", merge_text(F.col("name"))), ("path", path(F.col("bom_path")))]
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in keys))
    return base.select("row_id", F.explode(kinds).alias("x")).where("x.key != ''").groupBy("x.kind", "x.key").agg(F.min("row_id").alias("row_id"))


def with_tokens(text: Column, filters: dict[str, Column]) -> Column:
    """A query that carries its filters as words, for a search that takes none."""
    return F.concat_ws("\n", text, *(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{k.upper()}="), c)) for k, c in filters.items()))


def resolve_base(parts: DataFrame, base: DataFrame, secondary: DataFrame, remarks: list[str]) -> DataFrame:
    """parts (number, name, remarks) with found_by and found_part_no: the base row of
    their own number, else of the number that a remark refers to (the first remark
    whose number is found), else the secondary list's by that, else by name.

    Lists: part_no, name, ord.
    """
    side = lambda df: df.withColumns({"k_no": part_no_strict(F.col("part_no")), "k_name": merge_text(F.col("name"))})
    first, second = side(base), side(secondary)
    refs = [part_no_strict(referenced_part_no(F.col(r))) for r in remarks]
    steps = [("number", part_no_strict(F.col("number")), first, "k_no")]
    steps += [("remark", r, first, "k_no") for r in refs] + [("secondary", r, second, "k_no") for r in refs]
    steps += [("name", merge_text(F.col("name")), first, "k_name"), ("secondary_name", merge_text(F.col("name")), second, "k_name")]
    return match.waterfall(parts, steps, cells=["part_no"])


def second_proposals(scores: DataFrame, *, k: int = 8) -> DataFrame:
    """proposal_id, query, pid, score: the k best other parts of each request, numbered through."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "pid"))
    return numbered_proposals(scores.withColumn("rank", rank).where(F.col("rank") <= k))


def numbered_proposals(best: DataFrame) -> DataFrame:
    """proposal_id, query, pid, score of ranked ones (query, pid, score, rank), numbered through."""
    return row_numbers(best, "query", "rank").select(F.format_string("RR-%03d", "number").alias("proposal_id"), "query", "pid", "score")


def merge_stats(merged: DataFrame) -> DataFrame:
    """before, after, gone: how many rows a merge (with its column merged) took and left."""
    return merged.agg(F.sum("merged").alias("before"), F.count("*").alias("after"), (F.sum("merged") - F.count("*")).alias("gone"))


def module_by_summary(points: DataFrame, summaries: DataFrame, *, least: int = 2) -> DataFrame:
    """pid, module: the module whose summary holds most words of a change point (two
    points each); ties go to the first.  points: pid, text; summaries: ord, module, text."""
    long = lambda c: F.filter(tokens(c), lambda w: F.length(w) >= 3)
    said = points.select("pid", F.explode(long(F.col("text"))).alias("word"))
    known = summaries.select("ord", "module", F.explode(long(F.col("text"))).alias("word"))
    score = said.join(known, "word").groupBy("pid", "ord", "module").agg((2 * F.count("*")).alias("score")).where(F.col("score") >= least)
    return score.groupBy("pid").agg(F.max_by("module", F.struct("score", -F.col("ord"))).alias("module"))


def slide_metadata(lines: DataFrame) -> DataFrame:
    """file and a column for each label: the first value that stands behind it, after a
    colon or in the next cell of a line; a product type must name one, and of
    several the likeliest counts.  lines: file, ord, text."""
    text = squeeze(F.coalesce("text", F.lit("")))
    cells = []
    for name, labels in SLIDE_LABELS.items():
        words = "|".join(rf"\Q{w}\E" for w in labels)
        value = F.regexp_extract(text, rf"(?i)(?:^|\|)\s*(?:{words})\s*(?:[:：|])\s*([^|]+)", 1)
        cells.append(F.struct(F.lit(name).alias("name"), (product_type(value) if name == "product_type" else F.trim(value)).alias("value")))
    found = lines.select("file", "ord", F.explode(F.array(*cells)).alias("x")).select("file", "ord", "x.*").where("value != ''")
    low = F.lower("value")
    points = F.when(F.contains(low, F.lit("built-in")), 50).otherwise(0) + F.when(F.contains(low, F.lit("oven")), 10).otherwise(0) + F.when(F.length("value") <= 20, 4).otherwise(0)
    best = F.struct(F.when(F.col("name") == "product_type", -points).otherwise(0), F.when(F.col("name") == "product_type", F.length("value")).otherwise(0), "ord", "value")
    first = found.groupBy("file", "name").agg(F.min(best)["value"].alias("value"))
    return first.groupBy("file").agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in SLIDE_LABELS))


def module_lists(points: DataFrame) -> DataFrame:
    """module, category, texts: the different change points of each module and category
    in the order in which they came.  points: module, category, ord, text; a module's
    change points are a deck's, so a list stays short."""
    first = points.where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy("module", "category", "text").agg(F.min("ord").alias("ord"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    return first.groupBy("module", "category").agg(texts.alias("texts"))
