"""The property graph as tables: lines, parts, changes, their edges and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions.levels import impact_kind
from partloom.functions.text import blank_to_null, case_id, document_id, is_part_no, part_id, part_no, search_text
from partloom.operators.classify import direct_part_no, direct_role, effective_part_no, graph_classification
from partloom.operators.hierarchy import ancestors_by_stack, closure
from partloom.operators.merge import first_wins
from partloom.session import checkpointed

CHANGES = ["Change", "New", "Delete"]


def _line_id(row: Column) -> Column:
    return F.concat_ws(":", F.col("doc"), F.lit("line"), row.cast("string"))


def _said(rows: DataFrame) -> DataFrame:
    out = rows.withColumn("kind", graph_classification(F.col("class")))
    out = out.withColumn("effective_no", effective_part_no(F.col("base_no"), F.col("new_no"), F.col("kind")))
    return out.withColumns({
        "line_id": _line_id(F.col("row_no")),
        "search_text": search_text(F.col("doc"), F.col("row_no").cast("string"), F.col("level").cast("string"), F.col("part_type"), F.col("base_no"), F.col("new_no"), F.col("effective_no"), F.col("name"), F.col("kind")),
    })


def line_texts(rows: DataFrame) -> DataFrame:
    """lines without what says where a line hangs: each row alone gives its own, in any
    order, however few the documents are."""
    return _said(rows.where("level >= 1"))


def lines(rows: DataFrame) -> DataFrame:
    """bom_lines: rows (doc, row_no, level, part_type, base_no, new_no, name, class,
    point, reason) with identifiers, effective number, depth, ancestors, parent."""
    # texts are told behind the windows' shuffle, which has fewer bytes to carry without them
    out = _said(ancestors_by_stack(rows.where("level >= 1")))
    return out.withColumn("parent_line_id", F.when(F.col("parent").isNotNull(), _line_id(F.col("parent"))))


def both_ends(edges: DataFrame, src: str, sources: DataFrame, dst: str, targets: DataFrame) -> DataFrame:
    """The edges whose two ends are there (one column of keys each); dangling ones go."""
    for column, nodes in ((src, sources), (dst, targets)):
        keys = nodes.select(F.col(nodes.columns[0]).alias(column)).distinct()
        edges = edges.join(keys, column, "left_semi")
    return edges


def line_edges(line: DataFrame) -> DataFrame:
    """parent_line_id, child_line_id of the lines whose parent is a line too."""
    edges = line.where("parent IS NOT NULL").select("parent_line_id", F.col("line_id").alias("child_line_id"))
    return edges.join(line.select(F.col("line_id").alias("parent_line_id")).distinct(), "parent_line_id", "left_semi")


def raw_parts(line: DataFrame) -> DataFrame:
    """A row for each number in its role on a line."""
    roles = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(r).alias("role"), F.col(c).alias("number")) for i, (r, c) in enumerate([("base", "base_no"), ("new", "new_no"), ("effective", "effective_no")])))
    out = line.select("line_id", "doc", "row_no", "name", "part_type", F.explode(roles).alias("x")).select("*", "x.*").where(is_part_no(F.col("number")))
    return out.select(F.concat_ws(":", "line_id", F.lit("rawpart"), "role").alias("raw_part_id"), "number", "name", "part_type", "role", "line_id", part_id(F.col("number")).alias("part_id"), F.struct("doc", "row_no", "i").alias("ord"))


def parts(raw: DataFrame) -> DataFrame:
    """A row for each different number, named as where it came first."""
    first = first_wins(raw.select("part_id", "number", "name", "part_type", "ord"), ["part_id"], "ord")
    number = part_no(F.col("number"))
    return first.select("part_id", number.alias("canonical_no"), "name", "part_type", search_text(number, F.col("name"), F.col("part_type")).alias("search_text"))


def change_records(line: DataFrame) -> DataFrame:
    """A record for each changed line, with the parts it changes."""
    direct = direct_part_no(F.col("kind"), F.col("base_no"), F.col("new_no"), F.col("effective_no"))
    id_of = lambda c: F.when(is_part_no(c), part_id(c)).otherwise("")
    return line.where(F.col("kind").isin(CHANGES)).select(
        F.concat_ws(":", "line_id", F.lit("change")).alias("change_id"), "doc", "row_no", "line_id", "kind", "base_no", "new_no", "effective_no",
        id_of(direct).alias("direct_part_id"), direct_role(F.col("kind")).alias("direct_role"),
        id_of(F.col("base_no")).alias("base_part_id"), id_of(F.col("new_no")).alias("new_part_id"), "ancestors",
    )


def change_part_edges(changes: DataFrame) -> DataFrame:
    """change_id, edge, part_id: an edge for each part that a record names."""
    ends = F.array(*(F.struct(F.lit(e).alias("edge"), blank_to_null(F.col(c)).alias("part_id")) for e, c in [("DIRECTLY_CHANGES_PART", "direct_part_id"), ("BASE_PART", "base_part_id"), ("NEW_PART", "new_part_id")]))
    return changes.select("change_id", F.explode(F.filter(ends, lambda x: x["part_id"].isNotNull())).alias("x")).select("change_id", "x.*")


def impact_edges(changes: DataFrame) -> DataFrame:
    """change_id, line_id, distance, impact: the changed line and all above it."""
    reached = closure(changes.select("doc", "row_no", "ancestors", "change_id"), keep=["change_id"])
    line = F.concat_ws(":", F.col("doc"), F.lit("line"), F.col("ancestor").cast("string"))
    return reached.select("change_id", line.alias("impacted_line_id"), "distance", impact_kind(F.col("distance")).alias("impact_type"))


def replacement_edges(changes: DataFrame) -> DataFrame:
    real = (F.col("kind") == "Change") & (F.col("base_part_id") != "") & (F.col("new_part_id") != "") & (F.col("base_part_id") != F.col("new_part_id"))
    return changes.where(real).select(F.col("base_part_id").alias("from_part_id"), F.col("new_part_id").alias("to_part_id"), "doc", "line_id")


def build(rows: DataFrame) -> dict[str, DataFrame]:
    """All tables from one table of rows; the lines, of which all are made, are computed once."""
    line = checkpointed(lines(rows), "doc", "row_no")
    raw = raw_parts(line)
    changes = change_records(line)
    return {
        "bom_lines": line, "bom_line_edges": line_edges(line), "raw_parts": raw, "parts": parts(raw), "change_records": changes,
        "change_part_edges": change_part_edges(changes), "impact_edges": impact_edges(changes), "replacement_edges": replacement_edges(changes),
        "raw_part_resolutions": raw.select("raw_part_id", "part_id", F.lit("1.0").alias("confidence"), F.lit("exact_part_no").alias("method")),
        "bom_line_part_resolutions": raw.select("line_id", "part_id", "role", F.lit("auto").alias("method")).distinct(),
    }


def change_list(changes: DataFrame, parts_: DataFrame) -> DataFrame:
    """The changed parts of each document with their names."""
    named = changes.join(parts_.select(F.col("part_id").alias("direct_part_id"), F.col("canonical_no"), F.col("name").alias("part_name")), "direct_part_id", "left")
    return named.select("doc", "row_no", "kind", "canonical_no", "part_name")


def impacted_assemblies(impact: DataFrame, line: DataFrame) -> DataFrame:
    """Each assembly with how many changes reach it and the nearest distance."""
    above = impact.where("distance > 0").groupBy("impacted_line_id").agg(F.count("*").alias("n_changes"), F.min("distance").alias("nearest"))
    return above.join(line.select(F.col("line_id").alias("impacted_line_id"), "doc", "name"), "impacted_line_id")


def without_lines(changes: DataFrame, line: DataFrame) -> DataFrame:
    """Integrity: records whose line is missing; none is right."""
    return changes.join(line.select("line_id"), "line_id", "left_anti").select("change_id")


def without_direct_impact(changes: DataFrame, impact: DataFrame) -> DataFrame:
    """Integrity: records without an edge of distance 0; none is right."""
    return changes.join(impact.where("distance = 0").select("change_id"), "change_id", "left_anti").select("change_id")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """label, n of every table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def full_text(tables: dict[str, tuple[DataFrame, str]], word: str) -> DataFrame:
    """label, id: rows of several tables whose search text holds a word, whatever its case."""
    out = None
    for label, (df, key) in tables.items():
        one = df.where(F.contains(F.lower("search_text"), F.lit(word.lower()))).select(F.lit(label).alias("label"), F.col(key).alias("id"))
        out = one if out is None else out.unionByName(one)
    return out


def replacement_chain(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Parts that replaced others, step by step, as far as it goes."""
    from partloom.operators.hierarchy import walk

    return walk(edges.select(F.col("from_part_id").alias("src"), F.col("to_part_id").alias("dst")), start)


# The fields that columns of sheets map to.
CANONICAL_FIELDS = [
    ("row_no", "integer"), ("bom_level", "integer"), ("part_type", "string"), ("base_part_no", "string"), ("new_part_no", "string"), ("part_name", "string"),
    ("quantity", "string"), ("changing_point", "string"), ("changing_reason", "string"), ("supplier_name", "string"), ("classification", "string"),
]


def document_tables(sheets: DataFrame) -> dict[str, DataFrame]:
    """source_documents, review_cases and the edges between them.

    sheets: file, sheet, base_model, new_model, event; one row for each sheet.
    """
    cell = {c: F.coalesce(F.col(c), F.lit("")) for c in ("base_model", "new_model", "event")}
    document = document_id(F.col("file"), F.col("sheet"))
    case = case_id(cell["base_model"], cell["new_model"], cell["event"], document)
    both = sheets.select(document.alias("document_id"), case.alias("case_id"), "file", "sheet", *(c.alias(n) for n, c in cell.items()))
    said = search_text(F.col("file"), F.col("sheet"), *(F.col(n) for n in cell))
    return {
        "source_documents": both.select("document_id", F.col("file").alias("file_name"), F.col("sheet").alias("sheet_name")),
        "review_cases": both.select("case_id", "base_model", "new_model", "event", said.alias("search_text")),
        "document_case_edges": both.select("document_id", "case_id"),
    }


def source_columns(headers: DataFrame) -> DataFrame:
    """source_column_id, document_id, raw_column_name, column_index, canonical_field_key of headers (document_id, column_index, raw_column_name, field)."""
    known = [n for n, _ in CANONICAL_FIELDS]
    field = F.when(F.col("field").isin(known), F.col("field")).otherwise("")
    return headers.select(F.concat_ws(":", "document_id", F.lit("col"), F.col("column_index").cast("string")).alias("source_column_id"), "document_id", "raw_column_name", "column_index", field.alias("canonical_field_key"))


def impact_path(impact: DataFrame, line: DataFrame, changes: DataFrame) -> DataFrame:
    """change_id, distance, impacted_line_id, name of some changes (change_id): the line and all above it."""
    found = impact.join(changes.select("change_id").distinct(), "change_id", "left_semi")
    return found.join(line.select(F.col("line_id").alias("impacted_line_id"), "name"), "impacted_line_id").select("change_id", "distance", "impacted_line_id", "name")


def raw_rows(line: DataFrame, wanted: DataFrame, names: list[str]) -> DataFrame:
    """line_id, raw_json of some lines (line_id): all their cells, as they came."""
    from partloom.functions.text import row_json

    return line.join(wanted.select("line_id").distinct(), "line_id", "left_semi").select("line_id", row_json(names).alias("raw_json"))


def similar_changes(found: DataFrame, changes: DataFrame, wanted: DataFrame, *, k: int = 5) -> DataFrame:
    """query, change_id, score: past changes near a request (query, change_id, score
    of a search), the score raised for an equal kind and document; k of each."""
    from pyspark.sql import Window

    cells = changes.select("change_id", "kind", "doc")
    scored = found.join(cells, "change_id").join(wanted.select("query", F.col("kind").alias("__kind"), F.col("doc").alias("__doc")), "query")
    score = F.round(F.col("score") + F.when(F.col("kind") == F.col("__kind"), 0.2).otherwise(0.0) + F.when(F.col("doc") == F.col("__doc"), 0.1).otherwise(0.0), 6)
    ranked = scored.select("query", "change_id", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "change_id"))
    return ranked.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def subtree_impact(closure: DataFrame, changes: DataFrame, roots: DataFrame, *, depth: int = 6) -> DataFrame:
    """doc, row_no, n_lines, n_changes below each root (doc, row_no), down to a depth.

    closure: doc, row_no, ancestor, distance; changes: doc, row_no.
    """
    below = closure.where(F.col("distance") <= depth).join(roots.select("doc", F.col("row_no").alias("ancestor")), ["doc", "ancestor"], "left_semi")
    hit = changes.groupBy("doc", "row_no").agg(F.count("*").alias("n"))
    return below.join(hit, ["doc", "row_no"], "left").groupBy("doc", F.col("ancestor").alias("row_no")).agg(F.count("*").alias("n_lines"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_changes"))


def feature_paths(changes: DataFrame, impact: DataFrame, line: DataFrame, feature: Column) -> DataFrame:
    """feature, doc, name, n_changes: which assemblies the changes of a feature reach."""
    marked = changes.withColumn("feature", feature).where("feature != ''").select("change_id", "feature")
    reached = impact.where("distance > 0").join(marked, "change_id").join(line.select(F.col("line_id").alias("impacted_line_id"), "doc", "name"), "impacted_line_id")
    return reached.groupBy("feature", "doc", "name").agg(F.countDistinct("change_id").alias("n_changes"))


def build_all(rows: DataFrame, sheets: DataFrame, headers: DataFrame, spark) -> dict[str, DataFrame]:
    """All fifteen tables: the lines', the documents', the columns' and the fields'.

    sheets: doc too, for the edges from documents and cases to their lines.
    """
    tables = build(rows) | document_tables(sheets)
    keys = sheets.select("doc", document_id(F.col("file"), F.col("sheet")).alias("document_id")).join(tables["document_case_edges"], "document_id")
    own = tables["bom_lines"].select("line_id", "doc").join(keys, "doc")
    contains = own.select(F.col("document_id").alias("from_id"), "line_id").unionByName(own.select(F.col("case_id").alias("from_id"), "line_id"))
    return tables | {"contains_line": contains, "source_columns": source_columns(headers), "canonical_fields": spark.createDataFrame(CANONICAL_FIELDS, "key string, type string")}
