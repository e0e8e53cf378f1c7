"""The proposal engine: from lines of past documents to a list of proposed changes.

Each step is an operator of its own; here they stand in a row: action and tier of
each line, tiers recovered by their sets, one row for each part, the target
model's base list, levels, sourcing, and one proposal for each assembly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions.text import merge_text, part_no_strict, reason_key
from partloom.operators import classify, match, merge, proposals
from partloom.operators.ordering import row_numbers
from partloom.session import checkpointed


def changed_parts(lines: DataFrame, *, core: list[str], target: list[str]) -> DataFrame:
    """The lines that count, one for each assembly and part, with action and tier.

    lines: ord, doc, l1, base_no, new_no, name, chg, rsn, level, qty.
    """
    no = lambda c: F.when(classify.is_part_no(F.col(c)), F.col(c)).otherwise("")
    tier = classify.tier(F.col("rsn"), F.col("name"), F.col("chg"), core, target)
    related = tier.isin("CORE", "CASCADE")
    rows = lines.withColumns({"base_no": no("base_no"), "new_no": no("new_no")})
    rows = rows.withColumns({"tier": tier, "rsn_key": reason_key(F.col("rsn")), "action": classify.action(F.col("base_no"), F.col("new_no"), related), "source_doc": F.col("doc")})
    rows = checkpointed(rows)  # sets of rows are told several times, what they are told by once
    kept = proposals.recover_tiers(rows).where("tier != 'EXCLUDE' AND action != 'KEEP'")
    number = F.coalesce(F.when(F.col("new_no") != "", F.col("new_no")), F.col("base_no"))
    scope = merge_text(F.col("l1"))
    identity = F.when(number != "", F.concat_ws("|", F.lit("PNO"), scope, part_no_strict(number))).otherwise(F.concat_ws("|", F.lit("NAME"), scope, merge_text(F.col("name"))))
    columns = ["ord", "doc", "l1", "base_no", "new_no", "name", "chg", "rsn", "level", "qty", "tier", "action", "source_doc"]
    keyed = kept.select(*columns, F.lit("").alias("sourcing"), identity.alias("identity"))
    return merge.merge_same_parts(keyed)


def propose(lines: DataFrame, base: DataFrame, *, core: list[str], target: list[str]) -> tuple[DataFrame, DataFrame]:
    """Proposed parts, and one proposal for each assembly.

    base: part_no, level, kind, qty, ord of the target model.  Parts have
    identity, l1, part_no, name, action, tier, level, level_source, sourcing,
    in_base, rsn, chg, source_doc, merged, ord.
    """
    parts = checkpointed(changed_parts(lines, core=core, target=target).drop("sourcing", "qty"))
    mapped = proposals.map_to_base(parts, base)
    levelled = proposals.estimate_levels(mapped.withColumn("level", F.coalesce("level", F.lit(""))))
    source = F.when(F.col("level_estimated"), "ESTIMATED").otherwise(F.col("level_source"))
    db_no = F.coalesce(F.when(F.col("new_no") != "", F.col("new_no")), F.col("base_no"))
    out = levelled.withColumns({"level_source": source, "sourcing": classify.sourcing_by_base(F.col("action"), F.col("chg"), db_no, F.col("in_base"))})
    confidence = F.when(F.col("in_base"), 0.9).otherwise(0.6)
    grouped = proposals.merge_proposals(out.select("l1", F.lit("").alias("l1_no"), F.col("part_no").alias("number"), "tier", "level", "level_source", F.col("action").alias("change"), confidence.alias("confidence"), "ord"))
    columns = ["identity", "l1", "part_no", "name", "action", "tier", "level", "level_source", "sourcing", "in_base", "rsn", "chg", "source_doc", "merged", "ord"]
    return out.select(columns), grouped


def within_region(parts: DataFrame, region: str, hint: Column) -> DataFrame:
    """parts whose hint speaks of no other region, with relaxed: where that would leave
    too few of many (12 or more), all stay."""
    tagged = parts.withColumn("__fits", classify.region_fits(F.lit(region), classify.region_tag(hint)))
    n, left = F.count("*"), F.count_if("__fits")
    few = tagged.agg(((n >= 12) & (left < F.greatest(F.lit(8), F.floor(n * 0.55)))).alias("relaxed"))  # one row
    return tagged.join(F.broadcast(few), F.lit(True)).where(F.col("__fits") | F.col("relaxed")).drop("__fits")


def whole_proposals(parts: DataFrame, base: DataFrame, *, region: str, hint: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """What is shown of a run: the parts of every proposed assembly, and the assemblies.

    parts: as propose gives them; base: part_no, name, level, parent (the number above),
    ord.  An assembly is proposed for parts of the tiers CORE and CORE_GROUP, and stands for
    the first row of level .1 in base whose name holds its name or is held in it.
    Its rows are ``changed``, ``indirect`` (CASCADE parts, but for the assembly itself) and
    ``existing`` (what else base has below it, kept), with their position in base's
    order, unknown ones behind.  Assemblies are numbered as their first parts came; their
    confidence is their share of all changed parts (two digits, halves to even).
    """
    hint = F.concat_ws(" ", "name", "rsn", "chg", "source_doc") if hint is None else hint
    kept = checkpointed(within_region(parts, region, hint))
    core = kept.where(F.col("tier").isin("CORE", "CORE_GROUP"))
    groups = core.groupBy("l1").agg(F.min("ord").alias("first"), F.count("*").alias("n_changed")).withColumn("__l1", F.upper("l1"))
    tops = base.where(F.trim("level") == ".1").select("ord", F.upper("name").alias("key"), F.col("part_no").alias("top_no"), F.col("name").alias("top_name"))
    found = match.either_contains(groups, tops, "__l1", "key", order="ord")
    found = found.select("l1", "first", "n_changed", F.coalesce("top_no", F.lit("")).alias("top_no"), F.coalesce("top_name", "l1").alias("top_name"), F.col("ord").isNotNull().alias("in_base"))
    found = checkpointed(row_numbers(found, "first")).withColumn("proposal_id", F.format_string("P-%03d", "number"))

    own = kept.join(found.select("l1", "proposal_id", "top_no", "top_name"), "l1")
    own = own.withColumns({"list": F.when(F.col("tier").isin("CORE", "CORE_GROUP"), "changed").otherwise("indirect"), "__no": part_no_strict(F.col("part_no")), "__name": F.upper("name")})
    below = base.where("parent != ''").select(F.col("parent").alias("top_no"), part_no_strict(F.col("part_no")).alias("__no"), F.upper("name").alias("__name"), "part_no", "name", "level", F.col("ord").alias("position"))
    by_no = below.where("__no != ''").groupBy("top_no", "__no").agg(F.min("position").alias("by_no"))
    by_name = below.groupBy("top_no", "__name").agg(F.min("position").alias("by_name"))
    itself = (F.col("list") == "indirect") & (((F.col("part_no") != "") & (F.col("part_no") == F.col("top_no"))) | (F.col("__name") == F.upper("top_name")))
    placed = own.where(~itself).join(by_no, ["top_no", "__no"], "left").join(by_name, ["top_no", "__name"], "left")
    cells = ["proposal_id", "list", "part_no", "name", "action", "tier", "level"]
    shown = placed.select(*cells, F.coalesce("by_no", "by_name", F.lit(999_999)).alias("position"))
    rest = below.join(found.where("in_base").select("top_no", "l1", "proposal_id"), "top_no")
    rest = rest.join(own.where("__no != ''").select("l1", "__no").distinct(), ["l1", "__no"], "left_anti").join(own.select("l1", "__name").distinct(), ["l1", "__name"], "left_anti")
    existing = rest.select("proposal_id", F.lit("existing").alias("list"), "part_no", "name", F.lit("KEEP").alias("action"), F.lit("").alias("tier"), "level", "position")

    total = core.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))  # one row
    said = own.groupBy("proposal_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.split("source_doc", r" \| "), lambda d: d != ""))))).alias("source_docs"), F.bool_or(F.col("__name") == F.upper("top_name")).alias("skip")
    )
    out = found.join(said, "proposal_id").join(F.broadcast(total), F.lit(True))
    confidence = F.bround(F.col("n_changed") / F.col("total"), 2)
    return shown.unionByName(existing), out.select("proposal_id", "l1", "top_no", "top_name", "in_base", "skip", "n_changed", confidence.alias("confidence"), "source_docs")
