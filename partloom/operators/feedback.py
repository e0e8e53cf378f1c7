"""Review state folded from an append-only log of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions.text import merge_text, part_no_strict, squeeze
from partloom.operators.merge import last_wins
from partloom.session import checkpointed

# The words of an answer to a list of questions.
DROP_ALL = ["다 빼", "전부 제외", "다 필요없", "전부 빼", "모두 제외"]
KEEP_ALL = ["다 유지", "다 괜찮", "ㅇㅇ 다", "모두 유지", "전부 유지"]
DROP = ["빼", "제외", "삭제"]
KEEP = ["유지", "그대로", "맞아"]
CHANGE_TARGETS = ["도어", "카메라", "센서", "컨트롤러", "하네스", "모터", "팬", "히터", "패널", "포장", "라벨"]


def has_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def group_decisions(answers: DataFrame, *, text: str = "text", n: str = "n") -> DataFrame:
    """answers' columns, num, decision, replace_with: what an answer says of each
    of n questions; an answer that says nothing gives no rows."""
    t = squeeze(F.coalesce(F.col(text), F.lit("")))
    low = F.lower(t)
    numbered = F.regexp_extract_all(t, F.lit(r"(\d+)\s*번"), 1)
    nums = F.transform(F.when(F.size(numbered) > 0, numbered).otherwise(F.regexp_extract_all(t, F.lit(r"(\d+)"), 1)), lambda x: x.try_cast("int"))
    swap = r"(?i)(\d+)번.*?([A-Z]{2,3}\d{8,12}).*?(?:바꿔|교체|대체|변경)"
    # what an answer says is read once, before it is dealt to its questions
    said = F.struct(
        nums.alias("nums"), has_any(low, DROP_ALL).alias("drop_all"), has_any(low, KEEP_ALL).alias("keep_all"), F.contains(low, F.lit("만 유지")).alias("only"), has_any(low, DROP).alias("drop"), has_any(low, KEEP).alias("keep"),
        F.regexp_extract(t, swap, 1).try_cast("int").alias("swapped"), F.upper(F.regexp_extract(t, swap, 2)).alias("number"),
    )
    rows = answers.withColumn("__said", said).withColumn("num", F.explode(F.sequence(F.lit(1), F.col(n)))).where(F.col(n) > 0)
    s = F.col("__said")
    named, some = F.array_contains(s["nums"], F.col("num")), F.size(s["nums"]) > 0
    decision = (
        F.when(s["drop_all"], "제외").when(s["keep_all"], "유지").when(some & s["only"], F.when(named, "유지").otherwise("제외"))
        .when(some & s["drop"], F.when(named, "제외").otherwise("유지")).when(some & s["keep"], F.when(named, "유지").otherwise("제외"))
    )
    out = rows.withColumn("decision", F.when(decision.isNotNull() & (s["swapped"] == F.col("num")), "교체").otherwise(decision)).where("decision IS NOT NULL")
    return out.withColumn("replace_with", F.when(F.col("decision") == "교체", s["number"])).drop("__said")


def current(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last event of each key."""
    return last_wins(events, keys, order)


def apply_to_table(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """rows (number, name, kind, note) after decisions (number, decision, reason, replace_with).

    Dropped and replaced parts become 제외; a replacement is a new row of kind 추가.
    """
    d = decisions.select(part_no_strict(F.col("number")).alias("__k"), "decision", "reason", "replace_with")
    joined = rows.join(d, part_no_strict(F.col("number")) == F.col("__k"), "left")
    out = F.col("decision").isin("제외", "교체")
    said = F.when(F.col("decision").isNotNull(), F.concat(F.lit("[검토] "), F.coalesce("reason", F.lit(""))))
    note = F.concat_ws(" | ", F.when(F.col("note") != "", F.col("note")), said)
    edited = joined.select("number", "name", F.when(out, "제외").otherwise(F.col("kind")).alias("kind"), note.alias("note"))
    added = joined.where("decision = '교체'").select(
        F.coalesce(F.when(F.col("replace_with") != "", F.col("replace_with")), F.lit("(채번 필요)")).alias("number"), "name", F.lit("추가").alias("kind"), F.lit("[검토] 대체 추가").alias("note")
    )
    return edited.unionByName(added)


def question_queue(parts: DataFrame, *, n: int = 5) -> DataFrame:
    """qid, number, name: at most n questions, what is closest to the change first.

    parts: number, name, near (0 its path, 1 its name, 2 neither), ord; a part is asked about once.
    """
    first = parts.groupBy(part_no_strict(F.col("number")).alias("k"), merge_text(F.col("name")).alias("m")).agg(F.min(F.struct("near", "ord", "number", "name")).alias("x"))
    asked = first.select("x.*").orderBy("near", "ord").limit(n)
    from pyspark.sql import Window

    qid = F.format_string("Q-%03d", F.row_number().over(Window.orderBy("near", "ord")))
    return asked.select(qid.alias("qid"), "number", "name")


def queue_signature(questions: DataFrame) -> DataFrame:
    """One row: what a queue asks, whatever its order."""
    keys = F.array_sort(F.collect_list(F.concat_ws(":", part_no_strict(F.col("number")), merge_text(F.col("name")))))
    return questions.agg(F.array_join(keys, "|").alias("signature"))


def nearness(path: Column, name: Column, words: list[str]) -> Column:
    return F.when(has_any(F.lower(path), words), 0).when(has_any(F.lower(name), words), 1).otherwise(2)


def change_targets(text: Column) -> Column:
    """The kinds of part that a request speaks of."""
    return F.filter(F.array(*map(F.lit, CHANGE_TARGETS)), lambda w: F.contains(text, w))


def all_reviewed(decisions: DataFrame, group: str) -> DataFrame:
    return decisions.groupBy(group).agg(F.bool_and(F.coalesce(F.col("status").isin("OK", "RECHECK"), F.lit(False))).alias("all_reviewed"))


def replacement_copy(part: dict[str, Column], new: dict[str, Column]) -> list[Column]:
    """A part's cells with the new one's where they aren't blank."""
    return [F.coalesce(F.when(new[c] != "", new[c]), part[c]).alias(c) if c in new else part[c].alias(c) for c in part]


def named_classes(texts: DataFrame, parts: DataFrame, *, text_id: str = "text_id", scope: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The parts that texts name, by classes: numbers (text_id, part), links (text, name),
    texts (text, text_id) and parts (name, part).

    numbers: the text, signs left out, holds the part's number (five signs or more).
    Texts with equal words and parts with equal names (all names of a number) are
    classes, called by their smallest text_id and number; linked ones share a word: the
    texts hold one of the names'.  With scope, a column of both, texts speak of the parts
    of their own scope alone.
    """
    from partloom.operators.contains import holding
    from partloom.operators.sessions import bare_text, name_words

    scopes = [scope] if scope else []
    said = checkpointed(texts.select(text_id, *scopes, bare_text(F.col("text")).alias("bare"), F.upper(F.coalesce("text", F.lit(""))).alias("upper")))
    known = parts.select(F.col("number").alias("part"), *scopes, part_no_strict(F.col("number")).alias("bare_no"), F.explode_outer(name_words(F.col("name"))).alias("word"))
    words = F.array_sort(F.collect_set("word")).alias("words")
    known = checkpointed(known.groupBy("part", *scopes, "bare_no").agg(words))

    keyed = known.where(F.length("bare_no") >= 5)
    hits = holding(said, keyed, "bare", "bare_no").withColumnsRenamed({"text": "bare", "pattern": "bare_no"})
    numbers = hits.join(said.select(text_id, *scopes, "bare"), "bare").join(keyed.select("part", *scopes, "bare_no"), ["bare_no", *scopes]).select(text_id, "part").distinct()

    told = said.groupBy(*scopes, "upper").agg(F.min(text_id).alias("text"))
    names = known.where(F.size("words") > 0).groupBy(*scopes, "words").agg(F.coalesce(F.min("part"), F.lit("(no number)")).alias("name"))
    by_word = names.select(*scopes, "name", F.explode("words").alias("word"))
    found = checkpointed(holding(told, by_word, "upper", "word").withColumnsRenamed({"text": "upper", "pattern": "word"}), deal=True)
    links = checkpointed(found.join(told, "upper").join(by_word, ["word", *scopes]).select("text", "name", *scopes).distinct())
    in_texts, in_names = said.join(told, ["upper", *scopes]), known.join(names, ["words", *scopes])
    return numbers, links, in_texts.select("text", text_id, *scopes), in_names.select("name", "part", *scopes)


#: Pairs of texts and parts of one name that a deal of them has, if there are tasks enough.
NAMED_PAIRS = 250_000


def named_parts(texts: DataFrame, parts: DataFrame, *, text_id: str = "text_id", scope: str | None = None) -> DataFrame:
    """text_id, part, way: the parts that a text names, all pairs.

    For each part: 'part_no' if the text, signs left out, holds its number (five
    signs or more), else 'part_name' if it holds a word of its name.  With scope, a
    column of both, texts speak of the parts of their own scope alone.

    Pairs by name may be as many as the square of the rows.  They come out of the join
    that makes them, with no shuffle behind it, and a name's texts are dealt out over tasks.
    """
    scopes = [scope] if scope else []
    by_number, links, in_texts, in_names = named_classes(texts, parts, text_id=text_id, scope=scope)
    by_number = checkpointed(by_number)
    in_texts = checkpointed(in_texts.distinct())
    repeats = not in_texts.groupBy(text_id).count().where("count > 1").isEmpty()
    numbers = by_number.groupBy(text_id).agg(F.collect_set("part").alias("__numbers"))  # as many as fit into a text
    said = links.join(in_texts.join(numbers, text_id, "left"), ["text", *scopes]).select(text_id, "__numbers", "name", *scopes)
    said = checkpointed(said.distinct() if repeats else said)  # a row for each text and name, not part

    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * texts.sparkSession.sparkContext.defaultParallelism)
    n_parts = in_names.groupBy("name", *scopes).agg(F.count("*").alias("__parts"))
    deals = said.groupBy("name", *scopes).agg(F.count("*").alias("__texts")).join(n_parts, ["name", *scopes])
    deals = checkpointed(deals.select("name", *scopes, F.least(F.lit(tasks), F.ceil(F.col("__texts") * F.col("__parts") / NAMED_PAIRS)).cast("int").alias("__deals")))
    keys = ["name", *scopes, "__deal"]
    left = said.join(deals, ["name", *scopes]).withColumn("__deal", F.pmod(F.xxhash64(text_id), F.col("__deals")).cast("int")).drop("__deals")
    right = in_names.join(deals, ["name", *scopes]).withColumn("__deal", F.explode(F.sequence(F.lit(0), F.col("__deals") - 1))).drop("__deals")
    pairs = left.repartition(tasks, *keys).join(right.repartition(tasks, *keys).hint("shuffle_merge"), keys)
    by_name = pairs.where(~F.coalesce(F.array_contains("__numbers", F.col("part")), F.lit(False))).select(text_id, "part")
    if repeats and scopes:  # one text in several scopes may name a part in each
        by_name = by_name.distinct()
    return by_number.withColumn("way", F.lit("part_no")).unionByName(by_name.withColumn("way", F.lit("part_name")))


def past_exclusions(parts: DataFrame, log: DataFrame) -> DataFrame:
    """parts (with name) and past_reason: of the exclusions of a part whose name
    equals theirs, holds it or is held in it, the latest one's reason.

    log: ord, action, part_name, reason.  Only the last exclusion of each name counts.
    """
    from partloom.operators.match import either_contains

    gone = log.where("action = '제외'").select(F.upper(F.regexp_replace(F.coalesce("part_name", F.lit("")), r"\s+", "")).alias("k"), F.col("reason").alias("past_reason"), (-F.col("ord")).alias("back"))
    last = gone.where("k != ''").groupBy("k").agg(F.min("back").alias("back"), F.min_by("past_reason", "back").alias("past_reason"))
    keyed = parts.withColumn("__k", F.upper(F.regexp_replace(F.coalesce("name", F.lit("")), r"\s+", "")))
    found = either_contains(keyed, last.select("back", F.col("k"), "past_reason"), "__k", "k", order="back")
    return found.select(*parts.columns, "past_reason")


def handle(parts: DataFrame, events: DataFrame) -> DataFrame:
    """A review's parts after events that each speak of one part or of all.

    parts: pid, number, name, action, sourcing, display_no.  events: ord, pid
    (null for all), intent (EXCLUDE, SOURCING, BULK, RECHECK, others change
    nothing), value (the new sourcing or action).  Of the events of one intent
    the last counts.  A bulk event settles what is open; a part that is excluded
    stays so.
    """
    own = events.where(F.col("pid").isNotNull()).groupBy("pid").agg(
        F.bool_or(F.col("intent") == "EXCLUDE").alias("__out"), F.max_by(F.when(F.col("intent") == "SOURCING", F.col("value")), F.when(F.col("intent") == "SOURCING", F.col("ord"))).alias("__src"),
        F.bool_or(F.col("intent") == "RECHECK").alias("recheck"),
    )
    bulk = events.where("intent = 'BULK'").agg(F.max_by("value", "ord").alias("__bulk"))
    joined = parts.join(own, "pid", "left").join(F.broadcast(bulk), F.lit(True))  # one row
    is_open = F.upper(F.coalesce("action", F.lit(""))).isin("CHECK", "PENDING", "")
    has = ~F.coalesce("number", F.lit("")).isin("", "(채번 필요)")
    action = F.when(F.col("__out"), "EXCLUDE").when(is_open & F.col("__bulk").isNotNull(), F.col("__bulk")).otherwise(F.col("action"))
    shown = F.when((F.col("__src") == "공용검토") & has, F.col("number")).when(F.col("__src") == "신규", "(채번 필요)").otherwise(F.col("display_no"))
    why = F.when((F.col("__src") == "신규") & has, F.concat(F.lit("참고: "), F.col("number"))).otherwise("")
    return joined.select(
        "pid", "number", "name", action.alias("action"), F.coalesce("__src", "sourcing").alias("sourcing"), shown.alias("display_no"), why.alias("sourcing_reason"),
        F.coalesce("recheck", F.lit(False)).alias("recheck"),
    )


def apply_to_proposals(parts: DataFrame, decisions: DataFrame) -> DataFrame:
    """parts (pid, number, name, action, level, qty) after decisions (pid, decision,
    replace_with, replace_name): what goes is excluded, a replacement is added."""
    d = decisions.select(F.col("pid").alias("__p"), "decision", "replace_with", "replace_name")
    joined = parts.join(d, F.col("pid") == F.col("__p"), "left")
    gone = F.col("decision").isin("제외", "교체")
    edited = joined.select("pid", "number", "name", F.when(gone, "EXCLUDE").otherwise(F.col("action")).alias("action"), "level", "qty", F.lit("").alias("tier"))
    to = lambda c, other: F.coalesce(F.when(F.col(c) != "", F.col(c)), other)
    added = joined.where("decision = '교체'").select(
        "pid", to("replace_with", F.lit("(채번 필요)")).alias("number"), to("replace_name", F.col("name")).alias("name"), F.lit("ADD").alias("action"),
        "level", F.coalesce(F.when(F.col("qty") != "", F.col("qty")), F.lit("1")).alias("qty"), F.lit("USER").alias("tier"),
    )
    return edited.unionByName(added)


def added_part(text: Column) -> Column:
    """parent, name of a part that a text asks to add ("Door 하위에 Gasket 추가해줘")."""
    below, alone = r"(.+?)\s*(?:하위에|밑에|아래에)\s*(.+?)\s*(?:추가|넣어)", r"(.+?)\s*(?:추가해|넣어줘|추가로|넣어)"
    hit = text.rlike(below)
    return F.struct(F.when(hit, F.trim(F.regexp_extract(text, below, 1))).otherwise("").alias("parent"), F.when(hit, F.trim(F.regexp_extract(text, below, 2))).otherwise(F.trim(F.regexp_extract(text, alone, 1))).alias("name"))


def route(messages: DataFrame, *, text: str = "text", pending: str = "pending", n: str = "n") -> DataFrame:
    """messages' columns, handled_as and value: a pending question's answer first,
    else the intent of the words, with what it asks for."""
    from partloom.operators.classify import user_intent

    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    answers = has_any(low, DROP_ALL + KEEP_ALL) | (F.size(F.regexp_extract_all(low, F.lit(r"(\d+)"), 1)) > 0) & has_any(low, DROP + KEEP)
    intent = F.when(F.col(pending) & (F.col(n) > 0) & answers, "ANSWER").otherwise(user_intent(F.col(text)))
    sourcing = F.when(F.contains(low, F.lit("공용")), "공용검토").when(has_any(low, ["신규", "채번"]), "신규")
    bulk = F.when(has_any(low, ["변경", "시방"]), "MODIFY").when(F.contains(low, F.lit("삭제")), "REMOVE").otherwise("ADD")
    return messages.withColumn("handled_as", intent).withColumn("value", F.when(F.col("handled_as") == "SOURCING", sourcing).when(F.col("handled_as") == "BULK", bulk))
