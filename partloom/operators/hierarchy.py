"""Assembly hierarchies from rows in order with depth codes.

Rows of one document (a sheet) are ordered; each has a level.  Two readings of
the levels exist and differ where levels jump:

* by stack: a row hangs below the last row one step up, and a jump of several
  levels counts as one;
* by level: a row hangs below the last row of any smaller level.

Both, and all ancestors of a row, come from running windows over the document,
without recursion, however deep they go: a few levels are looked at one by one in
one pass, many by the bits of their numbers, in a pass for each bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.session import checkpointed

#: So many levels are looked at one by one.
FEW_LEVELS = 64


def _sofar(doc: str, order: str) -> Window:
    return Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def _before(doc: str, order: str) -> Window:
    return Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def effective_depth(df: DataFrame, *, doc: str = "doc", order: str = "row_no", level: str = "level") -> DataFrame:
    """df with depth: the height of the stack at each row, min(level, depth above + 1)."""
    rn = F.row_number().over(Window.partitionBy(doc).orderBy(order))
    out = df.withColumn("__rn", rn)
    lag = F.min(F.col(level) - F.col("__rn")).over(_sofar(doc, order))
    return out.withColumn("depth", (F.col("__rn") + F.least(F.lit(0), lag)).cast("int")).drop("__rn")


def _last_at(depth: str, value: Column, k: int, window: Window) -> Column:
    return F.last(F.when(F.col(depth) == k, value), ignorenulls=True).over(window)


def _top(df: DataFrame, level: str) -> int:
    return df.agg(F.max(level)).first()[0] or 0


def ancestors_by_stack(df: DataFrame, *, doc: str = "doc", order: str = "row_no", level: str = "level") -> DataFrame:
    """df with depth, ancestors (rows above, nearest first) and parent.

    The stack's entry at depth k is the last row of that depth, as depth never
    grows by more than one.  One aggregate tells how deep the stacks get.
    """
    out = effective_depth(df, doc=doc, order=order, level=level)
    top = _top(df, level)  # a stack is no higher than its rows' levels
    if top > FEW_LEVELS:
        top = _top(out, "depth")
    window = _before(doc, order)
    at = [F.when(F.lit(k) < F.col("depth"), _last_at("depth", F.col(order), k, window)) for k in range(top - 1, 0, -1)]
    none = F.array().cast(f"array<{df.schema[order].dataType.simpleString()}>")
    out = out.withColumn("ancestors", F.array_compact(F.array(*at)) if at else none)
    return out.withColumn("parent", F.get("ancestors", 0))


def _nearest_smaller(df: DataFrame, name: str, *, doc: str, order: str, level: str, below: bool = False) -> DataFrame:
    """df with name: the nearest row above (or below) of a smaller level, null without one.

    A level is smaller if it agrees with the own one above some bit, which the
    own one has and it hasn't.  So for each bit the rows that agree above it
    stand together, and the nearest without the bit is one candidate.
    """
    bounds = df.agg(F.min(level), F.max(level)).first()
    low, high = (0, 0) if bounds[0] is None else bounds
    find, best = (F.min, F.least) if below else (F.max, F.greatest)
    along = F.desc(order) if below else F.asc(order)  # a frame up to the end is summed up anew for each row, one from the start isn't
    x = F.col(level) - low
    if high - low < FEW_LEVELS:
        window = Window.partitionBy(doc).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
        found = [F.when(F.lit(k) < x, find(F.when(x == k, F.col(order))).over(window)) for k in range(high - low)]
    else:
        found = []
        for bit in range((high - low).bit_length()):
            window = Window.partitionBy(doc, F.shiftright(x.cast("long"), bit + 1)).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
            has = F.shiftright(x.cast("long"), bit) % 2 == 1
            found.append(F.when(has, find(F.when(~has, F.col(order))).over(window)))
    nothing = F.lit(None).cast(df.schema[order].dataType)
    return df.withColumn(name, best(nothing, nothing, *found))


def parent_by_level(df: DataFrame, *, doc: str = "doc", order: str = "row_no", level: str = "level") -> DataFrame:
    """df with parent: the nearest row above of a smaller level."""
    return _nearest_smaller(df, "parent", doc=doc, order=order, level=level)


def explicit_parent(df: DataFrame, given: str, *, number: str = "part_no", level: str = "level") -> DataFrame:
    """df with parent_no: the parent that a cell names, else the number of the
    parent row; rows of level 0 have none.  df: doc, row_no, parent."""
    up = df.select(F.col("doc").alias("__d"), F.col("row_no").alias("__r"), F.col(number).alias("__n"))
    out = df.join(up, (F.col("doc") == F.col("__d")) & (F.col("parent") == F.col("__r")), "left")
    named = F.when(F.trim(F.coalesce(F.col(given), F.lit(""))) != "", F.trim(given))
    return out.withColumn("parent_no", F.when(F.col(level) > 0, F.coalesce(named, "__n"))).drop("__d", "__r", "__n")


def closure(df: DataFrame, *, keep: list[str] | None = None) -> DataFrame:
    """doc, row_no, ancestor, distance, of each row and all above it.

    df: doc, row_no, ancestors (nearest first); keep names columns to carry.
    """
    own = F.array(F.col("row_no").cast("long"))
    chain = F.concat(own, F.transform("ancestors", lambda x: x.cast("long")))
    return df.select("doc", "row_no", *(keep or []), F.posexplode(chain).alias("distance", "ancestor"))


def _merged(*parts: DataFrame) -> DataFrame:
    """node, reached and the smallest distance of several such tables."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("node", "reached").agg(F.min("distance").alias("distance"))


class Jumps:
    """All that lies on the way in a graph (src, dst) each of whose nodes leads to one other at most.

    Nodes are held in ranges.  Between ranges, from each node that another range leads to
    to the next such one, jumps double: a table for 1, 2, 4, … of them, made when it is
    first asked for.  What lies between is told by tasks that hold a range each.
    """

    def __init__(self, edges: DataFrame) -> None:
        self.own = checkpointed(_left_ranges(checkpointed(edges.select("src", "dst")), whole=True))
        left = self.own.where("NOT cyclic")
        entered = left.select(F.col("last").alias("src")).distinct()
        self.tables = [checkpointed(left.join(entered, "src", "left_semi").select("src", F.col("last").alias("dst"), "length"))]

    def at(self, k: int) -> DataFrame:
        while len(self.tables) <= k:
            last = self.tables[-1]
            onward = last.select(F.col("src").alias("dst"), F.col("dst").alias("next"), F.col("length").alias("more"))
            self.tables.append(checkpointed(last.join(onward, "dst").select("src", F.col("next").alias("dst"), (F.col("length") + F.col("more")).alias("length"))))
        return self.tables[k]

    def follow(self, pairs: DataFrame) -> DataFrame:
        """pairs (node, reached, distance) and all that lies on the way from each reached
        one, some of it perhaps twice.

        n ranges on the way take about log2(n) rounds; a cycle ends when a round
        finds nothing new.
        """
        onward = lambda held, jump: held.join(jump, F.col("reached") == F.col("src")).select("node", F.col("dst").alias("reached"), (F.col("distance") + F.col("length")).cast("int").alias("distance"))
        entries = checkpointed(_merged(onward(pairs, self.own.where("NOT cyclic").select("src", F.col("last").alias("dst"), "length"))))
        k = 0
        while not entries.isEmpty():
            new = checkpointed(onward(entries, self.at(k)).join(entries.select("node", "reached"), ["node", "reached"], "left_anti"))
            if new.isEmpty():
                break
            entries, k = checkpointed(_merged(entries, new)), k + 1
        entries = _merged(pairs, entries)
        return entries.unionByName(_between(entries, self.own))


#: Pairs that a task tells at once from the nodes of a range, by the mean.
BETWEEN = 1 << 22


def _between(entries: DataFrame, own: DataFrame) -> DataFrame:
    """node, reached, distance of all that entries (node, reached, distance) lead to in the ranges of their reached nodes."""
    placed = checkpointed(entries.join(own.select(F.col("src").alias("reached"), "length", "range"), "reached"))
    blocks = checkpointed(placed.groupBy("range").agg(F.ceil(F.sum("length") / BETWEEN).cast("int").alias("blocks")))
    left = placed.join(blocks, "range").select("node", "reached", "distance", "range", F.pmod(F.xxhash64("node", "reached"), "blocks").cast("int").alias("block"))
    right = own.join(blocks, "range").select("src", "dst", "range", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def tell(asked: pa.Table, edges: pa.Table) -> pa.Table:
        node_type, type_ = asked.schema.field("node").type, edges.schema.field("src").type  # of texts, an empty result has them too
        asked, edges = asked.to_pandas(), edges.to_pandas()
        index, n = pd.Index(edges["src"]), len(edges)
        jump = index.get_indexer(edges["dst"])
        of, at, far, step = np.arange(len(asked)), index.get_indexer(asked["reached"]), np.zeros(len(asked), np.int64), 1
        while len(of):
            on = jump[at] >= 0
            new = of[on], jump[at[on]], far[on] + step
            order = np.argsort(new[2], kind="stable")
            key, first = np.unique(new[0][order] * n + new[1][order], return_index=True)
            fresh = order[first[~np.isin(key, of * n + at)]]  # a cycle comes back
            if not len(fresh):
                break
            of, at, far = (np.concatenate([x, y[fresh]]) for x, y in zip((of, at, far), new, strict=True))
            jump, step = np.where(jump >= 0, jump[jump], -1), 2 * step
        of, at, far = of[len(asked) :], at[len(asked) :], far[len(asked) :]
        return pa.table({"node": pa.array(asked["node"].to_numpy()[of], node_type), "reached": pa.array(edges["src"].to_numpy()[at], type_), "distance": pa.array((asked["distance"].to_numpy()[of] + far).astype(np.int32))})

    kind = {c: entries.schema[c].dataType.simpleString() for c in ("node", "reached")}
    return left.groupBy("range", "block").cogroup(right.groupBy("range", "block")).applyInArrow(tell, f"node {kind['node']}, reached {kind['reached']}, distance int")


def walk(edges: DataFrame, start: DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """node, reached, distance from start (node) along edges (src, dst), the nearest way.

    For any graph.  Stretches without branches are followed in ranges of nodes, and from
    range to range by jumps that double, so they take rounds by the logarithm of the ranges; each branching on the way is a
    round more.  What is reached again by no nearer way isn't followed, so cycles
    end.  With max_depth the walk goes step by step and stops there.
    """
    reached = checkpointed(start.select("node", F.col("node").alias("reached"), F.lit(0).alias("distance")).distinct())
    if max_depth is not None:
        frontier = reached
        for step in range(1, max_depth + 1):
            onward = frontier.join(edges, F.col("reached") == F.col("src")).select("node", F.col("dst").alias("reached"), F.lit(step).alias("distance")).distinct()
            frontier = checkpointed(onward.join(reached.select("node", "reached"), ["node", "reached"], "left_anti"))
            if frontier.isEmpty():
                break
            reached = checkpointed(reached.unionByName(frontier))
        return reached
    edges = checkpointed(edges.select("src", "dst").distinct())
    branching = edges.groupBy("src").count().where("count > 1").select("src")
    jumps = Jumps(edges.join(branching, "src", "left_anti"))
    forks = checkpointed(edges.join(branching, "src", "left_semi"))
    frontier = reached
    while True:
        frontier = jumps.follow(frontier)
        onward = frontier.join(forks, F.col("reached") == F.col("src")).select("node", F.col("dst").alias("reached"), (F.col("distance") + 1).alias("distance"))
        reached = checkpointed(_merged(reached, frontier))
        known = reached.select("node", "reached", F.col("distance").alias("known"))
        nearer = _merged(onward).join(known, ["node", "reached"], "left").where("known IS NULL OR distance < known").drop("known")
        frontier = checkpointed(nearer)
        if frontier.isEmpty():
            return reached


def chain_ends(edges: DataFrame) -> DataFrame:
    """node, last, length, cyclic of every node of a graph (src, dst) each of whose nodes
    leads to one other at most: the end of its chain and the steps to it; null, and
    cyclic, for a chain that comes back to itself.

    Ranges of nodes are followed side by side first: each task takes its own nodes to
    where they leave its range.  Only nodes that are reached from another range are then
    linked by pointers that double, so n of them take log2(n) rounds at most.  Of
    several ways on, the smallest is taken.
    """
    edges = checkpointed(edges.where("src IS NOT NULL").select("src", "dst"))  # ranges are sampled
    own = checkpointed(_left_ranges(edges.where("dst IS NOT NULL")))
    alone = edges.where("dst IS NULL").select(F.col("src").alias("node"))
    entered = checkpointed(own.where("NOT cyclic").select(F.col("last").alias("node")).unionByName(alone).distinct())
    links = entered.join(own.withColumnRenamed("src", "node"), "node", "left")  # nodes that lead nowhere are done
    ends = checkpointed(links.select("node", F.coalesce("last", "node").alias("last"), F.coalesce("length", F.lit(0)).cast("long").alias("length"), F.col("last").isNull().alias("done"), F.coalesce("cyclic", F.lit(False)).alias("cyclic")))
    ends = _doubled(ends)
    far = ends.select(F.col("node").alias("last"), F.col("last").alias("end"), F.col("length").alias("more"), F.col("cyclic").alias("turns"))
    whole = own.join(far, "last", "left").select(F.col("src").alias("node"), F.col("end").alias("last"), (F.col("length") + F.col("more")).alias("length"), (F.col("cyclic") | F.coalesce("turns", F.lit(False))).alias("cyclic"))
    whole = whole.unionByName(ends.where("done AND length = 0").select("node", "last", "length", "cyclic"))
    known = lambda c: F.when(~F.col("cyclic"), F.col(c)).alias(c)
    return whole.select("node", known("last"), known("length"), "cyclic")


#: Edges of a range that a task follows at once, by the mean.
RANGE = 1 << 19


def _left_ranges(edges: DataFrame, *, whole: bool = False) -> DataFrame:
    """src, last, length, cyclic (whole: dst and the number of the range too, and a bound of what a cyclic one leads to as its length): for each node with a way on the first node outside its
    range of nodes, or that leads nowhere, and the steps to it; cyclic where it never
    leaves.  edges are a table."""
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // RANGE))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held or not sum(b.num_rows for b in held):
            return
        both = pa.Table.from_batches(held).to_pandas().groupby("src", sort=False, as_index=False)["dst"].min()
        dst = both["dst"].to_numpy()
        onward = pd.Index(both["src"]).get_indexer(dst)  # -1 where the next node is elsewhere
        n, stays = len(onward), onward >= 0
        at, length = np.where(stays, onward, np.arange(n)), stays.astype(np.int64)
        for _ in range(n.bit_length()):
            length, at = length + length[at], at[at]
        out = pd.DataFrame({"src": both["src"], "last": dst[at], "length": length + 1, "cyclic": stays[at]})
        schema = pa.schema([held[0].schema.field("src"), held[0].schema.field("src").with_name("last"), ("length", pa.int64()), ("cyclic", pa.bool_())])
        if whole:
            # what a cycle's node leads to is no more than all that leads to its cycle
            least, hop = np.arange(n), np.where(stays, onward, np.arange(n))
            for _ in range(n.bit_length()):
                least, hop = np.minimum(least, least[hop]), hop[hop]
            turns = stays[at]
            out.loc[turns, "length"] = np.bincount(least[at[turns]], minlength=n)[least[at[turns]]]
            out["dst"], out["range"] = dst, TaskContext.get().partitionId()
            schema = schema.append(held[0].schema.field("src").with_name("dst")).append(pa.field("range", pa.int32()))
        yield from pa.Table.from_pandas(out, schema, preserve_index=False).to_batches(max_chunksize=1 << 16)

    kind = edges.schema["src"].dataType.simpleString()
    return edges.repartitionByRange(parts, "src").mapInArrow(follow, f"src {kind}, last {kind}, length long, cyclic boolean" + (f", dst {kind}, range int" if whole else ""))


def _doubled(ends: DataFrame) -> DataFrame:
    """ends (node, last, length, done, cyclic), each led on to where its chain ends; cyclic where it has none."""
    n, steps = ends.count(), 1
    while steps <= n:
        if ends.where("NOT done AND NOT cyclic").isEmpty():
            break
        onward = ends.select(F.col("node").alias("last"), F.col("last").alias("next"), F.col("length").alias("more"), F.col("done").alias("ended"), F.col("cyclic").alias("turns"))
        # a node whose range never lets it go has no next one: it turns, as do those that lead to it
        moved = ends.where("NOT cyclic").join(onward, "last").select("node", F.col("next").alias("last"), (F.col("length") + F.col("more")).alias("length"), F.col("ended").alias("done"), F.col("turns").alias("cyclic"))
        ends, steps = checkpointed(moved.unionByName(ends.where("cyclic"))), 2 * steps
    return ends.withColumn("cyclic", ~F.col("done"))


def _nested(rows: DataFrame, by: list[str], order: str, depth: str, opening: Column, closing: str) -> DataFrame:
    """by, json: each tree's rows in order of a walk from the top down, as nested text.

    What a row closes follows from the depth of the next one, so any depth takes one
    window and one aggregate.  A tree is one value, so its rows fit in a task.
    """
    following = F.lead(depth).over(Window.partitionBy(*by).orderBy(order))
    after = rows.withColumn("__next", following)
    # the last row closes everything, one before a child nothing
    closed = F.col(depth) - F.coalesce("__next", F.lit(1)) + 1
    comma = F.when(F.col("__next") <= F.col(depth), ",").otherwise("")
    pieces = after.withColumn("__text", F.concat(opening, F.repeat(F.lit(closing), closed.cast("int")), comma))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__text").alias("t")))), lambda x: x["t"]), "")
    return pieces.groupBy(*by).agg(whole.alias("json"))


def nested_tree(rows: DataFrame, cells: list[str]) -> DataFrame:
    """doc, json: each document's tree as one nested value, a list of nodes with cells
    and children.

    rows: doc, row_no, depth (one more than its parent's, 1 at the top, as
    ancestors_by_stack has it) and cells.
    """
    node = F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})
    opening = F.concat(F.expr("left(%s, length(%s) - 1)" % (("__node",) * 2)), F.lit(',"children":['))
    out = _nested(rows.withColumn("__node", node), ["doc"], "row_no", "depth", opening, "]}")
    return out.select("doc", F.concat(F.lit("["), "json", F.lit("]")).alias("json"))


def tree_of_paths(paths_: DataFrame, *, by: str = "doc", order: str = "ord", path: str = "path", sep: str = " > ") -> DataFrame:
    """by, json: the paths of each group as one nested object of names; equal beginnings
    are one node, and names stand in the order in which they came first."""
    steps = F.filter(F.transform(F.split(F.coalesce(F.col(path), F.lit("")), F.lit(sep)), lambda x: F.trim(x)), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("__s")), lambda i: F.slice("__s", F.lit(1), i))
    seen = paths_.select(by, order, steps.alias("__s")).where(F.size("__s") > 0).select(by, order, F.explode(prefixes).alias("p"))
    nodes = seen.groupBy(by, "p").agg(F.min(order).alias("first"))
    # a node comes after its parent, its place among others is that of its first path
    above = nodes.select(by, "p", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.slice("p", F.lit(1), i))).alias("at", "q"))
    ranks = above.join(nodes.select(by, F.col("p").alias("q"), F.col("first").alias("f")), [by, "q"])
    key = F.transform(F.array_sort(F.collect_list(F.struct("at", "f", F.element_at("q", -1).alias("n")))), lambda x: F.struct(x["f"], x["n"]))
    placed = ranks.groupBy(by, "p").agg(key.alias("__key")).withColumn("depth", F.size("p"))
    quoted = F.expr("substring(to_json(array(element_at(p, -1))), 2, length(to_json(array(element_at(p, -1)))) - 2)")
    out = _nested(placed, [by], "__key", "depth", F.concat(quoted, F.lit(":{")), "}")
    return out.select(by, F.concat(F.lit("{"), "json", F.lit("}")).alias("json"))


def paths(df: DataFrame, label: str, *, sep: str = " > ", width: int | None = None) -> DataFrame:
    """df (doc, row_no, ancestors) with bom_path: labels from the top to the row."""
    text = F.col(label) if width is None else F.substring(label, 1, width)
    names = df.select("doc", F.col("row_no").alias("ancestor"), text.alias("__label"))
    steps = closure(df).join(names, ["doc", "ancestor"])
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), F.col("__label").alias("l")))), lambda x: x["l"]), sep)
    return df.join(steps.groupBy("doc", "row_no").agg(path.alias("bom_path")), ["doc", "row_no"])


def subtree_end(df: DataFrame, *, doc: str = "doc", order: str = "row_no", level: str = "level") -> DataFrame:
    """df with subtree_end: the next row of the same level or a smaller one, null at the end."""
    out = _nearest_smaller(df, "__smaller", doc=doc, order=order, level=level, below=True)
    same = F.lead(order).over(Window.partitionBy(doc, level).orderBy(order))
    return out.withColumn("subtree_end", F.least("__smaller", same)).drop("__smaller")


def propagate(df: DataFrame, changed: str, *, doc: str = "doc", order: str = "row_no") -> DataFrame:
    """df (with parents by level in ``ancestors``-free form) with touched: the row
    or a row below it changed.  df: doc, row_no, level, changed."""
    ended = subtree_end(df, doc=doc, order=order)
    # a subtree is a range of rows: it holds a change if the running count grows in it
    running = F.sum(F.col(changed).cast("int")).over(_sofar(doc, order))
    counted = ended.withColumn("__upto", running).withColumn("__own", F.col("__upto") - F.col(changed).cast("int"))
    ends = counted.select(F.col(doc).alias("__d"), F.col(order).alias("__r"), F.col("__own").alias("__end"))
    joined = counted.join(ends, (F.col(doc) == F.col("__d")) & (F.col("subtree_end") == F.col("__r")), "left")
    total = F.max("__upto").over(Window.partitionBy(doc))
    return joined.withColumn("touched", F.coalesce("__end", total) > F.col("__own")).drop("__upto", "__own", "__end", "__d", "__r", "subtree_end")


def propagated_cells(df: DataFrame) -> DataFrame:
    """df (touched, change_point, change_reason, new_no, kind) with the cells of
    assemblies that change only by a part below filled in."""
    inherits = F.col("touched") & F.coalesce(F.col("change_point"), F.lit("-")).isin("-", "하위 부품 변경")
    or_mark = lambda c, mark: F.when(inherits & F.coalesce(F.col(c), F.lit("-")).isin("-"), mark).otherwise(F.col(c))
    return df.withColumns({
        "new_no": or_mark("new_no", "←"),
        "kind": or_mark("kind", "Common"),
        "change_reason": F.when(inherits, "하위부품 변경").otherwise(F.col("change_reason")),
        "change_point": F.when(inherits, "하위 부품 변경").otherwise(F.col("change_point")),
    })


def with_missing_assemblies(parts: DataFrame, tree: DataFrame) -> DataFrame:
    """The assemblies above some parts that aren't among them, each once a group.

    parts: grp, doc, row_no; tree: closure's rows.  Returns grp, doc, row_no,
    inserted, the rows of the whole list.
    """
    above = parts.join(tree, ["doc", "row_no"]).where("distance > 0").select("grp", "doc", F.col("ancestor").alias("row_no")).distinct()
    missing = above.join(parts.select("grp", "doc", "row_no"), ["grp", "doc", "row_no"], "left_anti")
    return parts.select("grp", "doc", "row_no", F.lit(False).alias("inserted")).unionByName(missing.withColumn("inserted", F.lit(True)))


def search_tree(df: DataFrame, matches: Column, *, max_level: int | None = None) -> DataFrame:
    """Rows that match, or have a row below that does; df: doc, row_no, level, ancestors."""
    hit = closure(df.where(matches)).select("doc", F.col("ancestor").alias("row_no")).distinct()
    found = df.join(hit, ["doc", "row_no"], "left_semi")
    return found if max_level is None else found.where(F.col("level") <= max_level)


def reorder(parts: DataFrame, skeleton: DataFrame, key: str) -> DataFrame:
    """parts with position: the order of the skeleton's first row of the key; unknown keys behind, in their own order."""
    first = skeleton.groupBy(key).agg(F.min("row_no").alias("position"))
    return parts.join(first, key, "left").withColumn("position", F.coalesce("position", F.lit(999_999)))


def module_paths(df: DataFrame, *, doc: str = "doc", order: str = "row_no", module: str = "module", level: str = "level") -> DataFrame:
    """df with bom_path: the modules of the stack down to each row's own; a row
    without a module has none and leaves the stack as it is."""
    named = df.where(F.trim(F.coalesce(F.col(module), F.lit(""))) != "").select(
        F.col(doc).alias("doc"), F.col(order).alias("row_no"), F.greatest(F.col(level), F.lit(1)).alias("level"), F.trim(module).alias("__module")
    )
    found = paths(ancestors_by_stack(named), "__module").select(F.col("doc").alias("__d"), F.col("row_no").alias("__r"), "bom_path")
    joined = df.join(found, (F.col(doc) == F.col("__d")) & (F.col(order) == F.col("__r")), "left").drop("__d", "__r")
    return joined.withColumn("bom_path", F.coalesce("bom_path", F.lit("")))


def children(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, children (in order) of some nodes along edges (src, dst)."""
    return nodes.join(edges, F.col("node") == F.col("src")).groupBy("node").agg(F.array_sort(F.collect_set("dst")).alias("children"))
