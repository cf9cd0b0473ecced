"""Recursive and structural operators over (nodes, edges).

nodes: tree_id, id, label, type, gate, pos; edges: tree_id, source, target, pos, from child (cause) to parent
(effect). `pos` is the place in the document; what is "first" is first by it. All operators work on any
number of trees at once and are keyed by tree_id. Loops go level by level, keep only what is new, and write
each level to the shared folder, so neither lineage nor a visited set on the driver grows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.storage import stored

EDGE = ["tree_id", "source", "target"]
LEAF_WIDTH = 160


def _walk(steps: DataFrame, start: DataFrame, keys: list[str], most_levels: int | None = None) -> DataFrame:
    """(*keys, id, depth): what is reached from start (*keys, id) by steps (tree_id, id, next), by the shortest way; cycles end.

    Where every node has one step at most no two ways meet, and only a way's own start can come again: then nothing is held
    against what was reached before.
    """
    steps = stored(steps.distinct())
    single = not steps.groupBy("tree_id", "next").count().filter("count > 1").limit(1).count()
    frontier = stored(start.select(*keys, "id", F.col("id").alias("origin"), F.lit(0).alias("depth")).distinct())
    levels = [frontier]
    while most_levels is None or len(levels) <= most_levels:
        new = frontier.join(steps, ["tree_id", "id"]).select(*keys, F.col("next").alias("id"), "origin", F.lit(len(levels)).alias("depth")).distinct()
        if single:
            new = new.filter("id <> origin")
        else:
            reached = reduce(DataFrame.unionByName, levels)
            new = new.join(reached.select(*keys, "id"), [*keys, "id"], "left_anti")
        frontier = stored(new)
        if not frontier.limit(1).count():
            break
        levels.append(frontier)
    return reduce(DataFrame.unionByName, levels).drop("origin")


def closure(edges: DataFrame, roots: DataFrame, *, most_levels: int | None = None) -> DataFrame:
    """(tree_id, root, id, depth): every descendant of roots (tree_id, root), by its shortest distance; cycles end."""
    down = edges.select("tree_id", F.col("target").alias("id"), F.col("source").alias("next"))
    return _walk(down, roots.select("tree_id", "root", F.col("root").alias("id")), ["tree_id", "root"], most_levels).select("tree_id", "root", "id", "depth")


def above_of(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(tree_id, start, id): each of starts (tree_id, start) and its ancestors, which are few beside what is below a node."""
    up = edges.select("tree_id", F.col("source").alias("id"), F.col("target").alias("next"))
    return _walk(up, starts.select("tree_id", "start", F.col("start").alias("id")), ["tree_id", "start"]).select("tree_id", "start", "id")


def reaches(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (tree_id, start, goal) with `reached`: is goal among start and its descendants (R2)? Walks up from the goals."""
    above = above_of(edges, pairs.select("tree_id", F.col("goal").alias("start")).distinct()).withColumnRenamed("start", "goal")
    hit = above.select("tree_id", F.col("id").alias("start"), "goal", F.lit(True).alias("hit"))
    return pairs.join(hit, ["tree_id", "start", "goal"], "left").select(*pairs.columns, F.coalesce("hit", F.lit(False)).alias("reached"))


def parents(edges: DataFrame) -> DataFrame:
    """(tree_id, id, parent): the target of each node's first edge (A3)."""
    return edges.groupBy("tree_id", F.col("source").alias("id")).agg(F.min_by("target", F.struct("pos", "target")).alias("parent"))


def ancestor_paths(edges: DataFrame, starts: DataFrame, separator: str = ">") -> DataFrame:
    """(tree_id, id, path, depth): each start and its first parents up to the root; a cycle ends at its second visit."""
    up = stored(parents(edges))
    done, open_ = [], starts.select("tree_id", "id", F.array("id").alias("path"), F.col("id").alias("at"))
    while True:
        step = stored(open_.join(up.withColumnRenamed("id", "at"), ["tree_id", "at"], "left").withColumn("parent", F.when(~F.array_contains("path", F.col("parent")), F.col("parent"))))
        done.append(step.filter("parent IS NULL").select("tree_id", "id", "path"))
        open_ = step.filter("parent IS NOT NULL").select("tree_id", "id", F.concat("path", F.array("parent")).alias("path"), F.col("parent").alias("at"))
        if not open_.limit(1).count():
            return reduce(DataFrame.unionByName, done).select("tree_id", "id", F.array_join("path", separator).alias("path"), (F.size("path") - 1).alias("depth"))


def children(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree_id, id, n_children, n_event_children, gate_child, parent) for every node."""
    types = nodes.select("tree_id", F.col("id").alias("source"), "type")
    below = edges.join(types, ["tree_id", "source"]).groupBy("tree_id", F.col("target").alias("id")).agg(
        F.count("*").alias("n_children"),
        F.count_if(F.col("type") != "gate").alias("n_event_children"),
        F.min_by(F.when(F.col("type") == "gate", F.col("source")), F.when(F.col("type") == "gate", F.col("pos"))).alias("gate_child"),
    )
    out = nodes.select("tree_id", "id").join(below, ["tree_id", "id"], "left").join(parents(edges), ["tree_id", "id"], "left")
    return out.select("tree_id", "id", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_event_children", F.lit(0)).alias("n_event_children"), "gate_child", "parent")


def summary(nodes: DataFrame, edges: DataFrame, branches: int = 12) -> DataFrame:
    """(tree_id, top_event, node_count, edge_count, type_counts, main_branches) (A1); branches in document order."""
    top = nodes.groupBy("tree_id").agg(
        F.min_by(F.struct("id", "label"), F.struct((F.col("type") != "top").cast("int"), "pos")).alias("top"),
        F.max((F.col("type") == "top").cast("int")).alias("has_top"),
        F.count("*").alias("node_count"),
    )
    kinds = nodes.groupBy("tree_id", "type").count().groupBy("tree_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "type", "count"))), ",").alias("type_counts"))
    tops = top.filter("has_top = 1").select("tree_id", F.col("top.id").alias("top_id"))
    below = edges.join(tops.withColumnRenamed("top_id", "target"), ["tree_id", "target"]).select("tree_id", F.col("source").alias("id"), F.lit(0).alias("way"))
    above = edges.join(tops.withColumnRenamed("top_id", "source"), ["tree_id", "source"]).select("tree_id", F.col("target").alias("id"), F.lit(1).alias("way"))
    sides = below.unionByName(above).distinct()
    way = sides.groupBy("tree_id").agg(F.min("way").alias("way"))
    named = sides.join(way, ["tree_id", "way"]).join(nodes, ["tree_id", "id"]).groupBy("tree_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "label"))), 1, branches).alias("b"))
    count = edges.groupBy("tree_id").agg(F.count("*").alias("edge_count"))
    out = top.join(count, "tree_id", "left").join(kinds, "tree_id").join(named, "tree_id", "left")
    return out.select("tree_id", F.col("top.label").alias("top_event"), "node_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"), "type_counts", F.array_join(F.transform(F.coalesce("b", F.array()), lambda x: x["label"]), "|").alias("main_branches"))


def expand_gates(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gates as nodes of their own between a parent and its children."""
    gated = nodes.filter("gate <> ''").select("tree_id", F.col("id").alias("target"), "gate", F.col("pos").alias("parent_pos"))
    gate_id = F.concat("target", F.lit("-gate"))
    under = edges.join(gated, ["tree_id", "target"])
    used = under.select("tree_id", "target", "gate", "parent_pos").distinct()
    rest = edges.join(gated.select("tree_id", "target"), ["tree_id", "target"], "left_anti")
    gates = used.select("tree_id", gate_id.alias("id"), F.col("gate").alias("label"), F.lit("gate").alias("type"), F.lit("").alias("gate"), (F.col("parent_pos") + F.lit(1 << 40)).alias("pos"))
    inner = under.select("tree_id", "source", gate_id.alias("target"), "pos")
    outer = used.select("tree_id", gate_id.alias("source"), "target", F.col("parent_pos").alias("pos"))
    return nodes.select("tree_id", "id", "label", "type", "gate", "pos").unionByName(gates), rest.select(*EDGE, "pos").unionByName(inner).unionByName(outer)


def collapse_gates(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gate nodes folded back into their parents: child -> gate -> parent becomes child -> parent."""
    gates = nodes.filter("type = 'gate'").select("tree_id", F.col("id").alias("g"), F.col("label").alias("gate_label"))
    out_of = edges.withColumnRenamed("source", "g").join(gates, ["tree_id", "g"]).groupBy("tree_id", "g").agg(F.min_by(F.struct(F.col("target").alias("parent"), "gate_label"), "pos").alias("o")).select("tree_id", "g", "o.parent", "o.gate_label")
    through = edges.withColumnRenamed("target", "g").join(out_of, ["tree_id", "g"]).select("tree_id", "source", F.col("parent").alias("target"), "pos")
    gate_ids = gates.select("tree_id", "g")
    plain = edges.join(gate_ids.withColumnRenamed("g", "source"), ["tree_id", "source"], "left_anti").join(gate_ids.withColumnRenamed("g", "target"), ["tree_id", "target"], "left_anti")
    labels = out_of.groupBy("tree_id", F.col("parent").alias("id")).agg(F.min("gate_label").alias("folded"))
    events = nodes.filter("type <> 'gate'").join(labels, ["tree_id", "id"], "left").select("tree_id", "id", "label", "type", F.coalesce("folded", "gate").alias("gate"), "pos")
    return events, plain.select(*EDGE, "pos").unionByName(through)


def gate_bundles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tree_id, id, gate, n_members, members) for each gated parent: its children's labels in document order."""
    gated = nodes.filter("gate <> ''").select("tree_id", F.col("id").alias("target"), "gate")
    labels = nodes.select("tree_id", F.col("id").alias("source"), "label")
    found = edges.join(gated, ["tree_id", "target"]).join(labels, ["tree_id", "source"])
    return found.groupBy("tree_id", F.col("target").alias("id"), "gate").agg(F.count("*").alias("n_members"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]), "|").alias("members"))


def subtree_widths(nodes: DataFrame, edges: DataFrame, leaf: int = LEAF_WIDTH) -> DataFrame:
    """(tree_id, id, width): a leaf has `leaf`, a node the sum of its children, a shared child counting once for each parent.

    Works up from the leaves; a node is done when all its children are. Nodes on or above a cycle are never
    done and get `leaf`.
    """
    return distinct_widths(nodes, stored(edges.select(*EDGE).distinct()), leaf)


def distinct_widths(nodes: DataFrame, edges: DataFrame, leaf: int = LEAF_WIDTH) -> DataFrame:
    """`subtree_widths` for edges that are stored already, each once."""
    ids = nodes.select("tree_id", "id")
    need = edges.groupBy("tree_id", F.col("target").alias("id")).agg(F.count("*").alias("need"))
    level = stored(ids.join(need, ["tree_id", "id"], "left_anti").withColumn("width", F.lit(leaf).cast("bigint")))
    levels, waiting = [level], stored(need.select("tree_id", "id", "need", F.lit(0).cast("bigint").alias("width")))
    while True:
        given = edges.join(level.withColumnRenamed("id", "source"), ["tree_id", "source"]).groupBy("tree_id", F.col("target").alias("id")).agg(F.count("*").alias("n"), F.sum("width").alias("w"))
        waiting = stored(waiting.join(given, ["tree_id", "id"], "left").select("tree_id", "id", (F.col("need") - F.coalesce("n", F.lit(0))).alias("need"), (F.col("width") + F.coalesce("w", F.lit(0))).alias("width")))
        level = waiting.filter("need = 0").select("tree_id", "id", "width")
        if not level.limit(1).count():
            break
        levels.append(level)
        waiting = waiting.filter("need > 0")
    return reduce(DataFrame.unionByName, levels).unionByName(waiting.select("tree_id", "id", F.lit(leaf).cast("bigint").alias("width")))


def linked(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, id, component): the smallest id that each end of edges (*keys, a, b) is connected to, within equal keys.

    Smallest label among neighbours, then the label of that label, until nothing changes: about log n rounds for chains.
    A round only sends labels that the round before has changed, and looks only at labels that have one of their own: those that a component has
    come down to, which most vertices share, are not joined. Joins are on unique keys at one side, so a hot vertex can be split.
    """
    keys = list(keys)
    pairs = stored(edges.filter("a <> b").select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = pairs.unionByName(pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    labels = moved = stored(both.groupBy(*keys, F.col("a").alias("id")).agg(F.min("b").alias("m")).select(*keys, "id", F.least("id", "m").alias("component")))
    while True:
        near = both.join(moved.withColumnRenamed("id", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("id")).agg(F.min("component").alias("m"))
        step = labels.join(near, [*keys, "id"], "left").select(*keys, "id", F.col("component").alias("was"), F.least("component", F.coalesce("m", "component")).alias("c"))
        jump = labels.filter("component < id").select(*keys, F.col("id").alias("c"), F.col("component").alias("j"))
        new = stored(step.join(jump, [*keys, "c"], "left").select(*keys, "id", "was", F.least("c", F.coalesce("j", "c")).alias("component")))
        labels, moved = new.drop("was"), new.filter("component <> was").drop("was")
        if not moved.limit(1).count():
            return labels


def components(edges: DataFrame) -> DataFrame:
    """(tree_id, id, component): the smallest id that each end of an edge is connected to."""
    return linked(edges.select("tree_id", F.col("source").alias("a"), F.col("target").alias("b")).filter("a <> b"), ["tree_id"])


def clean_gates(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without gates that nothing feeds, again and again until all gates are fed."""
    nodes, edges = stored(nodes), stored(edges)
    while True:
        fed = edges.select("tree_id", F.col("target").alias("id")).distinct()
        empty = stored(nodes.filter("type = 'gate'").join(fed, ["tree_id", "id"], "left_anti").select("tree_id", "id"))
        if not empty.limit(1).count():
            return nodes, edges
        nodes = stored(nodes.join(empty, ["tree_id", "id"], "left_anti"))
        for end in ("source", "target"):
            edges = edges.join(empty.withColumnRenamed("id", end), ["tree_id", end], "left_anti")
        edges = stored(edges)


def root_choice(nodes: DataFrame, edges: DataFrame, widths: DataFrame | None = None) -> DataFrame:
    """(tree_id, root): the widest top; without tops the first node that is no source; else the first (T5). widths: those of `subtree_widths`, where they are known."""
    widths = subtree_widths(nodes, edges) if widths is None else widths
    tops = nodes.filter("type = 'top'").join(widths, ["tree_id", "id"]).groupBy("tree_id").agg(F.min_by("id", F.struct(-F.col("width"), "pos")).alias("root"))
    tops = stored(tops)  # few rows: then trees without tops are told by a small table
    rest = nodes.join(tops.select("tree_id"), "tree_id", "left_anti")
    sources = edges.join(tops.select("tree_id"), "tree_id", "left_anti").select("tree_id", F.col("source").alias("id"), F.lit(1).alias("is_source")).distinct()
    rest = rest.join(sources, ["tree_id", "id"], "left").groupBy("tree_id").agg(F.min_by("id", F.struct(F.col("is_source").isNotNull(), "pos")).alias("root"))
    return tops.unionByName(rest)
