"""Where the nodes of trees are drawn: tidy trees, rows of what is left, collisions, gates, boxes and scenes.

All operators are keyed by tree_id and place any number of trees at once. Positions are centres (cx) and tops (cy).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.operators import graph
from causeway.storage import stored

# Widths and heights of what is drawn, and the distances between rows and columns.
EVENT_SIZE, BASIC_SIZE, GATE_SIZE = (140, 56), (110, 110), (60, 52)
EVENT_DROP, GATE_DROP = 90, 100
ROWS_BELOW, ROW_DROP, COLUMN_STEP = 200, 140, 200
ROW_KINDS = ("top", "intermediate", "basic", "other")
LEAST_GAP, SIDE_STEP, TRIES, BAND = 112.0, 67.2, 10, 10
SCENE_WIDTH, SCENE_HEIGHT, SCENE_PAD = 120.0, 80.0, 6.0


def footprint(kind: Column) -> tuple[Column, Column]:
    """(width, height) of what a node of a type takes up."""
    return tuple(F.when(kind == "gate", float(GATE_SIZE[i])).when(kind == "basic", float(BASIC_SIZE[i])).otherwise(float(EVENT_SIZE[i])) for i in (0, 1))


def tidy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tree_id, id, type, cx, cy, left, depth): each tree from its root down, a node over the middle of its subtree, its children side by
    side in document order, each as wide as its own subtree (R7).

    Level by level, by the running sum of the widths of the siblings before a node. A node that several parents share is placed where it is reached
    first, of several places of one level in the rightmost; so cycles end. What a level needs of a node stands beside its edge, and only nodes with
    children are gone on from.
    """
    nodes, links = stored(nodes.select("tree_id", "id", "type", "pos")), stored(edges.groupBy(*graph.EDGE).agg(F.min("pos").alias("pos")))
    inner = links.select("tree_id", F.col("target").alias("id"), F.lit(True).alias("inner")).distinct()
    kept = graph.distinct_widths(nodes, links).join(nodes.select("tree_id", "id", "type"), ["tree_id", "id"]).join(inner, ["tree_id", "id"], "left")
    widths = stored(kept.withColumn("inner", F.coalesce("inner", F.lit(False))))
    before = Window.partitionBy("tree_id", "target").orderBy("pos", "source").rowsBetween(Window.unboundedPreceding, -1)
    wide = links.join(widths.withColumnRenamed("id", "source"), ["tree_id", "source"])
    offset = F.coalesce(F.sum("width").over(before), F.lit(0)).cast("double")
    kids = stored(wide.select("tree_id", F.col("target").alias("id"), F.col("source").alias("kid"), F.col("type").alias("kid_type"), "inner", offset.alias("offset"), "width"))
    single = not kids.groupBy("tree_id", "kid").count().filter("count > 1").limit(1).count()
    top = graph.root_choice(nodes, links, widths.select("tree_id", "id", "width")).select("tree_id", F.col("root").alias("id")).join(widths, ["tree_id", "id"])
    zero = F.lit(0.0)
    level = stored(top.select("tree_id", "id", "type", "inner", "width", (-F.col("width") / 2).alias("left"), zero.alias("cy"), F.lit(0).alias("depth"), F.col("id").alias("origin")))
    levels = [level]
    while level.filter("inner").limit(1).count():
        drop = F.when(F.col("type") == "gate", float(GATE_DROP)).otherwise(float(EVENT_DROP))
        above = level.filter("inner").select("tree_id", "id", "left", (F.col("cy") + drop).alias("cy"), "origin")
        new = above.join(kids, ["tree_id", "id"]).select("tree_id", F.col("kid").alias("id"), F.col("kid_type").alias("type"), "inner", "width", (F.col("left") + F.col("offset")).alias("left"), "cy", "origin")
        if single:  # no two ways meet, but a way can come back to its start
            new = new.filter("id <> origin")
        else:
            placed = reduce(DataFrame.unionByName, [x.select("tree_id", "id") for x in levels])
            new = new.groupBy("tree_id", "id").agg(F.max(F.struct("left", "cy", "width", "origin", "type", "inner")).alias("p")).select("tree_id", "id", "p.type", "p.inner", "p.width", "p.left", "p.cy", "p.origin")
            new = new.join(placed, ["tree_id", "id"], "left_anti")
        level = stored(new.withColumn("depth", F.lit(len(levels))))
        levels.append(level)
    out = reduce(DataFrame.unionByName, [x.drop("origin", "inner") for x in levels])
    return out.select("tree_id", "id", "type", (F.col("left") + F.col("width") / 2).alias("cx"), "cy", "left", "depth")


def rows_below(nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """(tree_id, id, type, cx, cy, left, depth): nodes that `placed` has not, in rows by type under it, in document order (R8). left and depth put them after the placed ones."""
    rest = nodes.join(placed.select("tree_id", "id"), ["tree_id", "id"], "left_anti")
    kind = F.when(F.col("type").isin(*ROW_KINDS[:-1]), F.col("type")).otherwise(ROW_KINDS[-1])
    place = F.array_position(F.array(*map(F.lit, ROW_KINDS)), kind).cast("int")
    rest = rest.select("tree_id", "id", "type", "pos", place.alias("row"))
    counts = rest.groupBy("tree_id", "row").agg(F.count("*").alias("n"))
    lines = counts.withColumn("line", F.row_number().over(Window.partitionBy("tree_id").orderBy("row")) - 1)  # four rows of a tree at most
    lowest = placed.groupBy("tree_id").agg(F.greatest(F.max("cy"), F.lit(0.0)).alias("lowest"))
    nth = F.row_number().over(Window.partitionBy("tree_id", "row").orderBy("pos", "id")) - 1
    found = rest.withColumn("nth", nth).join(lines, ["tree_id", "row"]).join(lowest, "tree_id", "left")
    cx = -(F.col("n") - 1) * float(COLUMN_STEP) / 2 + F.col("nth") * float(COLUMN_STEP)
    cy = F.coalesce("lowest", F.lit(0.0)) + float(ROWS_BELOW) + F.col("line") * float(ROW_DROP)
    return found.select("tree_id", "id", "type", cx.alias("cx"), cy.alias("cy"), F.col("nth").cast("double").alias("left"), (F.lit(1 << 20) + F.col("line")).cast("int").alias("depth"))


def _candidates(cx: float) -> list[float]:
    """Where a node is tried: at its place, then left and right of it, further away each time; the last is taken as it is."""
    return [cx + (1 if n % 2 == 0 else -1) * -(-n // 2) * SIDE_STEP for n in range(TRIES)]


def _spread(table: pa.Table) -> pa.Table:
    """One cluster of a band, (.., cx, order): each node in its turn goes to the first place that no earlier one is too near to."""
    order = np.argsort(table.column("turn").to_numpy(), kind="stable")
    cx, taken = table.column("cx").to_numpy().copy(), []
    for i in order.tolist():
        for x in (tried := _candidates(cx[i])):
            at = bisect_left(taken, x)
            if x is tried[-1] or not any(abs(y - x) < LEAST_GAP for y in taken[max(0, at - 1) : at + 1]):
                break
        insort(taken, x)
        cx[i] = x
    return table.select(["tree_id", "id"]).append_column("cx", pa.array(cx))


def apart(placed: DataFrame) -> DataFrame:
    """placed with cx changed where nodes of a band would lie over each other (W6): a node that comes to less than LEAST_GAP of an earlier one of its band
    is moved aside, by turns to the left and the right.

    What comes earlier: by `left`, then `depth` (depth-first order of a tidy tree), rows below after it. Bands are cut into clusters
    that no move can reach across; only clusters with two nodes too near each other are gone through one by one, in a task each. Bands without such nodes
    are not cut.
    """
    reach = 2 * (TRIES // 2) * SIDE_STEP + LEAST_GAP
    band = F.floor(F.col("cy") / BAND + 0.5) * BAND
    across = Window.partitionBy("tree_id", "band").orderBy("cx", "id")
    steps = lambda rows: rows.withColumn("step", F.col("cx") - F.lag("cx").over(across))
    placed_in = placed.withColumn("band", band)
    crowded = stored(steps(placed_in.select("tree_id", "id", "cx", "band")).filter(F.col("step") < LEAST_GAP).select("tree_id", "band").distinct())
    if not crowded.limit(1).count():
        return placed
    cut = F.coalesce((F.col("step") >= reach).cast("int"), F.lit(0))
    clusters = steps(placed_in.join(crowded, ["tree_id", "band"], "left_semi")).withColumn("near", F.coalesce("step", F.lit(reach)) < LEAST_GAP)
    clusters = stored(clusters.withColumn("cluster", F.sum(cut).over(across.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("step"))
    keys = ["tree_id", "band", "cluster"]
    tight = clusters.groupBy(*keys).agg(F.bool_or("near").alias("tight")).filter("tight").select(*keys)
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy((F.col("depth") >= 1 << 20), "left", "depth", "id")).alias("turn")
    moved = clusters.join(tight, keys).select(*keys, "id", "cx", turn).groupBy(*keys).applyInArrow(_spread, "tree_id string, id string, cx double")
    return placed.join(moved.withColumnRenamed("cx", "_moved"), ["tree_id", "id"], "left").withColumn("cx", F.coalesce("_moved", "cx")).drop("_moved")


def laid_out(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tree_id, id, type, cx, cy): tidy trees, what they do not reach in rows below, and nothing over anything else."""
    nodes = stored(nodes)
    tree = tidy(nodes, edges)  # levels that are written already
    return apart(tree.unionByName(stored(rows_below(nodes, tree)))).select("tree_id", "id", "type", "cx", "cy")


def boxes(placed: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(tree_id, [component,] min_x, min_y, max_x, max_y) of what the nodes take up, by tree, or by component of groups (tree_id, id, component)."""
    wide, high = footprint(F.col("type"))
    found, keys = placed, ["tree_id"]
    if groups is not None:
        found, keys = placed.join(groups, ["tree_id", "id"], "left").withColumn("component", F.coalesce("component", "id")), ["tree_id", "component"]
    return found.groupBy(*keys).agg(F.min(F.col("cx") - wide / 2).alias("min_x"), F.min("cy").alias("min_y"), F.max(F.col("cx") + wide / 2).alias("max_x"), F.max(F.col("cy") + high).alias("max_y"))


def scene(placed: DataFrame, edges: DataFrame, *, width: float = SCENE_WIDTH, height: float = SCENE_HEIGHT, pad: float = SCENE_PAD) -> tuple[DataFrame, DataFrame]:
    """Shapes (tree_id, id, kind, x, y, w, h) and lines (tree_id, source, target, x1, y1, x2, y2) of each tree, fitted into a picture.

    An ellipse has its middle and radii, other shapes their corner and size.
    """
    box = boxes(placed)
    scale = F.least((width - 2 * pad) / F.greatest(F.col("max_x") - F.col("min_x"), F.lit(1.0)), (height - 2 * pad) / F.greatest(F.col("max_y") - F.col("min_y"), F.lit(1.0)))
    wide, high = footprint(F.col("type"))
    seen = placed.join(box.select("tree_id", "min_x", "min_y", scale.alias("scale")), "tree_id")
    x, y = lambda v: pad + (v - F.col("min_x")) * F.col("scale"), lambda v: pad + (v - F.col("min_y")) * F.col("scale")
    round_ = F.col("type") == "basic"
    kind = F.when(round_, "ellipse").when(F.col("type") == "gate", "gate").otherwise("rect")
    shapes = seen.select(
        "tree_id", "id", kind.alias("kind"), F.when(round_, x(F.col("cx"))).otherwise(x(F.col("cx") - wide / 2)).alias("x"), F.when(round_, y(F.col("cy") + high / 2)).otherwise(y(F.col("cy"))).alias("y"),
        F.when(round_, wide / 2).otherwise(wide).__mul__(F.col("scale")).alias("w"), F.when(round_, high / 2).otherwise(high).__mul__(F.col("scale")).alias("h"),
    )
    low = seen.select("tree_id", F.col("id").alias("source"), x(F.col("cx")).alias("x1"), y(F.col("cy") + high).alias("y1"))
    up = seen.select("tree_id", F.col("id").alias("target"), x(F.col("cx")).alias("x2"), y(F.col("cy")).alias("y2"))
    return shapes, edges.select("tree_id", "source", "target").join(low, ["tree_id", "source"]).join(up, ["tree_id", "target"]).select("tree_id", "source", "target", "x1", "y1", "x2", "y2")


def gate_places(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tree_id, id, gx, gy): where the gate of each gated node (x, y) with children stands: halfway between it and the mean of its children."""
    at = nodes.select("tree_id", F.col("id").alias("source"), F.coalesce("x", F.lit(0.0)).alias("_x"), F.coalesce("y", F.lit(0.0)).alias("_y"))
    below = edges.join(at, ["tree_id", "source"]).groupBy("tree_id", F.col("target").alias("id")).agg(F.avg("_x").alias("mean_x"), F.avg("_y").alias("mean_y"))
    gated = nodes.filter("gate <> ''").join(below, ["tree_id", "id"])
    return gated.select("tree_id", "id", ((F.coalesce("x", F.lit(0.0)) + F.col("mean_x")) / 2).alias("gx"), ((F.coalesce("y", F.lit(0.0)) + F.col("mean_y")) / 2).alias("gy"))


def overlay_places(overlays: DataFrame) -> DataFrame:
    """overlays (tree_id, id, parent, kind, pos) with `index`: the place of each among those of its parent, by kind and then in document order, from 0."""
    n = F.row_number().over(Window.partitionBy("tree_id", "parent").orderBy(F.coalesce("kind", F.lit("")), "pos", "id")) - 1
    return overlays.withColumn("index", n.cast("long"))
