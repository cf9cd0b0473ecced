"""Edit histories: what a tree shows after each edit, undo and redo.

Events of a session (session_id, seq, kind, version): "edit" shows a new version and can be undone; "apply" does the same with a document edited by hand
(`document`), unless that is no JSON; "sync" writes the version that is shown anew, without a step that can be undone; "undo" and "redo" go a step back and forth as long
as there are any. An edit after an undo drops what could have been redone.

The versions that can be reached are slots in a row, and the history is a place in it: an edit writes the next slot and ends the row there, undo and redo
move the place within the row. So a fold over a session's events needs no more than two numbers, the place and the last slot; which version a slot holds
is a matter of who wrote it last. The fold runs over sorted partitions batch by batch, and holds these numbers only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.sources import trees

KINDS = ("edit", "apply", "sync", "undo", "redo")


def valid_edits(events: DataFrame) -> DataFrame:
    """events with `valid`: false for documents applied by hand that are no JSON."""
    return events.withColumn("valid", (F.col("kind") != "apply") | F.try_parse_json("document").isNotNull())


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(session_id, seq, slot, last_slot, moved) of (session_id, seq, step), in the order of a session's events."""
    session, place, last = None, 0, 0
    for batch in batches:
        ids, steps = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        slots, lasts, moved = (np.zeros(len(ids), np.int64) for _ in range(3))
        for i, (own, step) in enumerate(zip(ids, steps, strict=True)):
            if own != session:
                session, place, last = own, 0, 0
            before = place
            if step == 2:  # an edit
                place = last = place + 1
            elif step:
                place = min(max(place + step, 0), last)
            slots[i], lasts[i], moved[i] = place, last, place - before
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(slots), pa.array(lasts), pa.array(moved)], names=["session_id", "seq", "slot", "last_slot", "moved"])


def replayed(events: DataFrame) -> DataFrame:
    """(session_id, seq, kind, changed, slot, can_undo, can_redo, shown): the version that is shown after each event of
    events (session_id, seq, kind, version, valid) (M43, M44, M57). Before the first edit, and after all are undone, it is null or what a sync wrote there."""
    step = F.when(~F.col("valid"), 0).when(F.col("kind").isin("edit", "apply"), 2).when(F.col("kind") == "undo", -1).when(F.col("kind") == "redo", 1).otherwise(0)
    steps = events.select("session_id", "seq", step.alias("step")).repartition("session_id").sortWithinPartitions("session_id", "seq")
    placed = steps.mapInArrow(_folded, "session_id string, seq long, slot long, last_slot long, moved long").join(events, ["session_id", "seq"])
    writes = F.col("valid") & F.col("kind").isin("edit", "apply", "sync")
    latest = Window.partitionBy("session_id", "slot").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shown = F.last(F.when(writes, F.col("version")), ignorenulls=True).over(latest)
    return placed.select(
        "session_id", "seq", "kind", (writes | (F.col("moved") != 0)).alias("changed"), "slot", (F.col("slot") > 0).alias("can_undo"), (F.col("slot") < F.col("last_slot")).alias("can_redo"), shown.alias("shown")
    )


def in_own_shape(parsed: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tree_id, shape, document): edited trees written in the shape that their documents (parsed: tree_id, shape, ...) had; what had none becomes a raw list."""
    kinds = parsed.select("tree_id", F.when(F.col("shape") == "map", "map").when(F.col("shape") == "graph", "graph").otherwise("raw").alias("shape"))
    out = []
    for shape, write in (("raw", trees.to_raw), ("map", trees.to_map), ("graph", trees.to_graph)):
        own = kinds.filter(F.col("shape") == shape).select("tree_id")
        out.append(write(nodes.join(own, "tree_id", "left_semi"), edges.join(own, "tree_id", "left_semi")).select("tree_id", F.lit(shape).alias("shape"), "document"))
    return out[0].unionByName(out[1]).unionByName(out[2])
