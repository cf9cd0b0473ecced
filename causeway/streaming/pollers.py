"""Imports that are polled for file by file, and edits that are validated when they have come to rest.

Poll events (POLLS): file_id, seq, kind ("start" of a poller, an "update" that it has read, or the "error" it ended with), job_id, status (done,
failed, processing, ...), progress, created_at. `seq` orders the events of a file.

A file has one poller at a time: a newer start takes the place of the older one, and what the older still says is not heard. Progress never falls.
A file that was once done stays imported: a later error does not make it failed (X12).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

POLLS = "file_id string, seq long, kind string, job_id string, status string, progress double, created_at timestamp"
STATE = "last_seq long, job_id string, status string, progress double, complete boolean"
OUT = f"file_id string, {STATE}"


def latched(polls: DataFrame) -> DataFrame:
    """OUT: the state of every file after its last event, from all of POLLS at once.

    Windows run in the order of seq within a file, and what is kept of a file is aggregated before it is shuffled again; a file's events stand in one
    task in any case, as each depends on the poller that is active before it, but no more than one of them is held.
    """
    order = Window.partitionBy("file_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = polls.withColumn("active", F.last(F.when(F.col("kind") == "start", F.col("job_id")), ignorenulls=True).over(order))
    heard = active.withColumn("heard", (F.col("kind") == "start") | F.coalesce(F.col("job_id") == F.col("active"), F.lit(False)))
    update = F.col("heard") & (F.col("kind") == "update")
    complete = heard.withColumn("complete", F.coalesce(F.max(update & (F.col("status") == "done")).over(order), F.lit(False)))
    told = F.when(update, F.col("status")).when(F.col("heard") & (F.col("kind") == "error") & ~F.col("complete"), F.lit("failed"))
    said = complete.withColumn("told", told).withColumn("progressed", F.when(update, F.col("progress")))
    return said.groupBy("file_id").agg(
        F.max("seq").alias("last_seq"), F.max_by("active", F.when(F.col("active").isNotNull(), F.col("seq"))).alias("job_id"), F.max_by("told", F.when(F.col("told").isNotNull(), F.col("seq"))).alias("status"),
        F.greatest(F.coalesce(F.max("progressed"), F.lit(0.0)), F.lit(0.0)).alias("progress"), F.max("complete").alias("complete"),
    )


def heard(state: tuple, event: tuple) -> tuple:
    """The state (last_seq, job_id, status, progress, complete) after an event (seq, kind, job_id, status, progress)."""
    last, job, status, progress, complete = state
    seq, kind, own, new, share = event
    if last is not None and seq <= last:
        return state  # it was here before
    if kind == "start":
        job = job if own is None else own
    elif own is not None and own == job:
        if kind == "update":
            progress, complete, status = max(progress, share or 0.0), complete or new == "done", status if new is None else new
        elif kind == "error" and not complete:
            status = "failed"
    return seq, job, status, progress, complete


class Pollers(StatefulProcessor):
    """One row of state for each file; a file that nothing was heard of for `idle_ms` after the watermark is forgotten."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        state = self.state.get() if self.state.exists() else (None, None, None, 0.0, False)
        events, latest = [], None
        for part in rows:
            part = part.astype(object).where(part.notna(), None)
            events += zip(part["seq"], part["kind"], part["job_id"], part["status"], part["progress"], strict=True)
            latest = max(x for x in (latest, part["created_at"].max()) if x is not None)
        for event in sorted(events, key=lambda x: x[0]):
            state = heard(tuple(state), event)
        self.state.update(state)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(max(pd.Timestamp(latest).timestamp() * 1000, timerValues.getCurrentWatermarkInMs())) + self.idle_ms)
        yield self._row(key, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield from ()

    def _row(self, key, state) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *state)], columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def latched_stream(polls: DataFrame, *, delay: str = "1 hour", idle_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """OUT after every batch, a row for each file that the batch has events of; the streaming form of `latched`.

    Events of a file must come in the order of seq from batch to batch (within a batch they need not). Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    watched = polls.withWatermark("created_at", delay)
    return watched.groupBy("file_id").transformWithStateInPandas(Pollers(idle_ms), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def at_rest(edits: DataFrame, gap: str = "350 milliseconds") -> DataFrame:
    """(tree_id, first_at, n_edits, edit_id, validated_at): what is validated of edits (tree_id, edit_id, at, empty), batch or stream.

    Edits of a tree that follow each other by `gap` or less are one burst; its last edit is validated when the gap is over. A burst that ends
    with an empty tree is not validated. In a stream the edits need a watermark, and a burst comes out when it has passed.
    """
    burst = edits.groupBy("tree_id", F.session_window("at", gap).alias("w")).agg(
        F.min("at").alias("first_at"), F.count("*").alias("n_edits"), F.max_by(F.struct("edit_id", "empty"), F.struct("at", "edit_id")).alias("last")
    )
    return burst.filter("NOT last.empty").select("tree_id", "first_at", "n_edits", F.col("last.edit_id").alias("edit_id"), F.col("w.end").alias("validated_at"))
