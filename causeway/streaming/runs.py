"""Run events as streams: deduplicated logs, latest states, batches that take each item once.

Events: run_id, event_seq, type, stage, status, progress, message, created_at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from causeway.functions.records import run_message

# States in which a run waits for nothing more.
TERMINAL = ("completed", "failed", "cancelled", "waiting_confirmation", "human_review_required")
EVENTS = "run_id string, event_seq long, type string, stage string, status string, progress double, message string, created_at timestamp"
STAGES = ("view", "click", "signup", "purchase", "error")


def read_events(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A folder that events arrive in, as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (run, sequence) once; state is dropped `delay` behind the newest event."""
    return events.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["run_id", "event_seq"])


def latest_state(events: DataFrame) -> DataFrame:
    """(run_id, last_seq, status, progress, terminal): by sequence; progress never falls (X3, X5, X10). Batch or a stream that ends
    (complete or update mode): it keeps every run that it has seen; `latest_state_stream` does not."""
    out = events.groupBy("run_id").agg(F.max("event_seq").alias("last_seq"), F.max_by("status", "event_seq").alias("status"), F.max("progress").alias("progress"))
    return out.withColumn("terminal", F.col("status").isin(*TERMINAL))


class Latest(StatefulProcessor):
    """The state of each run; one that has ended, or that nothing was heard of, is forgotten `idle_ms` after its last event."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", "last_seq long, status string, progress double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        last, status, progress = self.state.get() if self.state.exists() else (None, None, None)
        heard = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            newest = part.loc[part["event_seq"].idxmax()]
            if last is None or newest["event_seq"] > last:
                last, status = int(newest["event_seq"]), newest["status"]
            shares = [x for x in (progress, part["progress"].max()) if x is not None and x == x]
            progress = max(shares) if shares else None
            heard = max(heard, int(part["created_at"].max().timestamp() * 1000))
        self.state.update((last, status, progress))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(heard + self.idle_ms)
        yield pd.DataFrame([(key[0], last, status, progress, status in TERMINAL)], columns=["run_id", "last_seq", "status", "progress", "terminal"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def latest_state_stream(events: DataFrame, *, delay: str = "1 hour", idle_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """As latest_state, for streams without an end: a row for each run that a batch has events of, and state for the runs of the last `idle_ms` only. Needs the RocksDB state store."""
    kind = "run_id string, last_seq long, status string, progress double, terminal boolean"
    return events.withWatermark("created_at", delay).groupBy("run_id").transformWithStateInPandas(Latest(idle_ms), outputStructType=kind, outputMode="Update", timeMode="EventTime")


def after_cursor(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events of runs beyond their cursor (run_id, cursor), all of runs without one."""
    return events.join(cursors, "run_id", "left").filter(F.col("event_seq") > F.greatest(F.lit(0), F.coalesce("cursor", F.lit(0)))).drop("cursor")


def once(events: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The batch form of `deduplicated`: of equal keys the first by `order`."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return events.withColumn("_n", n).filter("_n = 1").drop("_n")


def ingest(seen: str, take: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: gives `take` the items (item_id, ...) that no earlier batch has, and the batch's number.

    Which items are a batch's is written to the table at `seen`, under its number, before `take` runs, and read from there: a batch
    that failed comes again with the same items, so a `take` that writes under the number (a folder or a key of its own,
    overwritten) takes each item once.
    """

    def batch(items: DataFrame, batch_id: int) -> None:
        spark = items.sparkSession
        try:
            known = spark.read.schema("item_id string, batch long").parquet(seen).filter(F.col("batch") < batch_id)  # earlier folders only
        except Exception as e:  # there is no table before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        new = once(items, ["item_id"], [F.col("item_id")])
        if known is not None:
            new = new.join(known.select("item_id").distinct(), "item_id", "left_anti")
        new.select("item_id").write.mode("overwrite").parquet(f"{seen}/batch={batch_id}")
        take(new.join(spark.read.parquet(f"{seen}/batch={batch_id}"), "item_id", "left_semi"), batch_id)

    return batch


def gaps(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """(run_id, cursor, n_events): runs of which fewer events (run_id, event_seq) are here than their cursor says were read, to be read anew from the start."""
    counts = events.groupBy("run_id").agg(F.count_distinct("event_seq").alias("n_events"))
    return cursors.join(counts, "run_id", "left").select("run_id", "cursor", F.coalesce("n_events", F.lit(0)).alias("n_events")).filter("n_events < cursor")


def memory_patches(latest: DataFrame) -> DataFrame:
    """(run_id, status, message, action, clears_pending) of runs (run_id, status, mode): what a session takes over from its run."""
    told = run_message(F.col("status"), F.col("mode"))
    return latest.select("run_id", "status", told["message"].alias("message"), told["action"].alias("action"), F.coalesce(F.lower("status").isin("completed", "failed", "cancelled"), F.lit(False)).alias("clears_pending"))


def stage_bounds(events: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """(run_id, first_<stage>, last_<stage>): sequences by stage, null where it is missing."""
    seq = lambda s: F.when(F.col("type") == s, F.col("event_seq"))
    return events.groupBy("run_id").agg(*(f(seq(s)).alias(f"{n}_{s}") for s in stages for n, f in (("first", F.min), ("last", F.max))))


def run_state(events: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """(run_id, n_events, current_stage, failed_seq): the last of `stages` in their order that a run has reached."""
    bounds = stage_bounds(events, stages)
    reached = F.coalesce(*(F.when(F.col(f"first_{s}").isNotNull(), F.lit(s)) for s in reversed(stages[:-1])))
    counts = events.groupBy("run_id").agg(F.count("*").alias("n_events"))
    return bounds.join(counts, "run_id").select("run_id", "n_events", reached.alias("current_stage"), F.col(f"last_{stages[-1]}").alias("failed_seq"))
