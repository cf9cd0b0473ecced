"""Sessions, messages, pending actions, drafts, versions and files: append-only logs and views of their latest state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How many of each are kept.
MESSAGES, SNAPSHOTS, TASKS, PENDING, DRAFTS = 320, 120, 80, 20, 40


def newest(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group by `order`, which must be total."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_n", place).filter(F.col("_n") <= max(1, n)).drop("_n")


def latest(rows: DataFrame, by: Sequence[str], order: Column) -> DataFrame:
    """One row for each key, the last by `order`, with partial results before the shuffle."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*by, "_r.*")


def truncated(messages: DataFrame, cuts: DataFrame) -> DataFrame:
    """messages (session_id, pos, message_id, ...) before each session's cut (session_id, message_id, keep): the
    message named, else the first `keep`; a session without a cut, or whose cut names nothing, stays whole (M31)."""
    named = messages.join(cuts.select("session_id", F.col("message_id").alias("_m")), "session_id").filter("message_id = _m").groupBy("session_id").agg(F.min("pos").alias("_at"))
    size = messages.groupBy("session_id").agg(F.count("*").alias("_n"))
    limits = cuts.join(named, "session_id", "left").join(size, "session_id").select("session_id", F.coalesce("_at", F.greatest(F.lit(0), F.least("keep", "_n"))).alias("_cut"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("pos")) - 1
    numbered = messages.withColumn("_p", place).join(limits, "session_id", "left")
    by_id = numbered.filter("_cut IS NULL OR _p < _cut")
    return by_id.select(*messages.columns)


def superseded(pending: DataFrame, keep: int = PENDING) -> DataFrame:
    """pending with waiting actions beyond the newest `keep` of a session as superseded."""
    place = F.row_number().over(Window.partitionBy("session_id", "status").orderBy(F.desc("updated_at"), F.desc("pending_id")))
    return pending.withColumn("_n", place).withColumn("status", F.when((F.col("status") == "waiting") & (F.col("_n") > keep), "superseded").otherwise(F.col("status"))).drop("_n")


def last_by_role(messages: DataFrame) -> DataFrame:
    """(session_id, last_user, last_assistant)."""
    of = lambda role: F.max_by(F.when(F.col("role") == role, F.col("content")), F.when(F.col("role") == role, F.col("pos")))
    return messages.groupBy("session_id").agg(of("user").alias("last_user"), of("assistant").alias("last_assistant"))


def answered(messages: DataFrame) -> DataFrame:
    """(session_id, pos, question): each assistant message with the user message last before it."""
    before = Window.partitionBy("session_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    question = F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(before)
    return messages.withColumn("question", question).filter("role = 'assistant'").select("session_id", "pos", "question")


def active_versions(files: DataFrame) -> DataFrame:
    """files (file_id, version, ...) with is_active: only the newest version of each file is."""
    top = F.max("version").over(Window.partitionBy("file_id"))
    return files.withColumn("is_active", F.col("version") == top)


def rolled_back(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """versions (tree_id, version, ...) and, for each wanted (tree_id, version), its payload again as the newest."""
    top = versions.groupBy("tree_id").agg(F.max("version").alias("_top"))
    again = versions.join(wanted.select("tree_id", "version"), ["tree_id", "version"]).join(top, "tree_id").withColumn("version", F.col("_top") + 1).drop("_top")
    return versions.unionByName(again.select(*versions.columns))


def group_starts(rows: DataFrame, group: str, order: Sequence[Column], by: Sequence[str]) -> DataFrame:
    """rows with is_start: the first of a run of equal `group` in the order, within `by`."""
    before = F.lag(group).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("is_start", ~F.col(group).eqNullSafe(before))


def project_status(n_reviewed: Column, n_results: Column, n_files: Column, n_messages: Column) -> Column:
    """(M37)"""
    return F.when(n_reviewed > 0, "reviewed").when(n_results > 0, "results").when((n_files > 0) | (n_messages > 0), "in_progress").otherwise("empty")


def upserted(rows: DataFrame, key: str, pos: str = "pos", keep: int = MESSAGES, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """The last copy of each key at the place of its first, the last `keep` of these in each group `by`."""
    rest = [c for c in rows.columns if c not in (*by, key, pos)]
    merged = rows.groupBy(*by, key).agg(F.min(pos).alias(pos), F.max_by(F.struct(*rest), pos).alias("_r")).select(*by, key, pos, "_r.*")
    return newest(merged, by, [F.desc(pos), F.desc(key)], keep)


def work_orders(rows: DataFrame, mapping: dict[str, str], required: Sequence[str]) -> DataFrame:
    """rows renamed by mapping (field -> column), with `ready`: all required fields are present."""
    missing = [f for f in required if f not in mapping]
    columns = [F.col(c).cast("string").alias(f) for f, c in mapping.items()]
    ready = F.lit(not missing)
    for f in required:
        if f in mapping:
            ready = ready & F.col(f).isNotNull() & (F.trim(f) != "")
    return rows.select(*columns).withColumn("ready", ready)
