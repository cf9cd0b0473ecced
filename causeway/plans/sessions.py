"""Queries on what happens in sessions: polled imports, edits at rest, histories; events of users stand for it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway import storage
from causeway.functions import scalars as S
from causeway.operators import history
from causeway.plans import surrogate as V
from causeway.plans.registry import query
from causeway.streaming import pollers, runs


def _events(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "events").withColumn("user", F.col("user_id").cast("string"))


def _by_type(**values: str):
    kind = F.col("event_type")
    return F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in values.items()), F.lit(None).cast("string"))


_RUNNING = "OVER (PARTITION BY file_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"


@query(f"""WITH p AS (SELECT CAST(user_id AS VARCHAR) AS file_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'start' WHEN 'error' THEN 'error' ELSE 'update' END AS kind, 'j' || (event_id % 3) AS job_id,
    CASE event_type WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'failed' WHEN 'click' THEN 'processing' END AS status, value AS progress FROM events),
  a AS (SELECT *, last_value(CASE WHEN kind = 'start' THEN job_id END IGNORE NULLS) {_RUNNING} AS active FROM p),
  h AS (SELECT *, kind = 'start' OR coalesce(job_id = active, false) AS heard FROM a),
  c AS (SELECT *, max(CASE WHEN heard AND kind = 'update' AND status = 'done' THEN 1 ELSE 0 END) {_RUNNING} = 1 AS complete FROM h),
  t AS (SELECT *, CASE WHEN heard AND kind = 'update' THEN status WHEN heard AND kind = 'error' AND NOT complete THEN 'failed' END AS told FROM c)
  SELECT file_id, max(seq) AS last_seq, arg_max(active, seq) FILTER (WHERE active IS NOT NULL) AS job_id, arg_max(told, seq) FILTER (WHERE told IS NOT NULL) AS status,
    greatest(coalesce(max(progress) FILTER (WHERE heard AND kind = 'update'), 0), 0) AS progress, bool_or(complete) AS complete FROM t GROUP BY file_id""")
def polls_latched(spark: SparkSession, d: str) -> DataFrame:
    """Views start pollers, errors end them, the rest are updates; three jobs for each user"""
    kind = F.coalesce(_by_type(view="start", error="error"), F.lit("update"))
    status = _by_type(purchase="done", signup="failed", click="processing")
    polls = _events(spark, d).select(F.col("user").alias("file_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("j"), F.col("event_id") % 3).alias("job_id"), status.alias("status"), F.col("value").alias("progress"))
    return pollers.latched(polls)


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS tree_id, event_id, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS cut FROM events),
  b AS (SELECT *, sum(cut) OVER (PARTITION BY tree_id ORDER BY ts, event_id) AS burst FROM e),
  l AS (SELECT tree_id, burst, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n_edits, arg_max(event_id, (ts, event_id)) AS edit_id, arg_max(event_type, (ts, event_id)) AS kind FROM b GROUP BY ALL)
  SELECT tree_id, epoch_us(first_at) - epoch_us(TIMESTAMP '2024-01-01') AS first_us, n_edits, edit_id, epoch_us(last_at + INTERVAL 6 HOUR) - epoch_us(TIMESTAMP '2024-01-01') AS validated_us FROM l WHERE kind <> 'error'""")
def edits_at_rest(spark: SparkSession, d: str) -> DataFrame:
    """A burst ends after six hours; after an error the tree is empty"""
    edits = _events(spark, d).select(F.col("user").alias("tree_id"), F.col("event_id").alias("edit_id"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "error").alias("empty"))
    since = lambda c: F.unix_micros(c) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    rest = pollers.at_rest(edits, "6 hours")
    return rest.select("tree_id", since(F.col("first_at")).alias("first_us"), "n_edits", "edit_id", since(F.col("validated_at")).alias("validated_us"))


@query("""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id AS seq, 'v' || event_id AS version,
    CASE event_type WHEN 'view' THEN 'edit' WHEN 'signup' THEN 'apply' WHEN 'error' THEN 'sync' WHEN 'click' THEN 'undo' ELSE 'redo' END AS kind,
    event_type <> 'signup' OR json_valid(CASE WHEN event_id % 4 = 0 THEN left(props, length(props) - 1) ELSE props END) AS valid FROM events),
  f AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, '' AS kind, false AS changed, CAST(0 AS BIGINT) AS place, [CAST(NULL AS VARCHAR)] AS slots FROM e
    UNION ALL SELECT e.session_id, e.n, e.seq, e.kind,
      CASE WHEN e.kind = 'undo' THEN f.place > 0 WHEN e.kind = 'redo' THEN f.place < len(f.slots) - 1 ELSE e.valid END,
      CASE WHEN NOT e.valid THEN f.place WHEN e.kind IN ('edit', 'apply') THEN f.place + 1 WHEN e.kind = 'undo' THEN greatest(f.place - 1, 0) WHEN e.kind = 'redo' THEN least(f.place + 1, len(f.slots) - 1) ELSE f.place END,
      CASE WHEN NOT e.valid THEN f.slots WHEN e.kind IN ('edit', 'apply') THEN list_concat(f.slots[1:f.place + 1], [e.version]) WHEN e.kind = 'sync' THEN list_concat(list_concat(f.slots[1:f.place], [e.version]), f.slots[f.place + 2:]) ELSE f.slots END
    FROM f JOIN e ON e.session_id = f.session_id AND e.n = f.n + 1)
  SELECT session_id, seq, kind, changed, place AS slot, place > 0 AS can_undo, place < len(slots) - 1 AS can_redo, slots[place + 1] AS shown FROM f WHERE n > 0""")
def history_replay(spark: SparkSession, d: str) -> DataFrame:
    """Views edit, signups apply documents of which some are no JSON, errors write anew, clicks undo, purchases redo"""
    kind = F.coalesce(_by_type(view="edit", signup="apply", error="sync", click="undo"), F.lit("redo"))
    document = F.when(F.col("event_id") % 4 == 0, F.col("props").substr(F.lit(1), F.length("props") - 1)).otherwise(F.col("props"))
    events = _events(spark, d).select(F.col("user").alias("session_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("v"), "event_id").alias("version"), document.alias("document"))
    return history.replayed(history.valid_edits(events))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(user_id % 2147483647 + 1 AS BIGINT) AS x FROM events
    UNION ALL SELECT f.user_id, f.n + 1, f.x * 48271 % 2147483647 FROM f WHERE f.n < (SELECT max(n) FROM e))
  SELECT e.event_id, f.x / 2147483647.0::DOUBLE AS draw FROM e JOIN f ON f.user_id = e.user_id AND f.n = e.n""")
def seeded_draws(spark: SparkSession, d: str) -> DataFrame:
    """The n-th event of a user gets the n-th draw of the user's generator"""
    numbered = V.run_events(spark, d).withColumn("seed", F.col("run_id").cast("long"))
    return numbered.select("event_id", S.seeded_random(F.col("seed"), F.col("event_seq")).alias("draw"))


@query("SELECT CAST(user_id AS VARCHAR) || '-' || event_type AS item_id, CAST(min(event_id % 3) AS BIGINT) AS batch FROM events GROUP BY 1")
def items_taken_once(spark: SparkSession, d: str) -> DataFrame:
    """Items of three batches, the last batch twice over; each is taken by the first that has it"""
    at = f"{storage.shared_folder(spark)}/{uuid.uuid4().hex}"
    items = _events(spark, d).select(F.concat_ws("-", "user", "event_type").alias("item_id"), (F.col("event_id") % 3).alias("nth"))
    take = runs.ingest(f"{at}/seen", lambda new, n: new.select("item_id", F.lit(n).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{at}/taken/{n}"))
    for n in (0, 1, 2, 2):
        take(items.filter(F.col("nth") == n), n)
    return spark.read.schema("item_id string, batch long").parquet(*(f"{at}/taken/{n}" for n in range(3)))
