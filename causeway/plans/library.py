"""Registered queries of versions, chunks, files, sessions, projects and drafts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import library, state
from causeway.plans import surrogate as V
from causeway.plans.registry import query
from causeway.streaming import runs


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return V.run_events(spark, d).select(F.col("run_id").alias("tree_id"), F.col("event_seq").alias("version"), F.col("type").alias("editor"), F.col("props").alias("payload"))


@query(f"WITH {V.RUN_EVENTS} SELECT run_id AS tree_id, event_seq AS version, type AS editor, row_number() OVER (PARTITION BY run_id ORDER BY event_seq DESC) AS place, event_seq < max(event_seq) OVER (PARTITION BY run_id) AS is_historical FROM sv_runs")
def version_history(spark: SparkSession, d: str) -> DataFrame:
    """S11, T2, F14, A9"""
    return library.history(_versions(spark, d)).withColumn("place", F.col("place").cast("bigint"))


@query(f"WITH {V.RUN_EVENTS} SELECT run_id AS tree_id, event_seq AS version, props AS payload FROM sv_runs WHERE event_seq = 1 + CAST(run_id AS BIGINT) % 3")
def version_at(spark: SparkSession, d: str) -> DataFrame:
    """Another version of each tree"""
    v = _versions(spark, d)
    wanted = v.select("tree_id").distinct().select("tree_id", (1 + F.col("tree_id").cast("bigint") % 3).alias("version"))
    return library.at_version(v, wanted).select("tree_id", "version", "payload")


@query(f"WITH {V.RUN_EVENTS} SELECT run_id AS tree_id, event_seq AS version FROM sv_runs WHERE CAST(run_id AS BIGINT) % 2 = 0 UNION ALL SELECT DISTINCT run_id, 7 FROM sv_runs WHERE CAST(run_id AS BIGINT) % 2 = 1")
def version_options(spark: SparkSession, d: str) -> DataFrame:
    """Half of the trees have no stored versions"""
    v = _versions(spark, d)
    current = v.select("tree_id").distinct().withColumn("version", F.lit(7).cast("bigint"))
    return library.version_options(v.filter(F.col("tree_id").cast("bigint") % 2 == 0), current)


@query(f"WITH {V.CHUNKS} SELECT chunk_id FROM sv_chunks WHERE file_id IN ('f1', 'f2') OR source = (SELECT min(source) FROM documents) ORDER BY pos LIMIT 100")
def chunk_listing(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred chunks of two files and a version (a listing is bounded)"""
    c = V.chunks(spark, d).withColumn("file_name", F.col("file_id"))
    first = c.agg(F.min("source")).first()[0]
    return library.listed_chunks(c, file_names=["f1", "f2"], version_ids=[first], limit=100).select("chunk_id")


@query(f"WITH {V.CHUNKS} SELECT chunk_id, substr(text, 1, 1200) AS text FROM sv_chunks WHERE chunk_id % 5 = 0 OR (chunk_id % 5 = 1 AND source LIKE '%1')")
def chunk_details(spark: SparkSession, d: str) -> DataFrame:
    """Chunks asked for with a version, right or wrong, and without"""
    c = V.chunks(spark, d)
    any_ = c.filter("chunk_id % 5 = 0").select("chunk_id", F.lit(None).cast("string").alias("file_version_id"))
    own = c.filter("chunk_id % 5 = 1").select("chunk_id", F.when(F.col("source").like("%1"), F.col("source")).otherwise("other").alias("file_version_id"))
    return library.chunk_details(c.select("chunk_id", "file_version_id", "text"), any_.unionByName(own)).select("chunk_id", "text")


@query(f"WITH {V.NODES} SELECT id, label FROM sv_nodes WHERE type = 'top' ORDER BY pos LIMIT 3")
def root_candidates(spark: SparkSession, d: str) -> DataFrame:
    """A top-k listing"""
    return library.root_candidates(V.nodes(spark, d), 3).select("id", "label")


def _files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return V.table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 7 != 0, F.concat(F.lit(" v"), (k % 100).cast("string"))).otherwise(" ").alias("file_version_id"), (F.col("o_orderstatus") == "F").alias("import_complete"),
        F.when(F.col("o_orderstatus") == "O", "done").otherwise("processing").alias("status"), F.when(k % 3 == 0, False).alias("include"), k.alias("pos"),
    )


_READY = "o_orderkey % 7 <> 0 AND o_orderstatus IN ('F', 'O')"


@query(f"SELECT 'v' || o_orderkey % 100 AS file_version_id, min(o_orderkey) AS pos FROM orders WHERE {_READY} AND o_orderkey % 2 = 0 AND o_custkey % 2 = 0 GROUP BY 1")
def selected_versions(spark: SparkSession, d: str) -> DataFrame:
    """even ids are allowed, those of even customers selected"""
    files = _files(spark, d)
    selection = V.table(spark, d, "orders").filter("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("pos"))
    return library.selected_versions(library.eligible_files(files, files.filter("id % 2 = 0").select("id")), selection)


@query("SELECT 'v' || o_orderkey % 100 AS file_version_id, min(o_orderkey) AS pos FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderstatus = 'O' AND o_orderkey % 3 <> 0 GROUP BY 1")
def batch_scope(spark: SparkSession, d: str) -> DataFrame:
    """F3, F19, A10"""
    return library.batch_scope(_files(spark, d))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 1 AND o_orderstatus <> 'O' THEN 'failed' WHEN o_orderstatus = 'O' THEN 'done' ELSE 'processing' END AS status,
  CASE WHEN o_orderkey % 5 = 1 AND o_orderstatus <> 'O' THEN 'e' || o_custkey END AS error, 4 AS epoch FROM orders WHERE o_orderkey % 5 <> 0""")
def file_edits(spark: SparkSession, d: str) -> DataFrame:
    """M53, M54"""
    files = _files(spark, d).withColumn("error", F.lit(None).cast("string"))
    o = V.table(spark, d, "orders")
    failures = o.filter("o_orderkey % 5 = 1").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("e"), F.col("o_custkey").cast("string")).alias("error"))
    kept, _ = library.deleted_files(library.failed_imports(files, failures), files.select("id"), o.filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("id")), F.lit(3))
    return kept.select("id", "status", "error", "epoch")


@query(f"""WITH {V.MESSAGES}, t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) AS n FROM sv_messages WHERE session_id % 2 = 0)
  SELECT session_id, 'm' || session_id AS memory, count(*) AS n_messages, string_agg(content, '|' ORDER BY pos) FILTER (WHERE n <= 2) AS last_messages, CAST(session_id % 4 = 0 AS BIGINT) AS n_pending FROM t GROUP BY session_id""")
def session_read(spark: SparkSession, d: str) -> DataFrame:
    """Every other session, with its last two messages"""
    m = V.messages(spark, d)
    ids = m.select("session_id").distinct()
    memory = ids.select("session_id", F.concat(F.lit("m"), F.col("session_id").cast("string")).alias("memory"))
    pending = ids.select("session_id", F.when(F.col("session_id") % 4 == 0, "waiting").otherwise("done").alias("status"))
    return library.session(memory, m, pending, ids.filter("session_id % 2 = 0"), tail=2)


@query(f"""WITH {V.MESSAGES}, c AS (SELECT session_id, max(pos) AS cut FROM sv_messages WHERE role = 'user' GROUP BY session_id)
  SELECT 'message' AS kind, message_id AS id FROM sv_messages LEFT JOIN c USING (session_id) WHERE cut IS NULL OR pos < cut
  UNION ALL SELECT 'snapshot', session_id || '-' || max(pos) FROM sv_messages JOIN c USING (session_id) WHERE pos < cut AND role <> 'user' GROUP BY session_id""")
def rollback_to_message(spark: SparkSession, d: str) -> DataFrame:
    """Back to before the last user message; what is no user message counts as a snapshot"""
    m = V.messages(spark, d)
    last = m.filter("role = 'user'").groupBy("session_id").agg(F.max_by("message_id", "pos").alias("message_id"))
    left, snaps = library.rolled_back_to(m, m.filter("role <> 'user'").select("session_id", "pos"), last)
    return left.select(F.lit("message").alias("kind"), F.col("message_id").alias("id")).unionByName(snaps.select(F.lit("snapshot").alias("kind"), F.concat_ws("-", "session_id", "pos").alias("id")))


@query("SELECT c_nationkey AS owner, '空白项目' || (1 + coalesce(max(CASE WHEN c_custkey % 2 = 0 THEN c_custkey END), 0)) AS name FROM customer GROUP BY c_nationkey")
def next_project(spark: SparkSession, d: str) -> DataFrame:
    """M38"""
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("空白项目"), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("p"), F.col("c_custkey").cast("string")))
    return library.next_blank(V.table(spark, d, "customer").select(F.col("c_nationkey").alias("owner"), name.alias("name")), ["owner"])


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 1 THEN 'new' ELSE c_name END AS name, c_custkey % 3 = 1 AS reviewed FROM customer WHERE c_custkey % 3 <> 2 UNION ALL SELECT -1, 'demo', false""")
def project_edits(spark: SparkSession, d: str) -> DataFrame:
    """M39, M52, D11"""
    p = V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(False).alias("reviewed"))
    edits = p.filter("id % 3 > 0").select("id", F.when(F.col("id") % 3 == 1, "new").alias("name"), F.when(F.col("id") % 3 == 1, True).alias("reviewed"), (F.col("id") % 3 == 2).alias("deleted"))
    demo = spark.createDataFrame([(-1, "demo", False)], "id long, name string, reviewed boolean")
    return library.ensured(library.edited_projects(p, edits), demo.unionByName(demo).distinct())


@query("SELECT c_custkey AS id, CASE WHEN n = 0 THEN 'empty' WHEN c_custkey % 5 = 0 THEN 'reviewed' WHEN c_custkey % 5 = 1 THEN 'results' ELSE 'in_progress' END AS status FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)")
def project_states(spark: SparkSession, d: str) -> DataFrame:
    """M37"""
    counts = V.table(spark, d, "customer").join(V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")), "c_custkey", "left")
    n, k = F.coalesce("n", F.lit(0)), F.col("c_custkey")
    zero = F.lit(0)
    return counts.select(k.alias("id"), state.project_status(F.when(k % 5 == 0, n).otherwise(zero), F.when(k % 5 == 1, n).otherwise(zero), n, zero).alias("status"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS draft_id, CASE c_custkey % 4 WHEN 0 THEN 'T' || c_custkey WHEN 1 THEN c_mktsegment ELSE '空白画布' END AS title,
  CAST(coalesce(max(CASE WHEN c_custkey % 2 = 0 THEN o_orderkey END), CASE WHEN c_custkey % 4 = 3 THEN 0 ELSE c_custkey END) AS DOUBLE) AS last_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment""")
def catalog_recent(spark: SparkSession, d: str) -> DataFrame:
    """Drafts as JSON (a quarter of it bad) by their last message, those of every other customer having none that counts"""
    k = F.col("c_custkey")
    top = F.array(F.struct(F.lit("basic").alias("type"), F.lit("b").alias("label")), F.struct(F.lit("top").alias("type"), F.when(k % 4 == 1, F.col("c_mktsegment")).otherwise(" ").alias("label")))
    text = F.when(k % 4 == 3, "{").otherwise(F.to_json(F.struct(F.when(k % 4 == 0, F.concat(F.lit("T"), k.cast("string"))).alias("title"), top.alias("nodes"), k.alias("updatedAt"))))
    drafts = library.parsed_drafts(V.table(spark, d, "customer").select(k.cast("string").alias("draft_id"), text.alias("document")))
    messages = V.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("draft_id"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise("none").alias("at"))
    return library.recent_drafts(drafts, messages).select("draft_id", "title", "last_at")


@query(f"WITH {V.RUN_EVENTS} SELECT run_id || '-' || event_seq AS item_id, CASE WHEN event_seq % 2 = 0 THEN 'own' ELSE props END AS payload FROM sv_runs WHERE type <> 'error'")
def drafts_of_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that are done, half of them with a payload of their own"""
    v = _versions(spark, d)
    items = v.select(F.concat_ws("-", "tree_id", "version").alias("item_id"), "tree_id", "version", F.when(F.col("version") % 2 == 0, "own").alias("payload"), F.when(F.col("editor") != "error", "success").otherwise("failed").alias("status"))
    return library.drafts_of_items(items, v)


@query("SELECT user_id, min(event_id) AS pos, max_by(props, event_id) AS content, event_type AS task FROM events GROUP BY user_id, event_type")
def upsert_messages(spark: SparkSession, d: str) -> DataFrame:
    """The last copy of each kind of event of a user, at the place of the first"""
    e = V.table(spark, d, "events").select("user_id", F.col("event_type").alias("task"), F.col("event_id").alias("pos"), F.col("props").alias("content"))
    return state.upserted(e, "task", by=["user_id"]).select("user_id", "pos", "content", "task")


@query(f"WITH {V.RUN_EVENTS}, c AS (SELECT run_id, count(*) AS n FROM sv_runs GROUP BY run_id) SELECT run_id, n + 1 AS cursor, n AS n_events FROM c WHERE CAST(run_id AS BIGINT) % 2 = 0")
def event_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Runs of even number say that they read one event more than there is"""
    e = V.run_events(spark, d)
    cursors = e.groupBy("run_id").agg((F.count("*") + F.when(F.col("run_id").cast("bigint") % 2 == 0, 1).otherwise(0)).alias("cursor"))
    return runs.gaps(e.unionByName(e), cursors)


@query(f"""WITH {V.RUN_EVENTS}, l AS (SELECT run_id, max_by(type, event_seq) AS t FROM sv_runs GROUP BY run_id)
  SELECT run_id, CASE t WHEN 'error' THEN 'generation_failed' WHEN 'purchase' THEN 'generation_finished' ELSE 'generation_running' END AS action, t IN ('error', 'purchase') AS clears_pending FROM l""")
def run_memory(spark: SparkSession, d: str) -> DataFrame:
    """X7, X13, P49, S34"""
    status = F.when(F.col("type") == "error", "failed").when(F.col("type") == "purchase", "completed").otherwise("running")
    latest = runs.latest_state(V.run_events(spark, d).select("run_id", "event_seq", status.alias("status"), F.col("value").alias("progress"), "type")).withColumn("mode", F.lit(None).cast("string"))
    return runs.memory_patches(latest).select("run_id", "action", "clears_pending")
