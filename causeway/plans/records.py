"""Registered queries of column functions over records, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import records as R
from causeway.functions import scalars as S
from causeway.plans import surrogate as V
from causeway.plans.registry import query
from causeway.sources import trees


def _events(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "events").withColumn("k", F.col("event_id") % 10)


def _pick(k, values):
    """The value of each k from 0 on, null beyond."""
    return F.element_at(F.create_map(*(x for i, v in enumerate(values) for x in (F.lit(i), F.lit(v)))), k.cast("int"))


def _case(column: str, values) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN {v!r}" for i, v in enumerate(values)) + " END"


_STAGES = ("repair", "Validate", "persistence", "curate", "generate_draft", "graph_chunks", "scope", "other", "x", "")
_TYPES = ("A", "b", "c", "d", "e", "f", "g", "run_failed", "stage_started", "z")
_AGENTS = ("RepairAgent", "VerifyAgent", "CommitAgent", "MemoryCurator", "TreeDraftAgent", "RetrievalAgent", "ScopeAgent", "ReviewAgent", "SchedulerAgent", "AssistantAgent")


@query(f"""SELECT event_id, CASE WHEN event_type = 'error' THEN 'ReviewAgent' WHEN event_type = 'view' AND event_id % 4 = 0 THEN 'SupervisorAgent' WHEN event_type = 'view' AND event_id % 4 = 1 THEN 'ExperienceMemoryAgent' ELSE {_case("event_id % 10", _AGENTS)} END AS agent, CASE WHEN event_id % 3 = 0 THEN 1 ELSE event_id END AS seq,
  lower({_case("event_id % 10", _STAGES)}) AS stage, upper({_case("event_id % 10", _TYPES)}) AS type, CASE WHEN event_type = 'view' THEN 'WARN' ELSE 'INFO' END AS level, event_type AS artifact, event_type <> 'click' AS passed FROM events""")
def event_records(spark: SparkSession, d: str) -> DataFrame:
    """Events in JSON"""
    e = _events(spark, d)
    view, k = F.col("event_type") == "view", F.col("event_id") % 4
    named = F.when(F.col("event_type") == "error", "ReviewAgent").when(view & (k == 0), "SupervisorAgent").when(view & (k == 1), "ExperienceMemoryAgent").when(view & (k == 2), "NobodyAgent")
    payload = F.struct(named.alias("agent"), F.col("event_type").alias("type"), F.when(F.col("event_type") == "click", False).alias("passed"))
    text = F.to_json(F.struct(_pick(F.col("k"), _STAGES).alias("stage"), _pick(F.col("k"), _TYPES).alias("type"), F.when(F.col("event_type") == "view", "warn").alias("level"), F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("event_seq"), payload.alias("payload")))
    v = F.parse_json(text)
    return e.select("event_id", R.run_event(v, F.lit(0)).alias("r"), R.validation_passed(v).alias("passed")).select("event_id", "r.agent", "r.seq", "r.stage", "r.type", "r.level", F.col("r.artifact_type").alias("artifact"), "passed")


_JOB_STATES, _JOB_STAGES = ("running", "FAILED", "success", "running", "running", "running", "syncing", "completed_with_sync_error", "", "queued"), ("chunk", "chunk", "", "relation", "entity", "clean", "", "", "x", "success")


@query(f"""WITH j AS (SELECT event_id, {_case("event_id % 10", _JOB_STATES)} AS st, {_case("event_id % 10", (1, 0, 5, 3, 2, 0, 4, 5, 0, 5))} AS i, event_id % 120 - 10 AS p FROM events)
  SELECT event_id, CAST(i AS BIGINT) AS stage_index, CASE WHEN i = 5 THEN 100.0 ELSE (i + greatest(0, least(100, p)) / 100.0) / 5 * 100 END AS fill, i = 5 AS done,
  CASE lower(st) WHEN 'success' THEN 'done' WHEN 'failed' THEN 'failed' ELSE 'processing' END AS state, CASE lower(st) WHEN 'success' THEN 100 WHEN 'failed' THEN 0 ELSE greatest(8, least(98, p)) END AS percent,
  lower(st) IN ('success', 'completed_with_sync_error') OR event_id % 4 = 0 AS complete FROM j""")
def job_records(spark: SparkSession, d: str) -> DataFrame:
    """P32, P33, P48, P53"""
    e = _events(spark, d)
    st, sg, p = _pick(F.col("k"), _JOB_STATES), _pick(F.col("k"), _JOB_STAGES), (F.col("event_id") % 120 - 10).cast("double")
    line = R.build_timeline(st, sg, p)
    return e.select(
        "event_id", line["stage_index"].cast("bigint").alias("stage_index"), line["fill_percent"].alias("fill"), line["all_done"].alias("done"), S.job_state(st).alias("state"),
        S.job_progress(F.lower(st), p).cast("bigint").alias("percent"), R.import_complete(F.col("event_id") % 4 == 0, F.lit("new"), st).alias("complete"),
    )


_STATUS = ("completed", "failed", "running", "human_review_required", "waiting_confirmation", "Completed", "", "queued", "review", "other")


@query(f"""SELECT event_id, {_case("event_id % 10", ("generation_finished", "generation_failed", "generation_running", "human_review_required", "need_top_event_confirmation", "generation_finished", "need_top_event_confirmation", "generation_running", "generation_running", "generation_running"))} AS action,
  {_case("event_id % 10", ("完成", "失败", "running", "人工复核", "待确认", "Completed", "", "排队", "人工复核", "other"))} AS stage, CASE event_id % 3 WHEN 0 THEN '文档资料/manual_document' WHEN 1 THEN '维修记录/maintenance_record' ELSE '/' END AS category,
  CASE event_id % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'maintenance' WHEN 2 THEN 'work_order' ELSE 'document' END AS import_as FROM events""")
def code_labels(spark: SparkSession, d: str) -> DataFrame:
    """P34, P37, P49, S21"""
    e = _events(spark, d)
    status = _pick(F.col("k"), _STATUS)
    category = F.when(F.col("event_id") % 3 == 0, " document").when(F.col("event_id") % 3 == 1, "maintenance_record").otherwise("none")
    name = _pick(F.col("event_id") % 4, ("A.DOCX", "x维修.xlsx", "y.csv", "z.txt"))
    return e.select(
        "event_id", R.run_message(status, F.when(F.col("k") == 6, "need_confirmation"))["action"].alias("action"), R.stage_label(status).alias("stage"),
        F.concat_ws("/", R.category_label(category), R.source_type(category)).alias("category"), S.file_category(name).alias("import_as"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || '::' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS chunk_key, 'default:' || o_custkey AS session, regexp_replace('s ' || o_custkey || ':x', '[^A-Za-z0-9._-]', '_', 'g') || '_' || substr(sha256('s ' || o_custkey || ':x'), 1, 8) AS file,
  'Object_' || o_custkey AS ref, 'f' || o_orderkey || ',f' || o_orderkey || '_v1' AS versions, 'a,' || o_custkey AS ids FROM orders""")
def keys_and_references(spark: SparkSession, d: str) -> DataFrame:
    """P17, P19, P27, P44, P45, P46, P79"""
    o = V.table(spark, d, "orders")
    c = F.col("o_custkey").cast("string")
    return o.select(
        "o_orderkey", S.chunk_key(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), "o_orderstatus")), c).alias("chunk_key"), R.session_id(F.lit(""), c).alias("session"), R.safe_name(F.concat(F.lit("s "), c, F.lit(":x"))).alias("file"),
        S.object_reference(F.concat(F.lit("see [Ref: Object_"), c, F.lit("]  "))).alias("ref"), F.array_join(S.version_candidates(F.concat(F.lit("f"), F.col("o_orderkey").cast("string"))), ",").alias("versions"),
        F.array_join(S.distinct_values(F.array(F.lit("a "), F.lit(""), c, F.lit("a"), F.lit(None).cast("string"))), ",").alias("ids"),
    )


@query("""SELECT doc_id, substr(trim(text, ' '), 1, 60) AS first_text, lang AS label, '2' AS items, 'user|' || substr(text, 1, 800) || '|edit|r1' AS compact, '最近意图：edit；当前顶事件：未确定；节点数：' || n_chars || '；最近用户：' || substr(text, 1, 120) || '；最近回复：' || substr(text, 1, 160) AS brief FROM documents""")
def compact_texts(spark: SparkSession, d: str) -> DataFrame:
    """P5, P16, P20, P22, P28, P47, P65, P80, A19"""
    t, meta = F.col("text"), F.parse_json(F.lit('{"intent": "edit", "intent_decision": {"reason": "r1"}}'))
    m = R.compact_message(F.lit("user"), t, meta)
    return V.table(spark, d, "documents").select(
        "doc_id", S.first_text([F.lit(""), t], 60).alias("first_text"), S.first_present(F.lit(""), F.lit(None).cast("string"), F.col("lang")).alias("label"), F.size(S.readable_items(F.lit(" a；\n; b ;"))).cast("string").alias("items"),
        F.concat_ws("|", m["role"], m["content"], m["intent"], m["pending_id"], m["reason"], m["result_mode"]).alias("compact"), R.brief_summary(F.lit("edit"), F.lit(""), F.col("n_chars"), t, t).alias("brief"),
    )


@query("""SELECT o_orderkey, o_orderpriority AS goal, '' AS intent, CASE WHEN o_orderkey % 2 = 0 THEN 'a,b' ELSE '' END AS cautions, CASE WHEN o_orderkey % 3 = 0 THEN '{"n":1}' ELSE '{}' END AS tree,
  't' || o_custkey AS tree_id, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 100 AS BIGINT) ELSE 1 END AS version, o_orderkey % 5 <> 0 AS generated FROM orders""")
def summary_and_version(spark: SparkSession, d: str) -> DataFrame:
    """P64, P66"""
    k = F.col("o_orderkey")
    raw = F.to_json(F.struct(F.col("o_orderpriority").alias("active_goal"), F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("cautions"), F.when(k % 3 == 0, F.struct(F.lit(1).alias("n"))).alias("current_tree"), F.lit("text").alias("last_meaningful_edit")))
    body = F.struct(F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("tree_id"), F.when(k % 2 == 0, (k % 100).cast("string")).otherwise("none").alias("version"), F.when(k % 5 == 0, False).alias("is_ai_generated"))
    response = F.to_json(F.struct(F.when(k % 2 == 0, body).alias("data"), F.when(k % 2 == 1, body).alias("result")))
    s, v = R.normal_summary(F.parse_json(raw)), R.version_payload(F.parse_json(response))
    return V.table(spark, d, "orders").select("o_orderkey", s["active_goal"].alias("goal"), s["last_user_intent"].alias("intent"), F.array_join(s["cautions"], ",").alias("cautions"), s["current_tree"].alias("tree"), v["tree_id"].alias("tree_id"), v["version"].cast("bigint").alias("version"), v["is_ai_generated"].alias("generated"))


@query("""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '内容=（空）' WHEN event_id % 10 = 1 THEN '内容={}' ELSE '设备类型=' || event_type || ';测点=m' || user_id || ';阈值=-1、' || event_id % 7 || ';extra={"a":1};note=n' END AS rows FROM events""")
def rule_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rules as JSON of two namings, with fields that are none of theirs"""
    rule = F.to_json(F.struct(F.col("event_type").alias("device_type_id"), F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("measurePointName"), F.lit(" ").alias("symbol"), F.array(F.lit("-1"), (F.col("event_id") % 7).cast("string")).alias("thresholds"), F.struct(F.lit(1).alias("a")).alias("extra"), F.lit("n").alias("note"), F.lit("").alias("blank")))
    text = F.when(F.col("k") == 0, None).when(F.col("k") == 1, "{}").otherwise(rule)
    return _events(spark, d).select("event_id", F.array_join(F.transform(R.rule_rows(text), lambda x: F.concat(x["label"], F.lit("="), x["value"])), ";").alias("rows"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS plain, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS wrapped, 'soon' AS other, '{"a":[1,2],"b":"' || o_orderstatus || '"}' AS canonical, CASE WHEN o_orderkey % 2 = 0 THEN 'r' || o_orderkey END AS run FROM orders""")
def dates_and_json(spark: SparkSession, d: str) -> DataFrame:
    """P18, P35, P36, P72, S25"""
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    run = F.struct(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("r"), F.col("o_orderkey").cast("string"))).alias("run_id"))
    text = F.concat(F.lit('{ "b" : "'), "o_orderstatus", F.lit('",\n "a": [1, 2]}'))
    found = R.unwrapped_run(F.parse_json(F.to_json(F.struct(F.struct(run.alias("agent_run")).alias("result")))))
    return V.table(spark, d, "orders").select("o_orderkey", R.version_date(at).alias("plain"), R.version_date(F.to_json(F.struct(at.alias("$date")))).alias("wrapped"), R.version_date(F.lit("soon")).alias("other"), R.canonical_json(text).alias("canonical"), F.try_variant_get(found, "$.run_id", "string").alias("run"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'gate' WHEN 1 THEN 'entity:part' WHEN 2 THEN 'thing' ELSE 'node' END AS kind, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'AND' ELSE 'OR' END AS gate, CAST(greatest(0, 10 - o_orderkey % 20) * 5 AS DOUBLE) AS overlap, o_orderpriority || '/1e-08' AS event FROM orders""")
def kinds_and_gates(spark: SparkSession, d: str) -> DataFrame:
    """P41, P55, P59, P61"""
    k = F.col("o_orderkey")
    labels = F.when(k % 4 == 0, F.array(F.lit("X"), F.lit("Gate"))).when(k % 4 == 1, F.array(F.lit("Entity"))).when(k % 4 == 2, F.array(F.lit("Thing"))).otherwise(F.array().cast("array<string>"))
    box = lambda x, w: F.struct(x.cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(float(w)).alias("w"), F.lit(5.0).alias("h"))
    event = R.default_event(F.col("o_orderpriority"))
    return V.table(spark, d, "orders").select(
        "o_orderkey", S.node_kind(labels, F.lit("part")).alias("kind"), R.own_gate(F.when(k % 3 == 0, "basic").otherwise("top"), F.when(k % 3 == 1, "与"), F.when(k % 3 == 2, "2")).alias("gate"),
        S.overlap_area(box(F.lit(0), 10), box(k % 20, 30)).alias("overlap"), F.concat(event["name"], F.lit("/"), F.format_string("%.0e", event["probability"])).alias("event"),
    )


@query("SELECT o_orderkey, 'Object_' || o_orderkey AS part, CASE WHEN o_orderkey % 2 = 0 THEN 'p' || o_custkey ELSE 'unknown' END AS id FROM orders")
def part_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A part table for each even order"""
    o = V.table(spark, d, "orders")
    entry = F.create_map(F.concat(F.lit("Object_"), F.col("o_orderkey").cast("string")), F.struct(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("id"), F.lit("n").alias("name"), F.lit("t").alias("type")))
    tables = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("tree_id"), F.to_json(entry).alias("document"))
    found = trees.parts(tables).select("part", "id")
    names = o.select("o_orderkey", F.concat(F.lit("Object_"), F.col("o_orderkey").cast("string")).alias("part"))
    return names.join(found, "part", "left").select("o_orderkey", "part", F.coalesce("id", F.lit("unknown")).alias("id"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'raw' WHEN 1 THEN 'map' WHEN 2 THEN 'graph' WHEN 3 THEN 'raw' END AS shape, CASE WHEN o_orderkey % 5 <> 4 THEN 'o' || o_orderkey END AS id, CASE WHEN o_orderkey % 5 <> 4 THEN o_orderpriority END AS label FROM orders""")
def document_shapes(spark: SparkSession, d: str) -> DataFrame:
    """A document of one node for each order, in every shape, wrapped, or bad"""
    k, id_ = F.col("o_orderkey"), V._key("o", "o_orderkey")
    node = F.to_json(F.struct(id_.alias("id"), F.col("o_orderpriority").alias("name"), F.lit("3").alias("type")))
    raw = F.concat(F.lit('{"nodeList":['), node, F.lit('],"linkList":[]}'))
    text = F.when(k % 5 == 0, raw).when(k % 5 == 1, F.concat(F.lit('{"treeData":{"nodes":{"x":'), node, F.lit("}}}"))).when(k % 5 == 2, F.concat(F.lit('{"nodes":['), node, F.lit('],"edges":[]}'))).when(k % 5 == 3, F.concat(F.lit('{"result":{"tree_data":'), raw, F.lit("}}"))).otherwise("{")
    parsed = trees.parse(V.table(spark, d, "orders").select(k.cast("string").alias("tree_id"), text.alias("document")))
    named = trees.nodes(parsed).select("tree_id", "id", "label")
    return parsed.select("tree_id", "shape").join(named, "tree_id", "left").select(F.col("tree_id").cast("bigint").alias("o_orderkey"), "shape", "id", "label")


@query("SELECT l_orderkey AS doc, l_quantity, substr('泵 当前故障树', 1, 1) || l_linenumber AS term FROM lineitem WHERE l_orderkey < 200")
def question_terms(spark: SparkSession, d: str) -> DataFrame:
    """What is left of a question without its fixed words is its second term"""
    question = F.concat(F.lit("当前故障树"), F.lit("泵"), F.col("l_linenumber").cast("string"), F.lit("是什么？"))
    return V.table(spark, d, "lineitem").filter("l_orderkey < 200").select(F.col("l_orderkey").alias("doc"), "l_quantity", F.element_at(S.query_terms(question), 2).alias("term"))
