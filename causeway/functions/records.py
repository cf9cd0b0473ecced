"""Column functions for records around trees: run events, jobs, messages, sessions, versions, summaries and rules.

JSON comes as VARIANT (`v`); a value "is missing" where it is null or the empty string.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from causeway.functions import scalars as S

_SUMMARY_TEXTS = ("active_goal", "last_user_intent", "last_assistant_action", "pending_action", "brief")
_SUMMARY_LISTS = ("user_preferences", "unresolved_questions", "source_scope", "cautions")


def _text(v: Column, *paths: str) -> Column:
    return F.coalesce(*(S.present(F.try_variant_get(v, p, "string")) for p in paths), F.lit(""))


def _lookup(x: Column, values: dict[str, str], default: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(t) for pair in values.items() for t in pair))[x], default)


def artifact_type(v: Column) -> Column:
    """(P71)"""
    return F.lower(_text(v, "$.artifact_type", "$.artifactType", "$.payload.artifact_type", "$.payload.type"))


# Who an event is told under, and the stages, types, artifacts and words that say so; the first that fits counts.
PROFILES = (
    ("RepairAgent", ("repair",), (), ("repair_patch",), ("repair",)),
    ("VerifyAgent", ("validate",), ("VALIDATION_DONE",), ("validation_report",), ("validat",)),
    ("CommitAgent", ("commit", "persistence"), ("TREE_COMMITTED",), ("final_tree",), ("persist", "saving validated draft")),
    ("MemoryCurator", ("curate",), ("RUN_COMPLETED",), (), ()),
    ("TreeDraftAgent", ("draft", "generate_draft"), ("DRAFT_GENERATED",), ("tree_draft",), ("draft",)),
    ("RetrievalAgent", ("retrieval", "graph_subgraph", "graph_chunks"), ("RETRIEVAL_DONE",), ("retrieval_context",), ("evidence", "subgraph")),
    ("ScopeAgent", ("scope", "graph_match"), ("SCOPE_RESOLVED", "CONFIRMATION_REQUIRED", "CONFIRMATION_RECEIVED"), ("requirement", "scope"), ("top event", "knowledge scope")),
    ("ReviewAgent", (), ("RUN_FAILED",), (), ()),
    ("SchedulerAgent", (), ("RUN_CREATED", "STAGE_STARTED", "ARTIFACT_CREATED"), (), ()),
)
# Who a payload may name besides, without rules of their own.
NAMED_ONLY = ("AssistantAgent", "ExperienceMemoryAgent", "SupervisorAgent")


def agent_profile(v: Column) -> Column:
    """Who a run event is told under: the agent that its payload names, if there is such a one, else by PROFILES."""
    type_, stage, message, artifact = F.upper(_text(v, "$.type")), F.lower(_text(v, "$.stage")), F.lower(_text(v, "$.message", "$.text")), artifact_type(v)
    named = F.trim(_text(v, "$.payload.agent"))
    out = F.when(named.isin(*(p[0] for p in PROFILES), *NAMED_ONLY), named)
    for name, stages, types, artifacts, words in PROFILES:
        tests = [c.isin(*values) for c, values in ((stage, stages), (type_, types), (artifact, artifacts)) if values] + [message.contains(w) for w in words]
        out = out.when(reduce(Column.__or__, tests), name)
    return out.otherwise("AssistantAgent")


def run_event(v: Column, place: Column) -> Column:
    """A run event (VARIANT) as a struct; its sequence is its own or its place from 1 on."""
    seq = F.coalesce(*(S.present(F.try_variant_get(v, p, "string")).try_cast("bigint") for p in ("$.event_seq", "$.seq")), F.lit(0))
    return F.struct(
        F.when(seq != 0, seq).otherwise(place + 1).alias("seq"), agent_profile(v).alias("agent"), F.upper(F.coalesce(S.present(F.try_variant_get(v, "$.level", "string")), F.lit("INFO"))).alias("level"),
        _text(v, "$.message", "$.text", "$.stage").alias("text"), F.coalesce(F.try_variant_get(v, "$.payload.progress", "double"), F.try_variant_get(v, "$.progress", "double")).alias("progress"),
        F.lower(_text(v, "$.stage")).alias("stage"), F.upper(_text(v, "$.type")).alias("type"), artifact_type(v).alias("artifact_type"),
    )


def validation_passed(v: Column) -> Column:
    """Unless its payload says that it is not."""
    no = lambda p: F.coalesce(~F.try_variant_get(v, p, "boolean"), F.lit(False))
    return ~(no("$.payload.passed") | no("$.payload.valid"))


def unwrapped_run(v: Column) -> Column:
    """A run in one of its wrappers; null where it has no run_id."""
    found = F.coalesce(*(F.when(S.present(F.try_variant_get(v, f"{p}.run_id", "string")).isNotNull(), F.try_variant_get(v, p, "variant")) for p in ("$.agent_run", "$.result.agent_run")), F.when(S.present(F.try_variant_get(v, "$.run_id", "string")).isNotNull(), v))
    return found


def run_message(status: Column, mode: Column) -> Column:
    """(message, action) of a run."""
    status, mode = F.lower(F.coalesce(status, F.lit(""))), F.lower(F.coalesce(mode, F.lit("")))
    pair = lambda a, b: F.struct(F.lit(a).alias("message"), F.lit(b).alias("action"))
    return (
        F.when((status == "waiting_confirmation") | (mode == "need_confirmation"), pair("请选择一个顶事件候选，以继续生成故障树。", "need_top_event_confirmation"))
        .when((status == "completed") | (mode == "completed"), pair("多智能体故障树生成已完成。", "generation_finished"))
        .when((status == "human_review_required") | (mode == "human_review_required"), pair("生成结果需要人工复核。", "human_review_required"))
        .when((status == "failed") | (mode == "failed"), pair("多智能体故障树生成失败。", "generation_failed"))
        .otherwise(pair("多智能体故障树生成任务正在执行。", "generation_running"))
    )


# Names of stages and of kinds of files.
STAGE_LABELS = {
    "queued": "排队", "prepare": "准备", "tree_record": "创建记录", "waiting_confirmation": "待确认", "review": "人工复核", "human_review_required": "人工复核",
    "completed": "完成", "reuse": "复用", "failed": "失败", "accelerated": "加速",
}
CATEGORY_LABELS = {"document": "文档资料", "work_order": "工单数据", "maintenance_record": "维修记录"}
SOURCE_TYPES = {"document": "manual_document", "work_order": "work_order", "maintenance_record": "maintenance_record"}
BUILD_STAGES = 5
IMPORTED = ("success", "completed", "finished", "done", "succeeded", "successful", "completed_with_sync_error")


def stage_label(stage: Column) -> Column:
    """(P34)"""
    return F.coalesce(_lookup(stage, STAGE_LABELS, stage), F.lit(""))


def category_label(category: Column) -> Column:
    """(P37)"""
    return _lookup(F.trim(category), CATEGORY_LABELS, F.lit(""))


def source_type(category: Column) -> Column:
    """(P37)"""
    return _lookup(F.trim(category), SOURCE_TYPES, F.lit(""))


def build_timeline(status: Column, stage: Column, progress: Column) -> Column:
    """(stage_index, fill_percent, all_done) of a knowledge job."""
    st, sg = F.lower(F.coalesce(status, F.lit(""))), F.lower(F.coalesce(stage, F.lit("")))
    over = st.isin("success", "completed_with_sync_error") | sg.isin("success", "completed_with_sync_error")
    index = (
        F.when((st == "failed") | (sg == "failed"), 0).when((st == "success") | (sg == "success"), BUILD_STAGES).when((sg == "syncing") | (st == "syncing"), 4).when(sg == "relation", 3).when(sg == "entity", 2).when(sg == "chunk", 1)
        .when(sg.isin("parse", "mineru", "clean", "prepare") | st.isin("running", "queued"), 0).when(over, BUILD_STAGES).otherwise(0)
    )
    done = over | (index >= BUILD_STAGES)
    part = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(progress, F.lit(0.0))))
    return F.struct(index.alias("stage_index"), F.when(done, 100.0).otherwise(F.least(F.lit(100.0), (index + part / 100) / BUILD_STAGES * 100)).alias("fill_percent"), done.alias("all_done"))


def import_complete(was: Column, file_status: Column, job_status: Column) -> Column:
    """Once complete a file stays so; else it is where it or its job is done."""
    return F.coalesce(was, F.lit(False)) | F.coalesce(file_status == "done", F.lit(False)) | F.coalesce(F.lower(job_status).isin(*IMPORTED), F.lit(False))


def session_id(project: Column, canvas: Column) -> Column:
    """(P44)"""
    return F.concat_ws(":", F.coalesce(S.present(project), F.lit("default")), F.coalesce(S.present(canvas), F.lit("default")))


def safe_name(session: Column) -> Column:
    """A file name for a session: other signs than letters, digits, dots and dashes as underscores, and a hash that keeps names apart."""
    return F.concat(F.substring(F.regexp_replace(session, "[^A-Za-z0-9._-]", "_"), 1, 80), F.lit("_"), F.substring(F.sha2(session, 256), 1, 8))


def compact_message(role: Column, content: Column, meta: Column, most: int = 800) -> Column:
    """What is kept of a message for a model: `most` signs, and of its meta (VARIANT) intent, action and result."""
    get = lambda p: F.try_variant_get(meta, p, "string")
    return F.struct(role.alias("role"), F.substring(F.coalesce(content, F.lit("")), 1, most).alias("content"), get("$.intent").alias("intent"), S.present(get("$.pending_id")).alias("pending_id"), get("$.intent_decision.reason").alias("reason"), get("$.result.mode").alias("result_mode"), get("$.result.tree_id").alias("tree_id"))


def normal_summary(v: Column) -> Column:
    """A session summary with every field there and of its kind."""
    lists = [F.coalesce(F.try_variant_get(v, f"$.{k}", "array<string>"), F.array().cast("array<string>")).alias(k) for k in _SUMMARY_LISTS]
    object_ = lambda k: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")).startswith("OBJECT"), F.to_json(F.try_variant_get(v, f"$.{k}", "variant")))
    return F.struct(*(_text(v, f"$.{k}").alias(k) for k in _SUMMARY_TEXTS), *lists, *(F.coalesce(object_(k), F.lit("{}")).alias(k) for k in ("current_tree", "last_meaningful_edit")))


def brief_summary(intent: Column, top: Column, nodes: Column, user: Column, assistant: Column) -> Column:
    """(A19, P80)"""
    empty = F.lit("")
    return F.concat(
        F.lit("最近意图："), F.coalesce(intent, empty), F.lit("；当前顶事件："), F.coalesce(S.present(top), F.lit("未确定")), F.lit("；节点数："), F.coalesce(nodes, F.lit(0)).cast("string"),
        F.lit("；最近用户："), F.substring(F.coalesce(user, empty), 1, 120), F.lit("；最近回复："), F.substring(F.coalesce(assistant, empty), 1, 160),
    )


def version_payload(v: Column) -> Column:
    """(tree_id, version, editor, description, is_ai_generated) of a response, version 1 where it has none."""
    body = lambda p: F.coalesce(*(F.try_variant_get(v, f"{w}.{p}", "string") for w in ("$.data", "$.result", "$.payload", "$")))
    return F.struct(body("tree_id").alias("tree_id"), F.coalesce(body("version").try_cast("int"), F.lit(1)).alias("version"), F.coalesce(body("editor"), F.lit("")).alias("editor"), F.coalesce(body("description"), F.lit("")).alias("description"), F.coalesce(body("is_ai_generated").try_cast("boolean"), F.lit(True)).alias("is_ai_generated"))


def version_date(x: Column, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """A time that is ISO text, or an object {"$date": ...}, for people; the text itself where it is neither."""
    text = F.coalesce(F.get_json_object(x, "$['$date']"), x)
    return F.coalesce(F.date_format(F.try_to_timestamp(text), pattern), text, F.lit(""))


# Fields of a trigger rule, under which names they come, and what they are called for people.
RULE_FIELDS = (
    ("设备类型", ("deviceTypeId", "device_type_id")), ("测点", ("measurePointName", "measure_point_name")), ("关系符", ("symbol", "operator", "op")),
    ("阈值", ("thresholds", "threshold")), ("持续时间", ("duration", "time_window", "timeWindow")),
)


def rule_rows(rule: Column) -> Column:
    """(label, value) of a trigger rule given as JSON text: known fields first, then what is left of it by name."""
    v = F.try_parse_json(rule)
    entry = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    known = []
    for label, names in RULE_FIELDS:
        plain = F.coalesce(*(F.try_variant_get(v, f"$.{n}", "string") for n in names))
        if label == "阈值":
            plain = F.coalesce(*(F.array_join(F.try_variant_get(v, f"$.{n}", "array<string>"), "、") for n in names), plain)
        known.append(F.when(F.trim(plain) != "", entry(label, plain)))
    rest = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, x: ~k.isin(*(n for _, names in RULE_FIELDS for n in names)) & x.isNotNull())
    simple = lambda x: F.coalesce(F.when(~F.schema_of_variant(x).startswith("OBJECT") & ~F.schema_of_variant(x).startswith("ARRAY"), F.try_variant_get(x, "$", "string")), F.to_json(x))
    others = F.filter(F.transform(F.array_sort(F.map_entries(F.map_from_entries(F.transform(F.map_entries(rest), lambda e: F.struct(e["key"], simple(e["value"])))))), lambda e: F.struct(e["key"].alias("label"), e["value"].alias("value"))), lambda e: F.trim(e["value"]) != "")
    rows = F.concat(F.array_compact(F.array(*known)), F.coalesce(others, F.array().cast("array<struct<label:string,value:string>>")))
    return F.when(rule.isNull(), F.array(entry("内容", F.lit("（空）")))).when(F.size(rows) == 0, F.array(entry("内容", rule))).otherwise(rows)


def canonical_json(text: Column) -> Column:
    """JSON as one text whatever its white space and the order of its keys; null where it is none."""
    return F.to_json(F.try_parse_json(text))


def default_event(name: Column) -> Column:
    """What an event holds when it is made."""
    empty = F.lit("")
    return F.struct(empty.alias("id"), name.alias("name"), empty.alias("description"), empty.alias("errorLevel"), F.lit(1e-8).alias("probability"), F.lit(1e-6).alias("showProbability"))


def own_gate(type_: Column, gate: Column, raw: Column) -> Column:
    """The gate of a node where gates are written as words: none for basic events, else its own, else by its code, else OR."""
    return F.when(type_ != "basic", F.coalesce(S.present(S.gate_type(gate)), S.present(S.gate_label(raw)), F.lit("OR")))
