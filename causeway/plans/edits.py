"""Registered queries of graph edits, plans, diffs and evidence, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import scalars as S
from causeway.operators import diff, graph, retrieval, rewrite
from causeway.plans import surrogate as V
from causeway.plans.registry import query
from causeway.storage import stored


def _graph(spark: SparkSession, d: str) -> rewrite.Graph:
    return V.nodes(spark, d), V.edges(spark, d)


def _of(spark: SparkSession, d: str, table: str, prefix: str, key: str, **columns):
    return V.table(spark, d, table).select(F.lit(V.TREE).alias("tree_id"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), *(v.alias(k) for k, v in columns.items()), F.col(key).cast("bigint").alias("pos"))


@query(f"WITH {V.NODES} SELECT id, CASE WHEN type = 'basic' THEN 'intermediate' ELSE type END AS type FROM sv_nodes UNION ALL SELECT 'x' || o_orderkey, 'basic' FROM orders")
def add_children(spark: SparkSession, d: str) -> DataFrame:
    """A cause below every order, which becomes intermediate"""
    new = V.table(spark, d, "orders").select(F.lit(V.TREE).alias("tree_id"), V._key("x", "o_orderkey").alias("id"), F.lit("new").alias("label"), F.lit("basic").alias("type"), F.lit("").alias("gate"), F.col("o_orderkey").alias("pos"), V._key("o", "o_orderkey").alias("parent"))
    return rewrite.add_nodes(_graph(spark, d), new)[0].select("id", "type")


@query(f"WITH {V.EDGES} SELECT source, CASE WHEN target LIKE 'n%' THEN target || '-g' ELSE target END AS target FROM sv_edges UNION ALL SELECT 'n' || n_nationkey || '-g', 'n' || n_nationkey FROM nation")
def insert_gates(spark: SparkSession, d: str) -> DataFrame:
    """A gate below every nation"""
    wanted = V.table(spark, d, "nation").select(F.lit(V.TREE).alias("tree_id"), V._key("n", "n_nationkey").alias("parent"), F.concat(V._key("n", "n_nationkey"), F.lit("-g")).alias("gate_id"), F.lit("OR").alias("label"), F.col("n_nationkey").cast("bigint").alias("pos"))
    return rewrite.insert_gates(_graph(spark, d), wanted)[1].select("source", "target")


@query(f"WITH {V.NODES} SELECT id, CASE WHEN id LIKE 'c%' THEN lower(label) ELSE label END AS label, CASE WHEN id LIKE 'n%' THEN 'AND' ELSE gate END AS gate, CASE WHEN id LIKE 'o%' THEN 'intermediate' ELSE type END AS type FROM sv_nodes")
def set_values(spark: SparkSession, d: str) -> DataFrame:
    """M5, M6, M7, M26, M27"""
    g = _graph(spark, d)
    g = rewrite.set_values(g, g[0].filter("id LIKE 'c%'").select("tree_id", "id", F.lower("label").alias("value")), "label")
    g = rewrite.set_values(g, _of(spark, d, "nation", "n", "n_nationkey", value=F.lit("AND")), "gate")
    return rewrite.set_values(g, _of(spark, d, "orders", "o", "o_orderkey", value=F.lit("intermediate")), "type")[0].select("id", "label", "gate", "type")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'basic_event' WHEN 1 THEN '3' ELSE 'basic' END AS type, CASE o_orderkey % 2 WHEN 0 THEN '2' ELSE 'OR' END AS gate FROM orders""")
def written_in_style(spark: SparkSession, d: str) -> DataFrame:
    """New types and gates written as the old ones are"""
    k = F.col("o_orderkey")
    old = F.when(k % 3 == 0, "top_event").when(k % 3 == 1, "2").otherwise("top")
    return V.table(spark, d, "orders").select("o_orderkey", S.type_in_style(old, F.lit("basic")).alias("type"), S.gate_in_style(F.when(k % 2 == 0, "1").otherwise("AND"), F.lit("OR")).alias("gate"))


@query(f"WITH {V.EDGES} SELECT source, target FROM sv_edges WHERE source NOT LIKE 'o%' UNION ALL SELECT 'o' || o_orderkey, 'r0' FROM orders WHERE o_orderstatus = 'F'")
def links_by_hand(spark: SparkSession, d: str) -> DataFrame:
    """Links of orders go, named the wrong way round; finished orders get new ones, twice asked for"""
    g = rewrite.delete_edges(_graph(spark, d), V.edges(spark, d).filter("source LIKE 'o%'").select("tree_id", F.col("target").alias("source"), F.col("source").alias("target")))
    new = V.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.lit(V.TREE).alias("tree_id"), V._key("o", "o_orderkey").alias("source"), F.lit("r0").alias("target"), F.col("o_orderkey").alias("pos"))
    return rewrite.add_edges(g, new.unionByName(new))[1].select("source", "target")


@query(f"WITH {V.EDGES} SELECT source, CASE WHEN source LIKE 'c%' THEN 'r1' ELSE target END AS target FROM sv_edges")
def move_subtrees(spark: SparkSession, d: str) -> DataFrame:
    """All customers hang on a region"""
    moves = _of(spark, d, "customer", "c", "c_custkey", parent=F.lit("r1"))
    return rewrite.move_subtrees(_graph(spark, d), moves)[1].select("source", "target")


@query("SELECT 'o' || o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderpriority END AS description, CASE WHEN o_orderstatus = 'O' THEN 'high' ELSE 'low' END AS level FROM orders")
def patch_events(spark: SparkSession, d: str) -> DataFrame:
    """M8, M9"""
    nodes = _of(spark, d, "orders", "o", "o_orderkey", type=F.lit("basic"), event=F.struct(F.col("o_orderpriority").alias("description"), F.lit("low").alias("errorLevel")))
    patches = _of(spark, d, "orders", "o", "o_orderkey", patch=F.struct(F.when(F.col("o_orderstatus") == "F", "done").alias("description"), F.when(F.col("o_orderstatus") == "O", "high").alias("errorLevel")))
    return rewrite.patch_events((nodes, V.edges(spark, d)), patches)[0].select("id", "event.description", F.col("event.errorLevel").alias("level"))


@query(f"WITH {V.NODES} SELECT id, label FROM sv_nodes UNION ALL SELECT id || '-copy', label || '(副本)' FROM sv_nodes WHERE id LIKE 'c%'")
def duplicate_events(spark: SparkSession, d: str) -> DataFrame:
    """M11"""
    wanted = _of(spark, d, "customer", "c", "c_custkey", new_id=F.concat(V._key("c", "c_custkey"), F.lit("-copy")))
    return rewrite.duplicate_events(_graph(spark, d), wanted)[0].select("id", "label")


@query(f"WITH {V.EDGES} SELECT source, CASE WHEN source LIKE 'c%' THEN source || '-up' ELSE target END AS target FROM sv_edges UNION ALL SELECT 'c' || c_custkey || '-up', 'n' || c_nationkey FROM customer")
def insert_parents(spark: SparkSession, d: str) -> DataFrame:
    """M14"""
    wanted = _of(spark, d, "customer", "c", "c_custkey", new_id=F.concat(V._key("c", "c_custkey"), F.lit("-up")), label=F.lit("up"))
    return rewrite.insert_parents(_graph(spark, d), wanted)[1].select("source", "target")


@query("SELECT 's' || user_id AS tree_id, '新底事件' || (1 + count(*) FILTER (WHERE event_type = 'view')) AS label FROM events GROUP BY user_id")
def standalone_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A tree for each user, with nodes called as new ones are"""
    e = V.table(spark, d, "events")
    nodes = e.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("tree_id"), F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") == "view", F.concat(F.lit("新底事件"), F.col("event_id").cast("string"))).otherwise(F.lit("x")).alias("label"), F.lit("basic").alias("type"), F.lit("").alias("gate"), F.col("event_id").alias("pos"))
    wanted = nodes.select("tree_id").distinct().select("tree_id", F.lit("new").alias("new_id"), F.lit("basic").alias("type"), F.lit(0).cast("bigint").alias("pos"))
    return rewrite.standalone_nodes((nodes, V.edges(spark, d)), wanted)[0].filter("id = 'new'").select("tree_id", "label")


@query(f"WITH {V.NODES} SELECT id, CASE WHEN id LIKE 'n%' THEN 'p' || id END AS probability, label FROM sv_nodes")
def set_node_properties(spark: SparkSession, d: str) -> DataFrame:
    """What tells nodes apart can't be set"""
    wanted = _of(spark, d, "nation", "n", "n_nationkey", properties=F.struct(F.concat(F.lit("p"), V._key("n", "n_nationkey")).alias("probability"), F.lit("other").alias("id")))
    return rewrite.set_node_properties(_graph(spark, d), wanted)[0].select("id", "probability", "label")


@query(f"WITH {V.EDGES} SELECT source, target, CASE WHEN source LIKE 'n%' THEN 'neg' END AS polarity FROM sv_edges")
def set_edge_properties(spark: SparkSession, d: str) -> DataFrame:
    """M22"""
    wanted = V.edges(spark, d).filter("source LIKE 'n%'").select("tree_id", "source", "target", F.struct(F.lit("neg").alias("polarity"), F.lit("z").alias("source")).alias("properties"))
    return rewrite.set_edge_properties(_graph(spark, d), wanted)[1].select("source", "target", "polarity")


@query("""SELECT 'p' || n_nationkey AS plan_id, i AS index, level, issue, node FROM nation, LATERAL (VALUES
  (CAST(0 AS BIGINT), 'WARNING', 'edge already exists', NULL), (2, 'ERROR', 'move would create a cycle', NULL), (4, 'ERROR', 'source or target node not found', NULL),
  (5, 'ERROR', 'self edge is not allowed', NULL), (7, 'ERROR', 'edge would create a cycle', NULL), (9, 'ERROR', 'unsupported operation', NULL), (10, 'ERROR', 'cannot move a node under itself', NULL),
  (11, 'ERROR', 'node or new parent not found', NULL)) AS v(i, level, issue, node)
  WHERE i NOT IN (2, 7) OR n_nationkey IN (SELECT c_nationkey FROM customer)
  UNION ALL SELECT 'p' || n_nationkey, i, 'ERROR', issue, NULL FROM nation, (VALUES (CAST(2 AS BIGINT), 'node or new parent not found'), (7, 'source or target node not found')) AS v(i, issue) WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)
  UNION ALL SELECT 'p' || n_nationkey, NULL, 'ERROR', 'basic event has children after edit plan', 'r' || n_regionkey FROM nation""")
def plan_validate(spark: SparkSession, d: str) -> DataFrame:
    """A plan of 13 operations for every nation, each with its own faults"""
    n, c = V.table(spark, d, "nation"), V.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_custkey").alias("child"))
    own, region, other = V._key("n", "n_nationkey"), V._key("r", "n_regionkey"), F.concat(F.lit("r"), ((F.col("n_regionkey") + 1) % 5).cast("string"))
    child, none = F.coalesce(V._key("c", "child"), F.lit("c0")), F.lit(None).cast("string")
    steps = [
        ("add_edge", region, none, own, none), ("add_edge", own, none, other, none), ("move_subtree", own, none, child, none), ("delete_edge", region, none, own, none), ("add_edge", own, none, none, F.lit("no such label")),
        ("add_edge", none, F.col("n_name"), own, none), ("add_edge", own, none, region, none), ("add_edge", own, none, child, none), ("set_node_type", none, none, region, none), ("paint", own, none, own, none),
        ("move_subtree", own, none, own, none), ("move_subtree", own, none, none, none), ("paint", own, none, own, none),
    ]
    rows = F.array(*(F.struct(F.lit(i).alias("index"), F.lit(op).alias("op"), a.alias("source_id"), b.alias("source_label"), e.alias("target_id"), f.alias("target_label"), F.lit("basic").alias("node_type")) for i, (op, a, b, e, f) in enumerate(steps)))
    plans = n.join(c, "n_nationkey", "left").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("plan_id"), F.lit(V.TREE).alias("tree_id"), F.inline(rows))
    found = rewrite.plan_issues(_graph(spark, d), plans)
    return found.select("plan_id", F.col("index").cast("bigint").alias("index"), "level", "issue", F.col("node_id").alias("node"))


@query(f"""WITH {V.NODES}, one AS (SELECT label, min(id) AS id, count(*) AS n, min(pos) AS p FROM sv_nodes GROUP BY label)
  SELECT 'i' || id AS ref, id FROM sv_nodes WHERE id LIKE 'n%' UNION ALL SELECT 'l' || s.id, CASE WHEN n = 1 THEN one.id END FROM sv_nodes s JOIN one USING (label) WHERE s.id LIKE 'c%'
  UNION ALL SELECT 'o' || o_orderkey, CASE WHEN (SELECT count(*) FROM orders b WHERE b.o_orderpriority = a.o_orderpriority) = 1 THEN 'o' || o_orderkey END FROM orders a WHERE o_orderkey < 50""")
def resolve_names(spark: SparkSession, d: str) -> DataFrame:
    """Nations by id, customers and some orders by label"""
    nodes = V.nodes(spark, d)
    none = F.lit(None).cast("string")
    ask = nodes.filter("id LIKE 'n%'").select("tree_id", F.concat(F.lit("i"), "id").alias("ref"), F.col("id").alias("node_id"), none.alias("label"))
    ask = ask.unionByName(nodes.filter("id LIKE 'c%'").select("tree_id", F.concat(F.lit("l"), "id").alias("ref"), none.alias("node_id"), "label"))
    some = V.table(spark, d, "orders").filter("o_orderkey < 50").select(F.lit(V.TREE).alias("tree_id"), V._key("o", "o_orderkey").alias("ref"), none.alias("node_id"), F.col("o_orderpriority").alias("label"))
    return rewrite.resolve(nodes, ask.unionByName(some)).select("ref", "id")


@query("""SELECT n_name AS needle, 'n' || min(n_nationkey) AS id FROM nation GROUP BY n_name UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region""")
def best_match(spark: SparkSession, d: str) -> DataFrame:
    """nations by name, regions by id"""
    needles = V.table(spark, d, "nation").select(F.col("n_name").alias("needle")).unionByName(V.table(spark, d, "region").select(V._key("r", "r_regionkey").alias("needle")))
    return retrieval.best_match(V.nodes(spark, d), needles)


@query(f"WITH {V.NODES}, {V.EDGES}, w AS (SELECT 'r' || n_regionkey AS id, sum(greatest(1, (SELECT sum(greatest(1, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey))) FROM customer WHERE c_nationkey = n_nationkey))) AS n FROM nation GROUP BY n_regionkey) SELECT id AS root FROM w ORDER BY n DESC, id LIMIT 1")
def root_choice(spark: SparkSession, d: str) -> DataFrame:
    """T5: the widest region"""
    return graph.root_choice(*_graph(spark, d)).select("root")


def _json_versions(spark: SparkSession, d: str):
    """Orders as nodes in JSON, before and after: gate, priority and description differ in tenths of them, and one in ten has its event elsewhere."""
    o, k = V.table(spark, d, "orders"), F.col("o_orderkey")

    def made(after: bool) -> DataFrame:
        priority = F.when((k % 10 == 3) & F.lit(after), "x").otherwise(F.col("o_orderpriority"))
        gate = F.when((k % 10 == 4) & F.lit(after), "AND").otherwise("OR")
        plain = F.to_json(F.struct(gate.alias("gate"), F.struct(priority.alias("priority")).alias("event"), F.lit(after).alias("unlike")))
        other = F.to_json(F.struct(F.struct(F.struct(priority.alias("priority")).alias("event"), gate.alias("gateLabel")).alias("meta")))
        return o.select(F.lit(V.TREE).alias("tree_id"), V._key("o", "o_orderkey").alias("id"), diff.node_signature(F.parse_json(F.when((k % 10 == 5) & F.lit(after), other).otherwise(plain))).alias("signature"))

    return made(False), made(True)


@query("SELECT 'o' || o_orderkey AS id, 'modified' AS status FROM orders WHERE o_orderkey % 10 IN (3, 4)")
def signature_diff(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the event and the gate count, wherever they stand; other fields don't"""
    return diff.node_diff(*_json_versions(spark, d), ["signature"]).select("id", "status")


@query("SELECT 'c' || o_custkey AS id, 'modified' AS status FROM orders WHERE o_orderkey % 10 = 3 GROUP BY o_custkey")
def relation_diff(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose relation changed mark their targets"""
    k = F.col("o_orderkey")

    def edges(after: bool) -> DataFrame:
        text = F.to_json(F.struct(F.struct(F.when((k % 10 == 3) & F.lit(after), "neg").otherwise("pos").alias("polarity"), F.lit(after).alias("seen")).alias("relation")))
        return V.table(spark, d, "orders").select(F.lit(V.TREE).alias("tree_id"), V._key("o", "o_orderkey").alias("source"), V._key("c", "o_custkey").alias("target"), diff.edge_signature(F.parse_json(text)).alias("relation"))

    nodes = V.nodes(spark, d).select("tree_id", "id", "label")
    return diff.graph_diff((nodes, edges(False)), (nodes, edges(True)), ["label"], "relation")[0].select("id", "status")


@query(f"WITH {V.VERSIONS} SELECT id, label FROM sv_after")
def accepted_overlay(spark: SparkSession, d: str) -> DataFrame:
    """The overlay of a pending edit without its marks is the later version"""
    shown = diff.overlay(V.versions_before(spark, d), V.versions_after(spark, d), ["label"])
    return diff.without_markers(shown).select("id", "label")


@query(f"WITH {V.VERSIONS} SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'modified' END AS status FROM sv_after a FULL JOIN sv_before b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.label IS DISTINCT FROM b.label")
def label_diff(spark: SparkSession, d: str) -> DataFrame:
    """D3"""
    return diff.node_diff(V.versions_before(spark, d), V.versions_after(spark, d), ["label"]).select("id", "status")


@query(f"WITH {V.RUN_EVENTS} SELECT run_id, event_seq + 1000000 AS seq FROM sv_runs WHERE type = 'view' UNION ALL SELECT run_id, event_seq FROM sv_runs WHERE type <> 'view'")
def replace_segment(spark: SparkSession, d: str) -> DataFrame:
    """Views are local, all else is fetched anew"""
    e = V.run_events(spark, d)
    local, old = e.filter("type = 'view'").select("run_id", (F.col("event_seq") + 1_000_000).alias("seq")), e.select("run_id", F.col("event_seq").alias("seq"))
    return diff.replace_segment(local.unionByName(old), e.filter("type <> 'view'").select("run_id", F.col("event_seq").alias("seq")), "seq")


@query("SELECT 'n' || c_nationkey AS tree_id, 'c' || c_custkey AS source, 'n' || c_nationkey AS target FROM customer WHERE c_nationkey % 2 = 1 OR c_mktsegment <> 'BUILDING' UNION ALL SELECT 'n' || n_nationkey, 'extra', 'n' || n_nationkey FROM nation WHERE n_nationkey % 2 = 1")
def edge_repair(spark: SparkSession, d: str) -> DataFrame:
    """A tree for each nation; what was to go goes only where the edges are as they were"""
    c, n = V.table(spark, d, "customer"), V.table(spark, d, "nation")
    edge = lambda df: df.select(V._key("n", "c_nationkey").alias("tree_id"), V._key("c", "c_custkey").alias("source"), V._key("n", "c_nationkey").alias("target"))
    more = n.filter("n_nationkey % 2 = 1").select(V._key("n", "n_nationkey").alias("tree_id"), F.lit("extra").alias("source"), V._key("n", "n_nationkey").alias("target"))
    return diff.repaired(edge(c), edge(c).unionByName(more), edge(c.filter("c_mktsegment = 'BUILDING'")))


@query("SELECT CAST(user_id AS VARCHAR) AS tree_id, count(*) > 0 AND bool_or(event_type = 'error') AS is_stale FROM events GROUP BY user_id")
def stale_signatures(spark: SparkSession, d: str) -> DataFrame:
    """A tree for each user; errors were checked under another label"""
    from causeway.operators import library

    e = V.table(spark, d, "events")
    nodes = lambda label: e.select(F.col("user_id").cast("string").alias("tree_id"), F.col("event_id").cast("string").alias("id"), label.alias("label"), F.col("event_type").alias("type"), F.lit("").alias("gate"))
    edges = e.select(F.col("user_id").cast("string").alias("tree_id"), F.col("event_id").cast("string").alias("source"), F.lit("top").alias("target"))
    before = diff.graph_signature(nodes(F.when(F.col("event_type") == "error", "old").otherwise("x")), edges)
    return library.stale(diff.graph_signature(nodes(F.lit("x")), edges), before, ["tree_id"])


@query("SELECT 'o' || o_orderkey || '-maintenance-' || i AS id, 'o' || o_orderkey AS parent, CASE i WHEN 1 THEN o_orderpriority ELSE o_orderstatus END AS label FROM orders, (VALUES (1), (2)) AS v(i)")
def overlay_items(spark: SparkSession, d: str) -> DataFrame:
    """J9, P16, F5"""
    text = F.concat(F.lit(" "), "o_orderpriority", F.lit("；；\n "), "o_orderstatus", F.lit(";"))
    return retrieval.overlay_items(_of(spark, d, "orders", "o", "o_orderkey", investigate=text)).select("id", "parent", "label")


@query("""SELECT o_orderkey, array_to_string(list_transform(range(0, 25 + CAST(o_orderkey % 3 AS INT)), lambda i: 'k' || i), ',') || ',s,7,obj' AS ids FROM orders""")
def all_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """More than 20 ids under six names, alone, as numbers and in objects, repeated"""
    many = F.transform(F.sequence(F.lit(0), (24 + F.col("o_orderkey") % 3).cast("int")), lambda i: F.concat(F.lit(" k"), i.cast("string")))
    node = F.to_json(F.struct(many.alias("evidence_chunk_ids"), F.lit("s").alias("source_chunk_ids"), F.array(F.lit("k1"), F.lit("")).alias("chunk_ids"), F.lit(7).alias("chunks"), F.array(F.struct(F.lit("obj").alias("chunk_id"))).alias("sourceChunks")))
    return V.table(spark, d, "orders").select("o_orderkey", F.array_join(retrieval.chunk_ids(F.parse_json(node)), ",").alias("ids"))


@query("SELECT o_orderkey, 'u1,' || o_orderstatus || ',' || o_custkey AS ids FROM orders")
def graph_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """P26, P23"""
    node = F.struct(F.array(F.struct(F.lit("u1").alias("chunk_uid"), F.lit("no").alias("id"))).alias("source_chunk_refs"))
    edge = F.struct(F.array(F.struct(F.col("o_custkey").alias("id"))).alias("documents"), F.col("o_orderstatus").alias("chunk_ids"))
    context = F.to_json(F.struct(F.array(node, node).alias("nodes"), F.array(edge).alias("edges")))
    return V.table(spark, d, "orders").select("o_orderkey", F.array_join(retrieval.graph_chunk_ids(F.parse_json(context)), ",").alias("ids"))


@query(f"WITH {V.KG} SELECT src AS source, dst AS target, file_version_id, chunk_id FROM (SELECT DISTINCT src, dst, rel AS file_version_id, CAST(length(rel_id) AS VARCHAR) AS chunk_id FROM sv_kg)")
def edge_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Documents of parallel edges, each reference once"""
    document = F.struct(F.col("rel").alias("file_version_id"), F.length("rel_id").cast("string").alias("chunk_id"))
    each = V.kg(spark, d).select(F.lit(V.TREE).alias("tree_id"), F.col("src").alias("source"), F.col("dst").alias("target"), F.array(document).alias("documents"))
    return retrieval.edge_evidence(each).select("source", "target", "file_version_id", "chunk_id")


@query("SELECT o_orderkey AS id, least(o_custkey, o_orderkey) || '|' || greatest(o_custkey, o_orderkey) || '|' || o_orderstatus AS documents FROM orders")
def node_documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by number, then texts"""
    none = F.lit(None).cast("string")
    docs = F.array(F.struct(none.alias("chunk_id"), F.col("o_orderstatus").alias("text")), F.struct(F.col("o_orderkey").cast("string").alias("chunk_id"), none.alias("text")), F.struct(F.col("o_custkey").cast("string").alias("chunk_id"), none.alias("text")))
    found = retrieval.node_documents(V.table(spark, d, "orders").select(F.lit(V.TREE).alias("tree_id"), F.col("o_orderkey").alias("id"), docs.alias("documents")))
    return found.select("id", F.array_join("documents", "|").alias("documents"))


@query("SELECT doc_id AS chunk_id, CASE WHEN contains(lower(source), 'site1') THEN 'a/Site1' WHEN contains(lower(source), 'site2') THEN 'b\\site2' ELSE 'a/Site1' END AS file_name FROM documents")
def chunk_named_in(spark: SparkSession, d: str) -> DataFrame:
    """J6"""
    none = F.lit(None).cast("string")
    chunks = V.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.upper("source").alias("source"), *(none.alias(c) for c in ("chunk_name", "file", "doc_name", "path")))
    return retrieval.named_in(chunks, ["a/Site1", "b\\site2"]).select("chunk_id", "file_name")


@query("SELECT DISTINCT 's7' AS id, 'p' || l_partkey AS neighbour, l_returnflag AS rel FROM lineitem WHERE l_suppkey = 7")
def question_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """J13"""
    edges = V.kg(spark, d)
    names = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("name", F.concat(F.lit("|"), "id", F.lit("|")))
    return retrieval.question_neighbours(edges, names, " |s7| ")


@query("""SELECT 'o' || o_orderkey AS id, o_custkey AS chunk, CASE WHEN o_orderstatus = 'F' THEN 'node' ELSE 'neighbour' END AS matched_by FROM orders""")
def evidence_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Orders that are finished name a chunk, the others' neighbours do"""
    o = V.table(spark, d, "orders")
    named = o.select(F.lit(V.TREE).alias("tree_id"), V._key("o", "o_orderkey").alias("id"), F.array(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey").cast("string"))).alias("source_chunk_ids"))
    near = o.select(F.lit(V.TREE).alias("tree_id"), V._key("o", "o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("neighbour_chunk_id"))
    chunks = o.select(F.col("o_custkey").cast("string").alias("chunk_id")).distinct().withColumn("text", F.col("chunk_id"))
    return retrieval.evidence_with_fallback(named, chunks, near).select("id", F.col("chunk_id").cast("bigint").alias("chunk"), "matched_by")


_PLAN = [
    {"op": "rename_node", "target_id": "r0", "new_label": "Zero"}, {"op": "add_child_node", "parent_id": "n2", "new_id": "x1", "label": "X"}, {"op": "move_subtree", "node_id": "n5", "new_parent_id": "r3"},
    {"op": "set_gate_type", "target_id": "n1", "gate_type": "and"}, {"op": "add_edge", "source_id": "n7", "target_id": "r4"}, {"op": "delete_edge", "source_id": "n8", "target_id": "r2"},
]


@query("""WITH e AS (SELECT 'n' || n_nationkey AS source, CASE n_nationkey WHEN 5 THEN 'r3' ELSE 'r' || n_regionkey END AS target FROM nation WHERE NOT (n_nationkey = 8 AND n_regionkey = 2) UNION ALL VALUES ('n7', 'r4'), ('x1', 'n2')),
  n AS (SELECT 'r' || r_regionkey AS id, CASE r_regionkey WHEN 0 THEN 'Zero' ELSE r_name END AS label, 'OR' AS gate FROM region
    UNION ALL SELECT 'n' || n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 OR n_nationkey = 1 THEN 'AND' ELSE 'OR' END FROM nation UNION ALL VALUES ('x1', 'X', ''))
  SELECT n.id, n.label, n.gate, coalesce(string_agg(DISTINCT e.target, ',' ORDER BY e.target), '') AS parents FROM n LEFT JOIN e ON e.source = n.id GROUP BY ALL""")
def dispatched_plan(spark: SparkSession, d: str) -> DataFrame:
    """A plan of six operations on the whole tree; regions, nations and what it adds afterwards"""
    (nodes, edges), errors = rewrite.apply_plan(spark, _graph(spark, d), json.dumps({"operations": _PLAN}), tree_id=V.TREE)
    if errors:
        raise ValueError(errors)
    shown = stored(nodes.filter("id RLIKE '^[rnx]'").select("id", "label", "gate"))
    up = edges.withColumnRenamed("source", "id").join(shown.select("id"), "id", "left_semi").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias("parents"))
    return shown.join(up, "id", "left").select("id", "label", F.coalesce("gate", F.lit("")).alias("gate"), F.coalesce("parents", F.lit("")).alias("parents"))
