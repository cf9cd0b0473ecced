"""Registered queries over the driver's tables, and the SQL that checks them.

"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import scalars as S
from causeway.operators import diff, graph, retrieval, rewrite, state
from causeway.plans import surrogate as V
from causeway.plans.registry import QUERIES, SQL, Query
from causeway.plans.registry import query as _query
from causeway.streaming import runs

def queries() -> dict[str, Query]:
    from causeway.plans import canvas, edits, layouts, library, records, sessions  # noqa: F401 (they register)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


def _long(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


_DOWN = "walk AS (SELECT id AS root, id, 0 AS depth FROM sv_nodes WHERE type = 'top' UNION ALL SELECT w.root, e.source, w.depth + 1 FROM walk w JOIN sv_edges e ON e.target = w.id)"


@_query(f"WITH RECURSIVE {V.NODES}, {V.EDGES}, {_DOWN} SELECT root, CAST(depth AS BIGINT) AS depth, count(*) AS n FROM walk GROUP BY ALL")
def closure_by_depth(spark: SparkSession, d: str) -> DataFrame:
    """R1, A1"""
    roots = V.nodes(spark, d).filter("type = 'top'").select("tree_id", F.col("id").alias("root"))
    return graph.closure(V.edges(spark, d), roots).groupBy("root", *_long("depth")).agg(F.count("*").alias("n"))


@_query(f"""WITH {V.EDGES} SELECT 'c' || c_custkey AS id, 'c' || c_custkey || '>n' || c_nationkey || '>r' || n_regionkey AS path, CAST(2 AS BIGINT) AS depth
  FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def ancestor_path(spark: SparkSession, d: str) -> DataFrame:
    """R2, A3"""
    starts = V.nodes(spark, d).filter("id LIKE 'c%'").select("tree_id", "id")
    return graph.ancestor_paths(V.edges(spark, d), starts).select("id", "path", *_long("depth"))


@_query(f"""WITH RECURSIVE {V.DAG}, walk AS (SELECT 'n' || n_nationkey AS root, 'n' || n_nationkey AS id FROM nation
  UNION SELECT w.root, e.source FROM walk w JOIN sv_dag e ON e.target = w.id) SELECT root, count(*) AS n FROM walk GROUP BY root""")
def reachable_dag(spark: SparkSession, d: str) -> DataFrame:
    """R1, R2 with shared children"""
    roots = V.table(spark, d, "nation").select(F.lit(V.TREE).alias("tree_id"), V._key("n", "n_nationkey").alias("root"))
    return graph.closure(V.dag(spark, d), roots).groupBy("root").agg(F.count("*").alias("n"))


@_query("""SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'duplicate' AS verdict FROM nation
  UNION ALL SELECT 'n' || n_nationkey, 'r' || ((n_regionkey + 1) % 5), 'ok' FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'duplicate' FROM customer
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'cycle' FROM customer""")
def cycle_check_add_edge(spark: SparkSession, d: str) -> DataFrame:
    """Their own and the next region under nations (turned around), customers under and above their nation"""
    n, c = (V.table(spark, d, t) for t in ("nation", "customer"))
    own, other = F.col("n_regionkey"), (F.col("n_regionkey") + 1) % 5
    tops = n.select(F.explode(F.array(own, other)).alias("r"), V._key("n", "n_nationkey").alias("target")).select(V._key("r", "r").alias("source"), "target")
    down = c.select(V._key("c", "c_custkey").alias("source"), V._key("n", "c_nationkey").alias("target"))
    wanted = tops.select("source", "target").unionByName(down).unionByName(down.select(F.col("target").alias("source"), F.col("source").alias("target"))).withColumn("tree_id", F.lit(V.TREE))
    return rewrite.judged_edges((V.nodes(spark, d), V.edges(spark, d)), wanted).select("source", "target", "verdict")


@_query(f"""WITH {V.NODES}, {V.EDGES} SELECT n.id, (SELECT count(*) FROM sv_edges e WHERE e.target = n.id) AS n_children, (SELECT count(*) FROM sv_edges e WHERE e.target = n.id) AS n_event_children,
  (SELECT min(e.target) FROM sv_edges e WHERE e.source = n.id) AS parent FROM sv_nodes n""")
def children_per_parent(spark: SparkSession, d: str) -> DataFrame:
    """A2, A5, R10, R11"""
    return graph.children(V.edges(spark, d), V.nodes(spark, d)).select("id", "n_children", "n_event_children", "parent")


@_query(f"""WITH {V.NODES}, {V.EDGES} SELECT (SELECT label FROM sv_nodes WHERE type = 'top' ORDER BY pos LIMIT 1) AS top_event, (SELECT count(*) FROM sv_nodes) AS node_count,
  (SELECT count(*) FROM sv_edges) AS edge_count, (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT type || '=' || count(*) AS t FROM sv_nodes GROUP BY type)) AS type_counts,
  (SELECT string_agg(label, '|' ORDER BY pos) FROM (SELECT n.label, n.pos FROM sv_edges e JOIN sv_nodes n ON n.id = e.source WHERE e.target = (SELECT id FROM sv_nodes WHERE type = 'top' ORDER BY pos LIMIT 1) ORDER BY n.pos LIMIT 12)) AS main_branches""")
def tree_summary(spark: SparkSession, d: str) -> DataFrame:
    """A1"""
    return graph.summary(V.nodes(spark, d), V.edges(spark, d)).drop("tree_id")


_EXPANDED = """
gx_edges AS (SELECT e.source, e.target || '-gate' AS target FROM sv_edges e JOIN sv_nodes n ON n.id = e.target AND n.gate <> ''
  UNION ALL SELECT DISTINCT e.target || '-gate', e.target FROM sv_edges e JOIN sv_nodes n ON n.id = e.target AND n.gate <> ''
  UNION ALL SELECT e.source, e.target FROM sv_edges e JOIN sv_nodes n ON n.id = e.target AND n.gate = '')"""


@_query(f"WITH {V.NODES}, {V.EDGES}, {_EXPANDED} SELECT source, target FROM gx_edges")
def gate_expand(spark: SparkSession, d: str) -> DataFrame:
    """J1"""
    return graph.expand_gates(V.nodes(spark, d), V.edges(spark, d))[1].select("source", "target")


@_query(f"WITH {V.NODES}, {V.EDGES} SELECT source, target FROM sv_edges")
def gate_collapse(spark: SparkSession, d: str) -> DataFrame:
    """J2, J3 after J1: the edges as they were"""
    return graph.collapse_gates(*graph.expand_gates(V.nodes(spark, d), V.edges(spark, d)))[1].select("source", "target")


@_query(f"""WITH {V.NODES}, {V.EDGES} SELECT p.id, p.gate, count(*) AS n_members, string_agg(c.label, '|' ORDER BY e.pos, c.label) AS members
  FROM sv_edges e JOIN sv_nodes p ON p.id = e.target AND p.gate <> '' JOIN sv_nodes c ON c.id = e.source GROUP BY p.id, p.gate""")
def gate_bundle(spark: SparkSession, d: str) -> DataFrame:
    """A6"""
    return graph.gate_bundles(V.nodes(spark, d), V.edges(spark, d)).select("id", "gate", "n_members", "members")


@_query(f"""WITH {V.VERSIONS} SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'modified' END AS status
  FROM sv_after a FULL JOIN sv_before b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.label IS DISTINCT FROM b.label OR a.type IS DISTINCT FROM b.type""")
def graph_diff_nodes(spark: SparkSession, d: str) -> DataFrame:
    """D1, D2, F6"""
    return diff.node_diff(V.versions_before(spark, d), V.versions_after(spark, d), ["label", "type"]).select("id", "status")


@_query(f"""WITH {V.VERSIONS}, x AS (SELECT id || '->' || parent AS edge FROM sv_before), y AS (SELECT id || '->' || parent AS edge FROM sv_after)
  SELECT edge, 'removed' AS status FROM (SELECT edge FROM x EXCEPT SELECT edge FROM y) UNION ALL SELECT edge, 'added' FROM (SELECT edge FROM y EXCEPT SELECT edge FROM x)""")
def graph_diff_edges(spark: SparkSession, d: str) -> DataFrame:
    """D1"""
    as_edges = lambda v: v.select("tree_id", F.col("id").alias("source"), F.col("parent").alias("target"))
    return diff.edge_diff(as_edges(V.versions_before(spark, d)), as_edges(V.versions_after(spark, d))).select("edge", "status")


@_query(f"""WITH {V.VERSIONS} SELECT a.id, a.label, CASE WHEN b.id IS NULL THEN 'added' WHEN a.label IS DISTINCT FROM b.label THEN 'modified' ELSE 'same' END AS status FROM sv_after a LEFT JOIN sv_before b ON a.id = b.id
  UNION ALL SELECT id, label, 'removed' FROM sv_before WHERE id NOT IN (SELECT id FROM sv_after)""")
def pending_overlay(spark: SparkSession, d: str) -> DataFrame:
    """D5"""
    return diff.overlay(V.versions_before(spark, d), V.versions_after(spark, d), ["label"]).select("id", "label", "status")


@_query(f"""WITH {V.VERSIONS} SELECT id, label FROM sv_after UNION ALL SELECT id, label FROM sv_before WHERE id NOT IN (SELECT id FROM sv_after)""")
def merge_next_wins(spark: SparkSession, d: str) -> DataFrame:
    """D4"""
    return diff.merge_next_wins(V.versions_before(spark, d), V.versions_after(spark, d), ["id"], [F.desc("pos")]).select("id", "label")


@_query(f"""WITH {V.RUN_EVENTS} SELECT run_id, type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, type ORDER BY event_seq) AS n FROM sv_runs) WHERE n = 1""")
def merge_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """D7"""
    return diff.winners(V.run_events(spark, d), ["run_id", "type"], [F.asc("event_seq")]).select("run_id", "type", "event_id")


@_query(f"""WITH {V.RUN_EVENTS} SELECT run_id, type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, type ORDER BY event_seq DESC) AS n FROM sv_runs) WHERE n = 1""")
def merge_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """D8"""
    return diff.winners(V.run_events(spark, d), ["run_id", "type"], [F.desc("event_seq")]).select("run_id", "type", "event_id")


@_query(f"""WITH {V.EDGES} SELECT CASE WHEN target LIKE 'c%' THEN 'n' || c_nationkey ELSE target END AS target, source FROM sv_edges LEFT JOIN customer ON 'c' || c_custkey = target WHERE source NOT LIKE 'c%'""")
def delete_promote(spark: SparkSession, d: str) -> DataFrame:
    """M3, M4: all customers go, their orders hang on nations"""
    doomed = V.nodes(spark, d).filter("id LIKE 'c%'").select("tree_id", "id")
    return rewrite.delete_promote((V.nodes(spark, d), V.edges(spark, d)), doomed)[1].select("source", "target")


@_query(f"WITH {V.NODES}, {V.EDGES} SELECT n.id FROM sv_nodes n WHERE n.type = 'top' OR (n.id LIKE 'n%' AND n.gate = 'OR') OR n.id IN (SELECT 'c' || c_custkey FROM customer WHERE c_nationkey % 2 = 1) OR n.id IN (SELECT 'o' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey % 2 = 1)")
def delete_closure(spark: SparkSession, d: str) -> DataFrame:
    """Nations with an AND gate go, and all below them"""
    doomed = V.nodes(spark, d).filter("id LIKE 'n%' AND gate = 'AND'").select("tree_id", "id")
    return rewrite.delete_closure((V.nodes(spark, d), V.edges(spark, d)), doomed)[0].select("id")


@_query(f"WITH {V.NODES}, {V.EDGES} SELECT n.id FROM sv_nodes n WHERE n.type <> 'basic' UNION ALL SELECT DISTINCT e.target || '-gate' FROM sv_edges e JOIN sv_nodes n ON n.id = e.target WHERE n.gate <> '' AND e.source NOT LIKE 'o%'")
def autoclean_gates(spark: SparkSession, d: str) -> DataFrame:
    """Gates left empty when all basic events go"""
    nodes, edges = graph.expand_gates(V.nodes(spark, d), V.edges(spark, d))
    basic = nodes.filter("type = 'basic'").select("tree_id", "id")
    return graph.clean_gates(*rewrite.delete_plain((nodes, edges), basic))[0].select("id")


@_query(f"""WITH {V.NODES}, {V.EDGES} SELECT 'ERROR' AS level, 'BASIC_WITH_CHILDREN' AS code, n.id AS node_id FROM sv_nodes n WHERE n.type = 'basic' AND n.id IN (SELECT 'o' || o_orderkey FROM orders WHERE o_orderstatus = 'F')
  UNION ALL SELECT 'WARNING', 'TOP_WITHOUT_CHILDREN', n.id FROM sv_nodes n WHERE n.type = 'top' AND n.id NOT IN (SELECT target FROM sv_edges)""")
def validate_rules(spark: SparkSession, d: str) -> DataFrame:
    """Orders that are finished get a cause below them"""
    late = V.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.lit(V.TREE).alias("tree_id"), V._key("x", "o_orderkey").alias("source"), V._key("o", "o_orderkey").alias("target"), F.col("o_orderkey").alias("pos"))
    found = rewrite.issues((V.nodes(spark, d), V.edges(spark, d).unionByName(late)))
    return found.select("level", "code", "node_id")


_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' ELSE 'INFO' END"


@_query(f"""SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) FILTER (WHERE {_LEVEL} = 'ERROR') AS error_count, count(*) FILTER (WHERE {_LEVEL} = 'WARNING') AS warning_count, count(*) FILTER (WHERE {_LEVEL} = 'INFO') AS info_count,
  count(*) FILTER (WHERE {_LEVEL} = 'ERROR') = 0 AS passed FROM events GROUP BY user_id""")
def issue_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A4, S26"""
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "WARNING").otherwise("INFO")
    return rewrite.issue_counts(V.table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), level.alias("level")), ["run_id"])


_PROBABILITY = "SELECT o_orderkey, round(avg(l_discount) * 10, 4) AS p FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"


@_query(f"SELECT CASE WHEN p IS NULL OR p < 0 OR p > 1 OR p < 0.01 THEN 'p0' WHEN p < 0.2 THEN 'p1' WHEN p < 0.4 THEN 'p2' WHEN p < 0.6 THEN 'p3' ELSE 'p4' END AS bucket, count(*) AS n FROM ({_PROBABILITY}) GROUP BY 1")
def prob_bucket(spark: SparkSession, d: str) -> DataFrame:
    """P8, P9"""
    mean = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.avg("l_discount") * 10, 4).alias("p"))
    p = S.probability(F.col("p").cast("string"))
    return V.table(spark, d, "orders").select("o_orderkey").join(mean, "o_orderkey", "left").groupBy(S.probability_class(p).alias("bucket")).agg(F.count("*").alias("n"))


@_query("SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'severe' WHEN '2-HIGH' THEN 'moderate' ELSE 'mild' END AS bucket, count(*) AS n FROM orders GROUP BY 1")
def severity_bucket(spark: SparkSession, d: str) -> DataFrame:
    """P10"""
    word = F.when(F.col("o_orderpriority") == "1-URGENT", " 高 ").when(F.col("o_orderpriority") == "2-HIGH", "中").otherwise("严重")
    return V.table(spark, d, "orders").groupBy(S.severity_class(word).alias("bucket")).agg(F.count("*").alias("n"))


# Codes as documents have them, one for each order, and what they mean when a document is scanned, and in a plan.
_CODES = (
    ("1", "1", "top", "AND", "top", ""), ("2", "2", "intermediate", "OR", "intermediate", ""), (" 3 ", "2.0", "basic", "OR", "basic", ""), ("top_event", "and", "top", "AND", "top", "AND"),
    ("BASIC_EVENT", " Or ", "basic", "OR", "basic", "OR"), ("intermediate_event", "xor", "intermediate", "", "intermediate", ""), ("7", "3", "event", "", "", ""), ("", "", "event", "", "", ""),
    ("top", "与", "event", "", "top", "AND"),
)


def _nth(k: int) -> str:
    return f"CASE o_orderkey % {len(_CODES)} " + " ".join(f"WHEN {i} THEN '{c[k]}'" for i, c in enumerate(_CODES)) + " END"


@_query(f"SELECT o_orderkey, {_nth(2)} AS scanned_type, {_nth(3)} AS scanned_gate, {_nth(4)} AS plan_type, {_nth(5)} AS plan_gate FROM orders")
def type_gate_codes(spark: SparkSession, d: str) -> DataFrame:
    """A code for the type and one for the gate of each order"""
    o = V.table(spark, d, "orders").select("o_orderkey", F.expr(_nth(0)).alias("t"), F.expr(_nth(1)).alias("g"))
    return o.select("o_orderkey", S.event_type(F.col("t")).alias("scanned_type"), S.gate_label(F.col("g")).alias("scanned_gate"), S.node_type(F.col("t")).alias("plan_type"), S.gate_type(F.col("g")).alias("plan_gate"))


@_query("""SELECT event_id, CASE WHEN event_type = 'view' THEN '' ELSE '[' || event_type || '] ' END || 'm' || user_id || CASE WHEN event_type = 'click' THEN ' 为 ' ELSE ' > ' END ||
  CASE WHEN event_type = 'click' THEN '-' || CAST(event_id % 7 AS VARCHAR) || '、' || CAST(event_id % 7 AS VARCHAR) WHEN event_id % 7 = 0 THEN '-0、0' ELSE CAST(event_id % 7 AS VARCHAR) END || '，瞬态' AS sentence FROM events""")
def rule_text(spark: SparkSession, d: str) -> DataFrame:
    """P12, P13, P14"""
    k = (F.col("event_id") % 7).cast("string")
    rule = F.struct(
        F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("deviceTypeId"), F.concat(F.lit(" m"), "user_id").alias("measurePointName"), F.when(F.col("event_type") == "click", "").otherwise(">").alias("symbol"),
        F.array(F.concat(F.lit("-"), k), k).alias("thresholds"), F.lit("瞬态").alias("duration"),
    )
    return V.table(spark, d, "events").select("event_id", S.rules_text(F.array(rule)).alias("sentence"))


@_query("""SELECT p_partkey, array_to_string(list_transform(range(0, greatest(length(s), 1), 4), lambda i: substr(s, CAST(i + 1 AS BIGINT), 4)), chr(10)) AS wrapped
  FROM (SELECT p_partkey, CASE WHEN length(p_name) > 16 THEN substr(p_name, 1, 15) || '…' ELSE p_name END AS s FROM part)""")
def label_wrap(spark: SparkSession, d: str) -> DataFrame:
    """P11"""
    return V.table(spark, d, "part").select("p_partkey", S.wrapped_label(F.col("p_name")).alias("wrapped"))


_NEEDLES = (("a", "the and/of"), ("b", "en-de la"), ("c", "License"), ("d", "MIT License"))
_TOKENS = {"a": ["the", "and", "of"], "b": ["en", "de", "la"], "c": ["License"], "d": ["MIT", "License"]}
_SCORES = " UNION ALL ".join(
    f"SELECT '{q}' AS query, chunk_id, pos, CASE WHEN contains(blob, '{n}') THEN 10 ELSE 0 END + " + " + ".join(f"CAST(contains(blob, '{t}') AS INT)" for t in _TOKENS[q]) + " AS score FROM b" for q, n in _NEEDLES
)


@_query(f"""WITH {V.CHUNKS}, b AS (SELECT chunk_id, pos, title || ' ' || source || ' ' || text AS blob FROM sv_chunks), s AS ({_SCORES}),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, pos) AS rank FROM s WHERE score > 0) SELECT query, chunk_id, CAST(score AS BIGINT) AS score, rank FROM r WHERE rank <= 10""")
def chunk_rank_topk(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report"""
    needles = spark.createDataFrame(list(_NEEDLES), "query string, needle string")
    return retrieval.ranked_chunks(V.chunks(spark, d), needles).select("query", "chunk_id", *_long("score", "rank"))


@_query(f"""WITH {V.CHUNKS} SELECT chunk_id, CASE WHEN version = 0 THEN 'version ' || source ELSE 'file ' || file END AS file_name FROM sv_chunks""")
def chunk_file_match(spark: SparkSession, d: str) -> DataFrame:
    """Files of the first versions by version, the others by file"""
    c = V.chunks(spark, d).withColumn("doc_name", F.lit(""))
    seen = c.select("source", "file", "file_id", "version").distinct()
    exact = seen.filter("version = 0").select(F.concat(F.lit("version "), "source").alias("name"), F.col("source").alias("file_version_id"), F.lit("").alias("file_id"), F.col("file").alias("pos"))
    loose = seen.select(F.concat(F.lit("file "), F.col("file").cast("string")).alias("name"), F.lit("").alias("file_version_id"), "file_id", (F.col("file") + 100).alias("pos")).distinct()
    return retrieval.chunk_files(c.select("chunk_id", "file_id", "file_version_id", "doc_name"), exact.unionByName(loose)).select("chunk_id", "file_name")


@_query("""SELECT 'q' || quality || toxic AS id, d.doc_id AS chunk_id, d.n_chars AS n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id""")
def evidence_join(spark: SparkSession, d: str) -> DataFrame:
    """Label classes as nodes that name their documents"""
    named = V.table(spark, d, "labels").select(F.lit(V.TREE).alias("tree_id"), F.concat(F.lit("q"), "quality", "toxic").alias("id"), F.array(F.col("doc_id").cast("string")).alias("source_chunk_ids"))
    chunks = V.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("n_chars").alias("text"))
    return retrieval.node_evidence(named, chunks).select("id", F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("text").alias("n_chars"))


_TERMS = ("s1", "s22")


@_query(f"""WITH {V.KG}, m AS (SELECT DISTINCT dst AS id FROM sv_kg WHERE contains(dst, 's1') OR contains(dst, 's22')) SELECT DISTINCT dst AS id, src AS neighbour, rel FROM sv_kg WHERE dst IN (SELECT id FROM m)""")
def neighbors(spark: SparkSession, d: str) -> DataFrame:
    """J8, U22"""
    edges = V.kg(spark, d)
    names = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("name", F.col("id"))
    return retrieval.neighbours(edges, names, list(_TERMS))


@_query(f"""WITH {V.KG} SELECT src, dst, rel_id, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY rel_id) - 1 AS index, count(*) OVER (PARTITION BY least(src, dst), greatest(src, dst)) AS total FROM sv_kg""")
def parallel_edges(spark: SparkSession, d: str) -> DataFrame:
    """W1"""
    return retrieval.parallel_edges(V.kg(spark, d))


@_query(f"""WITH RECURSIVE {V.EDGES}, {V.NODES}, walk AS (SELECT id AS root, id FROM sv_nodes WHERE type = 'top' UNION ALL SELECT w.root, e.source FROM walk w JOIN sv_edges e ON e.target = w.id),
  low AS (SELECT root, min(id) AS component FROM walk GROUP BY root) SELECT w.id, low.component FROM walk w JOIN low USING (root)""")
def components(spark: SparkSession, d: str) -> DataFrame:
    """Each region's tree is a component"""
    return graph.components(V.edges(spark, d)).select("id", "component")


@_query(f"""WITH {V.NODES}, {V.EDGES}, l2 AS (SELECT n.id, 160 * greatest(1, (SELECT count(*) FROM sv_edges e WHERE e.target = n.id)) AS width FROM sv_nodes n WHERE n.id LIKE 'c%'),
  l1 AS (SELECT n.id, coalesce(sum(l2.width), 160) AS width FROM sv_nodes n LEFT JOIN sv_edges e ON e.target = n.id LEFT JOIN l2 ON l2.id = e.source WHERE n.id LIKE 'n%' GROUP BY n.id),
  l0 AS (SELECT n.id, coalesce(sum(l1.width), 160) AS width FROM sv_nodes n LEFT JOIN sv_edges e ON e.target = n.id LEFT JOIN l1 ON l1.id = e.source WHERE n.id LIKE 'r%' GROUP BY n.id)
  SELECT id, CAST(width AS BIGINT) AS width FROM l2 UNION ALL SELECT id, CAST(width AS BIGINT) FROM l1 UNION ALL SELECT id, CAST(width AS BIGINT) FROM l0 UNION ALL SELECT id, 160 FROM sv_nodes WHERE type = 'basic'""")
def subtree_width(spark: SparkSession, d: str) -> DataFrame:
    """A16"""
    return graph.subtree_widths(V.nodes(spark, d), V.edges(spark, d)).select("id", "width")


@_query(f"WITH {V.MESSAGES} SELECT message_id, role FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) AS n FROM sv_messages) WHERE n <= 3")
def messages_tail(spark: SparkSession, d: str) -> DataFrame:
    """W4, S8, S9"""
    return state.newest(V.messages(spark, d), ["session_id"], [F.desc("pos")], 3).select("message_id", "role")


@_query(f"""WITH {V.MESSAGES} SELECT message_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS p, min(CASE WHEN role = 'assistant' THEN pos END) OVER (PARTITION BY session_id) AS a FROM sv_messages)
  WHERE p < CASE WHEN session_id % 3 = 0 THEN coalesce(a, 2) WHEN session_id % 3 = 1 THEN 2 ELSE 1000000 END""")
def messages_truncate(spark: SparkSession, d: str) -> DataFrame:
    """A third of the sessions at their first answer, a third after two messages, the others not"""
    m = V.messages(spark, d)
    first = m.groupBy("session_id").agg(F.min_by(F.when(F.col("role") == "assistant", F.col("message_id")), F.when(F.col("role") == "assistant", F.col("pos"))).alias("a"))
    cuts = first.filter("session_id % 3 < 2").select("session_id", F.when(F.col("session_id") % 3 == 0, F.col("a")).alias("message_id"), F.lit(2).alias("keep"))
    return state.truncated(m, cuts).select("message_id")


@_query(f"WITH {V.MESSAGES} SELECT session_id, max_by(content, pos) FILTER (WHERE role = 'user') AS last_user, max_by(content, pos) FILTER (WHERE role = 'assistant') AS last_assistant FROM sv_messages GROUP BY session_id")
def last_by_role(spark: SparkSession, d: str) -> DataFrame:
    """A17"""
    return state.last_by_role(V.messages(spark, d))


@_query(f"""WITH {V.MESSAGES} SELECT session_id, pos, question FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM sv_messages) WHERE role = 'assistant'""")
def user_assistant_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A18, W5"""
    return state.answered(V.messages(spark, d))


_PENDING = "SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS pending_id, CASE WHEN event_type IN ('view', 'click') THEN 'waiting' ELSE 'done' END AS status, ts AS updated_at FROM events"


@_query(f"SELECT pending_id, CASE WHEN status = 'waiting' AND row_number() OVER (PARTITION BY session_id, status ORDER BY updated_at DESC, pending_id DESC) > 20 THEN 'superseded' ELSE status END AS status FROM ({_PENDING})")
def pending_supersede(spark: SparkSession, d: str) -> DataFrame:
    """M32, S10"""
    status = F.when(F.col("event_type").isin("view", "click"), "waiting").otherwise("done")
    p = V.table(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("pending_id"), status.alias("status"), F.col("ts").alias("updated_at"))
    return state.superseded(p).select("pending_id", "status")


@_query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 40")
def draft_cap(spark: SparkSession, d: str) -> DataFrame:
    """M36, T9"""
    return state.newest(V.table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], state.DRAFTS).select("event_id")


@_query(f"WITH {V.RUN_EVENTS} SELECT run_id, max(event_seq) AS event_seq, max_by(event_id, event_seq) AS event_id, max_by(type, event_seq) AS type FROM sv_runs GROUP BY run_id")
def version_latest(spark: SparkSession, d: str) -> DataFrame:
    """S13, A9, M29"""
    return state.latest(V.run_events(spark, d).select("run_id", "event_seq", "event_id", "type"), ["run_id"], F.col("event_seq"))


@_query(f"WITH {V.CHUNKS} SELECT chunk_id, version = max(version) OVER (PARTITION BY file) AS is_active FROM sv_chunks")
def version_active(spark: SparkSession, d: str) -> DataFrame:
    """M42"""
    return state.active_versions(V.chunks(spark, d).select("chunk_id", F.col("file").alias("file_id"), "version")).select("chunk_id", "is_active")


@_query(f"""WITH {V.RUN_EVENTS}, t AS (SELECT run_id, max(event_seq) AS top FROM sv_runs GROUP BY run_id) SELECT run_id, event_seq AS version, event_id FROM sv_runs
  UNION ALL SELECT s.run_id, t.top + 1, s.event_id FROM sv_runs s JOIN t ON t.run_id = s.run_id WHERE s.event_seq = 1""")
def version_rollback(spark: SparkSession, d: str) -> DataFrame:
    """Every run goes back to its first version"""
    v = V.run_events(spark, d).select(F.col("run_id").alias("tree_id"), F.col("event_seq").alias("version"), "event_id")
    return state.rolled_back(v, v.filter("version = 1")).select(F.col("tree_id").alias("run_id"), "version", "event_id")


@_query("SELECT lang, string_agg(source, '|' ORDER BY source) AS signature FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang")
def scope_signature(spark: SparkSession, d: str) -> DataFrame:
    """D10, D13, F13"""
    return diff.signature(V.table(spark, d, "documents"), ["lang"], F.col("source"))


@_query(f"WITH {V.CHUNKS} SELECT chunk_id, coalesce(lag(source) OVER (PARTITION BY file ORDER BY version DESC, source, chunk_id) <> source, true) AS is_start FROM sv_chunks")
def file_groups(spark: SparkSession, d: str) -> DataFrame:
    """W2"""
    return state.group_starts(V.chunks(spark, d), "source", [F.desc("version"), F.asc("source"), F.asc("chunk_id")], ["file"]).select("chunk_id", "is_start")


_BOUNDS = ", ".join(f"{f}(CASE WHEN type = '{s}' THEN event_seq END) AS {n}_{s}" for s in runs.STAGES for n, f in (("first", "min"), ("last", "max")))


@_query(f"WITH {V.RUN_EVENTS} SELECT run_id, {_BOUNDS} FROM sv_runs GROUP BY run_id")
def run_stage_first_last(spark: SparkSession, d: str) -> DataFrame:
    """A11, P68"""
    return runs.stage_bounds(V.run_events(spark, d))


@_query(f"""WITH {V.RUN_EVENTS} SELECT run_id, count(*) AS n_events, CASE WHEN bool_or(type = 'purchase') THEN 'purchase' WHEN bool_or(type = 'signup') THEN 'signup' WHEN bool_or(type = 'click') THEN 'click' WHEN bool_or(type = 'view') THEN 'view' END AS current_stage,
  max(CASE WHEN type = 'error' THEN event_seq END) AS failed_seq FROM sv_runs GROUP BY run_id""")
def run_state(spark: SparkSession, d: str) -> DataFrame:
    """A12"""
    return runs.run_state(V.run_events(spark, d))


@_query(f"WITH {V.RUN_EVENTS} SELECT run_id, event_seq, type FROM sv_runs WHERE event_seq > 2")
def event_dedup_cursor(spark: SparkSession, d: str) -> DataFrame:
    """A log that delivers everything twice, read from each run's second event on"""
    e = V.run_events(spark, d).select("run_id", "event_seq", "type")
    twice = e.unionByName(e)
    cursors = e.select("run_id").distinct().withColumn("cursor", F.lit(2))
    return runs.after_cursor(runs.once(twice, ["run_id", "event_seq"], [F.asc("type")]), cursors).select("run_id", "event_seq", "type")


@_query(f"""WITH {V.RUN_EVENTS} SELECT run_id, max(event_seq) AS last_seq, max_by(type, event_seq) AS status, max(value) AS progress FROM sv_runs GROUP BY run_id""")
def run_latest(spark: SparkSession, d: str) -> DataFrame:
    """X3, X5, X10"""
    e = V.run_events(spark, d).select("run_id", "event_seq", F.col("type").alias("status"), F.col("value").alias("progress"))
    return runs.latest_state(e).drop("terminal")


@_query("""SELECT CAST(o_orderkey AS VARCHAR) AS work_order_no, o_orderpriority AS fault_phenomenon, CAST(o_custkey AS VARCHAR) AS device_id, true AS ready FROM orders""")
def work_order_map(spark: SparkSession, d: str) -> DataFrame:
    """S22, F11"""
    mapping = {"work_order_no": "o_orderkey", "fault_phenomenon": "o_orderpriority", "device_id": "o_custkey"}
    return state.work_orders(V.table(spark, d, "orders"), mapping, ["work_order_no", "fault_phenomenon"])


@_query("SELECT doc_id, CAST(i AS BIGINT) AS chunk, substr(text, CAST(i * 800 + 1 AS BIGINT), 800) AS text FROM (SELECT doc_id, text, unnest(range(0, CAST((greatest(length(text), 1) + 799) // 800 AS BIGINT))) AS i FROM documents)")
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """S22"""
    from causeway.sources import trees

    return trees.chunked(V.table(spark, d, "documents")).select("doc_id", *_long("chunk"), "text")


@_query(f"""WITH {V.NODES}, {V.EDGES} SELECT e.source, s.label AS source_label, t.label AS target_label FROM sv_edges e JOIN sv_nodes s ON s.id = e.source JOIN sv_nodes t ON t.id = e.target""")
def edge_labels(spark: SparkSession, d: str) -> DataFrame:
    """J4"""
    return retrieval.labelled_edges(V.edges(spark, d), V.nodes(spark, d)).select("source", "source_label", "target_label")


@_query(f"WITH {V.NODES} SELECT id, label, type, gate FROM sv_nodes WHERE type = 'basic' OR id LIKE 'c%'")
def raw_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The tree of each customer written as a document and read again"""
    from causeway.sources import trees

    documents = trees.to_raw(*_by_customer(spark, d))
    return trees.nodes(trees.parse(documents)).select("id", "label", "type", "gate")


@_query(f"WITH {V.EDGES} SELECT source, target FROM sv_edges WHERE target LIKE 'c%'")
def map_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """S2, M34"""
    from causeway.sources import trees

    return trees.edges(trees.parse(trees.to_map(*_by_customer(spark, d)))).select("source", "target")


def _by_customer(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A tree for each customer, with its orders."""
    below = V.edges(spark, d).filter("target LIKE 'c%'")
    nodes = V.nodes(spark, d).drop("tree_id").filter("type = 'basic' OR id LIKE 'c%'")
    keyed = nodes.join(below.select(F.col("source").alias("id"), "target"), "id", "left")
    return keyed.withColumn("tree_id", F.coalesce("target", "id")).drop("target"), below.withColumn("tree_id", F.col("target"))
