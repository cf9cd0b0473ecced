"""Queries on what a canvas keeps; customers stand for projects, orders for canvases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import canvas
from causeway.plans import surrogate as V
from causeway.plans.registry import query


def _store(column: str, *cases: str) -> str:
    """One of some SQL texts, by the remainder of a key."""
    return f"CASE {column} % {len(cases)} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END"


_FILES = _store("o_orderkey", "concat('[\"f', o_custkey, '\", \"\", 7]')", "concat('\"f', o_custkey, '\"')", "concat('f', o_custkey)", "'\"\"'", "''", "'[]'", "concat('{\"a\":', o_custkey, '}')")


@query(f"""WITH s AS (SELECT o_orderkey, {_FILES} AS raw, o_custkey FROM orders)
  SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'f' || o_custkey || '|7' WHEN 1 THEN 'f' || o_custkey WHEN 2 THEN 'f' || o_custkey WHEN 6 THEN raw ELSE '' END AS files FROM s""")
def selected_stores(spark: SparkSession, d: str) -> DataFrame:
    """Lists, single texts and plain texts"""
    raw = F.expr(_FILES)
    return V.table(spark, d, "orders").select("o_orderkey", F.array_join(canvas.selected_files(raw), "|").alias("files"))


_PREV = '"prev":{"graphData":{"nodes":[]},"rawJsonText":"{}"}'
_PENDING = _store(
    "o_orderkey", f"'{{\"kind\":\"edit\",{_PREV},\"finalGraph\":{{\"nodes\":[]}}}}'", f"'{{\"kind\":\"generate\",{_PREV}}}'", f"'{{\"kind\":\"edit\",{_PREV}}}'", f"'{{\"kind\":\"other\",{_PREV}}}'",
    "'{\"kind\":\"generate\",\"prev\":{\"graphData\":{\"nodes\":[]},\"rawJsonText\":3}}'", "'{bad'", "'null'",
)


@query("SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'edit' WHEN 1 THEN 'generate' END AS kind FROM orders")
def pending_kinds(spark: SparkSession, d: str) -> DataFrame:
    """whole and broken pending changes"""
    return V.table(spark, d, "orders").select("o_orderkey", canvas.pending_kind(F.expr(_PENDING)).alias("kind"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '{}' ELSE '{\"a\":\"' || o_custkey || '\"}' END AS meta FROM orders")
def compared_metas(spark: SparkSession, d: str) -> DataFrame:
    """Metas with the marks of a diff, and some that are no objects"""
    meta = F.when(F.col("o_orderkey") % 3 == 0, "[1]").otherwise(F.concat(F.lit('{"raw":{"x":1},"_diffStatus":"added","a":'), "o_custkey", F.lit("}")))
    return V.table(spark, d, "orders").select("o_orderkey", canvas.compared_meta(meta).alias("meta"))


_DRAFT = _store("o_orderkey", "concat('{\"id\":', o_orderkey, '}')", "'{bad'", "''")
_SNAPSHOT = _store("o_orderkey", "'{\"snap\":1}'", "NULL", "'no json'", "'{\"snap\":2}'")


@query(f"""WITH d AS (SELECT o_custkey, o_orderkey, {_DRAFT} AS document FROM orders WHERE o_orderkey % 5 <> 0),
  r AS (SELECT o_orderkey AS request_id, o_custkey, o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 't' ELSE '' END AS tree_id, o_orderkey % 2 = 0 AS has_canvas, CASE WHEN o_orderkey % 13 = 0 THEN '1' END AS blank, {_SNAPSHOT} AS snapshot FROM orders)
  SELECT request_id, CASE WHEN has_canvas AND tree_id = '' AND coalesce(document, '') <> '' AND json_valid(document) THEN 'draft' WHEN (has_canvas AND tree_id = '') OR blank = '1' THEN 'blank'
      WHEN coalesce(snapshot, '') <> '' AND json_valid(snapshot) THEN 'snapshot' ELSE 'sample' END AS origin,
    CASE origin WHEN 'draft' THEN document WHEN 'blank' THEN '{{"nodes":[],"edges":[]}}' WHEN 'snapshot' THEN snapshot ELSE '{{}}' END AS document
  FROM r LEFT JOIN d ON d.o_orderkey = r.o_orderkey AND has_canvas""")
def opened_documents(spark: SparkSession, d: str) -> DataFrame:
    """Drafts, empty canvases, snapshots, and the sample"""
    o = V.table(spark, d, "orders")
    names = V._key("p", "o_custkey").alias("project_id"), V._key("k", "o_orderkey")
    requests = o.select(
        F.col("o_orderkey").alias("request_id"), names[0], F.when(F.col("o_orderkey") % 2 == 0, names[1]).otherwise("").alias("canvas_id"), F.when(F.col("o_orderkey") % 11 == 0, "t").otherwise("").alias("tree_id"),
        F.when(F.col("o_orderkey") % 13 == 0, "1").alias("blank"), F.expr(_SNAPSHOT).alias("snapshot"),
    )
    drafts = o.filter("o_orderkey % 5 <> 0").select(names[0], names[1].alias("canvas_id"), F.expr(_DRAFT).alias("document"))
    return canvas.initial_documents(requests, drafts, "{}")


@query("""WITH a AS (SELECT o_custkey, o_orderkey, CAST(o_orderkey % 50 AS BIGINT) AS t, 'old' AS state FROM orders WHERE o_orderkey % 5 <> 1 AND o_orderkey % 5 <> 0
    UNION ALL SELECT o_custkey, o_orderkey, o_orderkey % 60 + 100, 'new' FROM orders WHERE o_orderkey % 5 = 0)
  SELECT 'p' || o_custkey AS project_id, 'k' || o_orderkey AS canvas_id, t AS updated_at, state FROM a QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY t DESC, 'k' || o_orderkey) <= 4""")
def draft_edits(spark: SparkSession, d: str) -> DataFrame:
    """Drafts of which some are removed and some flushed anew, the newest four of a project"""
    o = V.table(spark, d, "orders").withColumn("project_id", V._key("p", "o_custkey")).withColumn("canvas_id", V._key("k", "o_orderkey"))
    drafts = o.select("project_id", "canvas_id", (F.col("o_orderkey") % 50).alias("updated_at"), F.lit("old").alias("state"))
    flushed = o.filter("o_orderkey % 5 = 0").select("project_id", "canvas_id", (F.col("o_orderkey") % 60 + 100).alias("updated_at"), F.lit("new").alias("state"))
    return canvas.flushed_drafts(canvas.without_drafts(drafts, o.filter("o_orderkey % 5 = 1")), flushed, 4)


@query("SELECT 'p' || c_custkey AS project_id, c_custkey % 4 > 0 AS regenerate FROM customer")
def regenerate_flags(spark: SparkSession, d: str) -> DataFrame:
    """F20"""
    c = V.table(spark, d, "customer")
    k = F.col("c_custkey") % 4
    return canvas.regenerates(c.select(V._key("p", "c_custkey").alias("project_id"), k.alias("epoch"), F.when(k > 1, k - 1).alias("synced_epoch")))


@query("""SELECT l_orderkey AS graph_id, l_linenumber AS pos, CASE WHEN l_linenumber % 2 = 0 THEN 'x' || l_linenumber ELSE 'p' || l_partkey || '-s' || l_suppkey || '-' || l_linenumber END AS id FROM lineitem""")
def layout_edge_ids(spark: SparkSession, d: str) -> DataFrame:
    """J12"""
    lines = V.table(spark, d, "lineitem")
    own = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("x"), "l_linenumber"))
    edges = lines.select(F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").alias("pos"), own.alias("rel_id"), V._key("p", "l_partkey").alias("src"), V._key("s", "l_suppkey").alias("dst"))
    return canvas.edge_ids(edges).select("graph_id", "pos", "id")


@query(f"WITH {V.NODES}, {V.EDGES} SELECT n.id, coalesce(string_agg(e.source, ',' ORDER BY e.pos), '') AS children FROM sv_nodes n LEFT JOIN sv_edges e ON e.target = n.id GROUP BY n.id")
def layout_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """J10"""
    return canvas.adjacency(V.nodes(spark, d), V.edges(spark, d)).select("id", F.array_join("children", ",").alias("children"))
