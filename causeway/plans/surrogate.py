"""The driver's tables in the roles of this library's: the same views in Spark and in SQL.

All of one tree, "t": regions are tops, nations and customers intermediate, orders basic; edges lead from the
finer to the coarser.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TREE = "t"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region").select(_key("r", "r_regionkey").alias("id"), F.col("r_name").alias("label"), F.lit("top").alias("type"), F.lit("OR").alias("gate"), F.col("r_regionkey").cast("bigint").alias("pos"))
    n = table(spark, d, "nation").select(_key("n", "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit("intermediate").alias("type"), F.when(F.col("n_nationkey") % 2 == 0, "AND").otherwise("OR").alias("gate"), (F.col("n_nationkey") + 100).cast("bigint").alias("pos"))
    c = table(spark, d, "customer").select(_key("c", "c_custkey").alias("id"), F.col("c_name").alias("label"), F.lit("intermediate").alias("type"), F.lit("OR").alias("gate"), (F.col("c_custkey") + 1000).alias("pos"))
    o = table(spark, d, "orders").select(_key("o", "o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"), F.lit("basic").alias("type"), F.lit("").alias("gate"), (F.col("o_orderkey") + 1_000_000_000).alias("pos"))
    return r.unionByName(n).unionByName(c).unionByName(o).withColumn("tree_id", F.lit(TREE))


NODES = """
sv_nodes AS (
  SELECT 'r' || r_regionkey AS id, r_name AS label, 'top' AS type, 'OR' AS gate, CAST(r_regionkey AS BIGINT) AS pos FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'intermediate', CASE WHEN n_nationkey % 2 = 0 THEN 'AND' ELSE 'OR' END, n_nationkey + 100 FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_name, 'intermediate', 'OR', c_custkey + 1000 FROM customer
  UNION ALL SELECT 'o' || o_orderkey, o_orderpriority, 'basic', '', o_orderkey + 1000000000 FROM orders)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(_key("n", "n_nationkey").alias("source"), _key("r", "n_regionkey").alias("target"), F.col("n_nationkey").cast("bigint").alias("pos"))
    c = table(spark, d, "customer").select(_key("c", "c_custkey").alias("source"), _key("n", "c_nationkey").alias("target"), F.col("c_custkey").alias("pos"))
    o = table(spark, d, "orders").select(_key("o", "o_orderkey").alias("source"), _key("c", "o_custkey").alias("target"), F.col("o_orderkey").alias("pos"))
    return n.unionByName(c).unionByName(o).withColumn("tree_id", F.lit(TREE))


EDGES = """
sv_edges AS (
  SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, CAST(n_nationkey AS BIGINT) AS pos FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_orderkey FROM orders)"""


def dag(spark: SparkSession, d: str) -> DataFrame:
    """Parts under their suppliers, suppliers under nations: shared children."""
    p = table(spark, d, "lineitem").select(_key("p", "l_partkey").alias("source"), _key("s", "l_suppkey").alias("target")).distinct()
    s = table(spark, d, "supplier").select(_key("s", "s_suppkey").alias("source"), _key("n", "s_nationkey").alias("target"))
    return p.unionByName(s).select(F.lit(TREE).alias("tree_id"), "source", "target", F.lit(0).cast("bigint").alias("pos"))


DAG = """
sv_dag AS (
  SELECT DISTINCT 'p' || l_partkey AS source, 's' || l_suppkey AS target FROM lineitem
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""


def kg(spark: SparkSession, d: str) -> DataFrame:
    """Part to supplier, several times over."""
    ordered = F.format_string("%012d-%02d-%s", F.col("l_orderkey"), F.col("l_linenumber"), F.date_format("l_shipdate", "yyyyMMdd"))
    return table(spark, d, "lineitem").select(_key("p", "l_partkey").alias("src"), _key("s", "l_suppkey").alias("dst"), F.col("l_returnflag").alias("rel"), ordered.alias("rel_id"))


KG = """
sv_kg AS (
  SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, l_returnflag AS rel,
         lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '-' || strftime(l_shipdate, '%Y%m%d') AS rel_id
  FROM lineitem)"""


def versions_before(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderkey % 10 <> 0")
    return o.select(F.lit(TREE).alias("tree_id"), _key("o", "o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("type"), F.col("o_orderkey").alias("pos"), _key("c", "o_custkey").alias("parent"))


def versions_after(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderkey % 10 <> 1")
    label = F.when(F.col("o_orderkey") % 10 == 2, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority"))
    parent = F.when(F.col("o_orderkey") % 10 == 3, F.concat(F.lit("c"), (F.col("o_custkey") + 1).cast("string"))).otherwise(_key("c", "o_custkey"))
    return o.select(F.lit(TREE).alias("tree_id"), _key("o", "o_orderkey").alias("id"), label.alias("label"), F.col("o_orderstatus").alias("type"), F.col("o_orderkey").alias("pos"), parent.alias("parent"))


VERSIONS = """
sv_before AS (SELECT 'o' || o_orderkey AS id, o_orderpriority AS label, o_orderstatus AS type, o_orderkey AS pos, 'c' || o_custkey AS parent FROM orders WHERE o_orderkey % 10 <> 0),
sv_after AS (
  SELECT 'o' || o_orderkey AS id, CASE WHEN o_orderkey % 10 = 2 THEN lower(o_orderpriority) ELSE o_orderpriority END AS label, o_orderstatus AS type, o_orderkey AS pos,
         CASE WHEN o_orderkey % 10 = 3 THEN 'c' || (o_custkey + 1) ELSE 'c' || o_custkey END AS parent
  FROM orders WHERE o_orderkey % 10 <> 1)"""


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), F.concat_ws("-", "conv_id", "turn").alias("message_id"), "role", F.col("text").alias("content"))


MESSAGES = """
sv_messages AS (SELECT conv_id AS session_id, turn AS pos, conv_id || '-' || turn AS message_id, role, text AS content FROM conversations)"""


def run_events(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), seq.alias("event_seq"), F.col("event_type").alias("type"), "event_id", "value", "props", "ts")


RUN_EVENTS = """
sv_runs AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_seq, event_type AS type, event_id, value, props, ts
  FROM events)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    number = F.regexp_extract("source", r"(\d+)", 1).cast("bigint")
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("pos"), F.col("lang").alias("title"), "source", "text", F.col("source").alias("file_version_id"),
        F.concat(F.lit("f"), (number % 10).cast("string")).alias("file_id"), (number % 10).alias("file"), F.floor(number / 10).cast("bigint").alias("version"),
    )


CHUNKS = """
sv_chunks AS (
  SELECT doc_id AS chunk_id, doc_id AS pos, lang AS title, source, text, source AS file_version_id, 'f' || (CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) % 10) AS file_id,
         CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) % 10 AS file, CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) // 10 AS version
  FROM documents)"""
