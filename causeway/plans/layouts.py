"""Queries on layouts and names. A tree for each nation: its customers, their orders, half of the customers with a gate between; its suppliers hang on nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import layout, naming, rewrite
from causeway.plans import surrogate as V
from causeway.plans.registry import query

_EVEN = "c_custkey % 2 = 0"
_SUPPLIERS = {0: "top", 1: "intermediate", 2: "basic", 3: "house"}


def _tree(column: str):
    return F.concat(F.lit("t"), F.col(column).cast("string")).alias("tree_id")


def _trees(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, c, o, s = (V.table(spark, d, t) for t in ("nation", "customer", "orders", "supplier"))
    kind = F.coalesce(*(F.when(F.col("s_suppkey") % 4 == k, v) for k, v in _SUPPLIERS.items()))
    of = o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    gated = o.select("o_custkey").distinct().join(c, F.col("o_custkey") == F.col("c_custkey")).filter(_EVEN)
    nodes = (
        n.select(_tree("n_nationkey"), V._key("n", "n_nationkey").alias("id"), F.lit("top").alias("type"), F.col("n_nationkey").cast("long").alias("pos"))
        .unionByName(c.select(_tree("c_nationkey"), V._key("c", "c_custkey").alias("id"), F.lit("intermediate").alias("type"), (F.col("c_custkey") + 100).alias("pos")))
        .unionByName(gated.select(_tree("c_nationkey"), V._key("g", "c_custkey").alias("id"), F.lit("gate").alias("type"), (F.col("c_custkey") + (1 << 40)).alias("pos")))
        .unionByName(of.select(_tree("c_nationkey"), V._key("o", "o_orderkey").alias("id"), F.lit("basic").alias("type"), (F.col("o_orderkey") + (1 << 41)).alias("pos")))
        .unionByName(s.select(_tree("s_nationkey"), V._key("s", "s_suppkey").alias("id"), kind.alias("type"), (F.col("s_suppkey") + (1 << 42)).alias("pos")))
    )
    edges = (
        c.select(_tree("c_nationkey"), V._key("c", "c_custkey").alias("source"), V._key("n", "c_nationkey").alias("target"), F.col("c_custkey").alias("pos"))
        .unionByName(gated.select(_tree("c_nationkey"), V._key("g", "c_custkey").alias("source"), V._key("c", "c_custkey").alias("target"), F.lit(0).cast("long").alias("pos")))
        .unionByName(of.select(_tree("c_nationkey"), V._key("o", "o_orderkey").alias("source"), F.when(F.expr(_EVEN), V._key("g", "o_custkey")).otherwise(V._key("c", "o_custkey")).alias("target"), F.col("o_orderkey").alias("pos")))
    )
    return nodes, edges


_TIDY = """
lo_o AS (SELECT o_orderkey, o_custkey, c_nationkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders JOIN customer ON c_custkey = o_custkey),
lo_c AS (SELECT c_custkey, c_nationkey, greatest(160, 160 * coalesce(n, 0)) AS w, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey),
lo_n AS (SELECT n_nationkey, coalesce(w, 160) AS w FROM nation LEFT JOIN (SELECT c_nationkey, sum(w) AS w FROM lo_c GROUP BY c_nationkey) ON c_nationkey = n_nationkey),
lo_cx AS (SELECT c.*, -n.w / 2.0 + coalesce(sum(c.w) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft FROM lo_c c JOIN lo_n n ON n_nationkey = c_nationkey),
lo_placed AS (
  SELECT 't' || n_nationkey AS tree_id, 'n' || n_nationkey AS id, 'top' AS type, 0.0 AS cx, 0.0 AS cy FROM lo_n
  UNION ALL SELECT 't' || c_nationkey, 'c' || c_custkey, 'intermediate', lft + w / 2.0, 90 FROM lo_cx
  UNION ALL SELECT 't' || c_nationkey, 'g' || c_custkey, 'gate', lft + w / 2.0, 180 FROM lo_cx WHERE n > 0 AND c_custkey % 2 = 0
  UNION ALL SELECT 't' || o.c_nationkey, 'o' || o_orderkey, 'basic', lft + 160 * k + 80, CASE WHEN c_custkey % 2 = 0 THEN 280 ELSE 180 END FROM lo_o o JOIN lo_cx ON c_custkey = o_custkey)"""

_ROWS = """
lo_s AS (SELECT s_suppkey, 't' || s_nationkey AS tree_id, s_suppkey % 4 AS r, row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 4 ORDER BY s_suppkey) - 1 AS nth FROM supplier),
lo_r AS (SELECT tree_id, r, count(*) AS n, row_number() OVER (PARTITION BY tree_id ORDER BY r) - 1 AS line FROM lo_s GROUP BY tree_id, r),
lo_low AS (SELECT tree_id, max(cy) AS lowest FROM lo_placed GROUP BY tree_id),
lo_rest AS (SELECT s.tree_id, 's' || s_suppkey AS id, ['top', 'intermediate', 'basic', 'house'][s.r + 1] AS type, -(n - 1) * 200 / 2.0 + nth * 200 AS cx, lowest + 200 + line * 140 AS cy
  FROM lo_s s JOIN lo_r r ON r.tree_id = s.tree_id AND r.r = s.r JOIN lo_low l ON l.tree_id = s.tree_id)"""


@query(f"WITH {_TIDY} SELECT tree_id, id, CAST(cx AS DOUBLE) AS cx, CAST(cy AS DOUBLE) AS cy FROM lo_placed")
def tidy_layout(spark: SparkSession, d: str) -> DataFrame:
    """R7"""
    return layout.tidy(*_trees(spark, d)).select("tree_id", "id", "cx", "cy")


@query(f"WITH {_TIDY}, {_ROWS} SELECT tree_id, id, type, CAST(cx AS DOUBLE) AS cx, CAST(cy AS DOUBLE) AS cy FROM lo_rest")
def unreached_rows(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of each type"""
    nodes, edges = _trees(spark, d)
    return layout.rows_below(nodes, layout.tidy(nodes, edges)).select("tree_id", "id", "type", "cx", "cy")


@query(f"""WITH {_TIDY}, {_ROWS}, a AS (SELECT * FROM lo_placed UNION ALL SELECT * FROM lo_rest),
  b AS (SELECT *, CASE type WHEN 'gate' THEN 60 WHEN 'basic' THEN 110 ELSE 140 END AS w, CASE type WHEN 'gate' THEN 52 WHEN 'basic' THEN 110 ELSE 56 END AS h FROM a)
  SELECT tree_id, CAST(min(cx - w / 2.0) AS DOUBLE) AS min_x, CAST(min(cy) AS DOUBLE) AS min_y, CAST(max(cx + w / 2.0) AS DOUBLE) AS max_x, CAST(max(cy + h) AS DOUBLE) AS max_y FROM b GROUP BY tree_id""")
def scene_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of whole layouts"""
    return layout.boxes(layout.laid_out(*_trees(spark, d)))


@query(f"""WITH {_TIDY}, {_ROWS}, a AS (SELECT * FROM lo_placed UNION ALL SELECT * FROM lo_rest),
  b AS (SELECT *, CASE type WHEN 'gate' THEN 60 WHEN 'basic' THEN 110 ELSE 140 END AS w, CASE type WHEN 'gate' THEN 52 WHEN 'basic' THEN 110 ELSE 56 END AS h FROM a),
  x AS (SELECT tree_id, min(cx - w / 2.0) AS x0, min(cy) AS y0, least(108.0 / greatest(max(cx + w / 2.0) - min(cx - w / 2.0), 1), 68.0 / greatest(max(cy + h) - min(cy), 1)) AS s FROM b GROUP BY tree_id)
  SELECT b.tree_id, id, CASE type WHEN 'basic' THEN 'ellipse' WHEN 'gate' THEN 'gate' ELSE 'rect' END AS kind, round(CAST(6 + (cx - CASE WHEN type = 'basic' THEN 0 ELSE w / 2.0 END - x0) * s AS DOUBLE), 4) AS x,
    round(CAST(6 + (cy + CASE WHEN type = 'basic' THEN h / 2.0 ELSE 0 END - y0) * s AS DOUBLE), 4) AS y FROM b JOIN x ON x.tree_id = b.tree_id""")
def scene_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Layouts fitted into pictures"""
    nodes, edges = _trees(spark, d)
    shapes, _ = layout.scene(layout.laid_out(nodes, edges), edges)
    return shapes.select("tree_id", "id", "kind", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_CONNECTED = """
cn_c AS (SELECT c_nationkey, min(c_custkey) FILTER (WHERE c_custkey % 2 = 0) AS gated, min(c_custkey) FILTER (WHERE c_custkey % 2 = 1) AS plain FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY c_nationkey),
cn_o AS (SELECT c_nationkey, min(o_orderkey) AS leaf FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey),
cn_s AS (SELECT s_suppkey, s_nationkey, s_suppkey % 3 AS way, gated, plain, leaf, count(*) OVER (PARTITION BY s_nationkey, s_suppkey % 3) AS n FROM supplier JOIN cn_c c ON c.c_nationkey = s_nationkey JOIN cn_o o ON o.c_nationkey = s_nationkey
  WHERE gated IS NOT NULL AND plain IS NOT NULL)"""


@query(f"""WITH {_CONNECTED}, g AS (SELECT s_nationkey, min(s_suppkey) AS g FROM cn_s WHERE way = 1 GROUP BY s_nationkey),
  h AS (SELECT s_nationkey, s_suppkey AS g FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM cn_s WHERE way = 2) WHERE k = 2)
  SELECT 't' || s_nationkey AS tree_id, 's' || s_suppkey AS source, 'g' || gated AS target FROM cn_s WHERE way = 0
  UNION ALL SELECT 't' || s.s_nationkey, 's' || s_suppkey, 'new' || g FROM cn_s s JOIN g ON g.s_nationkey = s.s_nationkey WHERE way = 1
  UNION ALL SELECT DISTINCT 't' || s.s_nationkey, 'o' || o_orderkey, 'new' || g FROM cn_s s JOIN g ON g.s_nationkey = s.s_nationkey JOIN orders ON o_custkey = plain WHERE way = 1
  UNION ALL SELECT DISTINCT 't' || s.s_nationkey, 'new' || g, 'c' || plain FROM cn_s s JOIN g ON g.s_nationkey = s.s_nationkey WHERE way = 1
  UNION ALL SELECT 't' || s.s_nationkey, 's' || s_suppkey, CASE WHEN n > 1 THEN 'new' || g ELSE 'o' || leaf END FROM cn_s s LEFT JOIN h ON h.s_nationkey = s.s_nationkey WHERE way = 2
  UNION ALL SELECT DISTINCT 't' || s.s_nationkey, 'new' || g, 'o' || leaf FROM cn_s s JOIN h ON h.s_nationkey = s.s_nationkey WHERE way = 2""")
def connected_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers under a customer with a gate, one without, or an order of their nation; the edges that this adds or moves"""
    nodes, edges = _trees(spark, d)
    o = V.table(spark, d, "orders").join(V.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    hosts = o.groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.min(F.when(F.expr(_EVEN), F.col("c_custkey"))).alias("gated"), F.min(F.when(~F.expr(_EVEN), F.col("c_custkey"))).alias("plain"), F.min("o_orderkey").alias("leaf"))
    s = V.table(spark, d, "supplier").join(hosts.filter("gated IS NOT NULL AND plain IS NOT NULL"), "s_nationkey")
    target = F.when(F.col("s_suppkey") % 3 == 0, V._key("c", "gated")).when(F.col("s_suppkey") % 3 == 1, V._key("c", "plain")).otherwise(V._key("o", "leaf"))
    wanted = s.select(_tree("s_nationkey"), V._key("s", "s_suppkey").alias("source"), target.alias("target"), V._key("new", "s_suppkey").alias("gate_id"), F.col("s_suppkey").alias("pos"))
    key = ["tree_id", "source", "target"]
    return rewrite.connect_nodes((nodes.withColumn("label", F.col("id")).withColumn("gate", F.lit("")), edges), wanted)[1].select(*key).join(edges.select(*key), key, "left_anti")


_STEPS = ", ".join(f"c.cx + {(1 if n % 2 == 0 else -1) * -(-n // 2)} * 67.2" for n in range(9))


@query(f"""WITH RECURSIVE c AS (SELECT 't' || c_nationkey AS tree_id, 'c' || c_custkey AS id, CAST(c_acctbal AS DOUBLE) AS cx, CAST(c_custkey % 3 AS INTEGER) AS band,
    row_number() OVER (PARTITION BY c_nationkey, c_custkey % 3 ORDER BY c_custkey) AS n FROM customer),
  f AS (SELECT DISTINCT tree_id, band, CAST(0 AS BIGINT) AS n, '' AS id, CAST(0 AS DOUBLE) AS cx, CAST([] AS DOUBLE[]) AS taken FROM c
    UNION ALL SELECT tree_id, band, n, id, x, list_append(taken, x) FROM (
      SELECT c.tree_id, c.band, c.n, c.id, f.taken, coalesce(list_filter([{_STEPS}], lambda p: len(list_filter(f.taken, lambda t: abs(t - p) < 112)) = 0)[1], c.cx - 5 * 67.2) AS x
      FROM f JOIN c ON c.tree_id = f.tree_id AND c.band = f.band AND c.n = f.n + 1))
  SELECT tree_id, id, round(cx, 4) AS cx FROM f WHERE n > 0""")
def moved_apart(spark: SparkSession, d: str) -> DataFrame:
    """Customers at their balances, in three bands for each nation, in the order of their keys"""
    c = V.table(spark, d, "customer")
    placed = c.select(
        _tree("c_nationkey"), V._key("c", "c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("cx"), (F.col("c_custkey") % 3 * 10).cast("double").alias("cy"),
        F.col("c_custkey").cast("double").alias("left"), F.lit(0).alias("depth"),
    )
    return layout.apart(placed).select("tree_id", "id", F.round("cx", 4).alias("cx"))


@query("""WITH m AS (SELECT o_custkey, avg(o_orderkey % 1000) AS x, avg(o_orderkey % 77) AS y FROM orders GROUP BY o_custkey)
  SELECT 't' || c_nationkey AS tree_id, 'c' || c_custkey AS id, (c_custkey % 50 + x) / 2 AS gx, (c_custkey % 9 + y) / 2 AS gy FROM customer JOIN m ON o_custkey = c_custkey WHERE c_custkey % 2 = 0""")
def gate_centres(spark: SparkSession, d: str) -> DataFrame:
    """Gates of even customers"""
    c, o = V.table(spark, d, "customer"), V.table(spark, d, "orders")
    own = c.select(_tree("c_nationkey"), V._key("c", "c_custkey").alias("id"), F.when(F.expr(_EVEN), "OR").otherwise("").alias("gate"), (F.col("c_custkey") % 50).cast("double").alias("x"), (F.col("c_custkey") % 9).cast("double").alias("y"))
    of = o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    leaves = of.select(_tree("c_nationkey"), V._key("o", "o_orderkey").alias("id"), F.lit("").alias("gate"), (F.col("o_orderkey") % 1000).cast("double").alias("x"), (F.col("o_orderkey") % 77).cast("double").alias("y"))
    edges = of.select(_tree("c_nationkey"), V._key("o", "o_orderkey").alias("source"), V._key("c", "o_custkey").alias("target"))
    return layout.gate_places(own.unionByName(leaves), edges).select("tree_id", "id", "gx", "gy")


@query("""WITH t AS (SELECT DISTINCT 'b' || (o_custkey % 5) AS base, o_orderkey % 997 AS n FROM orders WHERE o_orderkey % 3 = 0),
  w AS (SELECT 'b' || (o_custkey % 5) AS base, o_orderkey AS pos, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) AS k FROM orders WHERE o_orderkey % 3 = 1),
  free AS (SELECT base, n, row_number() OVER (PARTITION BY base ORDER BY n) AS k FROM (SELECT b.base, i.n FROM (SELECT DISTINCT base FROM w) b, (SELECT unnest(range((SELECT count(*) FROM orders) + 1000)) AS n) i) x
    WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.base = x.base AND t.n = x.n))
  SELECT w.pos, CASE WHEN free.n = 0 THEN w.base ELSE w.base || '-' || free.n END AS id FROM w JOIN free ON free.base = w.base AND free.k = w.k""")
def fresh_node_ids(spark: SparkSession, d: str) -> DataFrame:
    """Orders ask for ids of which others have taken some"""
    o = V.table(spark, d, "orders")
    base = F.concat(F.lit("b"), (F.col("o_custkey") % 5).cast("string"))
    n = F.col("o_orderkey") % 997
    taken = o.filter("o_orderkey % 3 = 0").select(F.lit(V.TREE).alias("tree_id"), F.when(n == 0, base).otherwise(F.concat_ws("-", base, n.cast("string"))).alias("id"))
    wanted = o.filter("o_orderkey % 3 = 1").select(F.lit(V.TREE).alias("tree_id"), base.alias("base"), F.col("o_orderkey").alias("pos"))
    return naming.fresh_ids(wanted, taken).select("pos", "id")


@query("""WITH a AS (SELECT DISTINCT 't' || c_nationkey AS tree_id, substr(c_name, 12 + c_custkey % 6) AS name FROM customer WHERE c_custkey % 3 = 0)
  SELECT a.tree_id, a.name, c_name AS label FROM a JOIN customer ON 't' || c_nationkey = a.tree_id AND contains(c_name, a.name)""")
def names_inside_labels(spark: SparkSession, d: str) -> DataFrame:
    """Ends of customers' names, of 2 to 7 digits, among the names of their nation"""
    c = V.table(spark, d, "customer")
    names = c.filter("c_custkey % 3 = 0").select(_tree("c_nationkey"), F.expr("substr(c_name, cast(12 + c_custkey % 6 AS int))").alias("name"))
    return naming.containing(names, c.select(_tree("c_nationkey"), F.col("c_name").alias("label")), ["tree_id"])


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'basic' WHEN p_partkey % 4 = 1 THEN 'intermediate' WHEN p_partkey % 4 = 2 THEN 'top' END AS type FROM part""")
def mentioned_types(spark: SparkSession, d: str) -> DataFrame:
    """A type's name within a sentence on each part"""
    said = F.element_at(F.array(*map(F.lit, ("make it a Basic Event, no top event", "an INTERMEDIATE_EVENT", "顶事件", "an event"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return V.table(spark, d, "part").select("p_partkey", naming.mentioned_type(F.concat_ws(" ", "p_name", said)).alias("type"))


@query("""SELECT 'o' || o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey) - 1 AS index FROM orders""")
def overlay_indexes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as overlays of their customers, by status"""
    o = V.table(spark, d, "orders").select(F.lit(V.TREE).alias("tree_id"), V._key("o", "o_orderkey").alias("id"), V._key("c", "o_custkey").alias("parent"), F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("pos"))
    return layout.overlay_places(o).select("id", "index")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'n' || p_partkey WHEN 1 THEN 'r' || p_partkey WHEN 2 THEN '事件 ' || p_name WHEN 3 THEN p_type ELSE 'why ' || p_name END AS asked FROM part""")
def node_queries(spark: SparkSession, d: str) -> DataFrame:
    """Decisions that name a node, in two places, and messages with and without a mark"""
    k = F.col("p_partkey") % 5
    decision = F.when(k == 0, F.to_json(F.struct(F.lit(" ").alias("node_label"), F.concat(F.lit(" n"), "p_partkey").alias("event_name")))).when(k == 1, F.to_json(F.struct(F.struct(F.concat(F.lit("r"), "p_partkey").alias("target_node")).alias("requirements")))).otherwise("{}")
    message = F.when(k == 2, F.concat(F.lit(" 事件 "), "p_name")).when(k == 3, "why").otherwise(F.concat(F.lit("why "), "p_name"))
    top = F.when(k == 3, F.col("p_type")).otherwise(" ")
    return V.table(spark, d, "part").select("p_partkey", naming.node_query(message, F.try_parse_json(decision), top).alias("asked"))
