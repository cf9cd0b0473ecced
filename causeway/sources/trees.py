"""Tree documents of four shapes, read into nodes and edges, and written back.

Shapes: raw lists {nodeList, linkList}, a map {tree_data: {nodes: {id: node}}} with children, a graph {nodes, edges},
and any of these wrapped in {tree_data} or {treeData}. Documents are parsed once into VARIANT; each shape is a
filter on it and a projection to the same columns. A document of no shape gives no rows, as does bad JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import scalars as S

NODE_COLUMNS = ["tree_id", "id", "label", "type", "gate", "pos", "x", "y", "event", "source_chunk_ids"]
EDGE_COLUMNS = ["tree_id", "source", "target", "pos", "is_condition", "relation"]
EVENT = "struct<id:string,name:string,description:string,errorLevel:string,priority:string,probability:string,showProbability:string,rules:array<struct<deviceTypeId:string,measurePointName:string,symbol:string,thresholds:array<string>,duration:string>>,investigateMethod:string>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(tree_id, document) of a folder of JSON files, one document each; tree_id is the file's name."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.json)?$", 1).alias("tree_id"), F.col("value").alias("document"))


def _get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _text(v: Column | str, *paths: str) -> Column:
    return S.first_present(*(_get(v, p) for p in paths))


def parse(documents: DataFrame) -> DataFrame:
    """(tree_id, shape, body): documents (tree_id, document) unwrapped; shape is raw, map, graph or null."""
    v = documents.select("tree_id", F.try_parse_json("document").alias("v"))
    inner = v.select("tree_id", F.coalesce(*(_get("v", p, "variant") for p in ("$.tree_data", "$.treeData", "$.data.tree_data", "$.result.tree_data", "$.payload.tree_data")), F.col("v")).alias("body"))
    has = lambda p, kind: F.coalesce(F.schema_of_variant(_get("body", p, "variant")).startswith(kind), F.lit(False))
    shape = F.when(has("$.nodeList", "ARRAY") & has("$.linkList", "ARRAY"), "raw").when(has("$.nodes", "ARRAY") & has("$.edges", "ARRAY"), "graph").when(has("$.nodes", "OBJECT"), "map")
    return inner.select("tree_id", shape.alias("shape"), "body")


def _items(parsed: DataFrame, shape: str, path: str) -> DataFrame:
    rows = parsed.filter(F.col("shape") == shape).select("tree_id", _get("body", path, "array<variant>").alias("items"))
    return rows.select("tree_id", F.posexplode("items").alias("pos", "n"))


def _node(rows: DataFrame) -> DataFrame:
    id_ = _text("n", "$.id", "$.event_id", "$.node_id")
    label = S.first_present(_text("n", "$.name", "$.label", "$.title", "$.data.label", "$.data.name", "$.event.name", "$.meta.event.name"), id_)
    kind = _text("n", "$.type", "$.rawType", "$.event_type")
    typed = F.when(F.upper(kind).isin("AND", "OR") | (F.lower(kind) == "gate"), "gate").when(S.node_type(kind) != "", S.node_type(kind)).otherwise(S.event_type(kind))
    chunks = F.coalesce(_get("n", "$.source_chunk_ids", "array<string>"), F.array(_get("n", "$.source_chunk_ids")))
    out = rows.select(
        "tree_id", id_.alias("id"), label.alias("label"), F.coalesce(typed, F.lit("event")).alias("type"), F.coalesce(S.gate_label(_text("n", "$.gate", "$.gateLabel", "$.meta.gateLabel")), F.lit("")).alias("gate"),
        F.col("pos").cast("long"), F.coalesce(_get("n", "$.x", "double"), _get("n", "$.position.x", "double"), F.lit(0.0)).alias("x"), F.coalesce(_get("n", "$.y", "double"), _get("n", "$.position.y", "double"), F.lit(0.0)).alias("y"),
        F.coalesce(_get("n", "$.event", EVENT), _get("n", "$.meta.event", EVENT)).alias("event"), F.filter(chunks, lambda c: c.isNotNull()).alias("source_chunk_ids"),
    )
    return out.filter("id IS NOT NULL")


def nodes(parsed: DataFrame) -> DataFrame:
    """NODE_COLUMNS of parsed documents."""
    lists = _items(parsed, "raw", "$.nodeList").unionByName(_items(parsed, "graph", "$.nodes"))
    maps = parsed.filter("shape = 'map'").select("tree_id", F.posexplode(F.map_entries(_get("body", "$.nodes", "map<string,variant>"))).alias("pos", "e"))
    keyed = maps.select("tree_id", "pos", F.col("e.value").alias("n"))
    return _node(lists.unionByName(keyed)).select(*NODE_COLUMNS)


def edges(parsed: DataFrame) -> DataFrame:
    """EDGE_COLUMNS of parsed documents, from child to parent."""
    lists = _items(parsed, "raw", "$.linkList").unionByName(_items(parsed, "graph", "$.edges"))
    linked = lists.select(
        "tree_id", _text("n", "$.source", "$.sourceId", "$.from", "$.child", "$.source_id").alias("source"), _text("n", "$.target", "$.targetId", "$.to", "$.parent", "$.target_id").alias("target"),
        F.col("pos").cast("long"), F.coalesce(_get("n", "$.isCondition", "boolean"), F.lit(False)).alias("is_condition"), F.to_json(_get("n", "$.relation", "variant")).alias("relation"),
    )
    maps = parsed.filter("shape = 'map'").select("tree_id", F.posexplode(F.map_values(_get("body", "$.nodes", "map<string,variant>"))).alias("p", "n"))
    below = maps.select("tree_id", "p", _text("n", "$.id").alias("target"), F.posexplode(_get("n", "$.children", "array<string>")).alias("c", "source"))
    mapped = below.select("tree_id", "source", "target", (F.col("p").cast("long") * (1 << 31) + F.col("c")).alias("pos"), F.lit(False).alias("is_condition"), F.lit(None).cast("string").alias("relation"))
    return linked.unionByName(mapped).filter("source IS NOT NULL AND target IS NOT NULL").select(*EDGE_COLUMNS)


def embedded_issues(documents: DataFrame) -> DataFrame:
    """(tree_id, source, level, code, message, node_id) of a document's validation block."""
    v = documents.select("tree_id", F.try_parse_json("document").alias("v"))
    kind = "array<struct<level:string,code:string,message:string,node_id:string,source:string>>"
    rows = v.select("tree_id", F.inline(F.coalesce(_get("v", "$.validation.issues", kind), _get("v", "$.tree_data.validation.issues", kind))))
    return rows.select("tree_id", F.coalesce(S.present(F.col("source")), F.lit("logic")).alias("source"), F.upper("level").alias("level"), "code", "message", "node_id")


def to_raw(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """(tree_id, document): graphs without gate nodes in the raw list shape (M33, M48). A document is one value, so a tree must fit in
    one (2 GB as JSON, some ten million nodes); trees are spread over the cluster."""
    listed = nodes_.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct("id", F.col("label").alias("name"), "type", F.col("gate").alias("gate")).alias("n")))).alias("ns"))
    linked = edges_.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(F.col("source").alias("sourceId"), F.col("target").alias("targetId")).alias("e")))).alias("es"))
    body = F.to_json(F.struct(F.transform("ns", lambda x: x["n"]).alias("nodeList"), F.transform(F.coalesce("es", F.array()), lambda x: x["e"]).alias("linkList")))
    return listed.join(linked, "tree_id", "left").select("tree_id", body.alias("document"))


def to_graph(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """(tree_id, document): graphs in the shape {nodes, edges}, gate nodes as they are."""
    listed = nodes_.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct("id", "label", "type", "gate").alias("n")))).alias("ns"))
    linked = edges_.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct("source", "target").alias("e")))).alias("es"))
    body = F.to_json(F.struct(F.transform("ns", lambda x: x["n"]).alias("nodes"), F.transform(F.coalesce("es", F.array()), lambda x: x["e"]).alias("edges")))
    return listed.join(linked, "tree_id", "left").select("tree_id", body.alias("document"))


def to_map(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """(tree_id, document): graphs without gate nodes in the map shape, with children."""
    below = edges_.groupBy("tree_id", F.col("target").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source"))), lambda x: x["source"]).alias("children"))
    full = nodes_.join(below, ["tree_id", "id"], "left")
    entry = F.struct("id", F.col("label").alias("name"), "type", "gate", F.coalesce("children", F.array().cast("array<string>")).alias("children"))
    whole = full.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", entry.alias("n")))).alias("ns"))
    return whole.select("tree_id", F.to_json(F.struct(F.struct(F.map_from_entries(F.transform("ns", lambda x: F.struct(x["id"], x["n"]))).alias("nodes")).alias("tree_data"))).alias("document"))


def parts(documents: DataFrame) -> DataFrame:
    """(tree_id, part, id, name, type) of a part table {Object_n: {id, name, type}}; other entries are dropped."""
    v = documents.select("tree_id", F.try_parse_json("document").alias("v"))
    entries = v.select("tree_id", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("part", "p"))
    objects = entries.filter(F.schema_of_variant("p").startswith("OBJECT"))
    return objects.select("tree_id", "part", *(_get("p", f"$.{c}").alias(c) for c in ("id", "name", "type")))


def chunked(texts: DataFrame, size: int = 800) -> DataFrame:
    """(doc_id, chunk, text): texts (doc_id, text) cut every `size` characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(size))
    return texts.select("doc_id", F.posexplode(F.transform(starts, lambda s: F.col("text").substr(s, F.lit(size)))).alias("chunk", "text"))


def messages(spark: SparkSession, path: str) -> DataFrame:
    """Message lines; lines that are no JSON are dropped."""
    return spark.read.option("mode", "DROPMALFORMED").schema("message_id string, session_id string, role string, content string, ts long").json(path)
