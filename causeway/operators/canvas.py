"""What a canvas keeps between visits: selected files, pending changes, drafts, and what it opens with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import scalars as S

# Fixed value: the document of an empty canvas. Names of fields that a comparison does not look at.
BLANK = '{"nodes":[],"edges":[]}'
UNCOMPARED = ("_diffStatus", "_diffGhost", "raw")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def selected_files(raw: Column) -> Column:
    """The files that a store names: a JSON list, one JSON text, or the plain text that is no JSON of either kind."""
    v = F.try_parse_json(raw)
    listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("null")))
    found = F.when(_is(v, "ARRAY"), F.filter(listed, lambda x: x != "")).when(_is(v, "STRING"), F.filter(F.array(F.try_variant_get(v, "$", "string")), lambda x: x != "")).otherwise(F.array(raw))
    return F.when(F.coalesce(raw, F.lit("")) == "", F.array().cast("array<string>")).otherwise(found)


def pending_kind(raw: Column) -> Column:
    """The kind of a kept pending change, "edit" or "generate", or null where it can't be taken up again: without the graph and the text before it, or an
    edit without its outcome (F12)."""
    v = F.try_parse_json(raw)
    kind = F.try_variant_get(v, "$.kind", "string")
    before = _is(F.try_variant_get(v, "$.prev.graphData.nodes", "variant"), "ARRAY") & _is(F.try_variant_get(v, "$.prev.rawJsonText", "variant"), "STRING")
    after = _is(F.try_variant_get(v, "$.finalGraph.nodes", "variant"), "ARRAY")
    return F.when(before & ((kind == "generate") | ((kind == "edit") & after)), kind)


def compared_meta(meta: Column) -> Column:
    """A node's meta as JSON without what only marks a difference; what is no object is empty."""
    v = F.try_parse_json(meta)
    fields = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.isin(*UNCOMPARED))
    return F.when(_is(v, "OBJECT"), F.to_json(F.map_from_entries(F.array_sort(F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value"))))))).otherwise("{}")


def initial_documents(requests: DataFrame, drafts: DataFrame, sample: str) -> DataFrame:
    """(request_id, origin, document) of requests (request_id, project_id, canvas_id, tree_id, blank, snapshot): what a canvas opens with.

    A canvas of a project, where no tree is asked for, opens with its draft (project_id, canvas_id, document), or empty where that is none or no JSON; else an empty one, where it is
    asked for; else the snapshot; without one, or where that is no JSON, the sample.
    """
    own = drafts.select("project_id", "canvas_id", F.col("document").alias("_draft")).dropDuplicates(["project_id", "canvas_id"])
    seen = requests.join(own, ["project_id", "canvas_id"], "left")
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    valid = lambda c: F.try_parse_json(c).isNotNull()
    of_canvas = there("canvas_id") & there("project_id") & ~there("tree_id")
    origin = (
        F.when(of_canvas & there("_draft") & valid("_draft"), "draft").when(of_canvas | F.coalesce(F.col("blank").isin("1", "true"), F.lit(False)), "blank")
        .when(there("snapshot") & valid("snapshot"), "snapshot").otherwise("sample")
    )
    document = F.when(origin == "draft", F.col("_draft")).when(origin == "blank", BLANK).when(origin == "snapshot", F.col("snapshot")).otherwise(sample)
    return seen.select("request_id", origin.alias("origin"), document.alias("document"))


def without_drafts(drafts: DataFrame, doomed: DataFrame) -> DataFrame:
    """drafts without those of doomed (project_id, canvas_id)."""
    return drafts.join(doomed.select("project_id", "canvas_id"), ["project_id", "canvas_id"], "left_anti")


def flushed_drafts(drafts: DataFrame, flushed: DataFrame, most: int = 40) -> DataFrame:
    """drafts (project_id, canvas_id, updated_at, ...) with `flushed` ones in the place of those of their canvas, the newest `most` of each project."""
    kept = drafts.join(flushed.select("project_id", "canvas_id"), ["project_id", "canvas_id"], "left_anti")
    newest = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("updated_at"), "canvas_id"))
    return kept.unionByName(flushed, allowMissingColumns=True).withColumn("_n", newest).filter(F.col("_n") <= most).drop("_n")


def regenerates(workspaces: DataFrame) -> DataFrame:
    """(project_id, regenerate) of workspaces (project_id, epoch, synced_epoch): whether files have changed since the last generation."""
    return workspaces.select("project_id", (F.coalesce("epoch", F.lit(0)) > F.coalesce("synced_epoch", F.lit(0))).alias("regenerate"))


def edge_ids(edges: DataFrame) -> DataFrame:
    """edges (graph_id, pos, rel_id, src, dst) with `id`: their own, or made of both ends and their place from 0."""
    return edges.withColumn("id", F.coalesce(S.present(F.col("rel_id")), F.concat_ws("-", "src", "dst", F.col("pos").cast("string"))))


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tree_id, id, children): the children of every node in document order, none for leaves."""
    below = edges.groupBy("tree_id", F.col("target").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source"))), lambda x: x["source"]).alias("children"))
    return nodes.select("tree_id", "id").join(below, ["tree_id", "id"], "left").select("tree_id", "id", F.coalesce("children", F.array().cast("array<string>")).alias("children"))
