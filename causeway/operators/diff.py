"""Graph diff, merges with different winners, and signatures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def node_diff(before: DataFrame, after: DataFrame, compare: Sequence[str]) -> DataFrame:
    """(tree_id, id, status) of nodes that are added, removed or modified in one of `compare`."""
    pack = lambda df, name: df.select("tree_id", "id", F.struct(*compare).alias(name))
    both = pack(before, "was").join(pack(after, "now"), ["tree_id", "id"], "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "modified")
    return both.select("tree_id", "id", status.alias("status")).filter("status IS NOT NULL")


def edge_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(tree_id, edge, status): "source->target" that only one side has."""
    key = F.concat("source", F.lit("->"), "target").alias("edge")
    a, b = before.select("tree_id", key).distinct(), after.select("tree_id", key).distinct()
    added = b.join(a, ["tree_id", "edge"], "left_anti").withColumn("status", F.lit("added"))
    return added.unionByName(a.join(b, ["tree_id", "edge"], "left_anti").withColumn("status", F.lit("removed")))


def graph_diff(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], compare: Sequence[str], relation: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Node and edge statuses; a common edge whose `relation` differs marks its target as modified."""
    nodes = node_diff(before[0], after[0], compare)
    if relation:
        was = before[1].select("tree_id", "source", "target", F.col(relation).alias("was"))
        changed = after[1].join(was, ["tree_id", "source", "target"]).filter(~F.col("was").eqNullSafe(F.col(relation)))
        touched = changed.select("tree_id", F.col("target").alias("id")).distinct().join(nodes, ["tree_id", "id"], "left_anti").join(after[0].select("tree_id", "id"), ["tree_id", "id"], "left_semi")
        nodes = nodes.unionByName(touched.withColumn("status", F.lit("modified")))
    return nodes, edge_diff(before[1], after[1])


def overlay(before: DataFrame, after: DataFrame, compare: Sequence[str]) -> DataFrame:
    """The later nodes with their status, and the removed ones as ghosts."""
    status = node_diff(before, after, compare)
    live = after.join(status, ["tree_id", "id"], "left").withColumn("status", F.coalesce("status", F.lit("same")))
    ghosts = before.join(status.filter("status = 'removed'"), ["tree_id", "id"])
    return live.unionByName(ghosts.select(*live.columns))


def winners(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first by `order`, which must be total. The base of all merges."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def merge_next_wins(before: DataFrame, after: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """All of `after` (of equal keys the last), and what only `before` has."""
    new = winners(after, keys, order)
    return new.unionByName(before.join(new.select(*keys), list(keys), "left_anti").select(*new.columns))


def replace_segment(kept: DataFrame, fresh: DataFrame, seq: str, local_from: int = 1_000_000) -> DataFrame:
    """Local rows (sequence from `local_from`) of `kept`, and all of `fresh`."""
    return kept.filter(F.col(seq) >= local_from).unionByName(fresh)


def signature(rows: DataFrame, by: Sequence[str], value: Column, separator: str = "|") -> DataFrame:
    """(*by, signature): the distinct values, sorted and joined."""
    return rows.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(value)), separator).alias("signature"))


# What is compared of an event, and of a relation.
EVENT_KEYS = ("description", "errorLevel", "priority", "probability", "showProbability", "rule", "rules", "investigateMethod", "documents", "message")
RELATION_KEYS = ("relation_type", "polarity", "certainty", "evidence", "evidence_texts", "documents", "gate_type", "member_relation", "gate_relation")


def _first_under(v: Column, key: str, places: Sequence[str]) -> Column:
    return F.coalesce(*(F.try_variant_get(v, f"{p}.{key}", "variant") for p in places))


def node_signature(v: Column) -> Column:
    """What tells two versions of a node (VARIANT) apart beside label and type, as JSON: its gate, and the fields of its event."""
    gate = F.coalesce(*(F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in ("$.gate", "$.gateLabel", "$.meta.gateLabel", "$.meta.raw.gate")))
    places = ("$.meta.event", "$.event", "$.meta.raw.event", "$")
    return F.to_json(F.struct(gate.alias("gate"), *(F.to_json(_first_under(v, k, places)).alias(k) for k in EVENT_KEYS)))


def edge_signature(v: Column) -> Column:
    """What tells two versions of an edge (VARIANT) apart beside its ends, as JSON."""
    places = ("$.relation", "$.meta.relation", "$.meta.raw.relation", "$")
    return F.to_json(F.struct(*(F.to_json(_first_under(v, k, places)).alias(k) for k in RELATION_KEYS)))


def without_markers(rows: DataFrame, markers: Sequence[str] = ("status", "diff")) -> DataFrame:
    """rows without what a diff wrote on them; ghosts of removed ones go."""
    live = rows.filter("status <> 'removed'") if "status" in rows.columns else rows
    return live.drop(*markers)


def repaired(before: DataFrame, after: DataFrame, doomed: DataFrame) -> DataFrame:
    """`after` (tree_id, source, target) without the doomed edges, whichever way they point, in trees whose edges are those of `before`; other trees stay."""
    edge = ["tree_id", "source", "target"]
    a, b = before.select(*edge).distinct(), after.select(*edge).distinct()
    changed = a.join(b, edge, "left_anti").unionByName(b.join(a, edge, "left_anti")).select("tree_id").distinct()
    both = doomed.select(*edge).unionByName(doomed.select("tree_id", F.col("target").alias("source"), F.col("source").alias("target"))).join(changed, "tree_id", "left_anti").distinct()
    return after.join(both, edge, "left_anti")


def graph_signature(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tree_id, signature): a hash of a tree's nodes and edges whatever their order, by sums."""
    n = nodes.groupBy("tree_id").agg(F.sum(F.xxhash64("id", "label", "type", "gate").cast("decimal(38,0)")).alias("n"))
    e = edges.groupBy("tree_id").agg(F.sum(F.xxhash64("source", "target").cast("decimal(38,0)")).alias("e"))
    return n.join(e, "tree_id", "left").select("tree_id", F.sha2(F.concat_ws("|", "n", "e"), 256).alias("signature"))
