"""The fault-tree operators on small hand-made graphs: gates, shared children, cycles, orphans, plans."""

import json

import pytest

from causeway.operators import diff, graph, retrieval, rewrite, state
from causeway.sources import trees


def made(spark, types, links, gates=()):
    """(nodes, edges) of tree "t" from {id: type} and [(child, parent)]."""
    gates = dict(gates)
    nodes = spark.createDataFrame([("t", i, i.upper(), kind, gates.get(i, ""), n) for n, (i, kind) in enumerate(types.items())], "tree_id string, id string, label string, type string, gate string, pos long")
    edges = spark.createDataFrame([("t", a, b, n) for n, (a, b) in enumerate(links)], "tree_id string, source string, target string, pos long")
    return nodes, edges


def pairs(edges):
    return {(r.source, r.target) for r in edges.collect()}


def ids(nodes):
    return {r.id for r in nodes.collect()}


@pytest.fixture(scope="module")
def diamond(spark):
    """A basic event shared by two branches."""
    return made(spark, {"a": "top", "b": "intermediate", "c": "intermediate", "d": "basic"}, [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")], {"a": "AND", "b": "OR"})


def test_closure_of_shared_children_and_cycles(spark, diamond):
    root = spark.createDataFrame([("t", "a")], "tree_id string, root string")
    assert {(r.id, r.depth) for r in graph.closure(diamond[1], root).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    _, loop = made(spark, {}.fromkeys("ab", "basic"), [("a", "b"), ("b", "a"), ("a", "a")])
    assert {(r.id, r.depth) for r in graph.closure(loop, root).collect()} == {("a", 0), ("b", 1)}
    assert graph.closure(diamond[1].filter("false"), root).count() == 1


def test_reaches_and_verdicts(spark, diamond):
    wanted = spark.createDataFrame([("t", "d", "b"), ("t", "d", "a"), ("t", "d", "d"), ("t", "c", "b"), ("t", "a", "d")], "tree_id string, source string, target string")
    got = {(r.source, r.target): r.verdict for r in rewrite.judged_edges(diamond, wanted).collect()}
    assert got[("d", "b")] == "duplicate" and got[("d", "d")] == "self edge" and got[("c", "b")] == "ok" and got[("d", "a")] == "ok"


def test_gates_there_and_back(diamond):
    nodes, edges = graph.expand_gates(*diamond)
    assert pairs(edges) == {("b", "a-gate"), ("c", "a-gate"), ("a-gate", "a"), ("d", "b-gate"), ("b-gate", "b"), ("d", "c")}
    back = graph.collapse_gates(nodes, edges)
    assert pairs(back[1]) == pairs(diamond[1]) and {(r.id, r.gate) for r in back[0].collect()} == {("a", "AND"), ("b", "OR"), ("c", ""), ("d", "")}


def test_chain_of_empty_gates_goes(spark):
    got = graph.clean_gates(*made(spark, {"a": "top", "g": "gate", "h": "gate", "i": "gate", "x": "basic"}, [("g", "a"), ("h", "g"), ("i", "a"), ("x", "i")]))
    assert ids(got[0]) == {"a", "i", "x"} and pairs(got[1]) == {("i", "a"), ("x", "i")}


def test_widths_and_components(spark, diamond):
    assert {r.id: r.width for r in graph.subtree_widths(*diamond).collect()} == {"d": 160, "b": 160, "c": 160, "a": 320}
    _, chain = made(spark, {}, [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("x", "y")])
    found = {r.id: r.component for r in graph.components(chain).collect()}
    assert {found[f"n{i:03}"] for i in range(41)} == {"n000"} and found["y"] == "x"


def test_root_choice(spark):
    two = made(spark, {"a": "top", "b": "top", "c": "basic", "d": "basic"}, [("c", "b"), ("d", "b")])
    assert graph.root_choice(*two).first().root == "b"
    none = made(spark, {"x": "basic", "y": "intermediate"}, [("x", "y")])
    assert graph.root_choice(*none).first().root == "y"


def test_deletes(spark):
    g = made(spark, {"a": "top", "b": "intermediate", "c": "basic", "d": "basic"}, [("b", "a"), ("c", "b"), ("d", "b")])
    doomed = spark.createDataFrame([("t", "b")], "tree_id string, id string")
    kept = rewrite.delete_promote(g, doomed)
    assert ids(kept[0]) == {"a", "c", "d"} and pairs(kept[1]) == {("c", "a"), ("d", "a")}
    kept = rewrite.delete_plain(g, doomed)
    assert ids(kept[0]) == {"a", "c", "d"} and pairs(kept[1]) == set()
    assert ids(rewrite.delete_closure(g, doomed)[0]) == {"a"}


def test_edge_edits(spark, diamond):
    one = lambda a, b: spark.createDataFrame([("t", a, b, 99)], "tree_id string, source string, target string, pos long")
    assert ("d", "b") not in pairs(rewrite.delete_edges(diamond, one("b", "d"))[1])
    assert ("d", "b") in pairs(rewrite.delete_edges(diamond, one("b", "d"), directed=True)[1])
    assert pairs(rewrite.add_edges(diamond, one("d", "b"))[1]) == pairs(diamond[1])
    assert pairs(rewrite.add_edges(diamond, one("d", "a"))[1]) == pairs(diamond[1]) | {("d", "a")}


def test_plans(spark, diamond):
    steps = [
        {"op": "add_child_node", "source": "e", "target": "d", "value": "E"}, {"op": "move_subtree", "source": "c", "target": "b"}, {"op": "set_gate_type", "target": "b", "value": "and"},
        {"op": "insert_gate", "source": "g", "target": "b", "value": "or"}, {"op": "rename_node", "target": "a", "value": "Top"}, {"op": "delete_node", "target": "e"},
    ]
    (nodes, edges), errors = rewrite.apply_plan(spark, diamond, json.dumps({"operations": steps}), tree_id="t")
    seen = {r.id: r for r in nodes.collect()}
    assert errors == [] and seen["a"].label == "Top" and seen["b"].gate == "AND" and seen["d"].type == "intermediate" and seen["g"].type == "gate"
    assert pairs(edges) == {("b", "a"), ("d", "g"), ("c", "g"), ("g", "b"), ("d", "c")}
    same, errors = rewrite.apply_plan(spark, diamond, json.dumps({"operations": [steps[0], {"op": "paint"}]}), tree_id="t")
    assert same is diamond and len(errors) == 1
    many = [{"op": "rename_node", "target": "a", "value": f"n{i}"} for i in range(13)]
    (nodes, _), _ = rewrite.apply_plan(spark, diamond, json.dumps({"operations": many}), tree_id="t")
    assert nodes.filter("id = 'a'").first().label == "n11"


def test_relation_diff(spark, diamond):
    edges = diamond[1].selectExpr("*", "'x' AS relation")
    changed = edges.selectExpr("tree_id", "source", "target", "pos", "CASE WHEN target = 'c' THEN 'y' ELSE relation END AS relation")
    nodes, kinds = diff.graph_diff((diamond[0], edges), (diamond[0], changed), ["label"], "relation")
    assert {(r.id, r.status) for r in nodes.collect()} == {("c", "modified")} and kinds.collect() == []


def test_document_shapes(spark):
    raw = {"nodeList": [{"id": 1, "name": "Top", "type": "1", "gate": 2}, {"id": 2, "type": 3}, {"name": "no id"}], "linkList": [{"sourceId": 2, "targetId": 1}, {"sourceId": 2}]}
    mapped = {"tree_data": {"nodes": {"a": {"id": "a", "name": "A", "type": "top_event", "children": ["b"]}, "b": {"id": "b", "type": "basic"}}}}
    rows = [("raw", json.dumps(raw)), ("map", json.dumps(mapped)), ("wrapped", json.dumps({"data": {"tree_data": raw}})), ("bad", "{"), ("none", None), ("other", "[1]")]
    parsed = trees.parse(spark.createDataFrame(rows, "tree_id string, document string"))
    assert {r.tree_id: r.shape for r in parsed.collect()} == {"raw": "raw", "map": "map", "wrapped": "raw", "bad": None, "none": None, "other": None}
    nodes = {(r.tree_id, r.id): (r.label, r.type, r.gate) for r in trees.nodes(parsed).collect()}
    assert nodes == {(k, i): v for k in ("raw", "wrapped") for i, v in (("1", ("Top", "top", "OR")), ("2", ("2", "basic", "")))} | {("map", "a"): ("A", "top", ""), ("map", "b"): ("b", "basic", "")}
    assert {(r.tree_id, r.source, r.target) for r in trees.edges(parsed).collect()} == {("raw", "2", "1"), ("wrapped", "2", "1"), ("map", "b", "a")}


def test_parts_and_chunks(spark):
    table = spark.createDataFrame([("t", json.dumps({"Object_1": {"id": "p1", "name": "pump", "type": "x"}, "Object_2": 5}))], "tree_id string, document string")
    assert [(r.part, r.id, r.name, r.type) for r in trees.parts(table).collect()] == [("Object_1", "p1", "pump", "x")]
    texts = spark.createDataFrame([(1, "abcde"), (2, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.chunk, r.text) for r in trees.chunked(texts, 2).collect()) == [(1, 0, "ab"), (1, 1, "cd"), (1, 2, "e"), (2, 0, "")]


def test_caps_and_versions(spark):
    drafts = spark.range(41).selectExpr("'p' AS project", "id")
    assert state.newest(drafts, ["project"], [drafts.id.desc()], state.DRAFTS).agg({"id": "min"}).first()[0] == 1
    pending = spark.range(21).selectExpr("'s' AS session_id", "id AS pending_id", "'waiting' AS status", "id AS updated_at")
    assert [r.pending_id for r in state.superseded(pending).filter("status = 'superseded'").collect()] == [0]


def test_text_score(spark):
    from pyspark.sql import functions as F

    row = spark.sql("SELECT 'pump seal/leak' AS needle, 'the seal of the pump' AS blob")
    assert row.select(retrieval.text_score(F.col("needle"), F.col("blob"))).first()[0] == 2


def test_plan_properties(spark, diamond):
    steps = [
        {"op": "set_node_properties", "target": "b", "properties": {"probability": 0.5, "label": "B!", "id": "z"}}, {"op": "set_edge_properties", "source": "b", "target": "a", "properties": {"polarity": "neg", "source": "z"}},
        {"op": "insert_gate", "source": "g", "target": "a", "value": "or"}, {"op": "add_child_node", "source": "e", "target": "d", "value": "E"}, {"op": "move_subtree", "source": "d", "target": "b"},
    ]
    (nodes, edges), errors = rewrite.apply_plan(spark, diamond, json.dumps({"operations": steps}), tree_id="t")
    assert errors == [] and len(rewrite.OPERATIONS) == 11
    assert {(r.id, r.label) for r in nodes.filter("probability = '0.5'").collect()} == {("b", "B!")} and nodes.count() == diamond[0].count() + 2
    assert {(r.source, r.target) for r in edges.filter("polarity = 'neg'").collect()} == {("b", "g")}


def test_upserted_by_session(spark):
    rows = spark.createDataFrame([(f"s{s}", f"k{i % 5}", i, f"{s}-{i}") for s in range(3) for i in range(7)], "session_id string, task string, pos long, content string")
    got = {(r.session_id, r.task, r.pos, r.content) for r in state.upserted(rows, "task", keep=4).collect()}
    assert got == {(f"s{s}", f"k{k}", k, f"{s}-{k + 5 if k < 2 else k}") for s in range(3) for k in range(1, 5)}


def test_plan_is_validated_first(spark, diamond):
    """Names are found by label; what is added can't be linked in the same plan; one error stops the whole plan."""
    run = lambda *steps: rewrite.apply_plan(spark, diamond, json.dumps({"operations": list(steps)}), tree_id="t")
    (nodes, edges), errors = run({"op": "add_edge", "source_label": "D", "target_label": "A"}, {"op": "rename_node", "target_label": "B", "new_label": "Bee"})
    assert errors == [] and ("d", "a") in pairs(edges) and nodes.filter("id = 'b'").first().label == "Bee"
    for steps, want in (
        ([{"op": "add_child_node", "parent_id": "d", "new_id": "e", "label": "E"}, {"op": "add_edge", "source_id": "e", "target_id": "c"}], ["1: source or target node not found"]),
        ([{"op": "add_edge", "source_id": "b", "target_id": "b"}], ["0: self edge is not allowed"]),
        ([{"op": "move_subtree", "node_id": "b", "new_parent_id": "d"}], ["0: move would create a cycle", "d: basic event has children after edit plan"][:1]),
        ([{"op": "delete_edge", "source_id": "d", "target_id": "b"}, {"op": "move_subtree", "node_id": "b", "new_parent_id": "d"}], ["d: basic event has children after edit plan"]),
        ([{"op": "add_edge", "source_label": "no such", "target_id": "a"}, {"op": "paint"}], ["0: source or target node not found", "1: unsupported operation"]),
        ([{"op": "set_node_type", "target_id": "b", "node_type": "basic"}], ["b: basic event has children after edit plan"]),
    ):
        same, errors = run(*steps)
        assert same is diamond and errors == want, steps
    # Deleting what stood between, the move is sound; a thirteenth operation is not looked at.
    _, errors = run(*[{"op": "rename_node", "target_id": "a", "new_label": "x"}] * 12, {"op": "paint"})
    assert errors == []


def test_resolving_names(spark):
    nodes = spark.createDataFrame([("t", i, label, n) for n, (i, label) in enumerate([("1", "pump"), ("2", "pump"), ("3", "pump seal"), ("4", "valve")])], "tree_id string, id string, label string, pos long")
    ask = lambda rows, **kw: {r.ref: r.id for r in rewrite.resolve(nodes, spark.createDataFrame([("t", f"{i}{label}", i, label) for i, label in rows], "tree_id string, ref string, node_id string, label string"), **kw).collect()}
    rows = [("2", ""), ("", "pump"), ("", "seal"), ("9", "valve"), ("", "no"), ("", "valve broke")]
    assert ask(rows) == {"2": "2", "pump": None, "seal": "3", "9valve": "4", "no": None, "valve broke": None}
    assert ask(rows, first_exact=True)["pump"] == "1" and ask(rows, both_ways=True)["valve broke"] == "4"
    needles = spark.createDataFrame([("4",), ("pump",), ("ea",), ("p",)], "needle string")
    assert {r.needle: r.id for r in retrieval.best_match(nodes.drop("tree_id"), needles).collect()} == {"4": "4", "pump": "1", "ea": "3", "p": "1"}


def test_hand_edits(spark, diamond):
    from pyspark.sql import functions as F

    nodes, edges = diamond
    nodes = nodes.withColumn("event", F.struct(F.lit("d").alias("description"), F.lit("h").alias("errorLevel")))
    patch = spark.createDataFrame([("t", "b", ("new", None))], "tree_id string, id string, patch struct<description:string,errorLevel:string>")
    assert {r.id: tuple(r.event) for r in rewrite.patch_events((nodes, edges), patch)[0].collect()} == {"a": ("d", "h"), "b": ("new", "h"), "c": ("d", "h"), "d": ("d", "h")}
    more, same = rewrite.duplicate_events(diamond, spark.createDataFrame([("t", "b", "b2", 9)], "tree_id string, id string, new_id string, pos long"))
    assert more.filter("id = 'b2'").first().label == "B(副本)" and pairs(same) == pairs(edges)
    more, moved = rewrite.insert_parents(diamond, spark.createDataFrame([("t", "d", "n", "New", 9), ("t", "a", "m", "No", 9)], "tree_id string, id string, new_id string, label string, pos long"))
    assert ids(more) == {"a", "b", "c", "d", "n"} and pairs(moved) == {("b", "a"), ("c", "a"), ("d", "n"), ("n", "b"), ("d", "c")}
    once = rewrite.standalone_nodes(diamond, spark.createDataFrame([("t", "s", "basic", 9)], "tree_id string, new_id string, type string, pos long"))
    twice = rewrite.standalone_nodes(once, spark.createDataFrame([("t", "u", "basic", 9)], "tree_id string, new_id string, type string, pos long"))
    assert [r.label for r in twice[0].filter("id IN ('s', 'u')").orderBy("id").collect()] == ["新底事件1", "新底事件2"]


def most_read(spark, job):
    """The most rows that a task of the job reads from shuffles, which are neither avoided nor joined into larger ones."""
    as_is = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in as_is}
    spark.sparkContext.setJobGroup("most_read", "")
    try:
        for k, v in as_is.items():
            spark.conf.set(k, v)
        job()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    tracker, store, most = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore(), 0
    for stage in {s for j in tracker.getJobIdsForGroup("most_read") for s in tracker.getJobInfo(j).stageIds}:
        tasks = store.taskList(stage, 0, 10_000)
        for i in range(tasks.size()):
            found = tasks.apply(i).taskMetrics()
            most = max(most, found.get().shuffleReadMetrics().recordsRead()) if found.isDefined() else most
    return most


def test_names_of_a_label_that_most_nodes_share(spark):
    nodes = spark.range(8000).selectExpr("'t' AS tree_id", "concat('n', id) AS id", "CASE WHEN id < 7990 THEN 'pump' WHEN id < 7998 THEN 'seal' ELSE concat('valve ', id) END AS label", "id AS pos")
    names = spark.createDataFrame([("t", "1", None, "pump"), ("t", "2", None, "valve 7999"), ("t", "3", "n5", "pump"), ("t", "4", None, "e 7998"), ("t", "5", None, "eal")], "tree_id string, ref string, node_id string, label string")
    found = {}
    assert most_read(spark, lambda: found.update({r.ref: r.id for r in rewrite.resolve(nodes, names).collect()})) < 4000
    assert found == {"1": None, "2": "n7999", "3": "n5", "4": "n7998", "5": None}
    assert {r.ref: r.id for r in rewrite.resolve(nodes, names, first_exact=True).collect()} == found | {"1": "n0"}


def test_evidence_is_dealt_before_it_is_looked_through(spark):
    rows = [("t", "a", "b", [("v", "1"), (" v", "1 "), (None, "2")]), ("t", "a", "b", [("v", "3"), ("v", "1")]), ("t", "a", "c", [("v", "1"), ("v", None), ("v", "")]), ("u", "a", "b", [("v", "1")])]
    found = retrieval.edge_evidence(spark.createDataFrame(rows, "tree_id string, source string, target string, documents array<struct<file_version_id:string,chunk_id:string>>"))
    assert sorted(tuple(r) for r in found.fillna("").collect()) == [("t", "a", "b", "", "2"), ("t", "a", "b", "v", "1"), ("t", "a", "b", "v", "3"), ("t", "a", "c", "v", "1"), ("u", "a", "b", "v", "1")]
    assert "Aggregate" not in found._jdf.queryExecution().sparkPlan().toString().split("Generate")[-1]
    assert found._jdf.queryExecution().executedPlan().toString().split("Exchange")[-1].count("Aggregate") == 0
