"""Polled imports, edits at rest and histories: streams against the batch forms, replays against stacks."""

import datetime as dt
import json
import random

from causeway.operators import history
from causeway.sources import trees
from causeway.streaming import pollers

START = dt.datetime(2024, 1, 1)
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def polls(spark, rows):
    return spark.createDataFrame([(f, s, k, j, st, p, START + dt.timedelta(seconds=s)) for f, s, k, j, st, p in rows], pollers.POLLS)


def latched(df):
    return {r.file_id: (r.last_seq, r.job_id, r.status, r.progress, r.complete) for r in df.collect()}


ROWS = [
    ("a", 1, "start", "j1", None, None), ("a", 2, "update", "j1", "processing", 30.0), ("a", 3, "start", "j2", None, None), ("a", 4, "update", "j1", "done", 100.0),
    ("a", 5, "update", "j2", "processing", 10.0), ("a", 6, "error", "j1", None, None), ("b", 1, "start", "k", None, None), ("b", 2, "update", "k", "done", 100.0), ("b", 3, "start", "k2", None, None),
    ("b", 4, "update", "k2", "processing", 5.0), ("b", 5, "error", "k2", None, None), ("c", 1, "error", "x", None, None), ("d", 1, "start", "m", None, None), ("d", 2, "error", "m", None, None),
    ("d", 3, "start", "m2", None, None), ("d", 4, "update", "m2", None, 7.0),
]
WANT = {
    "a": (6, "j2", "processing", 30.0, False),  # the older poller is not heard, progress stays
    "b": (5, "k2", "processing", 100.0, True),  # once done, an error does not make it failed
    "c": (1, None, None, 0.0, False),
    "d": (4, "m2", "failed", 7.0, False),
}


def test_latched(spark):
    assert latched(pollers.latched(polls(spark, ROWS))) == WANT
    assert latched(pollers.latched(polls(spark, ROWS).limit(0))) == {}


def folded(rows):
    out = {}
    for f, *event in sorted(rows, key=lambda r: (r[0], r[1])):
        out[f] = pollers.heard(out.get(f, (None, None, None, 0.0, False)), tuple(event))
    return out


def test_latched_is_the_fold(spark):
    rng = random.Random(3)
    rows = [
        (f"f{rng.randrange(6)}", s, rng.choice(["start", "update", "update", "update", "error"]), rng.choice(["j1", "j2", None]), rng.choice(["done", "processing", "failed", None]), rng.choice([None, 5.0, 60.0, 99.0]))
        for s in range(300)
    ]
    assert latched(pollers.latched(polls(spark, rows))) == folded(rows)


def test_latched_stream(spark, tmp_path):
    """The state after all batches is that of the batch form; what came before is heard once."""
    parts = [[r for r in ROWS if r[1] in s] for s in ((1, 2), (3, 4), (4, 5, 6))]
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    seen = {}
    try:
        for i, part in enumerate(parts):
            polls(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
            stream = spark.readStream.schema(pollers.POLLS).parquet(f"{tmp_path}/in/*")
            out = pollers.latched_stream(stream).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/at")
            query = out.foreachBatch(lambda df, _: seen.update(latched(df))).trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert query.exception() is None
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
    assert seen == WANT


def test_edits_at_rest(spark):
    ms = lambda n: START + dt.timedelta(milliseconds=n)
    rows = [("t", 1, ms(0), False), ("t", 2, ms(349), False), ("t", 7, ms(-1), False), ("t", 3, ms(700), False), ("t", 4, ms(2000), False), ("t", 5, ms(2100), True), ("u", 6, ms(100), False)]
    edits = spark.createDataFrame(rows, "tree_id string, edit_id long, at timestamp, empty boolean")
    got = {(r.tree_id, r.edit_id, r.n_edits, (r.validated_at - START) / dt.timedelta(milliseconds=1)) for r in pollers.at_rest(edits).collect()}
    # 350 ms later is the same burst, 351 ms later is another; a burst that ends empty is not validated.
    assert got == {("t", 2, 3, 699.0), ("t", 3, 1, 1050.0), ("u", 6, 1, 450.0)}


def test_edits_at_rest_stream(spark, tmp_path):
    ms = lambda n: START + dt.timedelta(milliseconds=n)
    schema = "tree_id string, edit_id long, at timestamp, empty boolean"
    rows = [("t", 1, ms(0), False), ("t", 2, ms(300), False), ("t", 3, ms(5000), False), ("t", 4, ms(9000), False)]
    for i, part in enumerate((rows[:1], rows[1:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").withWatermark("at", "1 second")
    query = pollers.at_rest(stream).writeStream.outputMode("append").format("memory").queryName("rest").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = {(r.tree_id, r.edit_id) for r in pollers.at_rest(spark.createDataFrame(rows, schema)).collect()}
    assert {(r.tree_id, r.edit_id) for r in spark.table("rest").collect()} == batch - {("t", 4)}  # the last has not come to rest yet


def stacks(events):
    """By two stacks of what was shown."""
    shown, undo, redo, out = None, [], [], []
    for kind, version, valid in events:
        changed = valid
        if kind in ("edit", "apply") and valid:
            undo, redo, shown = [*undo, shown], [], version
        elif kind == "sync":
            shown = version
        elif kind == "undo":
            changed = bool(undo)
            if undo:
                redo, shown, undo = [*redo, shown], undo[-1], undo[:-1]
        elif kind == "redo":
            changed = bool(redo)
            if redo:
                undo, shown, redo = [*undo, shown], redo[-1], redo[:-1]
        out.append((changed, bool(undo), bool(redo), shown))
    return out


def test_history(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for session in range(12):
        events = [(rng.choice(["edit", "undo", "undo", "redo", "redo", "sync", "apply"]), f"v{i}", rng.choice(['{"a": 1}', "[]", "{bad", None])) for i in range(rng.randrange(0, 90))]
        if session == 0:
            events = [(k, f"v{i}", "{}") for i, k in enumerate(["undo", "redo", "edit", "edit", "undo", "edit", "redo", "undo", "undo", "undo", "redo", "sync", "redo", "redo"])]
        told = stacks([(k, v, k != "apply" or d in ('{"a": 1}', "[]", "{}")) for k, v, d in events])
        for i, ((k, v, d), w) in enumerate(zip(events, told, strict=True)):
            rows.append((f"s{session}", i, k, v, d))
            want[f"s{session}", i] = w
    df = spark.createDataFrame(rows, "session_id string, seq long, kind string, version string, document string").repartition(7)
    got = {(r.session_id, r.seq): (r.changed, r.can_undo, r.can_redo, r.shown) for r in history.replayed(history.valid_edits(df)).collect()}
    assert got == want
    assert history.replayed(history.valid_edits(df.limit(0))).collect() == []


def test_own_shape(spark):
    """An edited tree is written in the shape that it was read in."""
    docs = {
        "raw": {"nodeList": [{"id": "a", "name": "A"}], "linkList": []},
        "map": {"tree_data": {"nodes": {"a": {"id": "a", "name": "A", "children": ["b"]}, "b": {"id": "b", "name": "B", "children": []}}}},
        "graph": {"nodes": [{"id": "a", "label": "A"}, {"id": "b", "label": "B"}], "edges": [{"source": "b", "target": "a"}]},
        "none": {},
    }
    parsed = trees.parse(spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "tree_id string, document string"))
    nodes, edges = trees.nodes(parsed), trees.edges(parsed)
    out = {r.tree_id: (r.shape, json.loads(r.document)) for r in history.in_own_shape(parsed, nodes, edges).collect()}
    assert out.keys() == {"raw", "map", "graph"} and all(out[k][0] == k for k in out)
    assert "nodeList" in out["raw"][1] and out["map"][1]["tree_data"]["nodes"]["a"]["children"] == ["b"] and out["graph"][1]["edges"] == [{"source": "b", "target": "a"}]
    again = trees.parse(spark.createDataFrame([(k, json.dumps(v)) for k, (_, v) in out.items()], "tree_id string, document string"))
    assert {(r.tree_id, r.id, r.label) for r in trees.nodes(again).collect()} == {(r.tree_id, r.id, r.label) for r in nodes.collect()}
