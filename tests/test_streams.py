"""Run events as streams, against the batch forms."""

import datetime as dt

from causeway.streaming import runs


def events(spark, rows):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(r, s, "stage", "work", status, float(p), "m", start + dt.timedelta(seconds=s)) for r, s, status, p in rows], runs.EVENTS)


ROWS = [("a", 1, "started", 0), ("a", 2, "running", 40), ("a", 2, "running", 40), ("b", 1, "started", 5), ("a", 3, "completed", 30)]


def test_latest_state_of_a_stream(spark, tmp_path):
    for i, part in enumerate((ROWS[:3], ROWS[3:])):
        events(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = runs.latest_state(runs.deduplicated(runs.read_events(spark, f"{tmp_path}/in", 1)))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.run_id: (r.last_seq, r.status, r.progress, r.terminal) for r in spark.table("latest").collect()}
    assert got == {"a": (3, "completed", 40.0, True), "b": (1, "started", 5.0, False)}
    assert got == {r.run_id: (r.last_seq, r.status, r.progress, r.terminal) for r in runs.latest_state(events(spark, ROWS)).collect()}


def test_latest_state_of_an_endless_stream(spark, tmp_path):
    """The batch form's states after all batches; a run that was quiet for long is forgotten, and begins anew."""
    from tests.test_sessions import ROCKS, STORE

    before, seen = spark.conf.get(STORE, None), {}
    spark.conf.set(STORE, ROCKS)
    try:
        parts = (ROWS[:3], ROWS[3:], [("c", 100_000, "started", 1)], [("c", 100_001, "running", 2)], [("a", 100_002, "started", 1)])
        for i, part in enumerate(parts):
            events(spark, part).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
            stream = runs.latest_state_stream(runs.read_events(spark, f"{tmp_path}/in/*"), delay="10 seconds", idle_ms=60_000)
            keep = lambda df, _: seen.update({r.run_id: (r.last_seq, r.status, r.progress, r.terminal) for r in df.collect()})
            stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/at").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination(120)
            if i == 1:
                assert seen == {r.run_id: (r.last_seq, r.status, r.progress, r.terminal) for r in runs.latest_state(events(spark, ROWS)).collect()}
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
    assert seen["a"] == (100_002, "started", 1.0, False)  # not the 40 of a day before


def test_items_are_taken_once(spark, tmp_path):
    """A batch that fails after its items were noted, and comes again, takes the same items."""
    taken, fails = {}, [True]

    def take(new, batch_id):
        found = sorted(r.item_id for r in new.collect())
        if batch_id == 1 and fails.pop():
            raise RuntimeError("lost")
        taken[batch_id] = found

    batch = runs.ingest(f"{tmp_path}/seen", take)
    second = spark.createDataFrame([("y",), ("z",)], "item_id string")
    batch(spark.createDataFrame([("x",), ("y",), ("x",)], "item_id string"), 0)
    try:
        batch(second, 1)
    except RuntimeError:
        fails.append(False)
    batch(second, 1)
    batch(spark.createDataFrame([("z",), ("w",)], "item_id string"), 2)
    assert taken == {0: ["x", "y"], 1: ["z"], 2: ["w"]}


def test_gaps_and_patches(spark):
    e = events(spark, ROWS)
    cursors = spark.createDataFrame([("a", 5), ("b", 1), ("c", 2)], "run_id string, cursor long")
    assert {(r.run_id, r.n_events) for r in runs.gaps(e, cursors).collect()} == {("a", 3), ("c", 0)}
    latest = spark.createDataFrame([("a", "completed", None), ("b", "running", "need_confirmation")], "run_id string, status string, mode string")
    assert {(r.run_id, r.action, r.clears_pending) for r in runs.memory_patches(latest).collect()} == {("a", "generation_finished", True), ("b", "need_top_event_confirmation", False)}


def test_cursor(spark):
    e = events(spark, ROWS)
    cursors = spark.createDataFrame([("a", 2)], "run_id string, cursor long")
    assert {(r.run_id, r.event_seq) for r in runs.after_cursor(e, cursors).collect()} == {("a", 3), ("b", 1)}
