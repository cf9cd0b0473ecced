"""Layouts, names and ids against plain versions on hand-made trees."""

import random

from causeway.functions import scalars
from causeway.operators import layout, naming, retrieval, rewrite
from pyspark.sql import functions as F


def graph(spark, nodes, edges):
    n = spark.createDataFrame([("t", i, i, k, "", p) for p, (i, k) in enumerate(nodes)], "tree_id string, id string, label string, type string, gate string, pos long")
    e = spark.createDataFrame([("t", s, t, p) for p, (s, t) in enumerate(edges)], "tree_id string, source string, target string, pos long")
    return n, e


def places(df):
    return {r.id: (r.cx, r.cy) for r in df.collect()}


def test_tidy_with_gates_and_rows(spark):
    nodes = [("top", "top"), ("g", "gate"), ("a", "basic"), ("b", "basic"), ("c", "intermediate"), ("lone", "intermediate"), ("lone2", "intermediate"), ("x", "house"), ("top2", "top")]
    n, e = graph(spark, nodes, [("g", "top"), ("a", "g"), ("b", "g"), ("c", "top")])
    tree = layout.tidy(n, e)
    assert places(tree) == {"top": (0, 0), "g": (-80, 90), "c": (160, 90), "a": (-160, 190), "b": (0, 190)}
    assert places(layout.rows_below(n, tree)) == {"top2": (0, 390), "lone": (-100, 530), "lone2": (100, 530), "x": (0, 670)}


def test_shared_children_and_cycles(spark):
    n, e = graph(spark, [("r", "top"), ("a", "i"), ("b", "i"), ("s", "basic")], [("a", "r"), ("b", "r"), ("s", "a"), ("s", "b")])
    got = places(layout.tidy(n, e))
    assert got["s"] == (80, 180) and got["a"] == (-80, 90) and len(got) == 4  # in the rightmost of its two places
    n, e = graph(spark, [("r", "top"), ("a", "i"), ("b", "i")], [("a", "r"), ("b", "a"), ("r", "b")])
    assert set(places(layout.tidy(n, e))) == {"r", "a", "b"}
    empty = graph(spark, [("r", "top")], [("q", "z")])
    assert places(layout.laid_out(*empty)) == {"r": (0, 0)}


def slots(rows):
    """One after another, each against all before it in its band."""
    bands, out = {}, {}
    for i, cx, cy in rows:
        row = bands.setdefault(round((cy + 1e-9) / 10), [])
        x, tries = cx, 0
        while any(abs(y - x) < 112 for y in row) and tries < 10:
            x = cx + (1 if tries % 2 == 0 else -1) * ((tries + 1) // 2) * 67.2
            tries += 1
        row.append(x)
        out[i] = round(x, 6)
    return out


def test_apart(spark):
    rng = random.Random(5)
    for spread, many in ((300, 8), (3000, 40), (100_000, 60), (500, 60)):
        rows = [(f"n{i}", float(rng.randrange(spread)), float(rng.choice([0, 3, 90, 100]))) for i in range(many)]
        df = spark.createDataFrame([("t", i, "basic", cx, cy, float(k), 0) for k, (i, cx, cy) in enumerate(rows)], "tree_id string, id string, type string, cx double, cy double, left double, depth int")
        assert {r.id: round(r.cx, 6) for r in layout.apart(df).collect()} == slots(rows)


def test_boxes_by_component(spark):
    placed = spark.createDataFrame([("t", "a", "gate", 0.0, 0.0), ("t", "b", "basic", 200.0, 90.0), ("t", "c", "top", 500.0, 0.0)], "tree_id string, id string, type string, cx double, cy double")
    parts = spark.createDataFrame([("t", "a", "a"), ("t", "b", "a")], "tree_id string, id string, component string")
    got = {r.component: (r.min_x, r.min_y, r.max_x, r.max_y) for r in layout.boxes(placed, parts).collect()}
    assert got == {"a": (-30, 0, 255, 200), "c": (430, 0, 570, 56)}
    edges = spark.createDataFrame([("t", "b", "a"), ("t", "gone", "a")], "tree_id string, source string, target string")
    shapes, lines = layout.scene(placed, edges)
    scale = min(108 / 600, 68 / 200)
    line = lines.first()
    assert lines.count() == 1 and abs(line.x1 - (6 + 230 * scale)) < 1e-9 and abs(line.y1 - (6 + 200 * scale)) < 1e-9 and abs(line.y2 - 6) < 1e-9
    assert {r.id: r.kind for r in shapes.collect()} == {"a": "gate", "b": "ellipse", "c": "rect"}


def test_seeded_random(spark):
    want, x = {}, 12345 % 2147483647 + 1
    for n in range(1, 3000):
        x = x * 48271 % 2147483647
        want[n] = x / 2147483647
    got = {r.n: r.x for r in spark.range(1, 3000).select(F.col("id").alias("n"), scalars.seeded_random(F.lit(12345), F.col("id")).alias("x")).collect()}
    assert got == want
    far = spark.range(1).select(scalars.seeded_random(F.lit(12345), F.lit((1 << 31) - 1)).alias("x")).first().x
    assert far == (12345 + 1) * pow(48271, (1 << 31) - 1, 2147483647) % 2147483647 / 2147483647


def test_containing(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab泵") for _ in range(n))
    labels = [(rng.choice("tu"), word(rng.randrange(0, 9))) for _ in range(150)] + [("t", None)]
    names = [(rng.choice("tu"), word(rng.randrange(0, 6))) for _ in range(60)] + [("t", None), ("t", "zzz")]
    got = naming.containing(spark.createDataFrame(names, "tree_id string, name string"), spark.createDataFrame(labels, "tree_id string, label string"), ["tree_id"]).collect()
    want = {(t, n, l) for t, n in names for u, l in labels if t == u and n and l and n in l}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_names_need_no_nested_loops(spark):
    nodes = spark.createDataFrame([("t", "a", "main pump", 1), ("t", "b", "pump", 2), ("t", "c", "valve", 3), ("t", "d", "big valve", 4)], "tree_id string, id string, label string, pos long")
    found = retrieval.best_match(nodes, spark.createDataFrame([("valv",), ("c",), ("pump",), ("in p",), ("zz",)], "needle string"))
    assert {r.needle: r.id for r in found.collect()} == {"valv": "c", "c": "c", "pump": "b", "in p": "a"}
    names = spark.createDataFrame([("t", "1", None, "big"), ("t", "2", None, "valve"), ("t", "3", None, "ump"), ("t", "4", None, "the big valve there")], "tree_id string, ref string, node_id string, label string")
    plain = rewrite.resolve(nodes, names)
    assert {r.ref: r.id for r in plain.collect()} == {"1": "d", "2": "c", "3": None, "4": None}
    both = rewrite.resolve(nodes, names.filter("ref IN ('1', '4')"), both_ways=True)
    assert {r.ref: r.id for r in both.collect()} == {"1": "d", "4": None}  # both "valve" and "big valve" stand in it
    for df in (found, plain, both):
        assert "NestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()


def test_fresh_ids(spark):
    taken = {"p", "p-1", "p-3", "p-4", "q-1", "p-x", "p-01", "r-2", "p-99999999999999999999"}
    wanted = [("t", "p", i) for i in range(6)] + [("t", "q", i) for i in range(3)] + [("t", "r", 0), ("u", "p", 5)]
    df = naming.fresh_ids(spark.createDataFrame(wanted, "tree_id string, base string, pos long"), spark.createDataFrame([("t", x) for x in taken], "tree_id string, id string"))
    got = {(r.tree_id, r.base, r.pos): r.id for r in df.collect()}
    want, used = {}, {("t", x) for x in taken}
    for t, b, p in wanted:
        n = 0
        while (t, name := b if n == 0 else f"{b}-{n}") in used:
            n += 1
        used.add((t, name))
        want[t, b, p] = name
    assert got == want


def test_mentioned_type(spark):
    texts = {"a Basic Event": "basic", "TOP_EVENT, 中间事件": "intermediate", "顶事件": "top", "an event": None, None: None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", naming.mentioned_type(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in rows} == texts


def test_connect_nodes(spark):
    nodes = [("r", "top"), ("g", "gate"), ("a", "basic"), ("b", "basic"), ("c", "intermediate"), ("d", "basic"), ("e", "basic"), ("f", "basic"), ("h", "gate")]
    n, e = graph(spark, nodes, [("g", "r"), ("a", "g"), ("c", "r"), ("d", "c")])

    def after(*wanted):
        df = spark.createDataFrame([("t", s, t, f"new-{i}", i) for i, (s, t) in enumerate(wanted)], "tree_id string, source string, target string, gate_id string, pos long")
        made, links = rewrite.connect_nodes((n, e), df)
        return {(r.source, r.target) for r in links.collect()} ^ {(r.source, r.target) for r in e.collect()}, {r.id: r.type for r in made.collect()}

    assert after(("e", "g"))[0] == {("e", "g")}  # under a gate
    assert after(("e", "r"))[0] == {("e", "g")}  # under the gate that the target has
    changed, types = after(("e", "c"))  # the target has a child: all go under a new gate
    assert changed == {("d", "c"), ("d", "new-0"), ("e", "new-0"), ("new-0", "c")} and types["new-0"] == "gate"
    changed, types = after(("e", "f"))  # the only child
    assert changed == {("e", "f")} and types["f"] == "intermediate"
    assert after(("e", "f"), ("b", "f"))[0] == {("e", "new-1"), ("b", "new-1"), ("new-1", "f")}
    assert after(("h", "c"), ("e", "e"), ("d", "c"), ("gone", "c"), ("e", "gone"))[0] == set()


def test_bands_without_near_nodes_are_not_gone_through(spark):
    placed = spark.createDataFrame([("t", f"n{i}", "basic", 160.0 * i, 0.0, 160.0 * i, 1) for i in range(5)], "tree_id string, id string, type string, cx double, cy double, left double, depth int")
    assert layout.apart(placed) is placed
