"""The prefix-tree join against comparing all pairs."""

import os
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from causeway.llm import ngram_join as J
from causeway.llm import queries

DATA = "/root/testdata/sf0.01"


def grams(text, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + min(k, len(w))]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k=3, percent=90):
    """{row: (set size, component)} by all pairs that share an n-gram."""
    sets = [grams(t, k) for _, t in rows]
    holders, parent = defaultdict(list), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        shared = Counter()
        for g in s:
            shared.update(holders[g])
            holders[g].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), least[find(i)] if d is not None else None) for i, (d, _) in enumerate(rows))


def got(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def corpus(seed, n=220):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words, 40))
    rows, i = [], 0
    while len(rows) < n:
        base = rng.choice(words, int(rng.integers(1, 160))).tolist()
        for _ in range(int(rng.choice([1, 1, 2, 9]))):
            own = list(base)
            for _ in range(int(rng.integers(0, 3))):
                own[int(rng.integers(len(own)))] = str(rng.choice(words))
            if rng.random() < 0.3:
                own.insert(int(rng.integers(len(own) + 1)), passage)
            rows.append((i * 3, (" \n".join(own)).upper() if i % 2 else " ".join(own)))
            i += 1
    return [*rows, (5, None), (7, ""), (8, " \t\n"), (10, "one"), (11, "ONE"), (13, "one two"), (None, rows[0][1]), (14, rows[0][1]), (0, rows[5][1]), (15, rows[0][1])]


@pytest.mark.parametrize("block", [J.BLOCK, 3])
def test_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", block)
    for seed, k, percent in ((1, 3, 90), (2, 3, 75), (3, 2, 60)):
        rows = corpus(seed)
        docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string").repartition(4)
        assert got(J.linked_documents(docs, k=k, percent=percent)) == brute(rows, k, percent)


@pytest.mark.parametrize("few", [1, 3])
def test_larger_buckets(spark, few, monkeypatch):
    """Buckets of more than `few` members, joined by their centres and across components, beside pairs of smaller ones."""
    monkeypatch.setattr(J, "FEW", few)
    monkeypatch.setattr(J, "TREE_GRAMS", 1 << 9)
    for seed, k, percent in ((4, 3, 90), (5, 2, 60)):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert got(J.linked_documents(docs, k=k, percent=percent)) == brute(rows, k, percent)


def test_meetings():
    """Pairs of small buckets, each once and only where sizes and places allow; members of larger ones; however the rows are cut into batches."""
    rng = np.random.default_rng(3)
    rows = []
    for key in range(60):
        for c in rng.choice(400, int(rng.choice([1, 2, 3, 5, 9, 40])), replace=False).tolist():
            n = 300 + c // 4
            rows.append((c, n, int(rng.integers(0, J.lead_size(n, 90))), key, int(np.searchsorted(J.bands(n, 90), n, "right")) - int(rng.integers(0, 2))))
    rows.sort(key=lambda r: r[3:])
    buckets = defaultdict(list)
    for r in rows:
        buckets[r[3:]].append(r)
    want, large = Counter(), Counter()
    for (_, band), own in buckets.items():
        if len(own) > 5:
            large.update((c, n, key, b) for c, n, _, key, b in own)
            continue
        for i, (c, n, p, *_) in enumerate(own):
            for d, m, q, *_ in own[:i]:
                lower = min(np.searchsorted(J.bands(500, 90), x, "right") for x in (n, m))
                if min(n - p, m - q) * 190 >= 90 * (n + m) and lower == band and 10 * min(n, m) >= 9 * max(n, m):
                    want[min(c, d), max(c, d)] += 1
    names = ["c", "n", "place", "key", "band"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
    assert want and large
    for size in (1, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + size]), types)], names=names) for i in range(0, len(rows), size)]
        out = [r for b in J._met(90, 5)(iter(batches)) for r in b.to_pylist()]
        assert {(r["a"], r["b"]) for r in out if r["b"] is not None} == set(want)
        assert Counter((r["a"], r["n"], r["key"], r["band"]) for r in out if r["b"] is None) == large


def test_few_pairs_are_left(spark, monkeypatch):
    """Texts that share rare n-grams but are not near are not held against each other on whole sets, and texts that are not asked for are not cut into words again."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(0, 120, 2):
        passage = rng.choice(words, 30).tolist()
        rows += [(i + j, " ".join([*rng.choice(words, 170).tolist(), *passage])) for j in (0, 1)]
    rows += [(200, " ".join(words[:100])), (201, " ".join(words[:99]))]
    asked = []
    cells = J._cells

    def seen(pairs, sets, share):
        asked.append((pairs.count(), sets.count()))
        return cells(pairs, sets, share)

    monkeypatch.setattr(J, "_cells", seen)
    assert got(J.linked_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert sum(p for p, _ in asked) < 20 and sum(s for _, s in asked) < 40


def test_sketches():
    """What sketches tell apart is apart: never more than the sets are, whatever their sizes; unlike sets are told."""
    rng = np.random.default_rng(5)
    for size in (1, 3, 63, 64, 65, 127, 128, 200, 700):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for change in (0, 1, size // 20, size // 2, size):
            other = np.unique(np.concatenate([base[change:], rng.integers(0, 1 << 63, change + size // 9, dtype=np.uint64)]))
            if len(other):
                assert J.apart(J.sketch(base), J.sketch(other)) <= len(np.setxor1d(base, other))
    a, b = rng.integers(0, 1 << 63, (2, 400), dtype=np.uint64)
    assert not J.may_be_near(400, 400, J.sketch(a), J.sketch(b), 90)
    b = np.append(a[:379], b[:21])  # 379 of 421 n-grams: just above
    assert J.may_be_near(400, 400, J.sketch(a), J.sketch(b), 90)


def test_branches():
    """A set walks one cell's branch only."""
    sets = [np.array([0, 5, 6, 7]), np.array([1, 5, 6, 7]), np.array([1, 5, 6, 8])]
    tree = J.Tree(sets, np.full(3, 4), np.zeros(3, np.int64))
    own = np.array([1, 5, 6, 7])
    hit, overlap = tree.near(J._own(own, 9, 4), own, 4, -1, 50, tree.branches()[1])
    assert sorted(zip(hit.tolist(), overlap.tolist())) == [(1, 4), (2, 3)]


def test_threshold(spark):
    """Nine n-grams of ten, exactly, and a chain of links."""
    w = [f"a{i}" for i in range(30)]
    rows = [(3, " ".join(w[:11])), (2, " ".join(w[:12])), (1, " ".join(w[:13])), (9, " ".join(w[:14])), (4, " ".join(w[:10]))]
    assert got(J.linked_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_nothing(spark):
    assert J.linked_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    out = J.linked_documents(spark.createDataFrame([(None, None), (1, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in out) == [(0, 0, None), (1, 0, 1)]


def test_tree():
    """Every set that is near is found, with its overlap; on leads none is lost."""
    rng = np.random.default_rng(9)
    base = np.sort(rng.choice(500, 120, replace=False))
    sets = []
    for _ in range(60):
        own = np.setdiff1d(base, rng.choice(base, int(rng.integers(0, 12))))
        sets.append(np.union1d(own, rng.choice(500, int(rng.integers(0, 9)))).astype(np.int64)[: int(rng.integers(80, 130))])
    sets += [sets[0], np.arange(3), np.arange(4)]
    sizes = np.array([len(s) for s in sets])
    for percent in (60, 80, 90):
        for known in (1.0, 0.3):
            seen = [s[: max(1, int(len(s) * known))] for s in sets]
            tree = J.Tree(seen, sizes, np.zeros(len(sets), np.int64))
            for x, own in enumerate(sets):
                hit, overlap = tree.near(J._own(seen[x], 500, len(own)), seen[x], len(own), -1, percent)
                inter = {y: len(np.intersect1d(own, sets[y])) for y in range(len(sets))}
                want = {y for y, i in inter.items() if 100 * i >= percent * (len(own) + len(sets[y]) - i)}
                assert want <= set(hit.tolist())
                if known == 1:
                    assert all(inter[y] == o for y, o in zip(hit.tolist(), overlap.tolist(), strict=True))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert got(queries.op12_ngram_tree_join(spark, DATA)) == brute(rows)
