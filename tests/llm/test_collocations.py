"""Phrase collocations against brute force, the sort against counting."""

import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from causeway.llm import collocations as C
from causeway.llm import queries

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string"


def brute(rows, words=3, least=10, share=50, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lower):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, words + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, g in f.items():
        found = {p: a for p, a in g.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in found.items():
            for k in range(2, len(p)):
                gone |= {q for q in (p[i : i + k] for i in range(len(p) - k + 1)) if q in found and 100 * a >= share * found[q]}
        scored = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((1000000 * a * a // (g[p[:k]] * g[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), g[p[:k]], g[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def got(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_quicksort():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 50, 3000):
        columns = [rng.zipf(1.5, n).clip(max=30) for _ in range(3)]
        columns[2][rng.random(n) < 0.2] = -1
        columns[1][rng.random(n) < 0.2] = -1
        columns[2][columns[1] == -1] = -1
        weight = rng.integers(1, 5, n)
        for least in (0, 4, 40):
            runs, ends = C.quicksort(columns, weight, [least] * 3)
            for d in range(3):
                want, stop = Counter(), Counter()
                for i in range(n):
                    key = tuple(int(columns[x][i]) for x in range(d + 1))
                    (stop if key[-1] == -1 else want)[key] += int(weight[i])
                want = {k: v for k, v in want.items() if v >= max(1, least) and -1 not in k}
                have = {tuple(int(columns[x][i]) for x in range(d + 1)): int(v) for i, v in zip(*runs[d], strict=True)}
                assert have == want and len(have) == len(runs[d][0])
                if not least:
                    have = {tuple(int(columns[x][i]) for x in range(d + 1)): int(v) for i, v in zip(*ends[d], strict=True)}
                    assert have == {k: v for k, v in stop.items() if -1 not in k[:-1]}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    base = ["New", "york", "city", "of", "the", "été", "A-b", "x", "(y)", "zoo"]
    out = []
    for i in range(160):
        w = [base[j] for j in rng.zipf(1.3, 60).clip(max=10) - 1]
        text = "".join(x + str(rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b"], p=[0.6, 0.1, 0.05, 0.1, 0.05, 0.05, 0.05])) for x in w)
        out.append((text if i % 17 else None, ["en", "fr", None, "und"][i % 4]))
    return [*out, ("", "en"), (" .,; \n", "xx"), ("New York " * 4000, "long"), ("of the " * 20, "en"), ("of the " * 20, "en")]


@pytest.mark.parametrize("least,share,top", [(10, 50, 2000), (2, 50, 7), (3, 90, 2000)])
def test_brute_force(spark, rows, least, share, top):
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], SCHEMA).withColumnsRenamed({"doc_id": "n"})  # a column called like the result's
    assert got(C.collocations(docs.repartition(5), least=least, share=share, top=top)) == brute(rows, least=least, share=share, top=top)


def test_small_blocks(spark, rows, monkeypatch):
    """The same where tasks sort few pointers at a time and many pairs count as hot."""
    monkeypatch.setattr(C, "BLOCK", 500)
    monkeypatch.setattr(C, "ROUTED_BLOCK", 40)
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(3)
    assert got(C.collocations(docs, least=5)) == brute(rows, least=5)
    assert got(C.collocations(docs, words=4, least=3)) == brute(rows, words=4, least=3)


def test_nothing(spark):
    for rows in ([], [(1, None, None), (2, "", "en"), (3, " .\n", "en"), (4, "one", "en")]):
        assert C.collocations(spark.createDataFrame(rows, SCHEMA)).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_whole_table(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert got(queries.op11_phrase_collocations(spark, DATA)) == brute(rows)
