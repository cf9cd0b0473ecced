"""The registered queries on whole test tables, against exact versions and held-out labels."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import pytest

from causeway.llm import queries
from tests.llm.test_documents import WORD, brute_repeats, brute_spans, shingles, words

DATA, LABELLED = "/root/testdata/sf0.01", "/root/testdata/sf0.1"  # models need the labels of the larger one
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def test_near_duplicates_whole(spark, texts):
    """Every pair that shares a shingle, compared exactly: recall and precision of links are 1."""
    sets, holders, shared = {i: shingles(t) for i, t in texts.items()}, defaultdict(list), Counter()
    for i in sorted(sets):
        for s in sets[i]:
            shared.update((j, i) for j in holders[s])
            holders[s].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op2_minhash_near_dedup(spark, DATA).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_containment_whole(spark, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    want = set()
    for j, t in items.items():
        k = min(5, len(words(t)))
        own = shingles(t, k) if k else set()
        want |= {(i, j) for i, d in texts.items() if own and len(words(d)) >= k and 100 * len(own & shingles(d, k)) >= 75 * len(own)}
    assert {(r.doc_id, r.item_id) for r in queries.op10_benchmark_containment(spark, DATA).collect()} == want


def test_repeats_whole(spark, texts):
    want = brute_repeats(texts, 13)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op7_substring_dedup(spark, DATA).collect()}
    assert got == {i: (w[0], w[2], w[3]) for i, w in want.items()}
    want = brute_repeats(texts, 50)
    assert {r.doc_id: r.n_repeated for r in queries.op6_suffix_array_dedup(spark, DATA).collect()} == {i: w[1] for i, w in want.items() if w[1]}


def test_base_spans_whole(spark, texts):
    got = {r.doc_id: r.base_sha256 for r in queries.op3_pii_skip_chain(spark, DATA).collect()}
    joined = {i: ",".join(f"{k}:{s}:{e}" for k, s, e in brute_spans(t or "")) for i, t in texts.items()}
    assert got == {i: hashlib.sha256(x.encode()).hexdigest() for i, x in joined.items()}


def test_edited_texts_whole(spark, texts):
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in queries.op5_multiset_fingerprints(spark, DATA).collect()}
    for at, i in enumerate(order):
        t, after = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        cut = len(t) // 3
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()
    same = defaultdict(set)
    for i, t in texts.items():
        same[t or ""].add(got[i].fingerprint)
    assert all(len(f) == 1 for f in same.values())


def test_held_out_quality(spark):
    """Labels whose rows the model has not seen."""
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{LABELLED}/labels.parquet").collect()}
    held = [r for r in queries.op1_compression_quality(spark, LABELLED).collect() if r.held_out and truth.get(r.doc_id) is not None]
    assert len(held) > 500 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_toxicity_whole(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LABELLED}/labels.parquet").collect()}
    got = {r.doc_id: r.rejected for r in queries.op9_toxicity_chain(spark, LABELLED).collect()}
    toxic, clean = [i for i in truth if truth[i]], [i for i in truth if truth[i] == 0]
    assert sum(got[i] for i in toxic) >= 0.95 * len(toxic) and sum(got[i] for i in clean) <= 0.005 * len(clean)


def test_main_text_whole(spark):
    """Pages of the tables have one article each: its text, tags taken out, block by block."""
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in queries.op4_html_wrappers(spark, DATA).collect()}
    for i, page in pages.items():
        article = re.search(r"<article.*?</article>", page, re.S)
        if article and "<aside" not in article[0] and "<div" not in article[0]:
            plain = WORD.findall(html.unescape(re.sub(r"<[^>]*>", " ", article[0])))
            assert "".join(got[i].split()) == "".join("".join(plain).split()), i
