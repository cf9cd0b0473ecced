"""The skip-chain field: repeats of any number, exact marginals on small graphs, encoding and decoding in one pass."""

import itertools

import numpy as np
import pytest

from causeway.llm import pieces, pii
from tests.llm.test_documents import frame


@pytest.fixture(scope="module")
def field():
    rng = np.random.default_rng(4)

    def number(n):
        return "".join(rng.choice(list("0123456789"), n))

    texts = []
    for i in range(400):
        full = f"+44 20 {number(4)} {number(4)}" if i % 2 else f"+49 (30) {number(3)}-{number(4)}"
        texts.append(f"call {full} before 19 March 2024, order {number(7)} of {number(4)} {number(4)} or write to a{i}@mail.example.org from 10.0.{i % 200}.7")
    return pii.fitted(texts)


@pytest.mark.parametrize("full,short", [("+44 20 7946 0958", "20 7946 0958"), ("+49 (30) 555-0199", "(30) 555-0199"), ("+1 212 555 0147", "212 555 0147"), ("+33 1 70 18 99 00", "1 70 18 99 00")])
def test_all_repeats(field, full, short):
    """However often a number comes again, all of it is found, and a number of the same shape that repeats nothing is not."""
    other = "".join("3" if c.isdigit() else c for c in short)
    for many in (1, 2, 3, 12, 30, 200):
        text = f"call {full} now, " + "".join(f"or {short} at {i % 7} h, " for i in range(many)) + f"but {other} is a lot."
        base, spans = pii.all_spans(text, field)
        found = {text[s:e] for _, s, e in set(spans) - set(base)}
        assert len(spans) - len(base) == many and all(x.endswith(short[-8:]) for x in found), (many, spans)
    text = "".join(f"or {short} at {i % 7} h, " for i in range(30))
    assert pii.all_spans(text, field) == ([], [])


def test_before_and_after(field):
    text = "20 7946 0958 and 20 7946 0958, in full +44 20 7946 0958, and 20 7946 0958"
    base, spans = pii.all_spans(text, field)
    assert len(base) == 1 and [k for k, _, _ in spans] == ["phone"] * 4


def exact(node, chain, skip, a, b, kind):
    n, size = node.shape
    p = np.zeros((n, size))
    for labels in itertools.product(range(size), repeat=n):
        w = sum(node[i, x] for i, x in enumerate(labels)) + sum((skip if k else chain)[labels[x], labels[y]] for x, y, k in zip(a, b, kind))
        for i, x in enumerate(labels):
            p[i, x] += np.exp(w)
    return p / p.sum(axis=1, keepdims=True)


def test_exact_marginals():
    """On trees beliefs are the marginals; with loops of skip edges, the likeliest labels are the same where they are clear."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5):
        for _ in range(6):
            node, chain = rng.normal(size=(n, 3)), rng.normal(size=(3, 3)) * 0.5
            skip = np.full((3, 3), -1.0) + 2 * np.eye(3)
            field = pii.Field(np.zeros((pii.FEATURES, 3)), chain, skip)
            a, b = np.arange(n - 1), np.arange(1, n)
            belief = field.beliefs(node, a, b, np.zeros(n - 1, bool))
            p = np.exp(belief - np.logaddexp.reduce(belief, axis=1)[:, None])
            assert np.allclose(p, exact(node, chain, skip, a, b, np.zeros(n - 1, bool)), atol=1e-3)
            if n > 2:
                a, b, kind = np.append(a, 0), np.append(b, n - 1), np.append(np.zeros(n - 1, bool), True)
                p, got = exact(node, chain, skip, a, b, kind), field.beliefs(node, a, b, kind)
                clear = np.sort(p, axis=1)[:, -1] - np.sort(p, axis=1)[:, -2] > 0.15
                assert (p.argmax(axis=1) == got.argmax(axis=1))[clear].all()


def test_round_trip(spark):
    rows = {1: "the  garden\n and ▁ 🙂", 2: None, 3: "", 4: "x" * 400_000, 5: "\x00 odd \x01"}
    docs = frame(spark, rows)
    once = {r.doc_id: (r.ids, r.lossless) for r in pieces.round_trip(docs.select("doc_id", "text")).collect()}
    twice = {r.doc_id: (r.ids, r.decoded == (r.text or "")) for r in pieces.decode(pieces.encode(docs.select("doc_id", "text"))).collect()}
    assert once == twice and all(x for _, x in once.values())
    clash = docs.select("doc_id", "text").withColumnsRenamed({}).selectExpr("doc_id", "text", "1 AS lossless", "2 AS ids")
    assert {r.doc_id: (r.ids, r.lossless) for r in pieces.round_trip(clash).collect()} == once
    assert pieces.round_trip(docs.select("doc_id", "text").limit(0)).collect() == []
