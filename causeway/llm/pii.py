"""Personal data: base patterns, and a skip-chain conditional random field that completes them.

The base patterns find emails, IPv4 addresses, payment cards and phone numbers. The field then
labels a document's candidates: looser stretches that look like addresses or numbers. Its nodes
are candidates, its potentials: the shape of a candidate; the labels of candidates next to each
other; and, by skip edges, the labels of candidates anywhere in the document that are the same
address or digits (or end in the same seven). Candidates that a base span covers are observed; for
the others loopy message passing gives a label, and what is not "other" is added as a span. So a
number that is written once in full and later without its prefix is found each time, however often that is.

Of the candidates that are the same, those that are not observed have one skip edge to each label that is (to the first
observed candidate with it), and no edges between themselves; where none is observed, all have one to the first. So there are as many edges as candidates, and
repeats that the patterns miss can't outvote the one that they find. Messages are passed until none changes by more than `STILL`.

Weights of shapes and neighbours are fitted on the driver by pseudo-likelihood: each candidate's
label given those of its neighbours. The labels are the base spans of a bounded sample of documents with candidates (`SAMPLE`
of them and `SAMPLE_BYTES` of text at most, the first by a hash of the id); a candidate that the base patterns miss, but
that repeats what they find, is left out there, as its label is what the field is to tell. Skip weights are a prior: the belief that
repeats agree (`REPEAT`), which the same fit moves only as far as repeats of observed spans in the sample bear it out or not. Every document is searched whole, in time
linear in its length for each round of messages.

Defined cases: a null text is empty; no candidates give no spans and the hash of the empty string;
very long runs of digits or signs cost linear time; rows that repeat an id are each searched by their own text; extra
columns are ignored by `find` and kept by `redact`; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm import text as T
from causeway.llm.tables import SAMPLE_BYTES

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 2000
#: Messages have settled when none changes by more than this; damped messages that swing for ever end after MOST_ROUNDS, as they are.
STILL, MOST_ROUNDS = 1e-4, 1000
#: Edges whose messages are reckoned at a time; digits from which a number stands for itself beside others.
EDGES, ALONE = 1 << 14, 9
#: Log potential of a skip edge between equal labels, and less that between others, before fitting.
REPEAT = 6.0
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A run of digits is looked at from its start only: a match that began inside it would begin at its start as well.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOOSE = re.compile(r"[+(]?[0-9][0-9().\x20-]*[0-9]|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*+@[A-Za-z0-9.-]*[A-Za-z0-9]")
_SOME = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        after = at + 1
        if start < at and (m := _DOMAIN.match(text, after)):
            out.append((start, m.end()))
            done = after = m.end()
        at = text.find("@", after)
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns (kind, start, end), by start and then by kind as listed."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _shape(text: str) -> list[int]:
    """Places of a candidate's features that are set."""
    digits = sum("0" <= c <= "9" for c in text)
    letters = sum(c.isalpha() for c in text)
    on = [0, 1 + min(digits, 20), 22 + min(text.count("."), 4), 27 + min(text.count("-"), 3), 31 + min(text.count(" "), 3)]
    on += [35] * ("@" in text) + [36] * text.startswith("+") + [37] * ("(" in text) + [38] * (letters > 0) + [39] * (max(map(len, re.split(r"[^0-9]+", text))) > 3)
    return on


FEATURES = 40


def _keys(text: str) -> list[str]:
    """What makes two candidates the same: the address, or all digits and the last seven of them."""
    if "@" in text:
        return [text.lower()]
    digits = re.sub(r"[^0-9]", "", text)
    return [digits, "*" + digits[-7:]] if len(digits) >= 7 else []


@dataclass(frozen=True)
class Field:
    """Log potentials; label 0 is "other", then KINDS."""

    unary: np.ndarray  # FEATURES x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray

    def labels(self, texts: Sequence[str], observed: Sequence[int]) -> np.ndarray:
        """Most likely label of each candidate; observed: its label, or -1."""
        size = len(KINDS) + 1
        node = np.stack([self.unary[_shape(t)].sum(axis=0) for t in texts])
        for i, label in enumerate(observed):
            if label >= 0:
                node[i] = -1e9  # beyond what any number of neighbours can say
                node[i, label] = 0.0
        return self.beliefs(node, *_edges(texts, observed)).argmax(axis=1)

    def beliefs(self, node: np.ndarray, a: np.ndarray, b: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Log beliefs of nodes (up to a constant each) after message passing over the edges (a, b)."""
        size = node.shape[1]
        potential, kind = np.stack([self.chain, self.skip]), skip.astype(int)
        to_a, to_b = np.zeros((len(a), size)), np.zeros((len(a), size))
        for _ in range(MOST_ROUNDS if len(a) else 0):
            moved = 0.0
            belief = node.copy()
            np.add.at(belief, a, to_a)
            np.add.at(belief, b, to_b)
            for lo in range(0, len(a), EDGES):
                e = slice(lo, lo + EDGES)
                p = potential[kind[e]]
                new_b = np.logaddexp.reduce((belief[a[e]] - to_a[e])[:, :, None] + p, axis=1)
                new_a = np.logaddexp.reduce((belief[b[e]] - to_b[e])[:, None, :] + p, axis=2)
                for to, new in ((to_a, new_a), (to_b, new_b)):
                    new -= new.max(axis=1, keepdims=True)
                    moved = max(moved, float(np.abs(new - to[e]).max()))
                    to[e] = 0.5 * to[e] + 0.5 * new
            if moved < STILL:
                break
        belief = node.copy()
        np.add.at(belief, a, to_a)
        np.add.at(belief, b, to_b)
        return belief


def _edges(texts: Sequence[str], observed: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the edges between candidates, and which are skip edges: to the first of each observed label that is the same, else to the first that is."""
    edges = [(i, i + 1, False) for i in range(len(texts) - 1)]
    keys, hubs = [_keys(t) for t in texts], {}
    for i, label in enumerate(observed):
        if label > 0:
            for k in keys[i]:
                hubs.setdefault(k, {}).setdefault(label, i)
    for i in range(len(texts)):
        for k in keys[i]:
            own = hubs.setdefault(k, {0: i})
            edges += [(min(i, hub), max(i, hub), True) for hub in own.values() if hub != i]
    a, b, skip = (np.array([e[k] for e in edges], int) for k in range(3))
    return a, b, skip.astype(bool)


def _numbers(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """A loose stretch, cut at spaces beside a number of ALONE digits or more."""
    at, words = start, text[start:end].split(" ")
    many = [sum("0" <= c <= "9" for c in w) >= ALONE for w in words]
    place = start
    for i, w in enumerate(words):
        place += len(w)
        if i + 1 == len(words) or many[i] or many[i + 1]:
            if place - at > 1:
                yield at, place
            at = place + 1
        place += 1


def _candidates(text: str, base: list[Span]) -> list[tuple[int, int, int]]:
    """(start, end, label by the base spans or -1) of a text's candidates, in order."""
    out, at = [(s, e, KINDS.index(k) + 1) for k, s, e in base], 0
    taken = sorted((s, e) for _, s, e in base)
    for m in _LOOSE.finditer(text):
        for s, e in _numbers(text, *m.span()) if "@" not in m[0] else [m.span()]:
            while at < len(taken) and taken[at][1] <= s:
                at += 1
            if not any(x < e and y > s for x, y in taken[at : at + 8]) and _SOME.search(text, s, e):
                out.append((s, e, -1))
    return sorted(out)


def _sampled(docs: DataFrame, sample: int, most_bytes: int) -> list[str]:
    """Texts with candidates, at most `sample` and most_bytes of them, the first by a hash of their id."""
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]"))
    some = some.withColumn("h", F.xxhash64("text"))
    first = some.select(F.xxhash64("doc_id").alias("k"), "doc_id", "h", F.octet_length("text").alias("size")).orderBy("k", "doc_id", "h").limit(sample).collect()
    left, taken = most_bytes, set()
    for r in first:
        if r["size"] <= left:
            left -= r["size"]
            taken.add((r["doc_id"], r["h"]))
    few = docs.sparkSession.createDataFrame(sorted(taken), "doc_id long, h long")
    return [r["text"] for r in some.join(F.broadcast(few), ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"]).select("text").collect()]


def fit(docs: DataFrame, *, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Field:
    """From at most `sample` documents and most_bytes of text, whose base spans are the labels."""
    return fitted(sorted(_sampled(docs, sample, most_bytes)))


def fitted(texts: list[str], steps: int = 400, ridge: float = 1e-3) -> Field:
    size = len(KINDS) + 1
    shapes, y, a, b, skip = [], [], [], [], []
    for t in texts:
        found = [(t[s:e], max(label, 0)) for s, e, label in _candidates(t, base_spans(t))]
        known = {k for c, label in found if label for k in _keys(c)}
        seen = [label > 0 or not known.intersection(_keys(c)) for c, label in found]
        place = np.cumsum(seen) - 1 + len(y)
        own_a, own_b, own_skip = _edges(*zip(*found, strict=True)) if found else _edges([], [])
        use = np.array(seen, bool)[own_a] & np.array(seen, bool)[own_b] if len(own_a) else np.zeros(0, bool)
        a.append(place[own_a[use]] if len(own_a) else own_a)
        b.append(place[own_b[use]] if len(own_b) else own_b)
        skip.append(own_skip[use] if len(own_a) else own_skip)
        shapes += [_shape(c) for (c, _), s in zip(found, seen, strict=True) if s]
        y += [label for (_, label), s in zip(found, seen, strict=True) if s]
    start = np.full((size, size), -REPEAT) + 2 * REPEAT * np.eye(size)
    unary, chain, same = np.zeros((FEATURES, size)), np.zeros((size, size)), start.copy()
    if not y:
        unary[0, 0] = 3.0
        return Field(unary, chain, same)
    rows = np.zeros((len(y), FEATURES))
    for i, on in enumerate(shapes):
        np.add.at(rows[i], on, 1)
    a, b, skip = (np.concatenate(x).astype(kind) for x, kind in ((a, int), (b, int), (skip, bool)))
    truth = np.eye(size)[y]
    # Of each node and kind of edge, how many neighbours of each label there are on its left and right.
    around = {}
    for kind in (False, True):
        e = skip == kind
        left, right = np.zeros((len(y), size)), np.zeros((len(y), size))
        np.add.at(left, b[e], truth[a[e]])
        np.add.at(right, a[e], truth[b[e]])
        around[kind] = left, right
    for _ in range(steps):
        z = rows @ unary
        for kind, w in ((False, chain), (True, same)):
            left, right = around[kind]
            z = z + left @ w + right @ w.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - truth) / len(y)
        slope = [around[kind][0].T @ g + g.T @ around[kind][1] for kind in (False, True)]
        unary -= 0.3 * (rows.T @ g + ridge * unary)
        chain -= 0.3 * (slope[0] + ridge * chain)
        same -= 0.3 * (slope[1] + ridge * (same - start))
    return Field(unary, chain, same)


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text."""
    if not _SOME.search(text):
        return [], []
    base = base_spans(text)
    found = _candidates(text, base)
    if not any(label < 0 for _, _, label in found):
        return base, base
    labels = field.labels([text[s:e] for s, e, _ in found], [label for _, _, label in found])
    more = [(KINDS[k - 1], s, e) for (s, e, label), k in zip(found, labels, strict=True) if label < 0 and k]
    return base, sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string"


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans) for each row of docs (doc_id, text, ...);
    counts are of base spans, spans are kind:start:end in code points, the end exclusive."""
    field = field or fit(docs)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            counts, base, spans = [], [], []
            for text in batch.column(1):
                found, more = all_spans(text.as_py() or "", field)
                counts.append([sum(k == kind for k, _, _ in found) for kind in KINDS])
                base.append(_joined(found))
                spans.append(_joined(more))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(base, pa.string()), pa.array(spans, pa.string())], names=[c.split()[0] for c in _RESULT.split(", ")])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(rows, _RESULT)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; of spans that overlap, the first names it."""
    out, done = [], 0
    for kind, s, e in spans:
        if s >= done:
            out += [text[done:s], f"<{kind.upper()}>"]
        done = max(done, e)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs, all columns, with the spans of `text` redacted; a null text stays null."""
    field = field or fit(docs)
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            texts = [None if t is None else redacted(t, all_spans(t, field)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(rows, docs.schema)
