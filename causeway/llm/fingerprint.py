"""Homomorphic multiset fingerprints of documents.

A paragraph (non-blank line) hashes to a wide vector, and a document's fingerprint is the sum of its
paragraphs' vectors: the order of paragraphs doesn't matter, and adding or taking away a paragraph adds
or subtracts its vector. The first `EXACT` lanes are the 512 bits of the BLAKE2b digest of the whole paragraph, summed
modulo 2**64 each; they decide equality. The other `ALIKE` lanes are summed modulo 2**32 and count the
paragraph's three-word shingles with signs, each at a hashed lane; as vectors of signed numbers (no text that Spark can
hold has enough shingles to wrap one) their cosine estimates how much two documents share.

Edited texts need the next document in descending id. Documents are dealt into ranges of ids and, within an id, of hashes of texts, whose first keys are
picked from a sample (SAMPLED * MOST_RANGES keys at most come to the driver); the first rows of a range go to the end of the range before it as well, where they only serve as the last row's
next, so texts are shuffled once and rows stream in order through each task. Rows without an id are dealt by a hash of their text.

Defined cases: a null text is empty, an empty or blank text has the zero fingerprint, two zero
fingerprints are alike (1) and a zero and another are not (0); a null id comes after all others; rows
that repeat an id (or have none) follow each other in an order that their texts fix; a single row is its own next; an
empty table stays empty; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm import text as T

U64 = T.U64
EXACT, ALIKE, SHINGLE = 8, 128, 3
#: Bytes of texts in a range, sampled keys for each, and ranges in all; beyond these, ranges are larger (rows stream through a task, so it holds no more).
RANGE_BYTES, SAMPLED, MOST_RANGES = 64 << 20, 8, 1 << 17


class Fingerprints:
    """Fingerprints of several texts, as rows of two arrays."""

    def __init__(self, exact: np.ndarray, alike: np.ndarray) -> None:
        self.exact, self.alike = exact, alike

    def text(self, i: int) -> str:
        return self.exact[i].astype("<u8").tobytes().hex() + self.alike[i].astype("<i4").tobytes().hex()

    def likeness(self, i: int, other: Fingerprints, j: int) -> float:
        if np.array_equal(self.exact[i], other.exact[j]):
            return 1.0
        a, b = self.alike[i].astype(float), other.alike[j].astype(float)
        size = np.sqrt((a @ a) * (b @ b))
        return float(min(1.0, max(0.0, (a @ b) / size))) if size else 0.0


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> Fingerprints:
    n = len(offsets) - 1
    exact, alike = np.zeros((n, EXACT), U64), np.zeros((n, ALIKE), np.int32)
    for lo, hi in T.chunks(offsets):
        w = T.words(data, offsets[lo : hi + 1])
        if not len(w.hash):
            continue
        text = np.repeat(np.arange(hi - lo), np.diff(w.first))
        line = np.searchsorted(np.flatnonzero(w.data == 10), w.start)
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(line))
        raw = w.data.tobytes()
        whole = b"".join([hashlib.blake2b(raw[a:b]).digest() for a, b in zip(w.start[start].tolist(), w.end[end - 1].tolist(), strict=True)])
        sums = np.zeros((hi - lo, EXACT), U64)
        owners, first = np.unique(text[start], return_index=True)
        sums[owners] = np.add.reduceat(np.frombuffer(whole, "<u8").reshape(-1, EXACT), first, axis=0)
        exact[lo:hi] = sums
        line = np.cumsum(new)
        of, items = [], []
        for k in range(1, SHINGLE + 1):
            g = T.grams(w.hash, k)
            if k < SHINGLE:
                own = start[end - start == k]
            else:
                own = np.flatnonzero(line[: len(g)] == line[k - 1 :])
            of.append(text[own])
            items.append(g[own])
        of, items = np.concatenate(of), np.concatenate(items)
        at = of * ALIKE + (items & U64(ALIKE - 1)).astype(np.int64)
        sign = ((items >> U64(20)) & U64(1)).astype(float) * 2 - 1
        counts = np.bincount(at, weights=sign, minlength=(hi - lo) * ALIKE)
        alike[lo:hi] = counts.astype(np.int64).astype(np.int32).reshape(hi - lo, ALIKE)
    return Fingerprints(exact, alike)


def of_texts(texts: list[str]) -> Fingerprints:
    return fingerprints(*T.strings(pa.array(texts, pa.large_string())))


def _edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _RESULT.split(", ")]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, copy, doc_id, text) in order; those with copy > 0 only follow."""
    held: list[tuple] = []
    for batch in T.slices(batches):
        rows = held + list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        if rows:
            held = rows[-1:]
            yield _results(rows)
    if held:
        yield _results([*held, (None, 1, None, "")])


def _results(rows: list[tuple]) -> pa.RecordBatch:
    """For all rows but the last: each with the one after it, or itself where that is of another bucket."""
    texts = [t or "" for _, _, _, t in rows]
    after = [i + 1 if rows[i + 1][0] == rows[i][0] else i for i in range(len(rows) - 1)]
    own = [i for i in range(len(rows) - 1) if not rows[i][1]]
    edited = [_edited(texts[i], texts[after[i]]) for i in own]
    plain, changed = of_texts(texts), of_texts(edited)
    columns = [
        [rows[i][2] for i in own], [len(texts[i]) for i in own], [hashlib.sha256(e.encode()).hexdigest() for e in edited], [plain.text(i) for i in own],
        [changed.text(k) for k in range(len(own))], [plain.likeness(i, changed, k) for k, i in enumerate(own)], [plain.likeness(i, plain, after[i]) for i in own],
    ]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)


def _keys(place: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(place, h) as one value each, in the same order."""
    both = np.stack([place, h], axis=1).astype(np.int64).view(U64) ^ U64(1 << 63)
    return np.ascontiguousarray(both.astype(">u8")).view("S16").ravel()


def _ranges(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The first keys (place, h) of the ranges, of rows with an id (its complement) and of those without (the hash of the text)."""
    spark = docs.sparkSession
    least = F.min(F.struct("place", "h")).alias("least")
    kinds = {r["without"]: r for r in docs.groupBy("without").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"), least).collect()}
    size = sum(r["size"] or 0 for r in kinds.values())
    ranges = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))
    rows = sum(r["n"] for r in kinds.values())
    found = []
    for kind in (0, 1):
        firsts = np.zeros(0, "S16")
        if kind in kinds:
            own = -(-ranges * kinds[kind]["n"] // rows)
            every = max(1, kinds[kind]["n"] // (own * SAMPLED))
            some = docs.filter((F.col("without") == kind) & (F.pmod(F.xxhash64("place", "h"), F.lit(every)) == 0)).select("place", "h").distinct().toArrow()
            first = kinds[kind]["least"]
            keys = np.unique(np.append(_keys(some.column("place").to_numpy(), some.column("h").to_numpy()), _keys(np.array([first["place"]]), np.array([first["h"]]))))
            firsts = np.unique(keys[np.arange(own) * len(keys) // own])
        found.append(firsts)
    return found[0], found[1]


def with_edits(docs: DataFrame) -> DataFrame:
    """See _RESULT, for each row of docs (doc_id, text, ...): the fingerprint of its text and of its edited
    text (the last third replaced by as much of the next document's beginning), and likenesses of its own to
    the edited text's and to the next document's."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    docs = docs.select("doc_id", "text", F.col("doc_id").isNull().cast("int").alias("without"), F.coalesce(F.bitwise_not("doc_id"), hashed).alias("place"), hashed.alias("h"))
    firsts = _ranges(docs)
    n = max(1, len(firsts[0]) + len(firsts[1]))

    @F.pandas_udf("long")
    def spot(without: pd.Series, place: pd.Series, h: pd.Series) -> pd.Series:
        """Twice the range of a row, and one more if it is a first of it."""
        out = np.zeros(len(place), np.int64)
        for kind in (0, 1):
            own = np.flatnonzero(without.to_numpy() == kind)
            values = _keys(place.to_numpy()[own], h.to_numpy()[own])
            at = np.searchsorted(firsts[kind], values, "right") - 1
            out[own] = 2 * (at + kind * len(firsts[0])) + (firsts[kind][at] == values)
        return pd.Series(out)

    at = F.col("spot").bitwiseAND(F.lit(1)) == 1
    own, before = F.shiftright("spot", 1), F.pmod(F.shiftright("spot", 1) - 1, F.lit(n))
    place = lambda b, copy: F.struct(b.cast("int").alias("bucket"), F.lit(copy).alias("copy"))
    dealt = docs.withColumn("spot", spot("without", "place", "h")).select(F.inline(F.array_compact(F.array(place(own, 0), F.when(at, place(before, 1))))), "doc_id", "text", "without", "place", "h")
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "copy", "without", "place", "h", "text")
    return ordered.select("bucket", "copy", "doc_id", "text").mapInArrow(_rows, _RESULT)
