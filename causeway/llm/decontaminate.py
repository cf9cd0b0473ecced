"""Benchmark items inside documents: MinHash containment search in size partitions, then exact containment.

Items are partitioned by the size of their shingle set (powers of two from `BLOCK`). Against a
partition of size s, documents are seen as windows of about s shingles that start at every block, so
that a short item inside a long document meets a window of its own size and the containment bound
becomes a bound on Jaccard similarity (0.2 at worst, 0.3 and more for most sizes). An item and a
window that agree in one of `FUNCTIONS` minima are a candidate; a candidate's containment is then
counted on the item's full set and the document's whole text, by the words themselves. At the threshold an item is missed
with probability below 1e-4 in the worst partition, a whole item with less than 1e-9.

Items travel to the documents: as many at a time as `ITEM_BYTES` allows, measured first. Where that takes several passes, each
is run and written before the driver reads the next one's items. Items of at most `FEW` shingles, too small to hash, are found
by each shingle itself. Documents are not shuffled and their length doesn't matter for memory beyond the text itself.

Defined cases: null or blank items and documents match nothing; an item of fewer than k words is one
shingle of that many words, searched among the document's shingles of the same width; rows that repeat
a document's or an item's id give rows of their own; very long documents are searched whole; a
containment of exactly the threshold counts; an empty table on either side gives an empty
result; extra columns are ignored by `contained` and kept by `clean`, which judges each row by its own text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm import text as T
from causeway.storage import stored

U64 = T.U64
BLOCK, FUNCTIONS, FEW = 8, 48, 4
ITEM_BYTES = 16 << 20
_MULTIPLIERS = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, FUNCTIONS, dtype=np.uint64) * U64(2) + U64(1)


class _Partition:
    """Items whose sets have at most `size` shingles of `width` words."""

    def __init__(self, blocks: int, members: list[int], sets: list[np.ndarray]) -> None:
        self.blocks = blocks  # that a window spans
        minima = np.stack([(sets[i][:, None] * _MULTIPLIERS).min(axis=0) for i in members])
        self.lists = []
        for j in range(FUNCTIONS):
            order = np.argsort(minima[:, j], kind="stable")
            values = minima[order, j]
            bits = np.zeros(1 << 16, bool)
            bits[(values & U64(0xFFFF)).astype(np.int64)] = True
            self.lists.append((values, np.array(members)[order], bits))

    def candidates(self, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """least: minima of each block, by function -> (first block of a window, item)."""
        span = 1
        while span < self.blocks:
            step = min(span, self.blocks - span)
            least = np.minimum(least, np.concatenate([least[:, step:], np.full((FUNCTIONS, min(step, least.shape[1])), ~U64(0))], axis=1)[:, : least.shape[1]])
            span += step
        at, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row, (values, members, bits) in zip(least, self.lists, strict=True):
            maybe = np.flatnonzero(bits[(row & U64(0xFFFF)).astype(np.int64)])
            lo, hi = np.searchsorted(values, row[maybe], "left"), np.searchsorted(values, row[maybe], "right")
            hit = np.flatnonzero(lo < hi)
            for a, b, c in zip(maybe[hit].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                at.append(np.full(c - b, a))
                items.append(members[b:c])
        return np.concatenate(at), np.concatenate(items)


class Index:
    """Items by the width of their shingles and by size."""

    def __init__(self, texts: list[str], k: int) -> None:
        data, at = T.strings(pa.array(texts, pa.large_string()))
        w = T.words(data, at, lower=True)
        counts = np.diff(w.first)
        self.words, self.width = [_listed(w, i) for i in range(len(texts))], np.minimum(counts, k)
        self.sets = [T.shingles(w.hash[w.of(i)], k) for i in range(len(texts))]
        members: dict[tuple[int, int], list[int]] = defaultdict(list)
        few: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, s in enumerate(self.sets):
            if 0 < len(s) <= FEW:
                few[min(k, int(counts[i]))] += [(int(x), i) for x in s]
            elif len(s):
                size = max(BLOCK, 1 << (len(s) - 1).bit_length())
                members[min(k, int(counts[i])), size // BLOCK + 1].append(i)
        self.few = {width: (np.array([x for x, _ in sorted(own)], U64), np.array([i for _, i in sorted(own)])) for width, own in few.items()}
        self.widths: dict[int, list[_Partition]] = {width: [] for width in self.few}
        for (width, blocks), own in sorted(members.items()):
            self.widths.setdefault(width, []).append(_Partition(blocks, own, self.sets))

    def search(self, w: T.Words, n: int, percent: int) -> Iterator[tuple[int, int, int]]:
        """(document, item, shared shingles) of n documents."""
        doc_of_word = np.repeat(np.arange(n), np.diff(w.first))
        for width, partitions in self.widths.items():
            g = T.grams(w.hash, width)
            if not len(g):
                continue
            own = np.flatnonzero(doc_of_word[: len(g)] == doc_of_word[width - 1 :])
            g, doc = g[own], doc_of_word[own]
            if not len(g):
                continue
            first = np.searchsorted(doc, np.arange(n + 1))
            pairs = []
            if width in self.few:
                known, owners = self.few[width]
                at = np.flatnonzero(np.isin(g, known))
                lo, hi = np.searchsorted(known, g[at], "left"), np.searchsorted(known, g[at], "right")
                of = np.repeat(doc[at], hi - lo)
                pairs.append(np.unique(of * len(self.sets) + owners[np.repeat(lo, hi - lo) + np.arange(len(of)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]))
            if partitions:
                block = np.flatnonzero((np.arange(len(g)) - first[doc]) % BLOCK == 0)
                least = np.stack([np.minimum.reduceat(g * m, block) for m in _MULTIPLIERS])
            for p in partitions:
                at, items = p.candidates(least)
                # A window may run on into the next documents of the chunk: they have windows of their own.
                pairs.append(np.unique(doc[block[at]] * len(self.sets) + items))
            for pair in np.unique(np.concatenate(pairs)).tolist():
                d, i = divmod(pair, len(self.sets))
                item = self.sets[i]
                shared = int(np.count_nonzero(np.isin(item, g[first[d] : first[d + 1]])))
                if 100 * shared >= percent * len(item):
                    wanted = set(_rows_of(self.words[i], width))
                    shared = len({x for x in _rows_of(_listed(w, d), width) if x in wanted})
                    if 100 * shared >= percent * len(wanted):
                        yield d, i, shared

    def size(self, i: int) -> int:
        """Distinct shingles of an item."""
        return len(set(_rows_of(self.words[i], int(self.width[i]))))


def _listed(w: T.Words, i: int) -> list[bytes]:
    own = w.of(i)
    return w.data[w.start[own.start] : w.end[own.stop - 1]].tobytes().split() if own.stop > own.start else []


def _rows_of(words: list[bytes], k: int) -> Iterator[tuple[bytes, ...]]:
    return zip(*(words[i:] for i in range(k)), strict=False)


def _found(items: list[tuple[int, str]], k: int, percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index([t for _, t in items], k)
        for batch in T.slices(batches):
            ids, out = batch.column(0), list(_hits(index, batch.column(1), percent))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array([d for d, _, _ in out], pa.int64())), pa.array([items[i][0] for _, i, _ in out], pa.int64()),
                    pa.array([s for _, _, s in out], pa.int64()), pa.array([index.size(i) for _, i, _ in out], pa.int64()),
                ],
                names=["doc_id", "item_id", "n_shared", "n_item"],
            )

    return rows


def _without(items: list[tuple[int, str]], k: int, percent: int, at: int):
    """The rows whose text, column `at`, contains none of the items."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index([t for _, t in items], k)
        for batch in T.slices(batches):
            keep = np.ones(len(batch), bool)
            keep[[d for d, _, _ in _hits(index, batch.column(at), percent)]] = False
            yield batch.filter(pa.array(keep))

    return rows


def _hits(index: Index, texts: pa.Array, percent: int) -> Iterator[tuple[int, int, int]]:
    data, at = T.strings(texts)
    for lo, hi in T.chunks(at):
        for d, i, shared in index.search(T.words(data, at[lo : hi + 1], lower=True), hi - lo, percent):
            yield lo + d, i, shared


def _passes(items: DataFrame) -> Iterator[tuple[int, list[tuple[int, str]]]]:
    """(how many passes there are, the items of one); the next one's are read when they are asked for."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    passes = max(1, -(-size // ITEM_BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    for i in range(passes):
        yield passes, [(r["item_id"], r["text"]) for r in items.filter(part == i).orderBy("item_id", "text").collect()]


def contained(docs: DataFrame, items: DataFrame, *, k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) where 100 * n_shared >= percent * n_item.

    docs: (doc_id, text, ...); items: (item_id, text, ...); n_item counts the item's distinct k-word shingles.
    """
    docs, found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), []
    for passes, own in _passes(items):
        hits = docs.mapInArrow(_found(own, k, percent), "doc_id long, item_id long, n_shared long, n_item long")
        found.append(hits if passes == 1 else stored(hits))
    return reduce(DataFrame.unionByName, found).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def clean(docs: DataFrame, items: DataFrame, *, k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs, all columns, that contain no item."""
    schema, at = docs.schema, docs.columns.index("text")
    for passes, own in _passes(items):
        docs = docs.mapInArrow(_without(own, k, percent, at), schema)
        docs = docs if passes == 1 else stored(docs)
    return docs
