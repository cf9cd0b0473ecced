"""Exact similarity join of documents as sets of n-grams, by a prefix tree.

All n-grams have one global order: rare ones first, as far as a table of `COUNTERS` counters knows (an n-gram counts in the one of its hash;
any order is right, this one keeps frequent n-grams out of what follows), then by hash. Two different sets that are near enough share one of the first n - least + 1
n-grams of either (its lead), and their sizes are of one band or of neighbouring ones. So documents with the same set are one class, classes meet in buckets of (n-gram of
the lead, band), and no pair that is linked fails to meet.

Sets that meet are joined by a prefix tree: ordered sets are stored in it, and what they have in common at their beginnings is one path.
A set walks the tree from the root, all branches of a level at once; a branch carries the overlap so far, which is
shared by all sets below it, and is cut when this and what is left on both sides is too little for any size below it. What reaches the end of a
stored set is a link. A tree holds the members of many cells (a set and those that it is held against): their number comes before their n-grams, so each cell is a branch of its own.

In a bucket of at most `FEW` members, each two may be near, unless their sizes and the places that the n-gram has in them leave too little: no n-gram before
the first that two sets share is shared. What is left of these pairs, each once, is joined on whole sets. Of a larger bucket
the first class is its centre; a class is joined with at most two of its larger buckets' centres, the first and the most frequent: on leads at
first, which are a tenth of the sets, then what is left on whole sets. Where all that leaves several components in a larger bucket, its members
are joined across components, block by block: by their leads, which says which of them may be near one of another component at all, then these on whole sets;
only links leave the task, one for each two components. So every pair of a bucket is in one component, was compared, or can't be near.

Before whole sets are asked for, pairs are tried by sketches, a bit for each n-gram or two: a bit says whether the number of n-grams that fall on it is odd, so where two sets' bits
differ, an n-gram is in one of them only; more of these than near sets may have, and the pair is not near. No pair that is near is lost by that.

Whole sets are made again of the texts that are asked for only, which a map of hashes of texts tells before they are cut into words.

An n-gram is known by 64 bits mixed from SipHash values of its words: that two of the n-grams of a pair of documents with a thousand n-grams each are alike
by chance has probability 1e-13.

Defined cases: null or blank texts have no n-grams and are linked with nothing; a text of fewer than k words is one n-gram; rows that repeat an id are judged each by its text,
and a component's id is the smallest of its rows' ids; a null id is never linked and keeps a null component; an empty table
gives an empty result; ties of the order are broken by the hash; very long texts are whole sets; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from causeway.llm import text as T
from causeway.llm.tables import bit_map, components, in_bit_map
from causeway.storage import stored

#: Counters of the order, in rows of so many.
COUNTERS, COUNTER_ROW = 1 << 19, 1 << 12
#: What a counter goes up to: 20 bits of a bucket's key, which follows the order.
MOST_COUNT = (1 << 20) - 1
#: Members of a bucket, and n-grams of theirs, that are joined at a time.
BLOCK, BLOCK_GRAMS = 2048, 1 << 20
#: Members of a bucket that are held against each other two by two.
FEW = 16
#: N-grams of the cells that one tree holds.
TREE_GRAMS = 1 << 17
#: Bits of the map of the texts whose sets are asked for.
MOST_BITS = 1 << 27
#: Depths at which a path of the tree is tried against the bound, and doubled from there.
FIRST_DEPTH = 16


def _sets(data: np.ndarray, at: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number, sorted set) of each text that has one."""
    for lo, hi in T.chunks(at):
        w = T.words(data, at[lo : hi + 1], lower=True)
        for i in range(lo, hi):
            items = T.shingles(w.hash[w.of(i - lo)], k)
            if len(items):
                yield i, items


def _key(items: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(items.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def ordered(items: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The set in the global order."""
    shift = T.U64(64 - (len(counts) - 1).bit_length())
    return items[np.lexsort((items, counts[(items >> shift).astype(np.int64)]))]


def bucket_keys(lead: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A number for each n-gram of a lead that follows the global order: its counter and the upper bits of its hash."""
    shift = T.U64(64 - (len(counts) - 1).bit_length())
    return (counts[(lead >> shift).astype(np.int64)] << 43) | (lead >> T.U64(21)).astype(np.int64)


def lead_size(n: int, percent: int) -> int:
    """How many n-grams of a set of n the lead has: an other set that shares none of these can't be near enough."""
    return n - -(-percent * n // 100) + 1


def bands(most: int, percent: int) -> np.ndarray:
    """Lower bounds of the bands of sizes: near enough sizes are in one band or in neighbouring ones."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2, -(-100 * out[-1] // percent)))
    return np.array(out)


def _counted(k: int, size: int, row: int):
    """(chunk, part, counts) of the task's n-grams."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, shift = np.zeros(size, np.int64), T.U64(64 - (size - 1).bit_length())
        for batch in T.slices(batches):
            data, at = T.strings(batch.column(0))
            for _, items in _sets(data, at, k):
                np.add.at(counts, (items >> shift).astype(np.int64), 1)
        part = TaskContext.get().partitionId() % 32
        for i in range(0, size, row):
            if counts[i : i + row].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // row]), pa.array([part]), pa.array([counts[i : i + row].tobytes()], pa.binary())], names=["chunk", "part", "counts"])

    return rows


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            own = np.frombuffer(counts, np.int64)
            sums[chunk] = sums[chunk] + own if chunk in sums else own
    for chunk, counts in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([0]), pa.array([counts.tobytes()], pa.binary())], names=["chunk", "part", "counts"])


def gram_counts(texts: DataFrame, k: int) -> np.ndarray:
    """COUNTERS counters of the n-grams of (text), added up in two steps over the cluster; none goes beyond MOST_COUNT."""
    schema = "chunk long, part long, counts binary"
    rows = texts.mapInArrow(_counted(k, COUNTERS, COUNTER_ROW), schema).repartition("chunk", "part").mapInArrow(_summed, schema).repartition("chunk").mapInArrow(_summed, schema)
    out = np.zeros(COUNTERS, np.int64)
    for r in rows.collect():  # COUNTERS / COUNTER_ROW rows
        out[r["chunk"] * COUNTER_ROW : (r["chunk"] + 1) * COUNTER_ROW] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(out, MOST_COUNT)


def sketch(items: np.ndarray) -> bytes:
    """Bits for a set, at most as many as it has n-grams (a power of 2, 64 at least): is the number of n-grams that fall on it odd?"""
    size = max(64, 1 << (len(items).bit_length() - 1))
    odd = np.bincount((items & T.U64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """How many n-grams are in one of two sets only, at least, by their sketches; the longer one is folded."""
    x, y = sorted((np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def may_be_near(n: int, m: int, a: bytes, b: bytes, percent: int) -> bool:
    """For sets of n and m n-grams with these sketches."""
    return (n + m - apart(a, b)) * (100 + percent) >= 2 * percent * (n + m)


_LEADS = "doc_id long, th long, ka long, kb long, n long, lead binary, sketch binary"


def _leads(k: int, percent: int, counts: Broadcast):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            data, at = T.strings(batch.column(2))
            n = len(batch)
            keys, sizes, leads, sketches = np.zeros((n, 2), np.int64), np.zeros(n, np.int64), [b""] * n, [b""] * n
            for i, items in _sets(data, at, k):
                keys[i], sizes[i] = _key(items), len(items)
                leads[i], sketches[i] = ordered(items, counts.value)[: lead_size(len(items), percent)].tobytes(), sketch(items)
            made = pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(sizes), pa.array(leads, pa.binary()), pa.array(sketches, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=[c.split()[0] for c in _LEADS.split(", ")])

    return rows


_BUCKETS = "c long, n long, place int, key long, band int"


def _buckets(percent: int, counts: Broadcast):
    """(c, n, place, key, band) of (c, n, lead): a bucket for each n-gram of the lead in the band of n, and in the one below where a near set may be there."""
    least = next((n for n in range(1, 100) if 100 * n >= percent * (n + 1)), 1 << 62)  # no other set is near a smaller one

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            c, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            leads = [np.frombuffer(x, np.uint64) if size >= least else np.zeros(0, np.uint64) for x, size in zip(batch.column(2).to_pylist(), n.tolist(), strict=True)]
            many = np.array([len(x) for x in leads], np.int64)
            lower = bands(int(n.max(initial=1)), percent)
            band = np.searchsorted(lower, n, "right")
            also = 100 * (lower[band - 1] - 1) >= percent * n
            for of, step in ((many > 0, 0), ((many > 0) & also, 1)):
                keys = bucket_keys(np.concatenate([np.zeros(0, np.uint64), *(leads[x] for x in np.flatnonzero(of))]), counts.value)
                own = many[of]
                place = np.arange(len(keys)) - np.repeat(np.cumsum(own) - own, own)
                out = np.repeat(c[of], own), np.repeat(n[of], own), place.astype(np.int32), keys, np.repeat(band[of] - step, own).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=[x.split()[0] for x in _BUCKETS.split(", ")])

    return rows


_MET = "a long, b long, n long, key long, band int"


def _met(percent: int, few: int):
    """Of bucket rows, sorted by (key, band): pairs (a, b) of classes that meet in a bucket of at most `few` and may be near by their sizes and the places of its n-gram,
    if it is the first that they share; the members (a, n, key, band) of larger buckets, without b. A pair counts in the lower of its bands only."""

    def out(a, b, n, key, band, pair: bool) -> pa.RecordBatch:
        none = np.full(len(a), not pair)
        arrays = [pa.array(a), pa.array(b, mask=none), pa.array(n), pa.array(key), pa.array(band.astype(np.int32))]
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _MET.split(", ")])

    def handled(c, n, place, key, band, large: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of whole buckets' rows; large: is the bucket one of the larger ones?"""
        if large.any():
            yield out(c[large], c[large], n[large], key[large], band[large], False)
            c, n, place, key, band = (x[~large] for x in (c, n, place, key, band))
        own_band = np.searchsorted(bands(int(n.max(initial=1)), percent), n, "right")
        found = [np.zeros((0, 2), np.int64)]
        for step in range(1, few):
            x = np.flatnonzero((key[:-step] == key[step:]) & (band[:-step] == band[step:]))
            if not len(x):
                break
            y = x + step
            most = np.minimum(n[x] - place[x], n[y] - place[y])
            near = (most * (100 + percent) >= percent * (n[x] + n[y])) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            near &= (c[x] != c[y]) & (np.minimum(own_band[x], own_band[y]) == band[x])
            x, y = x[near], y[near]
            found.append(np.stack([np.minimum(c[x], c[y]), np.maximum(c[x], c[y])], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        if len(pairs):
            none = np.zeros(len(pairs), np.int64)
            yield out(pairs[:, 0], pairs[:, 1], none, none, none, True)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, going_on = None, None  # rows of a bucket that may go on; the larger bucket that may
        for batch in T.slices(batches, 1 << 14):
            if not len(batch):
                continue
            own = [x.to_numpy() for x in batch.columns]
            own = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
            key, band = own[3], own[4]
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (band[1:] != band[:-1])))
            size = np.diff(np.append(first, len(key)))
            large = size > few
            large[0] |= going_on == (key[0], band[0])
            end = len(key) if large[-1] else first[-1]
            held, going_on = (None, (key[-1], band[-1])) if large[-1] else ([x[end:] for x in own], None)
            yield from handled(*(x[:end] for x in own), np.repeat(large, size)[:end])
        if held is not None:
            yield from handled(*held, np.zeros(len(held[0]), bool))

    return rows


def _by_sketches(percent: int):
    """Of (a, b, n, m, sketch_a, sketch_b) the pairs (a, b) that may be near."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            keep = [may_be_near(*x, percent) for x in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows


class Tree:
    """Ordered sets (arrays of codes, ascending) in a prefix tree whose paths are cut at FIRST_DEPTH, twice of it, and so on."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray) -> None:
        raw = [s.astype(">u4").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=raw.__getitem__)
        self.sets, parent, to, rep, end = sets, [-1], [0], [order[0] if order else 0], np.zeros(len(sets), np.int64)
        stack, before = [0], np.zeros(0, np.int64)
        for i in order:
            own = sets[i]
            m = min(len(own), len(before))
            differ = np.flatnonzero(own[:m] != before[:m])
            common = int(differ[0]) if len(differ) else m
            last = -1
            while to[stack[-1]] > common:
                last = stack.pop()
            if to[stack[-1]] < common:  # a branch within the path to `last`
                parent.append(stack[-1])
                to.append(common)
                rep.append(i)
                parent[last] = len(to) - 1
                stack.append(len(to) - 1)
            if len(own) > common:
                parent.append(stack[-1])
                to.append(len(own))
                rep.append(i)
                stack.append(len(to) - 1)
            end[i] = stack[-1]
            before = own
        for node in range(1, len(to)):  # paths are cut where the bound is tried
            depth = FIRST_DEPTH
            while depth < to[node]:
                if depth > to[parent[node]]:
                    parent.append(parent[node])
                    to.append(depth)
                    rep.append(rep[node])
                    parent[node] = len(to) - 1
                depth *= 2
        self.parent, self.to, self.rep, self.end = np.array(parent), np.array(to), np.array(rep), end
        self.start = self.to[np.maximum(self.parent, 0)]
        nodes = len(to)
        self.low, self.high = np.full(nodes, np.iinfo(np.int64).max), np.zeros(nodes, np.int64)
        self.first, self.last = np.full(nodes, np.iinfo(np.int64).max), np.full(nodes, np.iinfo(np.int64).min)
        for values, put, out in ((sizes, np.minimum, self.low), (sizes, np.maximum, self.high), (labels, np.minimum, self.first), (labels, np.maximum, self.last)):
            put.at(out, end, values)
        for node in np.argsort(-self.to, kind="stable").tolist():  # from the leaves up
            up = parent[node]
            if up >= 0:
                self.low[up], self.high[up] = min(self.low[up], self.low[node]), max(self.high[up], self.high[node])
                self.first[up], self.last[up] = min(self.first[up], self.first[node]), max(self.last[up], self.last[node])
        by = np.argsort(self.parent, kind="stable")
        self.children, bounds = by, np.searchsorted(self.parent[by], np.arange(nodes + 1))
        self.child_first, self.child_end = bounds[:-1], bounds[1:]
        self.flat_first = np.cumsum([0, *(len(s) for s in sets)])
        self.flat = np.concatenate([np.zeros(0, np.int64), *sets]).astype(np.int64)
        by = np.argsort(end, kind="stable")
        self.ending, bounds = by, np.searchsorted(end[by], np.arange(nodes + 1))
        self.end_first, self.end_end = bounds[:-1], bounds[1:]

    def branches(self) -> dict[int, int]:
        """The nodes below the root by their first codes."""
        nodes = self.children[self.child_first[0] : self.child_end[0]]
        return dict(zip(self.flat[self.flat_first[self.rep[nodes]]].tolist(), nodes.tolist(), strict=True))

    def near(self, own: np.ndarray, codes: np.ndarray, n: int, label: int, percent: int, branch: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Stored sets that a set of n n-grams may be near to, and their overlap so far. codes: those that are known of it, the first in the order;
        own: for each code whether it is one of these (or comes after them, and may be); branch: the only node below the root that is looked at."""
        hits, overlaps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        front, carried = np.zeros(1, np.int64), np.zeros(1, np.int64)
        hidden = n - len(codes)
        while len(front):
            many = self.end_end[front] - self.end_first[front]
            if many.any():
                at = np.repeat(self.end_first[front] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                hits.append(self.ending[at])
                overlaps.append(np.repeat(carried, many))
            many = self.child_end[front] - self.child_first[front]
            next_ = self.children[np.repeat(self.child_first[front] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            carried = np.repeat(carried, many)
            if branch is not None:
                next_, carried, branch = np.array([branch]), np.zeros(1, np.int64), None
            other = (self.first[next_] != label) | (self.last[next_] != label)
            next_, carried = next_[other], carried[other]
            if not len(next_):
                break
            size = self.to[next_] - self.start[next_]
            begin = np.cumsum(size) - size
            place = self.flat_first[self.rep[next_]] + self.start[next_]
            tokens = self.flat[np.repeat(place - begin, size) + np.arange(size.sum())]
            carried = carried + np.add.reduceat(own[tokens], begin, dtype=np.int64)
            left = len(codes) - np.searchsorted(codes, tokens[begin + size - 1], "right") + hidden
            to = self.to[next_]
            most = np.clip(to + left, self.low[next_], self.high[next_])  # the size that leaves most room
            keep = (carried + np.minimum(left, most - to)) * (100 + percent) >= percent * (n + most)
            front, carried = next_[keep], carried[keep]
        return np.concatenate(hits), np.concatenate(overlaps)


def _coded(sets: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Codes that follow the global order, and how many there are."""
    all_ = ordered(np.unique(np.concatenate(sets)), counts)
    by = np.argsort(all_)
    bounds = np.cumsum([len(s) for s in sets])[:-1]
    return [np.sort(x) for x in np.split(by[np.searchsorted(all_[by], np.concatenate(sets))], bounds)], len(all_)


def _own(codes: np.ndarray, total: int, n: int) -> np.ndarray:
    own = np.zeros(total, bool)
    own[codes] = True
    if len(codes) < n:  # the set goes on with n-grams later in the order
        own[codes[-1] :] = True
    return own


def _with_centres(percent: int, counts: Broadcast, whole: bool):
    """Pairs (a, b) of each cell's centre and its members (a, part, c, n, items, centre) that may be near enough; on whole sets, those that are.

    A cell's number is an n-gram more of each of its sets, the first in the order; with it, near sets are near all the more."""

    def rows(table: pa.Table) -> pa.Table:
        c, n, a, part = (table.column(x).to_numpy() for x in ("c", "n", "a", "part"))
        centre = table.column("centre").to_numpy(zero_copy_only=False)
        codes, total = _coded([np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()], counts.value)
        numbers, cell = np.unique(np.stack([a, part], 1), axis=0, return_inverse=True)
        cells, cell = len(numbers), cell.reshape(-1)
        codes = [np.append(i, x + cells) for i, x in zip(cell, codes, strict=True)]
        members = np.flatnonzero(~centre)
        tree = Tree([codes[i] for i in members], n[members] + 1, np.zeros(len(members), np.int64))
        branches, out = tree.branches(), [np.zeros((0, 2), np.int64)]
        for x in np.flatnonzero(centre).tolist():
            size = int(n[x])
            hit, overlap = tree.near(_own(codes[x], total + cells, size + 1), codes[x], size + 1, -1, percent, branches[int(cell[x])])
            b = members[hit]
            if whole:
                b = b[(overlap - 1) * (100 + percent) >= percent * (size + n[b])]
            out.append(np.stack([np.full(len(b), c[x]), c[b]], 1))
        found = np.concatenate(out)
        return pa.table({"a": found[:, 0], "b": found[:, 1]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return rows


def _open_cell(key, table: pa.Table, counts: np.ndarray):
    """A cell (c, n, component, part, items; key, band, i, j): (c, n, components as numbers, how many, codes, how many, members of j, members of i that are held against them)."""
    c, n, part, label = (table.column(x).to_numpy() for x in ("c", "n", "part", "component"))
    codes, total = _coded([np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()], counts)
    i, j = key[2].as_py(), key[3].as_py()
    values, label, many = np.unique(label, return_inverse=True, return_counts=True)
    members, probes = np.flatnonzero(part == j), np.flatnonzero(part == i)
    if i == j:  # of each pair one is outside the largest component
        probes = probes[label[probes] != many.argmax()]
    return c, n, label, len(values), codes, total, members, probes


def _hopeful(percent: int, counts: Broadcast):
    """(key, band, c) of a cell's members that may be near a member of another component, by their leads and sketches. A pair counts in one bucket only: that of the first n-gram
    that both leads have, in the lower of their bands."""

    def rows(key, table):
        c, n, label, _, codes, total, members, probes = _open_cell(key, table, counts.value)
        own, band = key[0].as_py(), key[1].as_py()
        keys = [np.sort(bucket_keys(np.frombuffer(x, np.uint64), counts.value)) for x in table.column("items").to_pylist()]
        before = [k[: np.searchsorted(k, own)] for k in keys]  # what comes earlier in the order
        bands_of = np.searchsorted(bands(int(n.max(initial=1)), percent), n, "right")
        sketches, some = table.column("sketch").to_pylist(), np.zeros(len(c), bool)
        if len(members) and len(probes):
            tree = Tree([codes[x] for x in members], n[members], label[members])
            for x in probes.tolist():
                y = members[tree.near(_own(codes[x], total, int(n[x])), codes[x], int(n[x]), int(label[x]), percent)[0]]
                y = y[(label[y] != label[x]) & (np.minimum(bands_of[y], bands_of[x]) == band)]
                if len(y):
                    sizes = np.array([len(before[i]) for i in y])
                    earlier = np.isin(np.concatenate([before[i] for i in y]), before[x])
                    y = y[np.bincount(np.repeat(np.arange(len(y)), sizes), earlier, len(y)) == 0]
                    y = y[[may_be_near(int(n[x]), int(n[i]), sketches[x], sketches[i], percent) for i in y.tolist()]] if len(y) else y
                    some[y] = True
                    some[x] |= len(y) > 0
        found = np.unique(c[some])
        return pa.table({"key": pa.array(np.full(len(found), own, np.int64)), "band": pa.array(np.full(len(found), band, np.int32)), "c": pa.array(found)})

    return rows


def _across(percent: int, counts: Broadcast):
    """Links (a, b) between different components of one cell, by whole sets: of those between two components one, as it makes them the same."""

    def rows(key, table):
        c, n, label, values, codes, total, members, probes = _open_cell(key, table, counts.value)
        a, b = [], []
        if len(members) and len(probes):
            tree = Tree([codes[x] for x in members], n[members], label[members])
            joined = np.arange(values)
            for x in probes.tolist():
                hit, overlap = tree.near(_own(codes[x], total, int(n[x])), codes[x], int(n[x]), int(label[x]), percent)
                y = members[hit]
                near = y[(overlap * (100 + percent) >= percent * (n[x] + n[y])) & (joined[label[y]] != joined[label[x]])]
                for z in near[np.unique(joined[label[near]], return_index=True)[1]].tolist():
                    a.append(min(c[x], c[z]))
                    b.append(max(c[x], c[z]))
                    joined[joined == joined[label[z]]] = joined[label[x]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows


def _wanted(k: int, bits: Broadcast):
    """(ka, kb, items) of the texts (th, text) that may be wanted by their hash, each set once in a task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in T.slices(batches):
            wanted = in_bit_map(bits.value, batch.column(0).to_numpy())
            data, at = T.strings(batch.column(1).filter(pa.array(wanted)))
            out = []
            for _, items in _sets(data, at, k):
                key = _key(items)
                if key not in seen:
                    seen.add(key)
                    out.append((*key, items.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], names=["ka", "kb", "items"]
            )

    return rows


def _parts(many: Column, grams: Column) -> Column:
    return F.greatest(F.ceil(many / BLOCK), F.ceil(grams / BLOCK_GRAMS)).cast("int").alias("parts")


def _cells(pairs: DataFrame, sets: DataFrame, share: float) -> GroupedData:
    """Members (a, part, c, centre, n, items) of the cells of pairs (a, b), some cells at a time: a centre with a block of what it is joined with.
    Sets hold `share` of n."""
    sized = pairs.join(sets.select(F.col("c").alias("b"), "n"), "b")
    parts = stored(sized.groupBy("a").agg(_parts(F.count("*"), F.sum("n")), F.sum("n").alias("grams")))
    grams = parts.agg(F.sum("grams")).first()[0] or 0
    dealt = pairs.join(parts.select("a", "parts"), "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.col("b").alias("c"), F.lit(False).alias("centre"))
    own = dealt.select("a", "part").distinct().select("a", "part", F.col("a").alias("c"), F.lit(True).alias("centre"))
    trees = F.pmod(F.xxhash64("a", "part"), F.lit(1 + int(grams * share) // TREE_GRAMS)).alias("tree")
    return dealt.unionByName(own).join(sets, "c").groupBy(trees)


def linked_documents(docs: DataFrame, *, k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text, ...).

    Documents are linked where 100 * |intersection| >= percent * |union| of their k-word n-grams; component_id is the smallest id that
    links lead to.
    """
    spark, lead_share = docs.sparkSession, 1 - percent / 100
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    counts = spark.sparkContext.broadcast(gram_counts(docs.select("text"), k))
    rows = stored(docs.mapInArrow(_leads(k, percent, counts), _LEADS).withColumn("r", F.monotonically_increasing_id()))
    live = rows.filter("n > 0 AND doc_id IS NOT NULL")
    # c, the number of one of its rows, names a class.
    classes = stored(live.groupBy("ka", "kb").agg(F.min("doc_id").alias("least_id"), F.min("r").alias("c")))

    def leads_of(wanted: DataFrame) -> DataFrame:
        """(c, n, items, sketch) of the classes (c), by their leads."""
        return live.join(wanted.select(F.col("c").alias("r")), "r", "left_semi").select(F.col("r").alias("c"), "n", F.col("lead").alias("items"), "sketch")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(c, n, items) of the classes (c)."""
        keys = stored(live.select("th", "ka", "kb", F.col("r").alias("c")).join(wanted, "c", "left_semi"))
        bits = spark.sparkContext.broadcast(bit_map(keys.select(F.col("th").alias("h")), MOST_BITS))
        once = docs.select("th", "text").mapInArrow(_wanted(k, bits), "ka long, kb long, items binary").join(keys, ["ka", "kb"])
        return stored(once.groupBy("c").agg(F.first("items").alias("items")).select("c", (F.octet_length("items") / 8).cast("long").alias("n"), "items"))

    bucket = ["key", "band"]
    in_bucket = leads_of(classes).drop("sketch").mapInArrow(_buckets(percent, counts), _BUCKETS)
    met = stored(in_bucket.repartition(*bucket).sortWithinPartitions(*bucket).mapInArrow(_met(percent, FEW), _MET))
    near = met.filter("b IS NOT NULL").select("a", "b")
    crowded = met.filter("b IS NULL").select(F.col("a").alias("c"), "n", *bucket)
    any_crowded = crowded.limit(1).count() > 0
    if any_crowded:
        leads = stored(leads_of(crowded.select("c").distinct()))
        votes = crowded.join(crowded.groupBy(*bucket).agg(F.min("c").alias("a")), bucket).filter("c > a").groupBy("c", "a").agg(F.count("*").alias("votes"))
        chosen = votes.groupBy("c").agg(F.min("a").alias("low"), F.max_by("a", F.struct("votes", -F.col("a"))).alias("most"))
        pairs = stored(chosen.select(F.explode(F.array_distinct(F.array("low", "most"))).alias("a"), F.col("c").alias("b")))
        near = near.unionByName(_cells(pairs, leads.drop("sketch"), lead_share).applyInArrow(_with_centres(percent, counts, False), "a long, b long"))
    of_a = live.select(F.col("r").alias("a"), "n", F.col("sketch").alias("sketch_a"))
    of_b = live.select(F.col("r").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("sketch_b"))
    sketched = stored(near.distinct()).join(of_a, "a").join(of_b, "b").select("a", "b", "n", "m", "sketch_a", "sketch_b")
    near = stored(sketched.mapInArrow(_by_sketches(percent), "a long, b long"))
    ends = near.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    links = stored(_cells(near, sets_of(ends), 1.0).applyInArrow(_with_centres(percent, counts, True), "a long, b long"))
    found = components(links)

    def open_cells(members: DataFrame, sets: DataFrame, share: float) -> GroupedData:
        """The cells of open buckets (key, band, c, n, component); sets hold `share` of n."""
        parts = members.groupBy(*bucket).agg(_parts(F.count("*"), F.sum("n") * share))
        dealt = members.drop("n").join(parts, bucket).withColumn("part", F.pmod(F.xxhash64("c"), "parts").cast("int"))
        pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return pairs.select(*bucket, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "c", "component", "part").join(sets, "c").groupBy(*bucket, "i", "j")

    if any_crowded:
        # Larger buckets whose members are in several components; of buckets with the same members the first in the order.
        placed = stored(crowded.join(found, F.col("c") == F.col("id"), "left").select(*bucket, "c", "n", F.coalesce("component_id", "c").alias("component")))
        same = F.count("*").alias("many"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y")
        mixed = placed.groupBy(*bucket).agg(F.min("component").alias("low"), F.max("component").alias("high"), *same).filter("low < high")
        open_ = stored(placed.join(mixed.groupBy("band", "many", "x", "y").agg(F.min("key").alias("key")).select(*bucket), bucket))
        hopeful = stored(open_cells(open_, leads, lead_share).applyInArrow(_hopeful(percent, counts), "key long, band int, c long").distinct())
        if hopeful.limit(1).count():
            members = stored(open_.join(hopeful, [*bucket, "c"], "left_semi"))
            cells = open_cells(members, sets_of(members.select("c").distinct()), 1.0)
            found = components(links.unionByName(cells.applyInArrow(_across(percent, counts), "a long, b long").distinct()))
    placed = classes.join(found, F.col("c") == F.col("id"), "left").select("ka", "kb", "least_id", F.coalesce("component_id", "c").alias("c"))
    least = placed.groupBy("c").agg(F.min("least_id").alias("component_id"))
    out = rows.join(placed.join(least, "c").select("ka", "kb", "component_id"), ["ka", "kb"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
