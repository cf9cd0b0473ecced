"""Passages that stand in several documents: sparse suffix arrays, and recompression.

Both work on documents dealt into groups of bounded bytes by their id, and on windows: `width` consecutive words of one document.

`suffix_repeats` keeps a suffix of a document where its k-word prefix hashes smallest among those that some window holds, so every
window holds a kept suffix that its own words pick. Kept suffixes are range-partitioned and sorted by content (their
first k words), with the document's id behind it, so that equal ones can be split; neighbours are compared in order and over the bounds of the
partitions. Matches of suffixes that another document shares are then extended: first to the right, over the next `REACH` kept
suffixes, which finds long passages; then word by word to the left and right, by each window around a shared suffix. Windows inside a long passage
are left to the document of the smallest id that has it, whose windows the others' stand for. Spans of windows that another document has are the result.

`substring_repeats` recompresses documents: in each round runs of equal names and then pairs of names become names, by
rules that look at the names only, so equal passages get equal names inside, wherever they stand. In Spark rounds (at the `ROUNDS` given)
the names that stand for at least a window are compared over all documents, by the digest of their words; where a
round finds a name nowhere else, no later round looks at what it is part of. A name that a document of a smaller id has settles every window in it.
Windows that no such name settles are held against others by their inner names of the first rounds (three in a row, the
smallest such), and those under a shared one by all their words.

Names and windows are compared by 64 bits of BLAKE2b over their words and 64 of another hash. All exchanges are plain
rows, a name or window once for each group that has it, so what a third of all documents share comes once for each group, and
no task gets more for it.

Defined cases: null and blank texts have no words; texts shorter than a window have none; rows that repeat an id are one
document each way (a window of the same id is not "smaller"); a null id counts as larger than every id; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm import text as T
from causeway.storage import stored

U64 = T.U64
#: Names in a row that make an anchor of a window, and the rounds whose names these are.
JOINED, INNER = 3, 2
#: Rounds of recompression after which names are compared over all documents (a round leaves about three quarters of the names).
ROUNDS = (10, 16)
#: Kept suffixes that a match is extended over at first.
REACH = 6
GROUP_BYTES, LEAST_GROUPS = 32 << 20, 64
_LAST = np.iinfo(np.int64).max


def _least(x: np.ndarray, span: int, of=np.minimum) -> np.ndarray:
    """The least of each `span` values in a row."""
    done = 1
    while done < span:
        step = min(done, span - done)
        x = of(x[: len(x) - step], x[step:])
        done += step
    return x


def kept_suffixes(hashes: np.ndarray, ok: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of kept suffixes, the kept prefix's hash of each window in `ok`)."""
    if len(hashes) < width:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    grams = T.grams(hashes, k)
    least = _least(grams, width - k + 1)
    own = np.zeros(len(least), U64)
    own[ok] = least[ok]
    # A place is kept if one of the windows around it has its hash as the least.
    span = width - k + 1
    padded = np.concatenate([np.zeros(span - 1, U64), own, np.zeros(max(0, len(grams) - len(own)), U64)])
    most = _least(padded, span, np.maximum)[: len(grams)]
    return np.flatnonzero((most == grams) & (grams > 0)), least[ok]


def levels(hashes: np.ndarray, doc: np.ndarray, rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(names, first word of each, for each name of the level before the one that covers it) after runs, and after each round of pairs."""
    n = len(hashes)
    cut = np.ones(n, bool)
    cut[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(cut)
    length = np.diff(np.append(start, n))
    name = hashes[start]
    runs = np.flatnonzero(length > 1)
    name[runs] = T.mix(T.mix(name[runs] + U64(0xA24BAED4963EE407)) + length[runs].astype(U64))
    yield name, start, np.cumsum(cut) - 1
    for level in range(rounds):
        # Pairs of a name of class 0 with one of class 1 to its right.
        kind = (name >> U64(20 + level)) & U64(1) == 1
        owner = doc[start]
        join = np.zeros(len(name), bool)
        np.logical_and(kind[1:] & ~kind[:-1], owner[1:] == owner[:-1], out=join[:-1])
        keep = np.ones(len(name), bool)
        keep[1:] = ~join[:-1]
        two = np.flatnonzero(join)
        name = name.copy()
        name[two] = T.mix(T.mix(name[two] + U64(0x9FB21C651E98DF25)) + name[two + 1])
        name, start = name[keep], start[keep]
        yield name, start, np.cumsum(keep) - 1


def inner_names(hashes: np.ndarray, doc: np.ndarray, width: int, rounds: int = INNER) -> np.ndarray:
    """For the window at each word, the smallest hash of JOINED names in a row inside it, after the last round that leaves it so many.

    A run at an end of the window may go on outside, the first name may be the right half of a pair
    and the last the left half; what such ends touch doesn't count as inside. A window that is left
    fewer names, as in one long run, is its own anchor. Windows that run over into another document are not to be looked at.
    """
    n = len(hashes)
    m = n - width + 1
    out = np.zeros(n, U64)
    if m <= 0:
        return out
    made, before = [], None
    for name, start, of in levels(hashes, doc, rounds):
        if before is None:
            # For a window from word p to before word q: its names are those from left[p] to before right[q].
            left, right = of + 1, np.append(0, of)
        else:
            kind = (before >> U64(20 + len(made) - 1)) & U64(1) == 1
            of = np.append(of, len(name))
            # A first name of class 1 and a last one of class 0 may be half of a pair that reaches outside.
            first, last = of + np.append(kind, False), of.copy()
            last[1:] = np.where(kind, of[:-1] + 1, of[:-1])
            left, right = first[left], last[right]
        made.append((left, right, name))
        before = name
    todo = np.arange(m)
    for left, right, name in reversed(made):
        a, b = left[todo], right[todo + width] - (JOINED - 1)
        live = a < b
        a, b, own = a[live], b[live], todo[live]
        if not len(own):
            continue
        row = name
        for k in range(1, JOINED):  # of names in a row, as short names alone are common
            row = T.mix(T.mix(row + U64(0x9FB21C651E98DF25)) + np.append(name[k:], np.zeros(min(k, len(name)), U64)))
        if len(own) * 8 < len(name):  # few windows are left: each looks at its own names
            lowest = row[a]
            for k in range(1, int((b - a).max(initial=1))):
                lowest = np.minimum(lowest, row[np.minimum(a + k, b - 1)])
            out[own] = lowest
            todo = todo[~live]
            continue
        least, power = [row], np.frexp((b - a).astype(np.float32))[1] - 1
        while 2 ** len(least) <= width:
            half, last = 2 ** (len(least) - 1), least[-1]
            least.append(np.append(np.minimum(last[:-half], last[half:]), last[-half:]) if len(last) > half else last)
        flat, base = np.concatenate(least), power.astype(np.int64) * len(name)
        out[own] = np.minimum(flat[base + a], flat[base + b - (1 << power)])
        todo = todo[~live]
        if not len(todo):
            break
    if len(todo):
        out[todo] = T.grams(hashes, width)[todo]
    return out


def _groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text, g) with documents dealt by id into groups; their number follows the bytes."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(LEAST_GROUPS, -(-size // GROUP_BYTES))
    return docs.withColumn("g", F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(n)).cast("int"))


class _Chunk:
    """Words of some rows, the row of each word, and where windows start."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lo: int, hi: int, ids: np.ndarray, width: int) -> None:
        self.lo, self.hi, self.ids, self.width = lo, hi, ids, width
        self.w = T.words(data, at[lo : hi + 1])
        self.row = np.repeat(np.arange(lo, hi), np.diff(self.w.first))
        n = len(self.row) - width + 1
        self.ok = np.flatnonzero(self.row[:n] == self.row[width - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def docs(self, starts: np.ndarray) -> np.ndarray:
        return self.ids[self.row[starts]]


def _chunks(ids: pa.Array, texts: pa.Array, width: int) -> Iterator[_Chunk]:
    ids, (data, at) = T.ids(ids), T.strings(texts)
    for lo, hi in T.chunks(at):
        yield _Chunk(data, at, lo, hi, ids, width)


_NAME = np.dtype([("a", "<u8"), ("b", "<u8")])


def _named(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests).view(_NAME).reshape(-1)


def _bounds(names: list[np.ndarray], docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names, and the smallest and largest document of each."""
    name, doc = np.concatenate([np.zeros(0, _NAME), *names]), np.concatenate([np.zeros(0, np.int64), *docs])
    order = np.lexsort((doc, name["b"], name["a"]))
    name, doc = name[order], doc[order]
    first = np.ones(len(name), bool)
    first[1:] = name[1:] != name[:-1]
    at = np.flatnonzero(first)
    return name[at], doc[at], doc[np.append(at[1:], len(name)) - 1] if len(at) else doc


_ASKED = "a long, b long, g int, low long, high long"


def _asked(g: int, names: list[np.ndarray], docs: list[np.ndarray]) -> pa.Table:
    name, low, high = _bounds(names, docs)
    columns = [name["a"].copy().view(np.int64), name["b"].copy().view(np.int64), np.full(len(name), g, np.int32), low, high]
    return pa.Table.from_arrays([pa.array(c) for c in columns], names=["a", "b", "g", "low", "high"])


def _shared(asked: DataFrame, kind: int) -> DataFrame:
    """(g, kind, a, b, low): names (a, b) of several documents, for each group that asked; low is the smallest of all."""
    same = Window.partitionBy("a", "b")
    known = asked.select("g", "a", "b", F.min("low").over(same).alias("low"), F.max("high").over(same).alias("high"))
    return known.filter("low < high").select("g", F.lit(kind).alias("kind"), "a", "b", "low")


def _shared_anchors(asked: DataFrame, kind: int) -> DataFrame:
    """(g, kind, a, b, low): anchors a of (a, g, many) that several groups have, or several documents of one."""
    same = Window.partitionBy("a")
    known = asked.select("g", "a", F.min("g").over(same).alias("first"), F.max("g").over(same).alias("last"), F.max("many").over(same).alias("many"))
    nothing = F.lit(0).cast("long")
    return known.filter("first < last OR many").select("g", F.lit(kind).alias("kind"), "a", nothing.alias("b"), nothing.alias("low"))


def _names(c: _Chunk, at: np.ndarray) -> np.ndarray:
    """The names of the windows from `at`."""
    out = np.empty(len(at), _NAME)
    out["a"] = T.grams(c.w.hash, c.width)[at] if len(at) else 0
    out["b"] = T.digests(c.w, at, c.width)[:, 0]
    return out


def _known_windows(c: _Chunk, at: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(those of the windows from `at` whose names are known, their places there)."""
    at = at[_within(T.grams(c.w.hash, c.width)[at], known["a"])] if len(at) else at
    hit, where = _found(_names(c, at), known)
    return at[hit], where


def _told(heard: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(names in order, smallest document of each) of one kind."""
    own = np.flatnonzero(heard.column("kind").to_numpy() == kind)
    name = np.empty(len(own), _NAME)
    for c in ("a", "b"):
        name[c] = heard.column(c).to_numpy()[own].view(U64)
    order = np.lexsort((name["b"], name["a"]))
    return name[order], heard.column("low").to_numpy()[own][order]


def _found(names: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of names that are known, their places there)."""
    maybe = np.flatnonzero(_within(names["a"], known["a"]))
    at = np.searchsorted(known["a"], names["a"][maybe])
    hit = np.zeros(len(maybe), bool)
    for _ in range(int(np.unique(known["a"], return_counts=True)[1].max()) if len(known) else 0):
        left = ~hit & (at < len(known))
        hit[left] = known[at[left]] == names[maybe[left]]
        at = np.where(hit, at, at + 1)
    return maybe[hit], at[hit]


def _with(dealt: DataFrame, heard: list[DataFrame], ask: Callable, schema: str) -> DataFrame:
    told = reduce(DataFrame.unionByName, heard)
    return dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(ask, schema)


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array; most are not, which a table of bits settles."""
    if not len(known) or not len(values):
        return np.zeros(len(values), bool)
    bits = min(24, max(10, int(len(known)).bit_length() + 4))
    table = np.zeros(1 << bits, bool)
    table[(known >> U64(64 - bits)).astype(np.int64)] = True
    keep = table[(values >> U64(64 - bits)).astype(np.int64)]
    maybe = np.flatnonzero(keep)
    at = np.searchsorted(known, values[maybe])
    keep[maybe] = known[np.minimum(at, len(known) - 1)] == values[maybe]
    return keep


def _covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, starts + width, 1)
    return np.cumsum(edge[:n]) > 0


def _kept_bytes(w: T.Words, row: np.ndarray, keep: np.ndarray, lo: int, hi: int) -> list[bytes]:
    """For each row of a chunk its kept words, joined by one space."""
    size = len(w.data)
    at = np.flatnonzero(keep)
    edge = np.zeros(size + 1, np.int8)
    edge[w.start[at]] += 1
    edge[w.end[at]] -= 1
    mask = np.cumsum(edge[:size], dtype=np.int8) > 0
    inner = np.ones(len(at), bool)
    if len(at):
        inner[:-1] = row[at][1:] == row[at][:-1]
        inner[-1] = False
    data = w.data.copy()
    gap = w.end[at][inner]
    data[gap] = 0x20
    mask[gap] = True
    sizes = w.end[at] - w.start[at] + inner
    ends = np.cumsum(np.bincount(row[at] - lo, weights=sizes, minlength=hi - lo).astype(np.int64))
    joined = data[mask].tobytes()
    return [joined[a:b] for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)]


def _spans(mask: np.ndarray, chunk: _Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the runs of a mask, words after their last, and the bounds of each row's among them."""
    new, last = mask.copy(), mask.copy()
    new[1:] &= ~mask[:-1] | (chunk.row[1:] != chunk.row[:-1])
    last[:-1] &= ~mask[1:] | (chunk.row[1:] != chunk.row[:-1])
    start = np.flatnonzero(new)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, chunk.w.first)


def _lists(values: np.ndarray, bounds: np.ndarray, base: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array([(values[a:b] - o).tolist() for a, b, o in zip(bounds[:-1], bounds[1:], base, strict=True)], pa.list_(kind))


def _counts(mask: np.ndarray, chunk: _Chunk) -> pa.Array:
    return pa.array(np.bincount(chunk.row[mask] - chunk.lo, minlength=chunk.hi - chunk.lo))


def _result(table: pa.Table, chunk: _Chunk, columns: dict[str, pa.Array]) -> pa.Table:
    own = table.column("doc_id").slice(chunk.lo, chunk.hi - chunk.lo).combine_chunks()
    return pa.table({"doc_id": own, "n_words": pa.array(np.diff(chunk.w.first)), **columns})


# Suffixes.


def _suffixes(width: int, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(prefix, h, doc, g) of the kept suffixes of (doc_id, text, g), once for each document and prefix."""
        for batch in T.slices(batches):
            g = batch.column(2).to_numpy()
            for c in _chunks(batch.column(0), batch.column(1), width):
                at, _ = kept_suffixes(c.w.hash, c.ok, width, k)
                h, row = T.grams(c.w.hash, k)[at], c.row[at]
                order = np.lexsort((h, row))
                first = np.ones(len(at), bool)
                first[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
                at, h, row = at[order][first], h[order][first], row[order][first]
                raw, begin = T.plain_bytes(c.w)
                prefix = pa.array([raw[a:b] for a, b in zip(begin[at].tolist(), begin[at + k].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([prefix, pa.array(h.view(np.int64)), pa.array(c.ids[row]), pa.array(g[row])], names=["prefix", "h", "doc", "g"])

    return rows


_COMPARED = "prefix binary, h long, g int, low long, high long, part int"


class _Run:
    """Rows of one prefix: the groups that have it, and its smallest and largest document."""

    def __init__(self, prefix: bytes, h: int) -> None:
        self.prefix, self.h, self.low, self.high, self.groups = prefix, h, _LAST, ~_LAST, np.zeros(0, np.int32)

    def add(self, g: np.ndarray, doc: np.ndarray) -> None:
        self.low, self.high = min(self.low, int(doc[0])), max(self.high, int(doc[-1]))
        self.groups = np.unique(np.append(self.groups, g))

    def rows(self, part: int | None) -> pa.RecordBatch:
        n = len(self.groups) if part is not None or self.low < self.high else 0
        columns = [[None if part is None else self.prefix] * n, [self.h] * n, self.groups[:n], [self.low] * n, [self.high] * n, [part] * n]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COMPARED_SCHEMA, strict=True)], schema=_COMPARED_SCHEMA)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (prefix, h, doc, g, part): (h, g) of prefixes that neighbours of several documents share (part null), and the
    first and last prefix of the partition (part given) with its smallest and largest document, for the neighbours over the bounds."""
    open_, told = None, 0
    for batch in batches:
        if not len(batch):
            continue
        prefix, part = batch.column(0), batch.column(4)[0].as_py()
        h, doc, g = (batch.column(i).to_numpy() for i in (1, 2, 3))
        new = np.ones(len(batch), bool)
        if len(batch) > 1:
            new[1:] = pc.not_equal(prefix.slice(1), prefix.slice(0, len(prefix) - 1)).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(batch))
        # The first run of a batch may go on from the one before, its last into the next; the others are whole.
        for i in dict.fromkeys((0, len(start) - 1)):
            s, e = start[i], end[i]
            if open_ is None or open_.prefix != prefix[s].as_py():
                if open_ is not None:
                    yield open_.rows(None if told else part)
                    told += 1
                open_ = _Run(prefix[s].as_py(), int(h[s]))
            open_.add(g[s:e], doc[s:e])
        low, high = doc[start], doc[end - 1]
        own = low < high
        own[[0, -1]] = False
        at = np.flatnonzero(np.repeat(own, end - start))
        run = np.repeat(np.arange(len(start)), end - start)[at]
        order = np.lexsort((g[at], run))
        at, run = at[order], run[order]
        first = np.ones(len(at), bool)
        first[1:] = (run[1:] != run[:-1]) | (g[at][1:] != g[at][:-1])
        at, run = at[first], run[first]
        columns = [pa.nulls(len(at), pa.binary()), pa.array(h[at]), pa.array(g[at]), pa.array(low[run]), pa.array(high[run]), pa.nulls(len(at), pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, schema=_COMPARED_SCHEMA)
    if open_ is not None:
        yield open_.rows(part)


_COMPARED_SCHEMA = pa.schema([("prefix", pa.binary()), ("h", pa.int64()), ("g", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("part", pa.int32())])


def _shared_suffixes(dealt: DataFrame, width: int, k: int) -> DataFrame:
    """(g, kind 0, a, b, low): the hash a of each kept prefix that several documents have, for each group that has it."""
    made = dealt.mapInArrow(_suffixes(width, k), "prefix binary, h long, doc long, g int")
    parts = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = made.repartitionByRange(parts, "prefix", "doc").sortWithinPartitions("prefix", "doc").select("prefix", "h", "doc", "g", F.spark_partition_id().alias("part"))
    seen = stored(ordered.mapInArrow(_neighbours, _COMPARED))
    # What meets at the bounds of partitions: two prefixes of each.
    edges = seen.filter("part IS NOT NULL")
    over = edges.groupBy("prefix").agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least < most").select("prefix")
    at_bounds = edges.join(over, "prefix", "left_semi")
    found = seen.filter("part IS NULL").select("g", "h").unionByName(at_bounds.select("g", "h")).distinct()
    return stored(found.select("g", F.lit(0).alias("kind"), F.col("h").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("low")))


SUFFIX_RESULT = "doc_id long, n_words long, n_repeated long, starts array<int>, ends array<int>"


def suffix_repeats(docs: DataFrame, *, min_words: int = 50, k: int = 12) -> DataFrame:
    """See SUFFIX_RESULT: for each row of docs (doc_id, text, ...), how many of its words lie in passages of at least min_words words
    that another document has too, and these as maximal spans (start to end, the end exclusive)."""
    width, dealt = min_words, _groups(docs)
    suffixes = _shared_suffixes(dealt, width, k)

    def long_passages(c: _Chunk, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, names) of what reaches from a shared suffix over REACH kept ones to the end of a shared one's prefix."""
        at, _ = kept_suffixes(c.w.hash, c.ok, width, k)
        live = _within(T.grams(c.w.hash, k)[at], shared)
        i = np.flatnonzero(live[:-REACH] & live[REACH:] & (c.row[at[:-REACH]] == c.row[at[REACH:]]) & (at[REACH:] + k - at[:-REACH] >= width)) if len(at) > REACH else np.zeros(0, np.int64)
        start, end = at[i], at[i + REACH] + k if len(i) else i
        return start, end, _named(_digests(c.w, start, end))

    def ask_long(key, table, heard):
        shared, names, docs_ = _told(heard, 0)[0]["a"], [], []
        for c in _chunks(table.column("doc_id"), table.column("text"), width):
            start, _, name = long_passages(c, shared)
            names.append(name)
            docs_.append(c.docs(start))
        return _asked(key[0].as_py(), names, docs_)

    def ask_windows(key, table, heard):
        shared, (known, low), names, docs_ = _told(heard, 0)[0]["a"], _told(heard, 1), [], []
        for c in _chunks(table.column("doc_id"), table.column("text"), width):
            start, end, name = long_passages(c, shared)
            hit, where = _found(name, known)
            hit = hit[low[where] < c.docs(start[hit])]
            inside = np.zeros(len(c.row) + 1, np.int64)
            np.maximum.at(inside, start[hit], end[hit])
            _, least = kept_suffixes(c.w.hash, c.ok, width, k)
            at = c.ok[_within(least, shared)]
            at = at[np.maximum.accumulate(inside)[at] < at + width]
            names.append(_names(c, at))
            docs_.append(c.docs(at))
        return _asked(key[0].as_py(), names, docs_)

    def mark(key, table, heard):
        shared, long_, windows = (_told(heard, kind)[0] for kind in range(3))
        out = []
        for c in _chunks(table.column("doc_id"), table.column("text"), width):
            start, end, name = long_passages(c, shared["a"])
            hit, _ = _found(name, long_)
            again = _between(len(c.row), start[hit], end[hit]) | _covered(len(c.row), _known_windows(c, c.ok, windows)[0], width)
            start, end, bounds = _spans(again, c)
            base = c.w.first[:-1]
            out.append(_result(table, c, {"n_repeated": _counts(again, c), "starts": _lists(start, bounds, base, pa.int32()), "ends": _lists(end, bounds, base, pa.int32())}))
        return pa.concat_tables(out)

    long_ = _shared(_with(dealt, [suffixes], ask_long, _ASKED), 1)
    windows = _shared(_with(dealt, [suffixes, long_], ask_windows, _ASKED), 2)
    return _with(dealt, [suffixes, long_, windows], mark, SUFFIX_RESULT)


# Recompression.


class _Symbols:
    """The names of one chunk that stand for a window or more, after each of `rounds`, and what is known of them."""

    def __init__(self, c: _Chunk, rounds: tuple[int, ...], told: list[tuple[np.ndarray, np.ndarray]]) -> None:
        n = len(c.row)
        dead = np.zeros(n + 1, bool)  # words in a name that no other document has
        self.inside = np.zeros(n + 1, np.int64)  # where the name ends that settles the windows from a word on
        self.removed = np.zeros(n, bool)
        self.start = self.end = np.zeros(0, np.int64)
        self.name = np.zeros(0, _NAME)
        for i, (name, start, _) in enumerate(levels(c.w.hash, c.row, rounds[len(told)] if len(told) < len(rounds) else rounds[-1]) if n else ()):
            if i not in rounds:
                continue
            end = np.append(start[1:], n)
            some = np.flatnonzero((end - start >= c.width) & ~np.logical_or.reduceat(dead[:n], start))
            start, end, name = start[some], end[some], name[some]
            if (k := rounds.index(i)) == len(told):
                self.start, self.end, self.name = start, end, _long_names(c, name, start, end)
                return
            known, low = told[k]
            hit = np.flatnonzero(_within(name, known["a"]))
            right, where = _found(_long_names(c, name[hit], start[hit], end[hit]), known)
            hit = hit[right]
            other = np.ones(len(start), bool)
            other[hit] = False
            dead[:n] |= _between(n, start[other], end[other])
            own = hit[low[where] < c.docs(start[hit])]
            self.removed |= _between(n, start[own], end[own])
            np.maximum.at(self.inside, start[own], end[own])

    def settled(self, starts: np.ndarray, width: int) -> np.ndarray:
        return np.maximum.accumulate(self.inside)[starts] >= starts + width


def _long_names(c: _Chunk, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What the words from each start to before its end are called among all documents."""
    out = np.empty(len(start), _NAME)
    out["a"], out["b"] = hashes, _digests(c.w, start, end)[:, 0]
    return out


def _between(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.subtract.at(edge, end, 1)
    return np.cumsum(edge[:n]) > 0


def _digests(w: T.Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The digests of the words from each start to before its end."""
    raw, begin = T.plain_bytes(w)
    out = b"".join([T.digest(raw[a : b - 1]) for a, b in zip(begin[start].tolist(), begin[end].tolist(), strict=True)])
    return np.frombuffer(out, "<u8").reshape(-1, 2)


RECOMPRESSED_RESULT = "doc_id long, n_words long, n_removed long, starts array<int>, ends array<int>, kept string"


def substring_repeats(docs: DataFrame, *, width: int = 13, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """See RECOMPRESSED_RESULT: for each row of docs (doc_id, text, ...), how many of its words lie in a window whose words also start
    in a document of a smaller id, these as maximal spans, and the words that are left, joined by one space."""
    dealt = _groups(docs)
    inner, whole = len(rounds), len(rounds) + 1  # kinds of what is told beside the names of each round

    def ask_names(done: int):
        def ask(key, table, heard):
            told, names, docs_ = [_told(heard, k) for k in range(done)], [], []
            for c in _chunks(table.column("doc_id"), table.column("text"), width):
                symbols = _Symbols(c, rounds, told)
                names.append(symbols.name)
                docs_.append(c.docs(symbols.start))
            return _asked(key[0].as_py(), names, docs_)

        return ask

    def left(table: pa.Table, heard: pa.Table) -> Iterator[tuple[_Chunk, _Symbols, np.ndarray]]:
        """(chunk, symbols, starts of windows that no name settles)."""
        told = [_told(heard, k) for k in range(inner)]
        for c in _chunks(table.column("doc_id"), table.column("text"), width):
            symbols = _Symbols(c, rounds, told)
            yield c, symbols, c.ok[~symbols.settled(c.ok, width)]

    def ask_inner(key, table, heard):
        names, docs_ = [], []
        for c, _, at in left(table, heard):
            anchor, doc = inner_names(c.w.hash, c.row, width)[at], c.docs(at)
            first = np.ones(len(at), bool)
            first[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            name = np.zeros(int(first.sum()), _NAME)
            name["a"] = anchor[first]
            names.append(name)
            docs_.append(doc[first])
        name, low, high = _bounds(names, docs_)
        return pa.table({"a": name["a"].copy().view(np.int64), "g": np.full(len(name), key[0].as_py(), np.int32), "many": low < high})

    def ask_windows(key, table, heard):
        known, names, docs_ = _told(heard, inner)[0]["a"], [], []
        for c, _, at in left(table, heard):
            at = at[_within(inner_names(c.w.hash, c.row, width)[at], known)]
            names.append(_names(c, at))
            docs_.append(c.docs(at))
        return _asked(key[0].as_py(), names, docs_)

    def mark(key, table, heard):
        known, low = _told(heard, whole)
        out = []
        for c, symbols, at in left(table, heard):
            at, where = _known_windows(c, at, known)
            removed = symbols.removed | _covered(len(c.row), at[low[where] < c.docs(at)], width)
            start, end, bounds = _spans(removed, c)
            base = c.w.first[:-1]
            kept = pa.array([x.decode() for x in _kept_bytes(c.w, c.row, ~removed, c.lo, c.hi)], pa.string())
            out.append(_result(table, c, {"n_removed": _counts(removed, c), "starts": _lists(start, bounds, base, pa.int32()), "ends": _lists(end, bounds, base, pa.int32()), "kept": kept}))
        return pa.concat_tables(out)

    named = [dealt.sparkSession.createDataFrame([], "g int, kind int, a long, b long, low long")]
    for i in range(len(rounds)):
        named.append(_shared(_with(dealt, named, ask_names(i), _ASKED), i))
    anchors = _shared_anchors(_with(dealt, named, ask_inner, "a long, g int, many boolean"), inner)
    windows = _shared(_with(dealt, [*named, anchors], ask_windows, _ASKED), whole)
    return _with(dealt, [*named, windows], mark, RECOMPRESSED_RESULT)
