"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A document is the set of its k-word shingles. Its sketch has t coordinates, filled in rounds: in
round i < t every shingle draws a coordinate and a value, in round t + i all shingles go to
coordinate i; the first round to reach a coordinate decides it, by its smallest value. So every
coordinate is filled after at most 2t rounds, large sets need about one, and the share of equal
coordinates of two sketches concentrates around their Jaccard similarity as with fully independent
draws.

Documents with the same words in the same order are one class (by a 128-bit BLAKE2b digest of the words), and one row stands
for it. Bands of a few coordinates bring classes together. The first class of a band bucket is its centre; a class is
compared with at most two of its buckets' centres, the first and the most frequent. Where that leaves several components in a
bucket, its members are compared across components, block by block, and only links leave the task, one for each two
components that they join. So every pair of a bucket ends up either in one component or compared: no link is lost, and a
bucket of n members gives at most n rows for each of its blocks. Pairs whose sketches differ too much are not looked at
further (`SKETCH_FLOOR` lies eight standard deviations below the threshold). All links are confirmed on the words of both
texts, whatever their hashes are. At the threshold itself a pair shares no band with probability 5e-5.

Defined cases: null or blank texts have no shingles and are linked with nothing; a text of fewer than k words is one
shingle; rows that repeat an id and text are kept, each with its component; rows that share an id but not their text are
judged each by its text, and a component's id is the smallest of its rows' ids; a null id is never linked and keeps a null
component; very long texts are read whole, and compared whole; ties do not matter, as all links count;
an empty table gives an empty result; extra columns are ignored by `near_duplicates` and kept by `distinct`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm import text as T
from causeway.llm.tables import bit_map, components, free, in_bit_map
from causeway.storage import stored

COORDINATES, ROWS_PER_BAND = 300, 6
SKETCH_FLOOR = 0.55
#: Members of an open bucket, and shingles of theirs, that are compared with as many others at a time.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
#: Bits of the map of classes whose texts are asked for.
WANTED_BITS = 1 << 27
#: Rows of texts, and of pairs of texts, that go to Python at a time.
TEXTS, PAIRS = 1000, 250


def sketch(items: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """t values of a non-empty set of 64-bit hashes."""
    out, open_ = np.zeros(t, T.U64), np.ones(t, bool)
    left = t
    for i in range(2 * t):
        h = T.mix(items + T.U64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        if i < t:
            at = ((h >> T.U64(32)) % T.U64(t)).astype(np.int64)
            h = T.mix(h)
            keep = open_[at]
            at, h = at[keep], h[keep]
            if len(at):
                order = np.lexsort((h, at))
                at, h = at[order], h[order]
                lead = np.ones(len(at), bool)
                lead[1:] = at[1:] != at[:-1]
                at, h = at[lead], h[lead]
                out[at], open_[at] = h, False
                left -= len(at)
        elif open_[i - t]:
            out[i - t] = T.mix(h).min()
            open_[i - t] = False
            left -= 1
        if not left:
            break
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


_SKETCHED = "doc_id long, text_sha256 string, wa long, wb long, n_shingles long, bands array<long>, sketch binary"


def _words_keys(w: T.Words, lo: int, hi: int) -> np.ndarray:
    """Digests of the words of texts lo to hi, as two numbers each."""
    raw, begin = T.plain_bytes(w)
    at = begin[w.first].tolist()
    return np.frombuffer(b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True)]), "<i8").reshape(hi - lo, 2)


def _sketch_rows(k: int, t: int, r: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            data, at = T.strings(batch.column(1))
            n = len(batch)
            sizes, keys = np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
            bands: list = [None] * n
            small: list = [None] * n
            for lo, hi in T.chunks(at):
                w = T.words(data, at[lo : hi + 1], lower=True)
                keys[lo:hi] = _words_keys(w, lo, hi)
                for i in range(lo, hi):
                    items = T.shingles(w.hash[w.of(i - lo)], k)
                    if not len(items):
                        continue
                    sizes[i] = len(items)
                    s = sketch(items, t)
                    small[i] = (s >> T.U64(56)).astype(np.uint8).tobytes()
                    b = T.grams(s, r)[::r][: t // r]
                    bands[i] = _signed(T.mix(b + np.arange(len(b), dtype=T.U64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(sizes), pa.array(bands, pa.list_(pa.int64())), pa.array(small, pa.binary())],
                names=[c.split()[0] for c in _SKETCHED.split(", ")],
            )

    return rows


def _worded(bits: Broadcast):
    """(wa, wb, text) of (text), for texts whose class may be wanted; each class once in a batch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            data, at = T.strings(batch.column(0))
            keys = [np.zeros((0, 2), np.int64)]
            for lo, hi in T.chunks(at):
                keys.append(_words_keys(T.words(data, at[lo : hi + 1], lower=True), lo, hi))
            both = np.concatenate(keys)
            own = np.unique(both, axis=0, return_index=True)[1]
            own = np.sort(own[in_bit_map(bits.value, np.ascontiguousarray(both[own, 0]))])
            yield pa.RecordBatch.from_arrays([pa.array(both[own, 0]), pa.array(both[own, 1]), batch.column(0).take(pa.array(own))], names=["wa", "wb", "text"])

    return rows


def _alike(least: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(len(batch), -1) for i in (2, 3))
            keep = (x == y).mean(axis=1) >= least if len(batch) else np.zeros(0, bool)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return rows


def _confirm(k: int, percent: int):
    """Pairs (a, b) of (a, b, text_a, text_b) that are linked, by the words themselves."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, 64):
            n = len(batch)
            data, at = T.strings(pa.concat_arrays([batch.column(i).cast(pa.large_string()) for i in (2, 3)]))
            w = T.words(data, at, lower=True)
            code = T.codes(w)
            grams, size = T.exact_grams(code, k), np.diff(w.first)
            keep = np.zeros(n, bool)
            for i in range(n):
                own, other = w.of(i), w.of(n + i)
                if min(size[i], size[n + i]) < k:
                    keep[i] = size[i] > 0 and np.array_equal(code[own], code[other])
                else:
                    x, y = (np.unique(grams[o.start : o.stop - k + 1]) for o in (own, other))
                    inter = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * inter >= percent * (len(x) + len(y) - inter)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return rows


def _sets(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            data, at = T.strings(batch.column(1))
            sets = [T.shingles(T.words(data, at[i : i + 2], lower=True).hash, k).tobytes() for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "items"])

    return rows


def _across(least: float, percent: int):
    """Links (a, b) between different components of one cell (doc_id, c, part, sketch, items; i, j): of those between
    two components one, as it makes them the same."""

    def rows(key, table):
        part, ids, c = (table.column(x).to_numpy() for x in ("part", "doc_id", "c"))
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        sets = table.column("items").to_pylist()
        size = np.array([len(x) // 8 for x in sets])
        first = np.cumsum(size) - size
        items, at = np.unique(np.frombuffer(b"".join(sets), "<u8"), return_inverse=True)
        own = np.zeros(len(items), bool)
        i, j = key[1].as_py(), key[2].as_py()
        sides = {i: np.flatnonzero(part == i), j: np.flatnonzero(part == j)}
        values, c, counts = np.unique(c, return_inverse=True, return_counts=True)
        a, b = [], []
        for x in np.flatnonzero(c != counts.argmax()).tolist():  # of each pair one is outside the largest component
            right = sides[j if part[x] == i else i]
            others = right[c[right] != c[x]]
            others = others[(sketches[others] == sketches[x]).mean(axis=1) >= least] if len(others) else others
            if not len(others):
                continue
            mine, theirs = at[first[x] : first[x] + size[x]], size[others]
            begin = np.cumsum(theirs) - theirs
            own[mine] = True
            shared = np.add.reduceat(own[at[np.repeat(first[others] - begin, theirs) + np.arange(theirs.sum())]], begin, dtype=np.int64)
            own[mine] = False
            linked = others[100 * shared >= percent * (size[x] + theirs - shared)]
            for y in linked[np.unique(c[linked], return_index=True)[1]].tolist():
                a.append(min(ids[x], ids[y]))
                b.append(max(ids[x], ids[y]))
                c[c == c[y]] = c[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows


def _near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches (id, sketch) are near enough."""
    both = pairs.join(sketches.toDF("a", "x"), "a").join(sketches.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(_alike(SKETCH_FLOOR), "a long, b long")


def _verified(near: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts (id, text) are near enough."""
    both = near.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_confirm(k, percent), "a long, b long")


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 75, coordinates: int = COORDINATES, rows_per_band: int = ROWS_PER_BAND) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_sha256) for each row of docs (doc_id, text, ...).

    Documents are linked where 100 * |intersection| >= percent * |union| of their k-word shingles.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = docs.withColumn("text_sha256", F.sha2("text", 256)).mapInArrow(_sketch_rows(k, coordinates, rows_per_band), _SKETCHED)
    rows = stored(sketched.withColumn("r", F.monotonically_increasing_id()), TEXTS)
    live = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # c, the number of one of its rows, names a class.
    classes = stored(live.groupBy("wa", "wb").agg(F.min("doc_id").alias("least_id"), F.min("r").alias("c")))
    reps = live.join(classes.select(F.col("c").alias("r")), "r", "left_semi").select(F.col("r").alias("c"), "n_shingles", "bands", "sketch")
    in_band = reps.select("c", "n_shingles", F.explode("bands").alias("band"))
    buckets = in_band.groupBy("band").agg(F.min("c").alias("a"), F.max("c").alias("z")).filter("a < z")
    crowded = stored(in_band.join(buckets.select("band", "a"), "band"))
    votes = crowded.filter("c > a").groupBy("c", "a").agg(F.count("*").alias("n"))
    centres = votes.groupBy("c").agg(F.min("a").alias("low"), F.max_by("a", F.struct("n", -F.col("a"))).alias("most"))
    pairs = centres.select(F.explode(F.array_distinct(F.array("low", "most"))).alias("a"), F.col("c").alias("b"))
    sketches = reps.select(F.col("c").alias("id"), "sketch")
    near = stored(_near(pairs, sketches), 4 * TEXTS)
    needed = stored(classes.join(crowded.select("c").distinct(), "c", "left_semi").select("wa", "wb", F.col("c").alias("id")))
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(needed.select(F.col("wa").alias("h")), WANTED_BITS))
    worded = docs.select("text").mapInArrow(_worded(bits), "wa long, wb long, text string")
    once = worded.groupBy("wa", "wb").agg(F.first("text").alias("text"))  # copies of a text are one before they are dealt
    texts = stored(once.join(needed, ["wa", "wb"]).select("id", "text"), TEXTS)
    links = stored(_verified(near, texts, k, percent), PAIRS)
    found = components(links)
    # Buckets whose members are in several components.
    placed = stored(crowded.join(found, F.col("c") == F.col("id"), "left").select("band", F.col("c").alias("doc_id"), "n_shingles", F.coalesce("component_id", "c").alias("c")))
    mixed = placed.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n"), F.sum("n_shingles").alias("size")).filter("low < high")
    mixed = mixed.select("band", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    open_ = stored(placed.join(mixed, "band").select("band", "doc_id", "c", "parts"))
    sets = texts.join(open_.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi").mapInArrow(_sets(k), "id long, items binary")
    members = sketches.join(sets, "id").toDF("doc_id", "sketch", "items")
    cells = (
        open_.withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int"))
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("band", F.least("part", "k").alias("i"), F.greatest("part", "k").alias("j"), "doc_id", "c", "part")
        .join(members, "doc_id")
    )
    more = stored(_verified(cells.groupBy("band", "i", "j").applyInArrow(_across(SKETCH_FLOOR, percent), "a long, b long").distinct(), texts, k, percent), PAIRS)
    if more.limit(1).count():
        found = components(links.unionByName(more))
    placed = classes.join(found, F.col("c") == F.col("id"), "left").select("wa", "wb", "least_id", F.coalesce("component_id", "c").alias("c"))
    least = placed.groupBy("c").agg(F.min("least_id").alias("component_id"))
    of_class = placed.join(least, "c").select("wa", "wb", "component_id")
    out = rows.join(of_class, ["wa", "wb"], "left").select("doc_id", "n_shingles", "component_id", "text_sha256")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), "text_sha256")


def distinct(docs: DataFrame, *, k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs, all columns, that `near_duplicates` keeps: those of other texts go, even where a kept row has their id."""
    key = free("text_sha256", docs.columns)
    gone = near_duplicates(docs, k=k, percent=percent).filter("NOT kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    keyed = docs.withColumn(key, F.sha2(F.col("text").cast("string"), 256))
    return keyed.join(gone, (keyed["doc_id"].cast("long") == gone["_id"]) & (keyed[key] == gone["_sha"]), "left_anti").select(*docs.columns)
