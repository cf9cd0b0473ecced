"""Phrase collocations: phrases whose words stand together more often than their frequencies would have it.

A suffix pointer is the place of a word; it reads up to `words` words, to the end of its piece. Pointers are sorted by
multikey three-way quicksort: all open partitions at once are split by a pivot word into smaller, equal and larger, the equal
ones go on with the next word, up to depth `words`. The size of an equal partition at a depth is the count of
the phrase that it reads so far.

Leading words come first: tasks sort blocks of pointers to depth 2, and the sizes of equal partitions are routed by a hash of the leading pair
and added up. Pairs below the least count are abandoned over the whole corpus, as nothing that goes on from them can be
frequent; those left go into a bit map of bounded size (`MOST_BITS`; what it lets through beside them is only
more work). Then the tasks sort what goes on from these pairs to the maximum depth; a block sends one row for each distinct suffix, with its size,
to the task of its leading words, where the rows of all blocks are sorted again and partitions below the least count
abandoned. These sizes are exact: they are those of words, not of hashes. Leading pairs that hold a notable share of all (`HOT_SHARE`; there can be no more than
1 / HOT_SHARE of them) are dealt by their third word as well; only the sizes of such pairs are partial, and added up afterwards. Spark
sorts what a task gets by its routing key, so a task holds a block of rows and the rows of one key at most.

Defined cases: null texts are empty, a null lang is `und`; a table without words gives an empty result; equal
texts count each time; the order of results is total (score, count, phrase), so ties do not matter; long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm import text as T
from causeway.llm.tables import bit_map, in_bit_map
from causeway.storage import stored

#: Pointers that are sorted together in a task, and rows of a routing key's neighbours that are.
BLOCK, ROUTED_BLOCK = 1 << 19, 1 << 18
#: Rows that leave a task at a time.
OUT = 1 << 15
#: A leading pair with this share of what is frequent is dealt by its third word too.
HOT_SHARE = 1 / 1024
#: Bits of the map of frequent pairs: 16 for each, up to 16 MB in all.
MOST_BITS = 1 << 27
_END = -1

_CUT, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_CUT[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BLANK[[0x20, 0x09]] = True


Runs = list[tuple[np.ndarray, np.ndarray]]


def quicksort(columns: list[np.ndarray], weight: np.ndarray, least: list[int]) -> tuple[Runs, Runs]:
    """For each depth, one pointer of every equal partition and the partition's weight; and the same of the pointers that end there.

    columns: the word of each pointer at each depth, -1 where its piece has ended. least: the weight under which a
    partition at a depth is abandoned. The last depth is the maximum depth.
    """
    deepest = len(columns)
    table = np.stack(columns).astype(np.int32)  # codes of a block
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in columns]
    ends: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in columns]
    p = np.arange(len(weight), dtype=np.int32)
    first, depth = np.zeros(min(1, len(p)), np.int64), np.zeros(min(1, len(p)), np.int64)
    while len(p):
        size = np.diff(np.append(first, len(p)))
        segment = np.repeat(np.arange(len(first), dtype=np.int32), size)
        key = table[depth[segment], p]
        a, b, c = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[segment]
        side = (key >= pivot).astype(np.int8) + (key > pivot)
        # Places: within a segment first what is smaller, then what is equal, then what is larger.
        counts, place = np.zeros((len(first), 3), np.int64), np.empty(len(p), np.int32)
        before = first.copy()
        for s in range(3):
            own = side == s
            run = np.cumsum(own, dtype=np.int32)
            counts[:, s] = np.add.reduceat(own, first, dtype=np.int64)
            at = np.flatnonzero(own)
            seg = segment[at]
            place[at] = before[seg] + run[at] - 1 - (run[first] - own[first])[seg]
            before += counts[:, s]
        moved = np.empty_like(p)
        moved[place] = p
        p = moved
        starts = (first[:, None] + np.cumsum(counts, axis=1) - counts).ravel()
        sizes, depths = counts.ravel(), np.repeat(depth, 3)
        equal = np.tile(np.array([False, True, False]), len(first))
        live = sizes > 0
        starts, sizes, depths, equal = starts[live], sizes[live], depths[live], equal[live]
        sums = np.add.reduceat(weight[p], starts)
        lead = p[starts]
        ended = equal & (table[depths, lead] == _END)
        keep = sums >= np.array(least)[depths]
        done = equal & ~ended & keep
        for d in range(deepest):
            for out, which in ((found, done), (ends, ended)):
                here = np.flatnonzero(which & (depths == d))
                out[d].append((lead[here], sums[here]))
        depths = depths + equal
        on = keep & ~ended & (depths < deepest)
        held = np.repeat(on, sizes)
        p, sizes, depth = p[held], sizes[on], depths[on]
        first = np.cumsum(sizes) - sizes
    none = np.zeros(0, np.int64)
    return tuple([tuple(np.concatenate(x) for x in zip((none, none), *f, strict=True)) for f in out] for out in (found, ends))


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, first byte and end of each word, number of each word's piece)."""
    data = T._LOWER[data[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, none
    cut = _CUT[data]
    inside = ~(cut | _BLANK[data])
    new = np.zeros(len(data) + 1, bool)
    new[offsets] = True
    start = np.flatnonzero(inside & np.append(True, ~inside[:-1] | new[1:-1]))
    end = np.flatnonzero(inside & np.append(~inside[1:] | new[1:-1], True)) + 1
    piece = np.cumsum(cut | new[:-1])
    return data, start, end, piece[start]


class Block:
    """Words of texts in one language: their codes, strings and hashes, and pointers that read `words` of them."""

    def __init__(self, lang: str, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], words: int) -> None:
        coded = pa.concat_arrays([T.column(T.Words(data, start, end, start, start)) for data, start, end, _ in parts]).dictionary_encode()
        self.lang, self.code, self.strings = lang, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.string())
        own = np.frombuffer(lang.encode(), np.uint8)
        self.seed = T.word_hashes(own, np.zeros(1, np.int64), np.full(1, len(own)))[0]
        data, at = T.strings(self.strings)
        self.hash = T._two(np.full(len(self.strings), self.seed), T.word_hashes(data, at[:-1], at[1:]))
        step, numbers = 0, []
        for *_, piece in parts:
            numbers.append(piece + step)
            step = numbers[-1][-1] + 1
        piece = np.concatenate(numbers)
        self.columns = [self.code]
        for d in range(1, words):
            ahead = np.full(len(self.code), _END)
            ahead[:-d] = np.where(piece[d:] == piece[:-d], self.code[d:], _END)
            self.columns.append(ahead)

    def pair_hashes(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return T._two(self.hash[first], self.hash[second])

    def phrases(self, columns: list[np.ndarray]) -> pa.Array:
        return pc.binary_join_element_wise(*(self.strings.take(pa.array(c)) for c in columns), " ")


def _blocks(words: int, most: int, task) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What `task` makes of the blocks of (lang, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, list] = {}
        held: dict[str, int] = {}
        for batch in T.slices(batches):
            langs = batch.column(0).to_pylist()
            for lang in dict.fromkeys(langs):
                data, at = T.strings(batch.column(1).filter(pa.array([x == lang for x in langs])))
                for lo, hi in T.chunks(at, 1 << 20):
                    part = pieces(data, at[lo : hi + 1])
                    if len(part[1]):
                        open_.setdefault(lang, []).append(part)
                        held[lang] = held.get(lang, 0) + len(part[1])
                    if held.get(lang, 0) >= most:
                        held.pop(lang)
                        yield from task(Block(lang, open_.pop(lang), words))
            while sum(held.values()) >= 2 * most:
                longest = max(held, key=held.get)
                held.pop(longest)
                yield from task(Block(longest, open_.pop(longest), words))
        for lang, parts in open_.items():
            yield from task(Block(lang, parts, words))

    return rows


def _pairs(block: Block) -> Iterator[pa.RecordBatch]:
    """(h, n): hashes of leading pairs and the sizes of their partitions."""
    on = np.flatnonzero(block.columns[1] != _END)
    first, second = block.code[on], block.columns[1][on]
    runs, _ = quicksort([first, second], np.ones(len(on), np.int64), [0, 0])
    lead, size = runs[1]
    h = block.pair_hashes(first[lead], second[lead]).view(np.int64)
    for lo in range(0, len(h), OUT):
        yield pa.RecordBatch.from_arrays([pa.array(h[lo : lo + OUT]), pa.array(size[lo : lo + OUT])], names=["h", "n"])


_ROWS = "h long, hot boolean, lang string, phrase string, n long"


def _suffixes(bits: Broadcast, hot: Broadcast):
    """(h, hot, lang, phrase, n): how many words there are (a null phrase), words, and suffixes that go on from frequent pairs."""

    def task(block: Block) -> Iterator[pa.RecordBatch]:
        filter_, heavy, code = bits.value, hot.value, block.code
        # A pointer reads on as long as each pair of neighbours may be frequent.
        pair = np.flatnonzero(block.columns[1] != _END) if len(block.columns) > 1 else np.zeros(0, np.int64)
        h = block.pair_hashes(code[pair], block.columns[1][pair])
        maybe = np.zeros(len(code) + len(block.columns), bool)
        maybe[pair] = in_bit_map(filter_, h)
        on = np.flatnonzero(maybe[: len(code)])
        columns, reads = [code[on]], np.ones(len(on), bool)
        for d in range(1, len(block.columns)):
            reads = reads & maybe[on + d - 1]
            columns.append(np.where(reads, block.columns[d][on], _END))
        counts = np.bincount(code)
        rows = [(np.array([T.mix(block.seed)]), pa.array([None], pa.string()), np.array([len(code)]), np.zeros(1, bool))]
        rows.append((T.mix(block.hash), block.strings, counts, np.zeros(len(counts), bool)))
        runs, ends = quicksort(columns, np.ones(len(on), np.int64), [0] * len(columns))
        for size, (lead, n) in [*((d, ends[d]) for d in range(2, len(columns))), (len(columns), runs[-1])]:
            if len(lead):
                own = [c[lead] for c in columns[:size]]
                h = block.pair_hashes(own[0], own[1])
                is_hot = np.isin(h, heavy)
                if size > 2:
                    h = np.where(is_hot, T._two(h, block.hash[own[2]]), h)
                rows.append((h, block.phrases(own), n, is_hot))
        for h, phrase, n, is_hot in rows:
            for lo in range(0, len(n), OUT):
                cut = slice(lo, lo + OUT)
                lang = pa.array([block.lang] * len(n[cut]), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[cut].view(np.int64)), pa.array(is_hot[cut]), lang, phrase.slice(lo, OUT), pa.array(n[cut].astype(np.int64))], names=["h", "hot", "lang", "phrase", "n"]
                )

    return task


_COUNTS = "lang string, phrase string, size int, n long"


def _counted(words: int, least: int, most: int):
    """From _ROWS in the order of h: (lang, phrase, size, n) of what is frequent (size 0: all words); sizes of hot pairs are partial."""

    def block(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        weight, hot = table.column("n").to_numpy(), table.column("hot").to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(table.column("phrase").combine_chunks(), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        code, strings = np.append(coded.indices.to_numpy(zero_copy_only=False), _END).astype(np.int64), coded.dictionary
        size = np.diff(bounds)
        langs = table.column("lang").combine_chunks().dictionary_encode()
        columns = [langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
        columns += [code[np.where(size > d, bounds[:-1] + d, len(code) - 1)] for d in range(words)]
        always, floor = [0] * (words + 1), [least] * (words + 1)
        for part, least_of, depths in (
            (size == 0, always, [0]),
            (size == 1, floor, [1]),
            ((size > 1) & ~hot, floor, range(2, words + 1)),
            ((size > 1) & hot, [0, 0, 0, *floor[3:]], range(2, words + 1)),
        ):
            part = np.flatnonzero(part)
            runs, _ = quicksort([c[part] for c in columns[: max(depths) + 1]], weight[part], least_of)
            for d in depths:
                lead, n = runs[d]
                if len(lead):
                    lead = part[lead]
                    words_of = [strings.take(pa.array(columns[x][lead])) for x in range(1, d + 1)]
                    phrase = pc.binary_join_element_wise(*words_of, " ") if d else pa.array([""] * len(lead), pa.string())
                    lang = langs.dictionary.take(pa.array(columns[0][lead]))
                    yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(lead), d, np.int32)), pa.array(n)], names=["lang", "phrase", "size", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n < most:
                continue
            table = pa.Table.from_batches(held)
            h = table.column("h").to_numpy()
            change = np.flatnonzero(h[1:] != h[:-1]) + 1
            if len(change):
                yield from block(table.slice(0, change[-1]))
                table = table.slice(change[-1])
            held, n = table.to_batches(), len(table)
            if not len(change) and n >= 4 * most:  # one key has them all: its equal suffixes become one row each
                held = [_merged(table)]
                n = len(held[0])
        if n:
            yield from block(pa.Table.from_batches(held))

    return rows


def _merged(table: pa.Table) -> pa.RecordBatch:
    """The rows of one routing key, equal suffixes as one."""
    table = table.combine_chunks()
    code = pc.fill_null(table.column("phrase").combine_chunks(), "").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    _, first = np.unique(code, return_index=True)
    sums = np.bincount(code, weights=table.column("n").to_numpy()).astype(np.int64)
    few = table.take(pa.array(first))
    return few.set_column(few.schema.get_field_index("n"), "n", pa.array(sums[code[first]])).to_batches()[0]


def phrase_counts(docs: DataFrame, *, words: int = 3, least: int = 10) -> DataFrame:
    """(lang, phrase, size, n): the words (size 1) and phrases of 2 to `words` words of docs (lang, text, ...) that occur `least`
    times or more, and, with size 0, how many words each lang has."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    pairs = texts.mapInArrow(_blocks(2, BLOCK, _pairs), "h long, n long")
    frequent = stored(pairs.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    filter_ = bit_map(frequent, MOST_BITS)
    total = frequent.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    heavy = [r["h"] for r in frequent.filter(F.col("n") >= max(2.0, HOT_SHARE * total)).select("h").collect()]  # 1 / HOT_SHARE at most
    shared = [spark.sparkContext.broadcast(x) for x in (filter_, np.array(heavy, np.int64).view(np.uint64))]
    rows = texts.mapInArrow(_blocks(words, BLOCK, _suffixes(*shared)), _ROWS)
    found = rows.repartition("h").sortWithinPartitions("h").mapInArrow(_counted(words, least, ROUTED_BLOCK), _COUNTS)
    return stored(found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("size") == 0)))


def collocations(docs: DataFrame, *, words: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's first `top` phrases of 2 to `words` words.

    score = floor(1000000 * a * a / (l * r)) for the cut of the phrase into two parts with counts l and r that gives the least (the first of
    these). Phrases that stand inside a longer one which has `share` per cent of their occurrences or more are dropped.
    """
    counts = phrase_counts(docs, words=words, least=least)
    known = counts.filter("size > 0").select("lang", "phrase", "n")
    found = counts.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    def joined(first: str, many: str) -> F.Column:
        return F.expr(f"array_join(slice(w, {first}, {many}), ' ')")

    cuts = found.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", joined("1", "k").alias("left"), joined("k + 1", "size(w) - k").alias("right")
    )
    cuts = cuts.join(known.toDF("lang", "left", "l"), ["lang", "left"]).join(known.toDF("lang", "right", "r"), ["lang", "right"])
    wide = {c: F.col(c).cast("decimal(38,0)") for c in "alr"}
    million = F.lit(1000000).cast("decimal(38,0)")
    cuts = cuts.withColumn("top", million * wide["a"] * wide["a"]).withColumn("under", wide["l"] * wide["r"]).withColumn("score", F.expr("top div under"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("c")).select("lang", "phrase", "c.a", "c.l", "c.r", "c.score")
    inner = (
        found.filter("size > 2")
        .select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k"))
        .select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)).alias("at"))
        .groupBy("lang", joined("at", "k").alias("phrase"))
        .agg(F.max("a").alias("longer"))
    )
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(counts.filter("size = 0").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
