"""Alignment of two tokenizers: which of their tokens cover the same bytes, and which of these pairs are the usual ones.

A text is encoded by both; where tokens of both end at the same byte, a group ends. Tokens of a group whose bytes overlap are
linked. Most groups are one token of each with the same bytes, so a map from A's ids to the B ids with
the same bytes is made beforehand: pairs in this map are counted in vectors as long as A's vocabulary. Only the other, irregular
pairs are shuffled, and these not for each document: a block of documents (`BLOCK_BYTES` of text) sends each of its pairs once, with the number of
its documents that hold it, and gets the corpus-wide counts of its own pairs back.

Texts are cut before a space between two characters that are no white space. Neither tokenizer has a token over such a place (A splits there before it
merges; of B's pieces this is checked, and where one has, texts stay whole), so both encode the parts as they would the whole, and a
group never reaches over it. A worker therefore encodes and aligns a part once, and again only where it comes after more than `PARTS` others.
A text with a part that does not come back byte by byte is encoded as a whole and, where this does not come back either, has no tokens.

Both vocabulary files are read on the driver (their paths are parameters) and travel with the tasks, a few megabytes.

Defined cases: null and empty texts have no tokens, zeros and an empty hash column; null ids are kept; rows that repeat an id are aligned each, and each counts
as a document; ties for the highest count all count as best; an empty table gives an empty result; very long texts are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm import text as T
from causeway.storage import stored

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Text whose pairs are sent and looked up together, and distinct parts that a worker keeps.
BLOCK_BYTES, PARTS = 8 << 20, 1 << 18
_SPACE = "▁"


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, and the others as the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class _Strings:
    """Byte strings side by side, to be joined by their numbers."""

    def __init__(self, strings: list[bytes]) -> None:
        self.data, self.size = np.frombuffer(b"".join(strings), np.uint8), np.array([len(x) for x in strings], np.int64)
        self.first = np.cumsum(self.size) - self.size

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        size = self.size[numbers]
        ends = np.cumsum(size)
        return self.data[np.repeat(self.first[numbers] - (ends - size), size) + np.arange(size.sum())]


class Aligner:
    """Both tokenizers, and the aligned parts seen so far."""

    def __init__(self, a: str, b: bytes, parts: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b, self.most = Tokenizer.from_str(a), sentencepiece.SentencePieceProcessor(model_proto=b), parts
        self.a.encode_special_tokens = True
        own = _byte_of_character()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(own[c] for c in token) if all(c in own for c in token) else token.encode()
        self.bytes_b = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(_SPACE, " ").encode() for i in range(self.b.get_piece_size())
        ]
        first: dict[bytes, int] = {}
        for i in reversed(range(len(self.bytes_b))):
            first[self.bytes_b[i]] = i
        self.same = np.array([first.get(x, -1) for x in self.bytes_a])
        self.strings_a, self.strings_b = _Strings(self.bytes_a), _Strings(self.bytes_b)
        self.decimals = _Strings([b"%d," % i for i in range(max(len(self.bytes_a), len(self.bytes_b)))])
        self.by_words = not any(b" " in x.lstrip(b" ") for x in self.bytes_b)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.groups: list[bytes] = []
        # For each part: tokens, groups, links (n_groups is -1 where it does not come back), and where its pairs begin.
        self.n_a, self.n_b, self.n_groups, self.n_links, self.first = array("q"), array("q"), array("q"), array("q"), array("q", [0])
        self.pairs = array("q")

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both for each of the texts, which begin with a space."""
        own = self.a.encode_batch(texts, add_special_tokens=False)
        return [(x.ids, y) for x, y in zip(own, self.b.encode([t[1:] for t in texts], num_threads=1), strict=True)]

    def _learn(self, parts: list[bytes]) -> None:
        """Aligns the parts, all at once, and adds them to what is known."""
        tokens = self.tokens([p.decode() for p in parts])
        size = np.array([len(p) for p in parts], np.int64)
        many = [np.array([len(t[x]) for t in tokens], np.int64) for x in (0, 1)]
        ids = [np.array(list(chain.from_iterable(t[x] for t in tokens)), np.int64) for x in (0, 1)]
        of = [np.repeat(np.arange(len(parts)), m) for m in many]
        # Parts whose bytes come back from both.
        known = (self.strings_a, self.strings_b)
        good = np.logical_and(*(np.bincount(of[x], known[x].size[ids[x]], len(parts)).astype(np.int64) == size for x in (0, 1)))
        for x in (0, 1):
            on = np.flatnonzero(good)
            if len(on):
                text, first = np.frombuffer(b"".join([parts[i] for i in on]), np.uint8), np.cumsum(size[on]) - size[on]
                good[on[~np.logical_and.reduceat(known[x].joined(ids[x][good[of[x]]]) == text, first)]] = False
        a, b, part_a = ids[0][good[of[0]]], ids[1][good[of[1]]], of[0][good[of[0]]]
        end_a, end_b = np.cumsum(known[0].size[a]), np.cumsum(known[1].size[b])
        # From one end to the next, of either, one token of each covers the bytes; where both end, a group does.
        ends, common = np.union1d(end_a, end_b), np.intersect1d(end_a, end_b, assume_unique=True)
        at = np.searchsorted(end_a, ends)
        links, links_of = a[at] * len(self.bytes_b) + b[np.searchsorted(end_b, ends)], part_a[at]
        n_groups = np.bincount(part_a[np.searchsorted(end_a, common)], minlength=len(parts))
        n_links = np.bincount(links_of, minlength=len(parts))
        # The groups as text: tokens in their order, each with the sign that follows it.
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")
        place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        order, sign = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        order[place_a], order[place_b] = a, b
        sign[place_a] = np.where(common[group_a] == end_a, ord("|"), ord(","))
        sign[place_b] = np.where(common[group_b] == end_b, ord(";"), ord(","))
        text, stop = self.decimals.joined(order), np.cumsum(self.decimals.size[order])
        text[stop - 1] = sign
        raw, tokens_of = text.tobytes(), np.append(0, np.cumsum(np.where(good, many[0] + many[1], 0)))
        bounds = np.append(0, stop)[tokens_of].tolist()
        self.groups += [raw[x : max(x, y - 1)] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        for column, values in ((self.n_a, many[0]), (self.n_b, many[1]), (self.n_groups, np.where(good, n_groups, -1)), (self.n_links, n_links), (self.pairs, links)):
            column.frombytes(values.astype(np.int64).tobytes())
        self.first.frombytes((self.first[-1] + np.cumsum(n_links)).astype(np.int64).tobytes())

    def places(self, parts: list[bytes]) -> np.ndarray:
        """The number of each of the distinct parts."""
        if len(self.known) > self.most:
            self._clear()
        new = [p for p in parts if p not in self.known]
        for lo in range(0, len(new), 4000):
            some = new[lo : lo + 4000]
            self.known.update(zip(some, range(len(self.groups), len(self.groups) + len(some)), strict=True))
            self._learn(some)
        return np.array([self.known[p] for p in parts], np.int64)

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """(number of each text's parts, the distinct parts, which of them each part is) of texts that are not empty, a space before each."""
        bounds = offsets - offsets[0] + np.arange(len(offsets))
        full = np.full(bounds[-1], 0x20, np.uint8)
        inside = np.ones(len(full), bool)
        inside[bounds[:-1]] = False
        full[inside] = data[offsets[0] : offsets[-1]]
        cut = np.zeros(len(full), bool)
        if self.by_words:
            after = full[2:]
            # What begins with one of four bytes may be white space beyond ASCII.
            cut[1:-1] = (full[1:-1] == 0x20) & (full[:-2] != 0x20) & (after > 0x20) & ~np.isin(after, [0xC2, 0xE1, 0xE2, 0xE3])
            last = bounds[1:] - 1
            cut[last] = False
        cut[bounds[:-1]] = True
        start = np.flatnonzero(cut)
        column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(full))), pa.py_buffer(full)]).dictionary_encode()
        return np.diff(np.searchsorted(start, bounds)), column.dictionary.to_pylist(), column.indices.to_numpy(zero_copy_only=False)


_aligners: dict[tuple[str, int], Aligner] = {}


def _aligner(a: str, b: bytes, key: str, parts: int) -> Aligner:
    """A worker's aligner for these vocabularies, made once."""
    if (key, parts) not in _aligners:
        _aligners.clear()
        _aligners[key, parts] = Aligner(a, b, parts)
    return _aligners[key, parts]


_DOCUMENT, _PAIRS, _VECTOR = 0, 1, 2
_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
_SCHEMA = f"kind int, block long, doc_id long, {' '.join(f'{n} long,' for n in _NUMBERS)} groups_sha256 string, own binary, own_n binary, pairs binary, pairs_n binary"
_NAMES = ["kind", "block", "doc_id", *_NUMBERS, "groups_sha256", "own", "own_n", "pairs", "pairs_n"]


def _rows_of(kind: int, block: int, own: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    packed = [pa.array([x.tobytes()], pa.binary()) for x in (own[0].astype(np.int32), own[1].astype(np.int64), pairs[0], pairs[1].astype(np.int64))]
    none = pa.array([None], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block]), none, *[none] * len(_NUMBERS), pa.array([None], pa.string()), *packed], names=_NAMES)


def _aligned(a: str, b: bytes, key: str, parts: int, block_bytes: int):
    """A row for each of (doc_id, text), one with the distinct pairs of each block and one with the task's counts of same-bytes pairs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a, b, key, parts)
        wide, vector = len(aligner.bytes_b), np.zeros(len(aligner.bytes_a), np.int64)
        block, size, seen = TaskContext.get().partitionId() << 24, 0, []
        none = np.zeros(0, np.int64)

        def ended() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(seen), return_counts=True)
            return _rows_of(_PAIRS, block, (none, none), (codes, n))

        for batch in T.slices(batches):
            data, at = T.strings(batch.column(1))
            for lo, hi in T.chunks(at):
                full = lo + np.flatnonzero(np.diff(at[lo : hi + 1]) > 0)
                n, numbers, shas = hi - lo, np.zeros((4, hi - lo), np.int64), [""] * (hi - lo)
                which, code, times = none, none, none
                if len(full):
                    count, distinct, index = aligner.parts(data, np.append(at[full], at[hi]))
                    part = aligner.places(distinct)[index]
                    doc = np.repeat(full - lo, count)
                    bad = np.unique(doc[np.frombuffer(aligner.n_groups, np.int64)[part] < 0]).tolist()
                    whole = []  # texts as one part each
                    for d in bad:
                        text = b" " + data[at[lo + d] : at[lo + d + 1]].tobytes()
                        aligner._learn([text])
                        whole += [(d, len(aligner.groups) - 1)] * (aligner.n_groups[-1] >= 0)
                    if bad:
                        good = ~np.isin(doc, bad)
                        doc, part = np.append(doc[good], [d for d, _ in whole]).astype(np.int64), np.append(part[good], [p for _, p in whole]).astype(np.int64)
                        order = np.argsort(doc, kind="stable")
                        doc, part = doc[order], part[order]
                    columns = [np.frombuffer(x, np.int64) for x in (aligner.n_a, aligner.n_b, aligner.n_groups, aligner.n_links)]
                    numbers = np.stack([np.bincount(doc, x[part], n).astype(np.int64) for x in columns])
                    bounds = np.searchsorted(doc, np.arange(n + 1))
                    listed = part.tolist()
                    for d in range(n):
                        if bounds[d] < bounds[d + 1]:
                            shas[d] = hashlib.sha256(b";".join([aligner.groups[p] for p in listed[bounds[d] : bounds[d + 1]]])).hexdigest()
                    # Pairs of each document, once each with how often it has them.
                    total = len(aligner.groups)
                    held, often = np.unique(doc * total + part, return_counts=True)
                    first, pairs = np.frombuffer(aligner.first, np.int64), np.frombuffer(aligner.pairs, np.int64)
                    begin, many = first[held % total], first[held % total + 1] - first[held % total]
                    flat = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())
                    link = np.repeat(held // total, many) * (len(vector) * wide) + pairs[flat]
                    link, back = np.unique(link, return_inverse=True)
                    times = np.bincount(back, np.repeat(often, many), len(link)).astype(np.int64)
                    which, code = link // (len(vector) * wide), link % (len(vector) * wide)
                    del columns, first, pairs  # views: the arrays may grow again
                same = aligner.same[code // wide] == code % wide
                np.add.at(vector, code[same] // wide, 1)
                seen.append(code[~same])
                packed = []
                for of, values in ((same, (code // wide).astype(np.int32)), (same, times), (~same, code), (~same, times)):
                    cut = np.searchsorted(which[of], np.arange(n + 1)).tolist()
                    chosen = values[of]
                    packed.append(pa.array([chosen[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, _DOCUMENT, np.int32)), pa.array(np.full(n, block)), batch.column(0).slice(lo, n), *[pa.array(x) for x in numbers],
                        pa.array(shas, pa.string()), *packed,
                    ], names=_NAMES,
                )
                size += int(at[hi] - at[lo])
                if size >= block_bytes:
                    yield ended()
                    block, size, seen = block + 1, 0, []
        if seen:
            yield ended()
        ids = np.flatnonzero(vector)
        if len(ids):
            yield _rows_of(_VECTOR, block, (ids, vector[ids]), (none, none))

    return rows


def _spread(first: str, second: str, narrow: bool):
    """A row for each number in two packed columns of (block, first, second)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, x, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                codes, n = np.frombuffer(x, np.int32 if narrow else np.int64).astype(np.int64), np.frombuffer(y, np.int64)
                for lo in range(0, len(codes), 1 << 16):
                    part = slice(lo, lo + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes[part]), block)), pa.array(codes[part]), pa.array(n[part])], names=["block", first, second])

    return rows


_RESULT = f"doc_id long, {' '.join(f'{n} long,' for n in _NUMBERS)} n_best long, count_sum long, groups_sha256 string"


def _judged(same: np.ndarray, best: np.ndarray, wide: int):
    """The documents of a block with what their links count: (its documents, its pairs with their counts)."""

    def rows(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        order = np.argsort(code := pairs.column("code").to_numpy())
        code, count = code[order], pairs.column("c").to_numpy()[order]
        total, top = [], []
        for own, own_n, link, link_n in zip(*(docs.column(x).to_pylist() for x in ("own", "own_n", "pairs", "pairs_n")), strict=True):
            own, own_n, link, link_n = np.frombuffer(own, np.int32), np.frombuffer(own_n, np.int64), np.frombuffer(link, np.int64), np.frombuffer(link_n, np.int64)
            c = count[np.searchsorted(code, link)] if len(link) else link
            total.append(int(own_n @ same[own] + link_n @ c))
            top.append(int(own_n[same[own] == best[own]].sum() + link_n[c == best[link // wide]].sum()))
        columns = [docs.column(x) for x in ("doc_id", *_NUMBERS)]
        return pa.table([*columns, pa.array(top, pa.int64()), pa.array(total, pa.int64()), docs.column("groups_sha256")], names=["doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256"])

    return rows


def align(docs: DataFrame, *, a: str = BYTE_BPE, b: str = PIECE_BPE, block_bytes: int = BLOCK_BYTES, parts: int = PARTS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of docs (doc_id, text, ...).

    n_best: links whose pair is the one that most documents of the corpus hold among those of its A token; count_sum: documents that hold a
    link's pair, over all links.
    """
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        text_a, bytes_b = f.read(), g.read()
    key = hashlib.sha256(text_a.encode() + bytes_b).hexdigest()
    known = Aligner(text_a, bytes_b, parts)
    wide, length = len(known.bytes_b), len(known.bytes_a)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(docs.mapInArrow(_aligned(text_a, bytes_b, key, parts, block_bytes), _SCHEMA))
    own = rows.filter(F.col("kind") == _VECTOR).select("block", "own", "own_n").mapInArrow(_spread("id", "n", True), "block long, id long, n long")
    same = np.zeros(length, np.int64)
    for r in own.groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row for each id of A at most, as below
        same[r["id"]] = r["n"]
    held = rows.filter(F.col("kind") == _PAIRS).select("block", "pairs", "pairs_n").mapInArrow(_spread("code", "n", False), "block long, code long, n long")
    counts = stored(held.groupBy("code").agg(F.sum("n").alias("c")))
    best = same.copy()
    for r in counts.groupBy(F.expr(f"code div {wide}").alias("id")).agg(F.max("c").alias("c")).collect():
        best[r["id"]] = max(best[r["id"]], r["c"])
    told = held.select("block", "code").join(counts, "code").select("block", "code", "c")
    kept = rows.filter(F.col("kind") == _DOCUMENT).drop("kind")
    return kept.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_judged(same, best, wide), _RESULT)
