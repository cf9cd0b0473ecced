"""Sampled segmentation into the pieces of a SentencePiece model, and lossless decoding.

A text is cut into tokens before each space that follows another character (no piece of a model reaches over such a
place; where one does, the whole text is one token). The pieces of a token are a path through its
lattice; a path's weight is the product of its pieces' weights, 1 / (rank + 2) ** sharpness by the
model's order. Forward filtering sums the weights of all paths to every place, as logarithms, so that tokens may be as long as the text; backward sampling
then draws the last piece by its share of that sum, and so on to the front. Draws are hashes of the
row's key, the token's place and the step, so a row's segmentation is the same wherever and
whenever it is made. Characters that no piece covers are written as byte pieces, and so is a literal
U+2581, which stands for a space in pieces: decoding gives back every text exactly.

Distinct tokens of a chunk have their lattices built once, all tokens are drawn in step. The model file is
read on the driver (its path is a parameter); tables of pieces travel with the tasks, a megabyte or so.

Defined cases: null and empty texts have no pieces and decode to the empty text; a null key is a
key of its own; rows that repeat a key and text get the same pieces; extra columns are kept, but one that is called like
the result gives way to it; an empty table stays empty; sequences of ids that are not UTF-8 decode with replacement characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as Ty

from causeway.llm import text as T

U64 = T.U64
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK, SMALL_CHUNK = 1 << 19, 1 << 17
BYTE_WEIGHT = 1e-5
_SPACE = "▁"
_GOLDEN = U64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Pieces:
    """Bytes of each id (joined, with bounds), its weight, the ids of byte pieces, which ids encoding may use, and whether
    none of these has a space after another character."""

    data: np.ndarray
    bounds: np.ndarray
    weight: np.ndarray
    byte_ids: np.ndarray
    usable: np.ndarray
    by_words: bool

    @staticmethod
    def load(path: str = MODEL, sharpness: float = 1.0) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts, usable, byte_ids = [], [], np.zeros(256, np.int32)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                byte_ids[value] = i
                texts.append(bytes([value]))
                usable.append(False)
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                texts.append(b"")
                usable.append(False)
            else:
                texts.append(piece.replace(_SPACE, " ").encode())
                usable.append(len(texts[-1]) > 0)
        rank = np.cumsum(np.array(usable)) - 1.0
        weight = (rank + 2.0) ** -sharpness
        by_words = not any(b" " in t.lstrip(b" ") for t, u in zip(texts, usable, strict=True) if u)
        return Pieces(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), weight, byte_ids, np.array(usable), by_words)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and bounds of the texts ids[offsets[i]:offsets[i + 1]]."""
        size = self.bounds[ids + 1] - self.bounds[ids]
        ends = np.append(0, np.cumsum(size))
        at = np.repeat(self.bounds[ids] - ends[:-1], size) + np.arange(ends[-1])
        return self.data[at], ends[offsets]


class _Set:
    """Places of hashes in a sorted array, found from their upper bits."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray | None = None) -> None:
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], None if values is None else values[order]
        upper = (self.hashes >> U64(44)).astype(np.int64)
        counts = np.bincount(upper, minlength=1 << 20)
        self.most = int(counts.max(initial=0))
        self.some = counts > 0
        self.first = (np.cumsum(counts) - counts).astype(np.int32)
        self.hashes = np.append(self.hashes, np.zeros(self.most, U64))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of hashes that are in the set, their places in it)."""
        upper = (hashes >> U64(44)).astype(np.int64)
        maybe = np.flatnonzero(self.some[upper])
        at, h = self.first[upper[maybe]].astype(np.int64), hashes[maybe]
        out = np.full(len(maybe), -1)
        for k in range(self.most):
            out = np.where(self.hashes[at + k] == h, at + k, out)
        hit = out >= 0
        return maybe[hit], out[hit]


class Sampler:
    """Encodes chunks of texts; built once in a task."""

    def __init__(self, pieces: Pieces, seed: int) -> None:
        self.pieces, self.seed = pieces, U64(seed & (1 << 64) - 1)
        ids = np.flatnonzero(pieces.usable)
        sums = T.rolling(pieces.data)
        start, end = pieces.bounds[ids], pieces.bounds[ids + 1]
        self.whole = _Set(T.spans(sums, start, end), ids)
        size = end - start
        own = np.repeat(start, size)
        stop = own + np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + 1
        self.beginnings = _Set(np.unique(T.spans(sums, own, stop)))

    def _tokens(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """First bytes of tokens; texts are not empty."""
        new = np.zeros(len(data), bool)
        if self.pieces.by_words:
            space = data == 0x20
            new[1:] = space[1:] & ~space[:-1]
        new[offsets[:-1]] = True
        return np.flatnonzero(new)

    def encode(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the texts of a chunk."""
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        rows = len(offsets) - 1
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        if not len(full):
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        bounds = np.append(offsets[full], len(data))
        start = self._tokens(data, bounds)
        size = np.diff(np.append(start, len(data)))
        row = np.repeat(full, np.diff(np.searchsorted(start, bounds)))
        _, first, which = np.unique(T.spans(T.rolling(data), start, start + size), return_index=True, return_inverse=True)
        last, cdf, edge_from, edge_id, edge_first = self._lattice(data, start[first], size[first])
        # All tokens walk back in step.
        nth = np.arange(len(start)) - np.searchsorted(row, row)
        state = T.mix(T.mix(keys[row] + self.seed) + nth.astype(U64) * _GOLDEN)
        live = np.argsort(which, kind="stable")  # equal tokens next to each other: near places in the tables
        which, state = which[live], state[live]
        place, front = last[which], (last - size[first])[which]
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.zeros(len(start), np.int64)
        while len(live):
            u = (T.mix(state + U64((len(steps) + 1) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1)) >> U64(11)).astype(float) * 2.0**-53
            edge = np.searchsorted(cdf, place + u, "right")
            edge = np.clip(edge, edge_first[place], edge_first[place + 1] - 1)
            steps.append((live, edge_id[edge]))
            count[live] += 1
            place = edge_from[edge]
            on = np.flatnonzero(place > front)
            live, place, front, state = live[on], place[on], front[on], state[on]
        ends = np.cumsum(count)
        ids = np.empty(ends[-1], np.int32)
        for k, (live, id_) in enumerate(steps):
            ids[ends[live] - 1 - k] = id_
        per_row = np.bincount(row, weights=count, minlength=rows).astype(np.int64)
        return ids, np.append(0, np.cumsum(per_row))

    def _lattice(self, data: np.ndarray, start: np.ndarray, size: np.ndarray):
        """Places are numbered through the distinct tokens, size + 1 for each: the last place of each token, and, for
        edges in order of the place where they end, their cumulative shares (with the place's number added), starts and ids."""
        base = np.append(0, np.cumsum(size + 1))
        total = int(base[-1])
        # The tokens' bytes side by side, with a zero byte after each.
        at = np.repeat(start - base[:-1], size + 1) + np.arange(total)
        own = np.ones(total, bool)
        own[base[1:] - 1] = False
        text = np.zeros(total, np.uint8)
        text[own] = data[at[own]]
        left = np.repeat(base[1:] - 1, size + 1) - np.arange(total)
        sums = T.rolling(text)
        lead = own & ((text & 0xC0) != 0x80)
        width = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        alone = np.zeros(total, bool)
        froms, tos, ids = [], [], []
        active = np.flatnonzero(lead)
        n = 1
        while len(active):
            h = T.spans(sums, active, active + n)
            inside, _ = self.beginnings.find(h)
            active, h = active[inside], h[inside]
            hit, place = self.whole.find(h)
            found = active[hit]
            froms.append(found)
            tos.append(found + n)
            ids.append(self.whole.values[place])
            alone[found[width[found] == n]] = True
            n += 1
            active = active[left[active] >= n]
        # Bytes of characters that no piece covers alone.
        covered = alone[np.maximum.accumulate(np.where(lead, np.arange(total), 0))]
        raw = np.flatnonzero(own & ~covered)
        froms.append(raw)
        tos.append(raw + 1)
        ids.append(self.pieces.byte_ids[text[raw]])
        from_, to, id_ = np.concatenate(froms), np.concatenate(tos), np.concatenate(ids)
        weight = np.log(np.where(self.pieces.usable[id_], self.pieces.weight[id_], BYTE_WEIGHT))
        # Forward sums, by the offset at which edges start: their ends differ within one offset.
        offset = from_ - np.repeat(base[:-1], size + 1)[from_]
        order = np.argsort(offset, kind="stable")
        cut = np.append(0, np.cumsum(np.bincount(offset)))
        forward = np.full(total, -np.inf)
        forward[base[:-1]] = 0.0
        share = np.empty(len(from_))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            e = order[a:b]
            end = to[e]
            share[e] = own_ = forward[from_[e]] + weight[e]
            forward[end] = np.logaddexp(forward[end], own_)
        share = np.exp(share - forward[to])
        live = np.flatnonzero(share > 0)
        live = live[np.argsort(to[live], kind="stable")]
        from_, to, id_, share = from_[live], to[live], id_[live], share[live]
        run = np.cumsum(share)
        edge_first = np.append(0, np.cumsum(np.bincount(to, minlength=total)))
        before = np.append(0, run)[edge_first[to]]
        return base[1:] - 1, to + np.minimum(run - before, 1.0), from_, id_.astype(np.int32), edge_first


def encode(docs: DataFrame, *, model: str = MODEL, seed: int = 1, sharpness: float = 1.0, key: str = "doc_id", text: str = "text", out: str = "ids") -> DataFrame:
    """docs with a column `out` of piece ids, sampled by the row's key."""
    pieces = Pieces.load(model, sharpness)
    docs = docs.drop(out)
    at_key, at_text = docs.columns.index(key), docs.columns.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(pieces, seed)
        for batch in T.slices(batches):
            data, at = T.strings(batch.column(at_text))
            keys = T.ids(batch.column(at_key)).view(U64)
            ids, bounds = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
            for lo, hi in T.chunks(at, CHUNK):
                own, ends = sampler.encode(data, at[lo : hi + 1], keys[lo:hi])
                ids.append(own)
                bounds.append(ends[1:] + bounds[-1][-1])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(bounds).astype(np.int32)), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])

    return docs.mapInArrow(rows, Ty.StructType([*docs.schema.fields, Ty.StructField(out, Ty.ArrayType(Ty.IntegerType()))]))


def round_trip(docs: DataFrame, *, model: str = MODEL, seed: int = 1, sharpness: float = 1.0, key: str = "doc_id", text: str = "text", out: str = "ids", lossless: str = "lossless") -> DataFrame:
    """docs without `text`, with columns `out` of its piece ids and `lossless`: whether these decode to it. One pass, which holds the lattices and
    results of `SMALL_CHUNK` bytes of text (or of one text) at a time."""
    pieces = Pieces.load(model, sharpness)
    docs = docs.drop(out, lossless)
    at_key, at_text = docs.columns.index(key), docs.columns.index(text)
    kept = [i for i in range(len(docs.columns)) if i != at_text]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(pieces, seed)
        for batch in T.slices(batches, 250):
            data, at = T.strings(batch.column(at_text))
            keys = T.ids(batch.column(at_key)).view(U64)
            for lo, hi in T.chunks(at, SMALL_CHUNK):
                ids, bounds = sampler.encode(data, at[lo : hi + 1], keys[lo:hi])
                back, ends = pieces.decode(ids, bounds)
                same = np.diff(ends) == np.diff(at[lo : hi + 1])
                if not same.all() or not np.array_equal(back, data[at[lo] : at[hi]]):
                    same = np.array([back[ends[i] : ends[i + 1]].tobytes() == data[at[lo + i] : at[lo + i + 1]].tobytes() for i in range(hi - lo)], bool)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in kept), lists, pa.array(same)], names=[*(batch.schema.names[i] for i in kept), out, lossless])

    fields = [docs.schema.fields[i] for i in kept]
    return docs.mapInArrow(rows, Ty.StructType([*fields, Ty.StructField(out, Ty.ArrayType(Ty.IntegerType())), Ty.StructField(lossless, Ty.BooleanType())]))


def decode(docs: DataFrame, *, model: str = MODEL, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with a column `out`: the text of the piece ids."""
    pieces = Pieces.load(model)
    docs = docs.drop(out)
    at_ids = docs.columns.index(ids)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            column = pa.array([x or [] for x in batch.column(at_ids).to_pylist()], pa.list_(pa.int32())) if batch.column(at_ids).null_count else batch.column(at_ids)
            bounds = column.offsets.to_numpy().astype(np.int64)
            values = column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
            data, ends = pieces.decode(values, bounds - bounds[0])
            try:
                texts = pa.Array.from_buffers(pa.string(), len(batch), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
                texts.validate(full=True)
            except pa.ArrowInvalid:
                raw = data.tobytes()
                texts = pa.array([raw[a:b].decode(errors="replace") for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, out])

    return docs.mapInArrow(rows, Ty.StructType([*docs.schema.fields, Ty.StructField(out, Ty.StringType())]))
