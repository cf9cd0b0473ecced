"""Byte-level helpers that run inside tasks: words, hashes and chunks of an Arrow string column.

A word's hash is SipHash-1-3 of its bytes (BLAKE2b, beyond `SIP_BYTES`), so two words that hash alike cost as much to find
as for any 64-bit hash; hashes of several words mix theirs one into the other, which is no polynomial. All are
the same on every machine and in every session. `rolling` and `spans` serve short stretches of bytes only (pieces of a
vocabulary, beginnings of words). A null text is an empty text.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts of one chunk are handled together; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits each depend on all input bits."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """b**i and b**-i modulo 2**64 for an odd b; the tables grow to the longest text seen."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = self._table(self.base, 1 << 12), self._table(self.inverse, 1 << 12)

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        steps = np.full(n, base, dtype=U64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    def need(self, n: int) -> None:
        if n > len(self.up):
            n = 1 << (n - 1).bit_length()
            self.up, self.down = self._table(self.base, n), self._table(self.inverse, n)


_BYTES = Powers(0x9E3779B97F4A7C15)
SIP_BYTES = 64
# The starting state of SipHash for the key 0.
_SIP = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)


def _left(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U64(n)) | (x >> U64(64 - n))


def _sip_round(v: list[np.ndarray]) -> None:
    a, b, c, d = v
    a, c = a + b, c + d
    b, d = _left(b, 13) ^ a, _left(d, 16) ^ c
    a = _left(a, 32) + d
    c = c + b
    v[:] = a, _left(b, 17) ^ c, _left(c, 32), _left(d, 21) ^ a


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each data[start:end]."""
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    size = end - start
    state = [np.full(len(start), x, U64) for x in _SIP]
    at, lane = slice(None), 0
    while True:
        left = size[at] - 8 * lane
        word = eight[np.minimum(start[at] + 8 * lane, len(data))]
        last = left < 8
        tail = left[last].astype(U64)
        word[last] = (word[last] & ((U64(1) << (tail * U64(8))) - U64(1))) | ((size[at][last].astype(U64) & U64(255)) << U64(56))
        v = [x[at] for x in state]
        v[3] = v[3] ^ word
        _sip_round(v)
        v[0] = v[0] ^ word
        for x, y in zip(state, v, strict=True):
            x[at] = y
        lane += 1
        at = np.flatnonzero((size >= 8 * lane) & (size <= SIP_BYTES))
        if not len(at):
            break
    state[2] = state[2] ^ U64(255)
    for _ in range(3):
        _sip_round(state)
    out = state[0] ^ state[1] ^ state[2] ^ state[3]
    for i in np.flatnonzero(size > SIP_BYTES).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


class Words(NamedTuple):
    """Words of several texts: byte places in `data`, hashes, and where each text's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # len(texts) + 1

    def of(self, i: int) -> slice:
        return slice(self.first[i], self.first[i + 1])


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and len + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes, at least one row each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def rolling(data: np.ndarray) -> np.ndarray:
    """Sums S such that (S[e] - S[s]) * b**-s identifies data[s:e], where that is short."""
    n = len(data)
    _BYTES.need(n + 1)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(_BYTE[data] * _BYTES.up[:n], out=sums[1:])
    return sums


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _BYTES.down[start])


def words(data: np.ndarray, offsets: np.ndarray, *, lower: bool = False) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of the texts data[offsets[i]:offsets[i + 1]]; `lower` folds A-Z only."""
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none.astype(U64), np.zeros(len(offsets), np.int64))
    space = _SPACE[data]
    before, after = np.empty_like(space), np.empty_like(space)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = True
    after[inner - 1] = True
    np.logical_not(space, out=space)
    start, end = np.flatnonzero(space & before), np.flatnonzero(space & after) + 1
    return Words(data, start, end, word_hashes(data, start, end), np.searchsorted(start, offsets))


def codes(w: Words) -> np.ndarray:
    """A number for each word, the same for equal words only."""
    bounds = np.append(0, np.cumsum(w.end - w.start))
    edge = np.zeros(len(w.data) + 1, np.int8)
    edge[w.start] += 1
    edge[w.end] -= 1
    joined = w.data[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    return pa.Array.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(joined)]).dictionary_encode().indices.to_numpy()


def column(w: Words) -> pa.Array:
    """The words as a string column."""
    bounds = np.append(0, np.cumsum(w.end - w.start)).astype(np.int64)
    edge = np.zeros(len(w.data) + 1, np.int8)
    edge[w.start] += 1
    edge[w.end] -= 1
    return pa.Array.from_buffers(pa.large_string(), len(w.start), [None, pa.py_buffer(bounds), pa.py_buffer(w.data[np.cumsum(edge[:-1], dtype=np.int8) > 0])])


def _two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a + U64(0x9E3779B97F4A7C15)) + b)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, from those of runs of 1, 2, 4, ... words."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.zeros(0, U64)
    run, size, done, out = hashes, 1, 0, None
    while True:
        if k & size:
            part = run[done : done + n]
            out = part if out is None else _two(out, part)
            done += size
        if done == k:
            return mix(out + U64(k))
        run, size = _two(run[:-size], run[size:]), 2 * size


def exact_grams(code: np.ndarray, k: int) -> np.ndarray:
    """A number for each k consecutive words, given by their codes, the same for equal words only."""
    n = len(code) - k + 1
    if n < 1:
        return np.zeros(0, np.int64)
    out = code[:n].astype(np.int64)
    for i in range(1, k):
        out = np.unique(out * (int(code.max()) + 1) + code[i : i + n], return_inverse=True)[1]
    return out


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The sorted set of hashed k-word shingles of one text; of a shorter text, its whole sequence; of none, empty."""
    n = len(hashes)
    return np.unique(grams(hashes, min(k, n))) if n else np.zeros(0, U64)


def ids(column: pa.Array) -> np.ndarray:
    """Signed 64-bit ids; null counts as larger than every id."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def release() -> None:
    """Gives memory that a worker has freed back to the system; workers serve many tasks, and would keep the most that one of them took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], size: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows, at most `size` at a time: what a task makes of a batch follows them. Memory is given back after each batch."""
    for batch in batches:
        for at in range(0, max(1, len(batch)), size):
            yield batch.slice(at, size)
        del batch
        release()


def plain_bytes(w: Words) -> tuple[bytes, np.ndarray]:
    """The words one after another, each with a space after it, and where each begins (and the last ends)."""
    size = w.end - w.start
    begin = np.append(0, np.cumsum(size + 1))
    out = np.full(begin[-1], 0x20, np.uint8)
    inside = np.ones(begin[-1], bool)
    inside[begin[1:] - 1] = False
    edge = np.zeros(len(w.data) + 1, np.int8)
    edge[w.start] += 1
    edge[w.end] -= 1
    out[inside] = w.data[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    return out.tobytes(), begin


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def digests(w: Words, first: np.ndarray, size: int) -> np.ndarray:
    """The 128-bit BLAKE2b digest of the `size` words from each of `first`, as two numbers."""
    raw, begin = plain_bytes(w)
    at, to = begin[first].tolist(), (begin[first + size] - 1).tolist()
    out = b"".join([digest(raw[a:b]) for a, b in zip(at, to, strict=True)])
    return np.frombuffer(out, "<u8").reshape(-1, 2)
