"""Text quality from compression with two dictionaries.

One zstandard dictionary is built from well-labelled texts, one from badly labelled ones. A text is
cut into blocks of a few hundred bytes (so that a long text can't become its own dictionary), each
block is compressed with both, and the sizes are summed over the whole text. The normalised
difference (bad - good) / (bad + good), with the log of the better compressed share as a second
input, goes through a logistic calibration fitted on labelled texts that the dictionaries have not
seen, weighted to the classes' shares among all labels.

The model is fitted on a bounded sample: at most `per_class` texts of each class for the
dictionaries and as many for the calibration, the first by a hash of their id, and `tables.SAMPLE_BYTES` of text in
all. Everything else covers all rows. Defined cases: a null or empty text gets the calibrated score of a zero difference;
null labels are not used, of several labels of an id the smallest counts; without labels of both classes every score is the share of good labels
(0.5 without labels); rows that repeat an id are scored each, texts that are equal get equal scores, a score of exactly 0.7 counts as good; very long texts are
compressed as a whole, block by block; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm import text as T
from causeway.llm.tables import labelled_sample

BLOCK, LEVEL, DICTIONARY_BYTES, PER_CLASS = 256, 1, 1 << 16, 1000
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are kept for measuring."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (self.bad, self.good)]

    def scores(self, sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """sizes: bad and good for each text."""
        if not self.good:
            return np.full(len(n), self.weights[0])
        x = (_inputs(sizes, n) - self.mean) / self.scale
        return _sigmoid(x @ np.array(self.weights[1:]) + self.weights[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def _sizes(compressors: list[zstandard.ZstdCompressor], text: bytes) -> list[int]:
    blocks = _blocks(text)
    return [sum(len(c.compress(b)) for b in blocks) for c in compressors]


def _inputs(sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
    bad, good = sizes[:, 0], sizes[:, 1]
    d = (bad - good) / (bad + good + 1)
    c = np.where(n > 0, np.log(np.minimum(bad, good) / np.maximum(n, 1) + 1e-3), 0)
    return np.stack([d, d * d, c, c * c, c * d], axis=1)


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a logistic model with the least penalised loss: Newton's method, each step halved until the loss falls enough."""
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - y * z) + ridge / 2 * w @ w)

    now = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -700, 700)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        step = -np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        share, falls = 1.0, float(slope @ step)
        while share > 1e-12 and loss(w + share * step) > now + 1e-4 * share * falls:
            share /= 2
        w = w + share * step
        before, now = now, loss(w)
        if before - now <= 1e-10 * (1 + abs(now)):
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS) -> Model:
    """labels: (doc_id, label), 1 for good and 0 for bad; at most 4 * per_class texts come to the driver, SAMPLE_BYTES in all."""
    rows, counts = labelled_sample(docs, labels, 2 * per_class)
    texts = {y: [(t or "").encode() for _, t, label in rows if label == y] for y in (0, 1)}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    blocks = {y: [b for t in texts[y][::2] for b in _blocks(t)] for y in (0, 1)}
    try:
        dicts = {y: zstandard.train_dictionary(DICTIONARY_BYTES, blocks[y]).as_bytes() for y in (0, 1)}
    except (zstandard.ZstdError, ValueError):  # too little text to train on: the texts themselves
        dicts = {y: b"".join(blocks[y])[-DICTIONARY_BYTES:] for y in (0, 1)}
        if not all(len(d) >= 8 for d in dicts.values()):
            return Model(b"", b"", (share,), (), ())
    model = Model(dicts[1], dicts[0], (), (), ())
    held = [(t, y) for y in (0, 1) for t in (texts[y][1::2] or texts[y])]
    compressors = model.compressors()
    sizes, n = np.array([_sizes(compressors, t) for t, _ in held], float), np.array([len(t) for t, _ in held])
    y = np.array([y for _, y in held], float)
    x = _inputs(sizes, n)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w = calibrated(x, y, weight)
    return Model(dicts[1], dicts[0], tuple(map(float, w)), tuple(map(float, mean)), tuple(map(float, scale)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of docs (doc_id, text, ...)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors() if model.good else []
        for batch in T.slices(batches):
            data, at = T.strings(batch.column(1))
            sizes, view = np.zeros((len(batch), 2)), data.tobytes()
            if compressors:
                for i in range(len(batch)):
                    sizes[i] = _sizes(compressors, view[at[i] : at[i + 1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(sizes, np.diff(at)))], names=["doc_id", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(rows, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) with labels (doc_id, quality) of rows that are not held out."""
    seen = labels.filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("label"))
    scored = score(docs, fit(docs, seen))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
