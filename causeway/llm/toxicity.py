"""Toxicity by a chain of linear classifiers.

The categories are predicted in a fixed order. Each is a logistic regression on the presence of
hashed word features (the lower-cased word without outer punctuation, and its first four to six
bytes, which catch inflected and coined forms), and on the log-odds of all earlier categories. For
training, those come from models that have not seen the row (folds by a hash of the id); for
scoring, from the models fitted on all rows. A feature is kept if its texts are dealt to the classes
more unevenly than chance would (likelihood ratio G of LEAST_G or more), the highest G first; a fold's models choose
theirs without the fold's rows.

Labels say only whether a text is toxic. The kinds of toxicity before it in the chain are labelled by a few plain words
(`KINDS`): a text is of a kind if it is labelled toxic and has one of them. Other labels can be given instead.

Models are fitted on a bounded sample of labelled texts (`per_class` of each value of the last
category), weighted to the classes' shares among all labels. Spark takes the sample's features and
counts them by class and fold; only the places of the chosen ones come to the driver, which fits the weights.
Scoring covers every word of every text. Defined cases: a null or blank text gets the models' intercepts; rows with a null label
are not used, of several labels of an id the smallest counts; a category without both labels gets a constant probability, without any labels nearly 0; rows
that repeat an id are scored each by their own text (of a labelled id's texts the smallest is fitted on); extra columns are
kept by `reject`, whatever they are called, and ignored by `toxicity`; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm import text as T
from causeway.llm.tables import sampled_ids, sampled_texts
from causeway.storage import stored

U64 = T.U64
PER_CLASS, FEATURES, LEAST_G, FOLDS = 3000, 4096, 20.0, 5
PREFIXES = (4, 5, 6)
#: Log-odds of all categories where there are no labels: nothing is toxic.
NO_LABELS = -10.0
_OUTER = np.zeros(256, bool)
_OUTER[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each feature, its hash) for every word."""
    w = T.words(data, offsets, lower=True)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
    start, end = w.start.copy(), w.end.copy()
    for _ in range(3):  # up to three signs at each side
        start += (start < end) & _OUTER[w.data[np.minimum(start, len(w.data) - 1)]] if len(start) else 0
        end -= (start < end) & _OUTER[w.data[end - 1]] if len(end) else 0
    live = start < end
    text, start, end = text[live], start[live], end[live]
    sums = T.rolling(w.data)
    texts, hashes = [text], [T.spans(sums, start, end)]
    for k in PREFIXES:
        longer = np.flatnonzero(end - start > k)
        texts.append(text[longer])
        hashes.append(T.mix(T.spans(sums, start[longer], start[longer] + k) + U64(k)))
    return np.concatenate(texts), np.concatenate(hashes)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, features, rest) of (doc_id, text, rest)."""
    for batch in T.slices(batches):
        data, at = T.strings(batch.column(1))
        sets: list[np.ndarray] = []
        for lo, hi in T.chunks(at):
            text, hashes = features(data, at[lo : hi + 1])
            order = np.argsort(text, kind="stable")
            bounds = np.searchsorted(text[order], np.arange(hi - lo + 1))
            sets += [np.unique(hashes[order[a:b]]).view(np.int64) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64())), *batch.columns[2:]], names=["doc_id", "features", *batch.schema.names[2:]])


def _places(known: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _Lookup(known)
        for batch in batches:
            column = batch.column(1)
            bounds = column.offsets.to_numpy().astype(np.int64)
            values = column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]].view(U64)
            text, at = look(np.repeat(np.arange(len(batch)), np.diff(bounds)), values)
            own = np.searchsorted(text, np.arange(len(batch) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([at[a:b] for a, b in zip(own[:-1], own[1:], strict=True)], pa.list_(pa.int64()))], names=["doc_id", "places"])

    return rows


def _uneven(sample: DataFrame, y: np.ndarray, fold: np.ndarray, categories: Sequence[str]) -> list[np.ndarray]:
    """The hashes of at most FEATURES features of sample (features, fold, categories), those whose shares differ most: without the rows
    of fold 0, 1, ... and, last, of all rows."""
    columns = [F.count_if(F.col("fold") == k).alias(f"_n{k}") for k in range(FOLDS)] + [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"_{i}_{k}") for i, c in enumerate(categories) for k in range(FOLDS)]
    counted = stored(sample.select(F.explode("features").alias("feature"), "fold", *categories).groupBy("feature").agg(*columns))

    def part(seen, expected):
        return seen * F.log(F.greatest(seen, F.lit(1e-9)) / F.greatest(expected, F.lit(1e-9)))

    def sum_of(prefix: str, without: int):
        return sum((F.col(f"{prefix}{k}") for k in range(FOLDS) if k != without), F.lit(0)).cast("double")

    found = []
    for without in range(FOLDS + 1):
        rows, n = fold != without, sum_of("_n", without)
        shares = [float(y[rows, i].mean()) if rows.any() else 0.0 for i in range(len(categories))]
        of = [sum_of(f"_{i}_", without) for i in range(len(categories))]
        g = F.greatest(F.lit(0.0), *(2 * (part(x, n * p) + part(n - x, n * (1 - p))) for x, p in zip(of, shares, strict=True)), F.lit(0.0))
        best = counted.select("feature", g.alias("g")).filter(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "feature").limit(FEATURES)
        found.append(np.sort(np.array([r["feature"] for r in best.collect()], np.int64).view(U64)))
    return found


class _Lookup:
    """Places of hashes in a sorted array of few."""

    def __init__(self, known: np.ndarray) -> None:
        self.known = known
        self.bits = np.zeros(1 << 18, bool)
        self.bits[(known >> U64(46)).astype(np.int64)] = True

    def __call__(self, text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, place)."""
        if not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.bits[(hashes >> U64(46)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, hashes[maybe]), len(self.known) - 1)
        hit = self.known[at] == hashes[maybe]
        both = np.unique(text[maybe[hit]] * len(self.known) + at[hit])
        return both // len(self.known), both % len(self.known)


@dataclass(frozen=True)
class Chain:
    """For each category its intercept, its weights on the features, and on the log-odds of earlier categories."""

    categories: tuple[str, ...]
    known: np.ndarray
    intercepts: np.ndarray
    weights: np.ndarray
    on_earlier: np.ndarray

    def odds(self, text: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Log-odds of n texts, a column for each category."""
        out = np.zeros((n, len(self.categories)))
        for c in range(len(self.categories)):
            out[:, c] = self.intercepts[c] + np.bincount(text, weights=self.weights[c][at], minlength=n) + out[:, :c] @ self.on_earlier[c, :c]
            out[:, c] = np.clip(out[:, c], -30, 30)
        return out


def _fit(text: np.ndarray, at: np.ndarray, chosen: np.ndarray, earlier: np.ndarray, y: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic regression with a ridge, on some rows and the features that are chosen, by gradient steps of adapted length."""
    n_features = len(chosen)
    use = np.zeros(len(y), bool)
    use[rows] = True
    total = weight[use].sum()
    share = np.clip((weight * y)[use].sum() / max(total, 1e-9), 1e-4, 1 - 1e-4)
    b, w, v = float(np.log(share / (1 - share))), np.zeros(n_features), np.zeros(earlier.shape[1])
    if share <= 1e-4 or share >= 1 - 1e-4:
        return b, w, v
    own = use[text] & chosen[at]
    text, at = text[own], at[own]
    m, s = np.zeros(1 + n_features + len(v)), np.zeros(1 + n_features + len(v))
    for i in range(1, 161):
        z = b + np.bincount(text, weights=w[at], minlength=len(y)) + earlier @ v
        e = np.where(use, weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y), 0) / total
        g = np.concatenate([[e.sum()], np.bincount(at, weights=e[text], minlength=n_features) + 1e-4 * w, e @ earlier + 1e-3 * v])
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        step = 0.08 * (m / (1 - 0.9**i)) / (np.sqrt(s / (1 - 0.99**i)) + 1e-8)
        b, w, v = b - step[0], w - step[1 : 1 + n_features], v - step[1 + n_features :]
    return b, w, v


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], *, derive: Mapping[str, str] | None = None, per_class: int = PER_CLASS) -> Chain:
    """labels: (doc_id, a 0/1 column for each category that is not in `derive`); the sample is drawn by the last category. A category
    of `derive` holds where the last one does and the text matches its pattern."""
    derive = dict(derive or {})
    given, last = [c for c in categories if c not in derive], categories[-1]
    drawn, counts = sampled_ids(labels.select("doc_id", F.col(last).cast("int").alias("label")), per_class)
    spark = docs.sparkSession
    few = F.broadcast(spark.createDataFrame([(i,) for i, _ in drawn], "doc_id long"))
    known_labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("int").alias(c) for c in given)).filter(F.col(last).isin(0, 1)).join(few, "doc_id", "left_semi")
    of = {r["doc_id"]: r for r in known_labels.groupBy("doc_id").agg(*(F.min(c).alias(c) for c in given)).collect()}
    flags = [F.coalesce(F.col("text").rlike(p), F.lit(False)).cast("int").alias(c) for c, p in derive.items()]
    kept = ", ".join(f"`{c}` int" for c in derive)
    sample = stored(sampled_texts(docs, [i for i, _ in drawn]).select("doc_id", "text", *flags).mapInArrow(_feature_rows, "doc_id long, features array<long>" + (f", {kept}" if kept else "")))
    there = {r["doc_id"]: r for r in sample.drop("features").collect()}
    rows = [(i, label) for i, label in drawn if i in there]
    chosen, n = [i for i, _ in rows], len(rows)
    y = np.array([[int(of[i][last] and there[i][c]) if c in derive else int(of[i][c] or 0) for c in categories] for i in chosen], float).reshape(n, len(categories))
    fold = (T.mix(np.array(chosen, np.int64).view(U64)) % U64(FOLDS)).astype(np.int64)
    truth = spark.createDataFrame([(i, int(k), *map(int, row)) for i, k, row in zip(chosen, fold, y, strict=True)], "doc_id long, fold int, " + ", ".join(f"`{c}` int" for c in categories))
    sets = _uneven(sample.select("doc_id", "features").join(F.broadcast(truth), "doc_id"), y, fold, categories) if n else [np.zeros(0, U64)] * (FOLDS + 1)
    known = np.unique(np.concatenate(sets))
    masks = [np.isin(known, s) for s in sets]
    places = {r["doc_id"]: r["places"] for r in sample.select("doc_id", "features").mapInArrow(_places(known), "doc_id long, places array<long>").collect()}
    text = np.repeat(np.arange(n), [len(places[i]) for i in chosen])
    at = np.array([p for i in chosen for p in places[i]], np.int64)
    share = {k: v / sum(counts.values()) for k, v in counts.items()}
    weight = np.array([share[label] / max(1, sum(x[1] == label for x in rows)) for label in (0, 1) if label in share])
    weight = np.array([weight[label] if len(weight) > 1 else weight[0] for _, label in rows]) * n if n else np.zeros(0)
    odds, parts = np.zeros((n, 0)), []
    for c in range(len(categories)):
        out = np.zeros(n)
        for k in range(FOLDS):
            train, test = np.flatnonzero(fold != k), fold == k
            if not len(train) or not test.any() or c == len(categories) - 1:
                continue
            b, w, v = _fit(text, at, masks[k], odds, y[:, c], weight, train)
            z = b + np.bincount(text, weights=w[at], minlength=n) + odds @ v
            out[test] = np.clip(z[test], -30, 30)
        parts.append(_fit(text, at, masks[-1], odds, y[:, c], weight, np.arange(n)) if n else (NO_LABELS, np.zeros(len(known)), np.zeros(c)))
        odds = np.column_stack([odds, out])
    on_earlier = np.zeros((len(categories), len(categories)))
    for c, (_, _, v) in enumerate(parts):
        on_earlier[c, :c] = v
    return Chain(tuple(categories), known[masks[-1]], np.array([p[0] for p in parts]), np.stack([p[1][masks[-1]] for p in parts]), on_earlier)


def _odds(chain: Chain, look: _Lookup, texts: pa.Array) -> np.ndarray:
    data, at = T.strings(texts)
    odds = np.zeros((len(texts), len(chain.categories)))
    for lo, hi in T.chunks(at):
        odds[lo:hi] = chain.odds(*look(*features(data, at[lo : hi + 1])), hi - lo)
    return odds


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, p_<category>, ...) for each row of docs (doc_id, text, ...)."""
    names = ["doc_id", *(f"p_{c}" for c in chain.categories)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _Lookup(chain.known)
        for batch in T.slices(batches):
            p = 1 / (1 + np.exp(-_odds(chain, look, batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, c]) for c in range(p.shape[1]))], names=names)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(rows, "doc_id long, " + ", ".join(f"`{c}` double" for c in names[1:]))


# Words that tell kinds of toxicity from each other.
KINDS = {
    "insult": r"(?i)\b(?:idiot|stupid|moron|clown|fool|loser|scum)\b",
    "contempt": r"(?i)\b(?:trash|garbage|worthless|useless|pathetic|disgusting)\b",
}
CATEGORIES = (*KINDS, "toxic")


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_insult, p_contempt, p_toxic, rejected) with labels (doc_id, toxic)."""
    return score(docs, fit(docs, labels, CATEGORIES, derive=KINDS)).withColumn("rejected", F.col("p_toxic") >= threshold)


def reject(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that are not toxic."""
    chain, at = fit(docs, labels, CATEGORIES, derive=KINDS), docs.columns.index("text")
    least = float(np.log(threshold / (1 - threshold)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _Lookup(chain.known)
        for batch in T.slices(batches):
            yield batch.filter(pa.array(_odds(chain, look, batch.column(at))[:, -1] < least))

    return docs.mapInArrow(rows, docs.schema)
