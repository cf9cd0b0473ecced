"""What the operators share on the Spark side: tables, free column names, samples of labels, components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators.graph import linked

#: Bytes of sampled texts that come to the driver at most.
SAMPLE_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(name: str, columns: list[str]) -> str:
    """name, with underscores before it as long as a column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every end of `edges` (a, b): the smallest id reachable."""
    return linked(edges).withColumnRenamed("component", "component_id")


def sampled_ids(labels: DataFrame, per_class: int) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """At most per_class (doc_id, label) of each label 0 and 1, the first by a hash of their id, and how many labels there are of
    each. Of several labels of one id the smallest counts."""
    known = labels.filter("label IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    ordered = F.xxhash64("doc_id"), F.col("doc_id")
    return [(r["doc_id"], r["label"]) for y in (0, 1) for r in known.filter(F.col("label") == y).orderBy(*ordered).limit(per_class).collect()], counts


def sampled_texts(docs: DataFrame, ids: list[int]) -> DataFrame:
    """(doc_id, text), a row for each of the ids that docs has (of several texts the smallest); ids are few (a bounded sample), so they are broadcast."""
    few = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, most_bytes: int = SAMPLE_BYTES) -> tuple[list[tuple[int, str, int]], dict[int, int]]:
    """sampled_ids with their whole texts, which come to the driver: at most 2 * per_class of them, and most_bytes in all,
    half for each class (texts that would go beyond are left out)."""
    chosen, counts = sampled_ids(labels, per_class)
    if not chosen:
        return [], counts
    texts = sampled_texts(docs, [i for i, _ in chosen])
    sizes = {r["doc_id"]: r["size"] or 0 for r in texts.select("doc_id", F.octet_length("text").alias("size")).collect()}
    left, taken = {0: most_bytes // 2, 1: most_bytes // 2}, []
    for i, label in chosen:
        if i in sizes and sizes[i] <= left[label]:
            left[label] -= sizes[i]
            taken.append((i, label))
    few = docs.sparkSession.createDataFrame([(i,) for i, _ in taken], "doc_id long")
    of = {r["doc_id"]: r["text"] for r in texts.join(F.broadcast(few), "doc_id", "left_semi").collect()}
    return [(i, of[i], label) for i, label in taken], counts


def bit_map(hashes: DataFrame, most_bits: int) -> np.ndarray:
    """A map with a bit for each of the 64-bit hashes (h): 16 to 32 bits for each, most_bits (a power of 2) in all. What is in it may
    also be another hash; what is not, is none of them. One row for each 64 bits comes to the driver, most_bits / 64 at most."""
    bits = min(most_bits, max(1 << 12, 1 << (16 * hashes.count()).bit_length()))
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    rows = hashes.groupBy(F.shiftright(place, 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[rows.column("i").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def in_bit_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each of the hashes whether the map may have it."""
    place = hashes.view(np.uint64) & np.uint64(len(bits) * 64 - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0
