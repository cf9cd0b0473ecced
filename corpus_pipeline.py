"""Documents made ready for training, in five stages, each written and read again before the next.

Toxic documents go; one document of each near-duplicate group stays (the smallest id); documents that
contain a benchmark item go; personal data is replaced by its kind; the rest is cut into pieces.
A stage sees all that its predecessor kept, and judges rows by their own text: of rows that share an id, one can go and
another stay; rows that repeat an id and its text stay or go together. Rows without an id or text pass the filters; extra
columns of documents are kept by all stages but the last, whatever they are called; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import decontaminate, near_dedup, pieces, pii
from causeway.llm import toxicity as toxic
from causeway.llm.tables import table
from causeway.storage import stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxic.reject(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.distinct(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else clean


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_pieces, ids, lossless)"""
    there_and_back = pieces.round_trip(docs.select("doc_id", "lang", "source", "text"))
    return there_and_back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids", "lossless")


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("sentencepiece", sentencepiece),
]

#: Models, sketches and sampled pieces have no SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
