"""The registered queries of this folder. Each applies one operator, with production parameters, to its whole table.

None of them has SQL beside it: models, sketches, shared windows and sampled segmentations are beyond
it on whole tables. tests/llm checks each against a brute-force version, an exact round trip or held-out rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import pieces
from causeway.llm.alignment import align
from causeway.llm.collocations import collocations
from causeway.llm.decontaminate import contained
from causeway.llm.fingerprint import with_edits
from causeway.llm.html import main_text
from causeway.llm.near_dedup import near_duplicates
from causeway.llm.ngram_join import linked_documents
from causeway.llm.pii import find
from causeway.llm.quality import quality
from causeway.llm.repeats import substring_repeats, suffix_repeats
from causeway.llm.tables import table
from causeway.llm.toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op4_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op5_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of at least 50 words that another document holds too."""
    return suffix_repeats(table(spark, sf_dir, "documents")).filter("n_repeated > 0")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each text, sampled by its id, as a count and a hash, and whether they decode to it."""
    there_and_back = pieces.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return there_and_back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "lossless")


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with each benchmark item whose shingles it contains to three quarters or more."""
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_ngram_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_compression_quality, op2_minhash_near_dedup, op3_pii_skip_chain, op4_html_wrappers, op5_multiset_fingerprints, op6_suffix_array_dedup,
            op7_substring_dedup, op8_sentencepiece_sampling, op9_toxicity_chain, op10_benchmark_containment, op11_phrase_collocations, op12_ngram_tree_join, op13_tokenizer_alignment,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {}
