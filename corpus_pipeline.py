"""From raw documents to packed sequences: quality rules, exact dedup, near-dedup, pseudonyms, packing.

Each stage works on what its predecessor kept and is written to the shared folder before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murkwatch.llm import exact, minhash, packing, pii, quality
from murkwatch.llm.queries import PII_KEY, RANKS, TOKENIZER
from murkwatch.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents past the base rules and within the thresholds of their language and source."""
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each text, white space aside."""
    return exact.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones: five-word shingles, similarity of 0.8 or more."""
    return minhash.keep_representatives(docs, size=5, percent=80)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced in the texts; n_chars follows them."""
    replaced = pii.pseudonymise(docs, PII_KEY, count_col=None)
    return replaced.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in the training sequences."""
    pieces = packing.pack(docs, TOKENIZER, RANKS, public_tokenizers.PATTERN, digest={"ids_crc32": F.crc32("ids")})
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
    ("pseudonyms", pseudonyms), ("packing", packed),
]

#: Signatures, keyed permutations and token merges have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
