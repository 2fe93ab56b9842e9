"""Documents made ready for training: each stage is one operator over all its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafledger.llm import bpe, langid, linechunks, mixing, simhash
from leafledger.llm.shared import in_order_of_files, placed, stored, table

VOCABULARY = "byte_bpe_50k.tiktoken"
TARGET_WEIGHTS = {"src0": 6, "src1": 4, "src2": 3}
DEFAULT_WEIGHT = 2
LEAST_SHARE = 0.25
SHINGLE_WORDS = 3
BIT_DISTANCE = 3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; documents in several languages stay.

    The top share is at least one in the number of learned languages, so with up to four (the
    given data have four) ``LEAST_SHARE`` rejects nothing, and text in no learned language stays.
    """
    return langid.keep_identified(docs, least_score=LEAST_SHARE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that stand earlier in the corpus are cut out of the texts."""
    kept = linechunks.without_repeated_chunks(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.keep_one_per_group(docs, shingle=SHINGLE_WORDS, distance=BIT_DISTANCE)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, ordered so that sources follow their target weights."""
    return mixing.in_mixed_order(docs, TARGET_WEIGHTS, DEFAULT_WEIGHT)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per document, and the digest of what they decode to, in the order of ``docs``.

    ``position`` counts the rows of ``docs`` from 0 in the order of its files, which is the
    mixture's where the mixture stage wrote them.
    """
    path = public_tokenizers.path(VOCABULARY)
    narrow = placed(docs, ["doc_id", "lang", "source", "text"], ("__file", "__row"))
    decoded = bpe.encode(narrow, path, public_tokenizers.PATTERN, decoded="bytes")
    done = decoded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2("bytes", 256).alias("decoded_sha256"), "__file", "__row",
    )
    return in_order_of_files(stored(done, "tokens"), ("__file", "__row"), "position")


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("tokens", tokens)]
#: Model fitting, SimHash and byte-pair merges have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
