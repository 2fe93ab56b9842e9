"""The numbered queries: thin forms of the operators over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafledger.llm import bpe, gridjoin, iblt, langid, linechunks, mixing, periods, pii, rules, simhash, spelling, sql, suffixes, warc
from leafledger.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Slots that a source gets in a period of the mixture.
TARGET_WEIGHTS = {"src0": 6, "src1": 4, "src2": 3}
DEFAULT_WEIGHT = 2


def _of_kind(number: int):
    return lambda span: span["kind"] == number


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), TARGET_WEIGHTS, DEFAULT_WEIGHT)
    return mixed.select("doc_id", "source", "size", "block", "release", "deadline", "slot", F.col("place.offset").alias("offset"))


@query
def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linechunks.without_repeated_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", "n_chunks", "n_removed", digest.alias("kept_sha256"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query
def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridjoin.near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE_SQL |= {"op3_mixing": sql.MIX, "op7_line_chunks": sql.LINES, "op9_warc": sql.WARC, "op10_embeddings": sql.EMBEDDINGS}


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    counts = [
        F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)
    ]
    return found.select(
        "doc_id", *counts,
        F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        "n_secret",
        (F.size("base") + F.size("added") + F.col("n_secret")).alias("n_private"),
    )


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query
def op6_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = iblt.compare_versions(table(spark, sf_dir, "documents"))
    return versions.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


@query
def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digests(periods.with_repeated_tail(table(spark, sf_dir, "documents")))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
