"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tokenlm.llm import byte_bpe, hilbert, importance, jaccard_join, license_scan, line_rules, packing, pii, toxicity, transport_stream
from tokenlm.llm.session import table


def op1_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).drop("fp")


def op3_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op5_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.describe(transport_stream.stored_media(table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_quality(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_importance": op1_importance,
    "op2_partenum": op2_partenum,
    "op3_hilbert": op3_hilbert,
    "op4_license_scan": op4_license_scan,
    "op5_transport_stream": op5_transport_stream,
    "op6_toxicity": op6_toxicity,
    "op7_nnls_packing": op7_nnls_packing,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_personal_data": op9_personal_data,
    "op10_line_rules": op10_line_rules,
}
SQL: dict[str, str] = {"op10_line_rules": line_rules.SQL}
