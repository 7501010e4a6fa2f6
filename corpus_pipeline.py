"""A corpus pipeline over documents: each stage works on all that the stage before it kept.

All stages take nulls in any column, empty and very long texts, repeated rows, empty tables and further columns of any
name; what becomes of them is said at each stage. All but the last return the columns that they get.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tokenlm.llm import importance, jaccard_join, line_rules, packing, pii
from tokenlm.llm.session import table, written

#: Near duplicates share this percentage of shingles of so many words; op2_partenum has its own, stricter constants.
SHINGLE, PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling doesn't draw go, and with them null texts and texts without a word. Repeated rows
    stay or go together, ties with the last key stay, a null doc_id joins no label; without both kinds of labels all texts with a word stay."""
    return importance.keep_sampled(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and so do documents that the rules reject, null and empty texts among them. n_chars counts the new
    text. Repeated rows get the same verdict; a null doc_id passes through."""
    return line_rules.clean_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, that of the smallest doc_id, and of rows that share it the one whose
    columns hash least. Documents without words stay, all of them; a group without any doc_id keeps one row of each set of shingles."""
    return jaccard_join.keep_first(docs, shingle=SHINGLE, percent=PERCENT)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in all texts, and n_chars counts the new text. Rows, null texts and other columns stay as they are."""
    return pii.mask_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, in sequences. A null or empty text is a piece with the end id alone, repeated rows are packed as
    often as they occur, and a null doc_id passes through."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Trained scores, tokenisers and packing have no SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; every other stage is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
