"""Corpus pipeline: quality classifier, toxicity, near-dedup, packing, each stage written before the next.

Every stage reads whole texts of any length and only the columns doc_id and text;
all other columns pass as they are, whatever their names. Null and empty texts are
texts without words. Repeated rows are rows of their own until near-dedup. An empty
table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.llm import nearcopies, packing, quality, toxicity
from ashlar.llm.common import keep, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts (score 0.3 or more); all, if no label can be learned from."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model accepts (score below 0.5); all, if no label can be learned from."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (they meet by SimHash or in min-hash bands; Jaccard similarity of 5-word shingles 0.8 or more): that of the smallest doc_id.

    Texts without words are one group; of rows that repeat the smallest doc_id, or
    of a group without any, the first row stays.
    """
    return nearcopies.representatives(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining rows; a text without words is one end id."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("near-dedup", dedup_stage),
    ("packing", packing_stage),
]

#: Learned weights, fingerprints and tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
