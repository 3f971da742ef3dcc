"""Batch retrieval: facet filter, similarity, top k, minimum score, floor, turns of document types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import retrieval as R


def retrieve(queries: DataFrame, chunks: DataFrame, top_k: int = 6, min_score: float = 0.05, floor: float = 0.2, min_keep: int = 3) -> DataFrame:
    """query_id, rank, chunk_id and score of every query's answer set."""
    found = R.knn(queries, chunks, top_k, min_score)
    return R.score_floor(found, floor, min_keep).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))
