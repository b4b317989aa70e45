"""Reciprocal rank fusion of two rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, DEPTH = 60, 50


def fuse(first: DataFrame, second: DataFrame, docs: DataFrame, k: int = 10, rrf_k: int = RRF_K, weights: tuple[float, float] = (1.0, 1.0), depth: int = DEPTH, digits: int | None = 6) -> DataFrame:
    """(query_id, rank, document_id, score, rank_1, rank_2) from rankings (query_id, document_id, rank).

    Ties: the better of the two ranks, then repository and path without regard to case, then id.
    """
    if not 1 <= rrf_k <= 10_000 or min(weights) <= 0 or not 1 <= k <= 100:
        raise ValueError("rrf_k, weights or k out of range")
    pick = lambda r, name: r.where(F.col("rank") <= depth).select("query_id", "document_id", F.col("rank").alias(name))
    both = pick(first, "rank_1").join(pick(second, "rank_2"), ["query_id", "document_id"], "full_outer")
    part = lambda name, w: F.coalesce(F.lit(w) / (rrf_k + F.col(name)), F.lit(0.0))
    score = part("rank_1", weights[0]) + part("rank_2", weights[1])
    named = both.withColumn("score", F.round(score, digits) if digits is not None else score).join(docs.select("document_id", F.lower("repository_full_name").alias("_r"), F.lower("path").alias("_p")), "document_id", "left")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.least("rank_1", "rank_2"), "_r", "_p", "document_id")
    return named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "document_id", "score", "rank_1", "rank_2")
