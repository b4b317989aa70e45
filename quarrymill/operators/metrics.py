"""Graded retrieval metrics for all queries of a table at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import checks


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / (F.log(rank + 1.0) / F.log(F.lit(2.0)))


def per_query(ranking: DataFrame, qrels: DataFrame, queries: DataFrame, cutoff: int = 10, threshold: int = 1) -> DataFrame:
    """(query_id, ndcg, reciprocal_rank, recall, first_relevant) for each query; what nobody judged has grade 0, a query without results has zeros.

    ranking: (query_id, document_id, rank). qrels: (query_id, document_id, relevance). Sums are over at most `cutoff` rows
    a query; the ideal ranking is cut before it is summed.
    """
    if not 1 <= cutoff <= 100 or not 1 <= threshold <= 2:
        raise ValueError("cutoff or threshold out of range")
    judged = ranking.where(F.col("rank") <= cutoff).join(qrels, ["query_id", "document_id"], "left").withColumn("g", F.coalesce("relevance", F.lit(0)))
    in_order = F.array_sort(F.collect_list(F.struct("rank", gain(F.col("g"), F.col("rank")).alias("v"))))
    got = judged.groupBy("query_id").agg(
        F.aggregate(in_order, F.lit(0.0), lambda a, x: a + x["v"]).alias("dcg"),
        F.min(F.when(F.col("g") >= threshold, F.col("rank"))).alias("first_relevant"),
        F.count_if(F.col("g") >= threshold).alias("hits"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"))
    ideal = qrels.where("relevance > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cutoff)
    best = ideal.groupBy("query_id").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("rank", gain(F.col("relevance"), F.col("rank")).alias("v")))), F.lit(0.0), lambda a, x: a + x["v"]).alias("idcg"))
    relevant = qrels.groupBy("query_id").agg(F.count_if(F.col("relevance") >= threshold).alias("relevant"))
    zero = F.lit(0.0)
    return (
        queries.select("query_id").join(got, "query_id", "left").join(best, "query_id", "left").join(relevant, "query_id", "left")
        .select(
            "query_id",
            F.coalesce(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")), zero).alias("ndcg"),
            F.coalesce(1.0 / F.col("first_relevant"), zero).alias("reciprocal_rank"),
            F.coalesce(F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")), zero).alias("recall"),
            "first_relevant",
        )
    )


def macro(per: DataFrame, *by: str) -> DataFrame:
    return per.groupBy(*by).agg(F.count("*").alias("queries"), F.avg("ndcg").alias("ndcg"), F.avg("reciprocal_rank").alias("mrr"), F.avg("recall").alias("recall"))


def require_rankings(rankings: DataFrame, qrels: DataFrame, queries: DataFrame) -> None:
    """Raises unless rankings and judgements are of these queries, and every query has a relevant document.

    A query without results is named by a row with null document_id in rankings, or is absent there only if it found nothing.
    """
    asked = queries.select("query_id").distinct()
    for df, what in ((rankings, "rankings"), (qrels, "judgements")):
        checks.require_none(df.select("query_id").distinct().join(asked, "query_id", "left_anti"), f"{what} of unknown queries")
    checks.require_none(asked.join(qrels.where("relevance >= 1").select("query_id"), "query_id", "left_anti"), "queries without a relevant document")


# The labels of the kinds of failure.
def failure_type() -> Column:
    return (
        F.when(F.col("first_relevant").isNull(), "no_relevant_result_in_top_10")
        .when(F.col("first_relevant") > 3, "first_relevant_result_below_rank_3")
        .when(F.col("recall") < 1, "relevant_pool_items_missed")
        .otherwise("relative_ordering_error")
    )


def failures(per: DataFrame, limit: int = 3) -> DataFrame:
    """The queries that went worst: a report of `limit` rows."""
    return per.where("ndcg < 1 OR reciprocal_rank < 1 OR recall < 1").orderBy("ndcg", "reciprocal_rank", "recall", "query_id").limit(limit).withColumn("failure_type", failure_type())


def nearest_rank(df: DataFrame, value: str, percentiles: dict[str, float], *by: str) -> DataFrame:
    """Nearest-rank percentiles: always values of the data."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), *[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(name) for name, p in percentiles.items()])


def problems(queries: DataFrame, qrels: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, document_id, problem): judgements of unknown queries or documents, of other contents, with grades out of range, given twice; queries without a relevant document.

    documents: (document_id, content_sha256).
    """
    known = documents.select("document_id", F.col("content_sha256").alias("_now"), F.lit(True).alias("_there")).dropDuplicates(["document_id"])
    asked = queries.select("query_id", F.lit(True).alias("_asked")).distinct()
    seen = qrels.join(known, "document_id", "left").join(asked, "query_id", "left").select(
        "query_id", "document_id",
        F.when(F.col("_asked").isNull(), "unknown_query").when(F.col("_there").isNull(), "missing_document")
        .when(~F.col("content_sha256").eqNullSafe(F.col("_now")), "stale_content").when(~F.col("relevance").between(0, 2), "grade").alias("problem"),
    ).where("problem IS NOT NULL")
    twice = qrels.groupBy("query_id", "document_id").count().where("count > 1").select("query_id", "document_id", F.lit("judged_twice").alias("problem"))
    bare = queries.select("query_id").join(qrels.where("relevance >= 1"), "query_id", "left_anti").select("query_id", F.lit(None).cast("string").alias("document_id"), F.lit("no_relevant_document").alias("problem"))
    return seen.unionByName(twice).unionByName(bare)
