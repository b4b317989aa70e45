"""Judgement pools, their blinded worksheets, and judgements from filled-in worksheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import checks
from quarrymill.functions.text import csv_safe

# Fixed value: the version of the blinding, which is part of what is hashed.
BLINDING = "sha256-query-document-v1"
EVIDENCE = ("query_id", "query_text", "label_order", "document_id", "content_sha256", "name", "repository", "path", "snippet")


def pool(ranking: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, document_id, sources, bm25_rank): ranked documents and authored seeds (query_id, document_id)."""
    hits = ranking.select("query_id", "document_id", F.col("rank").alias("bm25_rank"))
    named = seeds.select("query_id", "document_id", F.lit(True).alias("_seed")).distinct()
    return hits.join(named, ["query_id", "document_id"], "full_outer").select(
        "query_id", "document_id", F.array_compact(F.array(F.when(F.col("bm25_rank").isNotNull(), "bm25"), F.when(F.col("_seed"), "query_seed"))).alias("sources"), "bm25_rank"
    )


def unknown_seeds(seeds: DataFrame, documents: DataFrame) -> DataFrame:
    return seeds.join(documents.select("document_id"), "document_id", "left_anti")


def blinded(pooled: DataFrame) -> DataFrame:
    """pooled with label_order: an order by hash that tells nothing about ranks."""
    key = F.sha2(F.concat_ws("\u0000", F.lit(BLINDING), "query_id", "document_id").cast("binary"), 256)
    return pooled.withColumn("label_order", F.row_number().over(Window.partitionBy("query_id").orderBy(key)))


def worksheet(pooled: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows to be labelled, inert in a spreadsheet, without ranks and sources. documents: document_id, content_sha256, name, repository, path, snippet."""
    rows = blinded(pooled).join(queries.select("query_id", "query_text"), "query_id").join(documents, "document_id")
    safe = [csv_safe(F.col(c)).alias(c) for c in ("query_text", "document_id", "name", "repository", "path", "snippet")]
    return rows.select("query_id", "label_order", "content_sha256", *safe, F.lit("").alias("relevance"), F.lit("").alias("rationale")).select(*EVIDENCE, "relevance", "rationale")


def qrels(filled: DataFrame, expected: DataFrame) -> DataFrame:
    """Judgements of a filled-in worksheet; raises if evidence was changed, a label is missing or a rationale lacks."""
    if set(filled.columns) != set(expected.columns):
        raise checks.ContractError("the columns of the worksheet were changed")
    text = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in EVIDENCE])
    if not checks.same_rows(text(filled), text(expected)):
        raise checks.ContractError("evidence in the worksheet was changed")
    grade, why = F.trim("relevance"), F.trim("rationale")
    checks.require(filled, grade.isin("0", "1", "2"), "every row needs relevance 0, 1 or 2")
    checks.require(filled, (grade == "0") | (F.coalesce(why, F.lit("")) != ""), "relevant rows need a rationale")
    return filled.select("query_id", "document_id", "content_sha256", grade.cast("int").alias("relevance"), F.nullif(why, F.lit("")).alias("rationale"))
