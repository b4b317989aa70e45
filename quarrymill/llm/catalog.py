"""The pN_ queries with their SQL counterparts, where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import bpe, history, licences, names, near, packing, planes, sentences, similar
from quarrymill.runtime import spread, table

CAPACITY = 2048


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar_pairs(table(spark, sf_dir, "skill_embeddings"), "vec_id", "embedding", 384).toDF("vec_id_a", "vec_id_b")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.repeated(table(spark, sf_dir, "existing_skills"), table(spark, sf_dir, "skill_candidates"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.map_values(table(spark, sf_dir, "skills"), table(spark, sf_dir, "canonical_values"))


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names no entry, with how often it was typed."""
    found = names.resolved_values(table(spark, sf_dir, "skills"), table(spark, sf_dir, "canonical_values"))
    return found.where("reference_id = 0").groupBy("field", "value").agg(F.count("*").alias("times"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every body that has one."""
    return near.linked_groups(table(spark, sf_dir, "corpus_documents"), "skill_id", "body_text", 20, planes.Bits).toDF("skill_id", "group_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near.linked_groups(table(spark, sf_dir, "corpus_documents"), "skill_id", "body_text", 20, planes.Bits)
    return near.pairs_within(groups).toDF("skill_id_a", "skill_id_b")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.decide(*(table(spark, sf_dir, t) for t in ("repositories", "skills", "skill_files", "canonical_values")))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(spread(table(spark, sf_dir, "documents")), "text", ("doc_id",))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = bpe.encode_column(spread(table(spark, sf_dir, "documents")), "text", ("doc_id",), "n_tokens", count_only=True)
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split_sentences(spread(table(spark, sf_dir, "documents")), "doc_id", "text")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_unmatched": p3_unmatched, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p6_ids": p6_ids, "p7_packed": p7_packed, "p8_found": p8_found}

ORACLES: dict[str, str] = {}
