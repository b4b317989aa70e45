"""Corpus statistics and single records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import text as X


def zero_filled(df: DataFrame, column: str, values: list[str], rest: str | None = None) -> DataFrame:
    """(value, count, share) for each of the values, also those that don't occur; with `rest`, a row of that name for all other values and null."""
    if rest is not None:
        df = df.select(F.when(F.col(column).isin(values), F.col(column)).otherwise(rest).alias(column))
        values = [*values, rest]
    listed = df.sparkSession.createDataFrame([(v,) for v in values], "value string")
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    filled = listed.join(counted, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))
    total = filled.agg(F.sum("n").alias("total"))  # one row
    return filled.crossJoin(F.broadcast(total)).select("value", "n", F.when(F.col("total") > 0, F.round(F.col("n") / F.col("total"), 6)).otherwise(0.0).alias("share"))


def top_tools(skills: DataFrame, k: int = 20) -> DataFrame:
    """The k tools that most skills' lists name, as (tool, n)."""
    named = skills.select(F.explode("allowed_tools").alias("raw")).select(X.declared_tool(F.col("raw")).alias("tool")).where("tool <> ''")
    return named.groupBy("tool").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tool").limit(k)


def overview(repositories: DataFrame, skills: DataFrame) -> DataFrame:
    """One row of counts; each side is aggregated on its own."""
    r = repositories.agg(F.count("*").alias("repositories"), F.count_if(F.col("is_archived")).alias("archived"), F.count_if(F.col("is_fork")).alias("forks"))
    s = skills.agg(
        F.count("*").alias("skills"), F.count_if(F.col("has_scripts")).alias("with_scripts"), F.count_if(F.col("declared_license").isNotNull()).alias("with_license"),
        F.count_if(F.size("allowed_tools") > 0).alias("with_tools"), F.max("indexed_at").alias("last_indexed"),
    )
    return r.crossJoin(s)  # one row each


def detail(skills: DataFrame, repositories: DataFrame, corpus: DataFrame, skill_id: int) -> DataFrame:
    """One skill with its repository and the first characters of its body."""
    shown, longer = X.excerpt(F.col("body_text"))
    body = corpus.where(F.col("skill_id") == skill_id).select("skill_id", X.plain_text(shown).alias("excerpt"), longer.alias("truncated")).dropDuplicates(["skill_id"])
    one = skills.where(F.col("skill_id") == skill_id)
    return one.join(repositories.select(F.col("github_repository_id").alias("repository_id"), "full_name", "stars_count", "license_status"), "repository_id").join(body, "skill_id", "left")


def files(skill_files: DataFrame, skill_id: int) -> DataFrame:
    return skill_files.where(F.col("skill_id") == skill_id).dropDuplicates().orderBy(F.lower("relative_path"), "file_id")
