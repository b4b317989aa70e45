"""The retrieval corpus: eligible documents with their lexical fields, reconciled with what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import checks
from quarrymill.functions import text as X

ELIGIBLE = ("valid", "warning")
FIELDS = ("name_text", "description_text", "metadata_text", "heading_text", "body_text")


def latest(df: DataFrame, keys: list[str], when: str) -> DataFrame:
    """The latest version of each key; with partial aggregation, so that many versions of one key don't meet in one task."""
    rest = [c for c in df.columns if c not in keys]
    plain = [c for c in rest if not df.schema[c].dataType.simpleString().startswith("map")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(when, *[c for c in plain if c != when])).alias("_r")).select(*keys, "_r.*")


def documents(corpus: DataFrame) -> DataFrame:
    """One row for each eligible document: identity, filter columns, combined text."""
    return (
        corpus.where(F.col("validation_status").isin(*ELIGIBLE))
        .select("document_id", "skill_id", "repository_full_name", "path", "name", "validation_status", "license_status", "has_scripts", X.combined_text(*[F.col(f) for f in FIELDS]).alias("text"))
        .dropDuplicates(["document_id"])
    )


def tokenized(docs: DataFrame, normalize: bool = False) -> DataFrame:
    """docs with tokens and doc_len. normalize: clean the combined text once more, as texts from outside need."""
    text = X.normalize("text") if normalize else F.col("text")
    return docs.withColumn("tokens", F.coalesce(X.tokens(text), F.array().cast("array<string>"))).withColumn("doc_len", F.size("tokens")).drop("text")


def lexical_fields(skills: DataFrame) -> DataFrame:
    """The five fields of each skill, from its columns name, description, declared_license, compatibility, allowed_tools, metadata, body_text."""
    parted = skills.withColumn("_md", X.partition_markdown(F.coalesce("body_text", F.lit(""))))
    return parted.select(
        "*",
        X.normalize(F.coalesce("name", F.lit(""))).alias("name_text"),
        X.normalize(F.coalesce("description", F.lit(""))).alias("description_text"),
        X.normalize(X.metadata_text(F.col("declared_license"), F.col("compatibility"), F.col("allowed_tools"), F.col("metadata"))).alias("metadata_text"),
        F.array_join("_md.headings", " ").alias("heading_text"),
        F.col("_md.body").alias("body_normalized"),
    ).drop("_md")


def allows(licenses: list[str] | None = None, statuses: list[str] | None = None, has_scripts: bool | None = None) -> Column:
    """The conjunction of the filters that are set."""
    rule = F.lit(True)
    if licenses:
        rule &= F.col("license_status").isin(licenses)
    if statuses:
        rule &= F.col("validation_status").isin(statuses)
    if has_scripts is not None:
        rule &= F.col("has_scripts") == has_scripts
    return rule


def drift(snapshot: DataFrame, stored: DataFrame) -> DataFrame:
    """(repository_id, path, problem): where a snapshot and what is stored differ. Both have repository_id, path, repository_full_name, content_sha256, validation_status."""
    keys = ["repository_id", "path"]
    mine = stored.select(*keys, F.lower("repository_full_name").alias("_name"), F.col("content_sha256").alias("_hash"), F.col("validation_status").alias("_status"), F.lit(True).alias("_there"))
    return (
        snapshot.join(mine, keys, "left")
        .select(
            *keys,
            F.when(F.col("_there").isNull(), "missing")
            .when(~F.lower("repository_full_name").eqNullSafe(F.col("_name")), "renamed")
            .when(~F.col("content_sha256").eqNullSafe(F.col("_hash")), "stale")
            .when(~F.col("validation_status").eqNullSafe(F.col("_status")), "status")
            .alias("problem"),
        )
        .where("problem IS NOT NULL")
    )


def frozen(snapshot: DataFrame, header: dict, stored: DataFrame, manifest_sha256: str) -> DataFrame:
    """The stored rows of a snapshot, or an error: the snapshot must be of this manifest, and nothing stored may differ from it."""
    if header.get("manifest_sha256") != manifest_sha256:
        raise checks.ContractError("the snapshot is of another manifest")
    taken = snapshot.where("stored")
    checks.require_none(drift(taken, stored), "what is stored differs from the snapshot")
    return stored.join(taken.where(F.col("validation_status").isin(*ELIGIBLE)).select("repository_id", "path"), ["repository_id", "path"], "left_semi")


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """(rows, digest): changes with any row, does not depend on their order, and is summed in parts, so no task sees all rows."""
    one = F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"))
    part = lambda k: F.sum(F.conv(F.substring(one, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("rows"), F.concat_ws("-", *[F.coalesce(part(k), F.lit(0)).cast("string") for k in range(4)]).alias("digest"))


def corpus_fingerprint(corpus: DataFrame) -> DataFrame:
    """The fingerprint of a table of documents; repeated rows count once, and only the hashed columns and the id are shuffled."""
    columns = ("content_sha256", "validation_status", "has_scripts", "license_status")
    return fingerprint(corpus.select("document_id", *columns).distinct(), *columns)
