"""Files: Markdown documents with their blob hashes, seed lists, settings and worksheets."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
import re
from typing import TypeVar, get_args, get_origin, get_type_hints

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.checks import ContractError

MOST_SETTINGS_BYTES = 64 * 1024
C = TypeVar("C")


def git_blob_sha(content: Column) -> Column:
    """The hash that git gives a file with these bytes."""
    return F.sha1(F.concat(F.lit("blob ").cast("binary"), F.octet_length(content).cast("string").cast("binary"), F.unhex(F.lit("00")), content))


def documents(spark: SparkSession, root: str, name: str = "SKILL.md") -> DataFrame:
    """(path, content, git_blob_sha, content_sha256, byte_count) of every file of that name below root."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(root)
    base = "/" + root.removeprefix("file:").strip("/") + "/"
    return files.withColumn("p", F.regexp_replace("path", "^file:/+", "/")).select(
        F.expr(f"substring(p, {len(base) + 1})").alias("path"),
        "content", git_blob_sha(F.col("content")).alias("git_blob_sha"), F.sha2("content", 256).alias("content_sha256"), F.octet_length("content").alias("byte_count"),
    )


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """(repository, position) lines of a text file in their order, without what follows a #, blank lines left out."""
    read = spark.read.text(path).select(F.monotonically_increasing_id().alias("position"), F.trim(F.substring_index("value", "#", 1)).alias("repository"))
    return read.where("repository <> ''").select("repository", "position")


def settings(path: str, kind: type[C]) -> C:
    """A JSON object as a frozen dataclass; no field may lack or be unknown, and types must fit."""
    if os.path.getsize(path) > MOST_SETTINGS_BYTES:
        raise ContractError("the settings are too large")
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    fields = {f.name: f for f in dataclasses.fields(kind)}
    needed = {n for n, f in fields.items() if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING}
    if not isinstance(given, dict) or set(given) - set(fields) or needed - set(given):
        raise ContractError("the settings have unknown or missing fields")
    hints = get_type_hints(kind)
    for name, value in given.items():
        if not _fits(value, hints[name]):
            raise ContractError(f"the setting {name} has the wrong type")
    return kind(**{n: tuple(v) if isinstance(v, list) else v for n, v in given.items()})


def _fits(value: object, kind: type) -> bool:
    if get_origin(kind) is tuple:
        return isinstance(value, list) and all(_fits(v, get_args(kind)[0]) for v in value)
    if kind is float:
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, kind) and (kind is bool or not isinstance(value, bool))


@dataclasses.dataclass(frozen=True)
class Bm25Settings:
    k1: float = 1.5
    b: float = 0.75
    default_top_k: int = 10
    eligible_validation_statuses: tuple[str, ...] = ("valid", "warning")

    def __post_init__(self):
        if self.k1 <= 0 or not 0 <= self.b <= 1 or not 1 <= self.default_top_k <= 100:
            raise ContractError("BM25 settings out of range")


@dataclasses.dataclass(frozen=True)
class HybridSettings:
    model_id: str
    model_revision: str
    model_dimension: int = 384
    rrf_k: int = 60
    rrf_candidate_depth: int = 50
    bm25_weight: float = 1.0
    dense_weight: float = 1.0
    batch_size: int = 16
    metric: str = "cosine"
    search: str = "exact"
    max_sequence_length: int = 256
    normalize_embeddings: bool = True

    def __post_init__(self):
        if self.metric != "cosine" or self.search != "exact" or not 1 <= self.max_sequence_length <= 8_192 or not 1 <= self.rrf_candidate_depth <= 100:
            raise ContractError("hybrid settings name an unknown metric, search or depth")
        if not 1 <= self.rrf_k <= 10_000 or min(self.bm25_weight, self.dense_weight) <= 0 or not 1 <= self.batch_size <= 128 or self.model_dimension < 1:
            raise ContractError("hybrid settings out of range")


def write_worksheet(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').mode("errorifexists").csv(path)


def read_worksheet(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, as they stand."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).csv(path).na.fill("")


@dataclasses.dataclass(frozen=True)
class EvaluationSettings:
    query_set_path: str
    qrels_path: str
    query_set_sha256: str
    qrels_sha256: str
    corpus_snapshot_sha256: str
    cutoff: int = 10
    relevance_threshold: int = 1

    def __post_init__(self):
        if not 1 <= self.cutoff <= 100 or not 1 <= self.relevance_threshold <= 2:
            raise ContractError("evaluation settings out of range")
        for path in (self.query_set_path, self.qrels_path):
            safe_path(path, ".jsonl")
        if not all(re.fullmatch("[0-9a-f]{64}", h) for h in (self.query_set_sha256, self.qrels_sha256, self.corpus_snapshot_sha256)):
            raise ContractError("evaluation settings need SHA-256 hashes")


def safe_path(path: str, suffix: str) -> str:
    """A relative path of plain parts with a suffix, or an error."""
    parts = path.split("/")
    if not path or path != path.strip() or "\\" in path or "\0" in path or any(p in ("", ".", "..") for p in parts) or not path.endswith(suffix):
        raise ContractError(f"not a safe relative {suffix} path: {path!r}")
    return path


def bound_settings(path: str, kind: type[C], expected_sha256: str) -> C:
    """Settings whose bytes another artefact names by their hash."""
    with open(path, "rb") as f:
        if hashlib.sha256(f.read(MOST_SETTINGS_BYTES + 1)).hexdigest() != expected_sha256:
            raise ContractError("the settings have other bytes than expected")
    return settings(path, kind)
