"""Ingest runs: the outcome of every candidate in one plan, the totals of a run, and the audit tables.

An outcome is decided by what is stored and by what was fetched, as columns of joined rows; nothing is looked up one by one.
Reasons are JSON objects with sorted keys, built and read with built-ins.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import checks
from quarrymill.operators.ingest import IDENTITY
from quarrymill.sources.tables import VersionedTable

# The outcomes of a candidate and the states of a run.
STATUSES = ("ingested", "unchanged", "invalid", "skipped", "error")
RUNNING, COMPLETED, FAILED = "running", "completed", "failed"
REASON = "category string, codes array<string>, message string"
RUN_SCHEMA = (
    "run_id string, at timestamp, status string, started_at timestamp, completed_at timestamp, git_commit_sha string, manifest_path string, manifest_sha256 string, queries array<string>, "
    "discovered_count bigint, fetched_count bigint, unchanged_count bigint, parsed_count bigint, invalid_count bigint, skipped_count bigint, error_count bigint"
)
COUNTERS = ("fetched_count", "unchanged_count", "parsed_count", "invalid_count", "skipped_count", "error_count")


def reason(category: Column, message: Column, codes: Column | None = None) -> Column:
    """A structured reason; keys are in sorted order, absent codes are left out."""
    return F.to_json(F.struct(category.alias("category"), *([F.array_sort(F.array_distinct(codes)).alias("codes")] if codes is not None else []), message.alias("message")))


def parsed_reason(column: str) -> Column:
    """The fields of a structured reason; null if it isn't one."""
    return F.from_json(column, REASON)


def outcomes(candidates: DataFrame, stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """One row for each candidate: identity, change of version, status, reason, content_sha256, fetched, parsed.

    candidates and stored: IDENTITY, git_blob_sha; stored also content_sha256. fetched: IDENTITY, fetched_sha, content_sha256,
    validation_status (null if the parser found no front matter), codes, failure (null, or why it could not be fetched).
    A candidate without a version is skipped; one whose version is stored is unchanged; one that was not fetched, or whose
    fetched file has another version, is an error; the rest is invalid or ingested, as the parser says.
    """
    known = stored.select(*IDENTITY, F.col("git_blob_sha").alias("_old"), F.col("content_sha256").alias("_old_hash"), F.lit(True).alias("_held"))
    got = fetched.select(*IDENTITY, "fetched_sha", F.col("content_sha256").alias("_hash"), "validation_status", "codes", "failure", F.lit(True).alias("_got"))
    both = candidates.join(known, IDENTITY, "left").join(got, IDENTITY, "left")
    sha = F.col("git_blob_sha")
    unchanged = F.col("_held") & (sha == F.col("_old"))
    came = F.coalesce(F.col("_got") & F.col("failure").isNull(), F.lit(False))
    moved = came & ~F.col("fetched_sha").eqNullSafe(sha)
    bad = F.col("validation_status").isNull() | (F.col("validation_status") == "invalid")
    status = (
        F.when(sha.isNull(), "skipped").when(unchanged, "unchanged").when(~came | moved, "error").when(bad, "invalid").otherwise("ingested")
    )
    why = (
        F.when(status == "skipped", reason(F.lit("candidate"), F.lit("The candidate names no version.")))
        .when(status == "error", reason(F.when(moved, "changed").otherwise("fetch"), F.when(moved, "The file changed after its discovery.").otherwise(F.coalesce("failure", F.lit("The file was not fetched.")))))
        .when(status == "invalid", reason(F.lit("validation"), F.lit("The parser reported invalid content."), F.coalesce("codes", F.array().cast("array<string>"))))
    )
    done = status.isin("invalid", "ingested")
    return both.select(
        *candidates.columns,
        F.when(F.col("_held").isNull(), "new").when(unchanged, "unchanged").otherwise("changed").alias("change"),
        status.alias("status"), why.alias("reason"),
        F.when(status == "unchanged", F.col("_old_hash")).when(done, F.col("_hash")).alias("content_sha256"),
        (done | F.coalesce(moved, F.lit(False)) & (status == "error")).alias("fetched"), done.alias("parsed"),
        F.when(done, F.col("validation_status")).alias("validation_status"),
    )


def summary(items: DataFrame) -> DataFrame:
    """One row: the totals of a run."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    status = F.col("status")
    return items.agg(
        F.count("*").alias("discovered_count"), n(F.col("fetched")).alias("fetched_count"), n(status == "unchanged").alias("unchanged_count"), n(F.col("parsed")).alias("parsed_count"),
        n(status == "invalid").alias("invalid_count"), n(status == "skipped").alias("skipped_count"), n(status == "error").alias("error_count"),
    )


def failures(items: DataFrame) -> DataFrame:
    """(category, code, n): how often each reason was given; a reason without codes has a null code."""
    said = items.where("reason IS NOT NULL").select(parsed_reason("reason").alias("r"))
    return said.select(F.col("r.category").alias("category"), F.explode_outer("r.codes").alias("code")).groupBy("category", "code").agg(F.count("*").alias("n"))


class Audit:
    """Runs and their items below a folder. Both only grow: a change of a run's state is a further row, the last one counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.lock = VersionedTable(spark, f"{self.root}/runs")

    def _add(self, **fields) -> None:
        row = self.spark.createDataFrame([fields], RUN_SCHEMA)
        self.lock.write_parts(row, F.lit(f"{len(self.lock.parts()):06d}"), [])

    def create(self, run_id: str, now: datetime, queries: list[str], discovered: int, git_commit_sha: str, manifest_path: str, manifest_sha256: str) -> None:
        if not checks.OBJECT_SHA.fullmatch(git_commit_sha):
            raise checks.ContractError("not a commit")
        if self.run(run_id) is not None:
            raise checks.ContractError(f"run {run_id} exists")
        self._add(run_id=run_id, at=now, status=RUNNING, started_at=now, git_commit_sha=git_commit_sha, manifest_path=manifest_path, manifest_sha256=manifest_sha256, queries=queries, discovered_count=discovered)

    def add_items(self, run_id: str, items: DataFrame) -> None:
        """Appends the items of a run; a call that is made again replaces what it wrote."""
        path = f"{self.root}/items/run_id={run_id}"
        items.select(*IDENTITY, "status", "reason", "content_sha256").write.mode("overwrite").parquet(path)

    def items(self, run_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/items/run_id={run_id}").orderBy(*IDENTITY)

    def complete(self, run_id: str, now: datetime, totals: DataFrame) -> None:
        self._change(run_id, now, COMPLETED, totals.first().asDict())

    def fail(self, run_id: str, now: datetime) -> None:
        self._change(run_id, now, FAILED, {})

    def _change(self, run_id: str, now: datetime, status: str, totals: dict) -> None:
        run = self.run(run_id)
        if run is None or run["status"] != RUNNING:
            raise checks.ContractError(f"run {run_id} is not running")
        self._add(**{**run, **{k: totals[k] for k in COUNTERS if k in totals}, "at": now, "status": status, "completed_at": now})

    def runs(self) -> DataFrame:
        """The last state of every run."""
        every = self.lock.read()
        if every is None:
            return self.spark.createDataFrame([], RUN_SCHEMA)
        rest = [c for c in every.columns if c != "run_id"]
        return every.groupBy("run_id").agg(F.max_by(F.struct(*rest), F.struct(F.col("status") != RUNNING, "at")).alias("r")).select("run_id", "r.*")

    def run(self, run_id: str) -> dict | None:
        row = self.runs().where(F.col("run_id") == run_id).first()
        return row.asDict() if row else None

    def last_completed(self) -> DataFrame:
        """One row: when the last completed run ended."""
        return last_completed(self.runs())


def last_completed(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status") == COMPLETED).agg(F.max("completed_at").alias("last_completed"))
