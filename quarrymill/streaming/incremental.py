"""Streams: incremental ingest by micro-batches, and counts over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrymill.functions import checks
from quarrymill.operators import ingest
from quarrymill.sources.tables import VersionedTable, part_of

#: Parts that a table is kept in; a micro-batch rewrites those it has rows for.
PARTS = 64


def upsert_stream(source: DataFrame, target: VersionedTable, checkpoint: str, keep: list[str], seen_at: str = "seen_at", parts: int = PARTS) -> StreamingQuery:
    """Merges each micro-batch of candidates (repository_id, path, git_blob_sha, seen_at, keep...) into a table kept in parts by a hash of the identity.

    Within a batch the latest row of an identity counts. Only parts that the batch has rows for are read and written.
    Running a batch again changes nothing, as equal versions only move last_seen_at to what it is already.
    """
    part = part_of(*ingest.IDENTITY, parts=parts)

    def merge(batch: DataFrame, _: int) -> None:
        rest = ["git_blob_sha", seen_at, *keep]
        one = batch.groupBy(*ingest.IDENTITY).agg(F.max_by(F.struct(*rest), F.struct(seen_at, "git_blob_sha")).alias("r")).select(*ingest.IDENTITY, "r.*")
        touched = [r.p for r in one.select(part.alias("p")).distinct().collect()]  # at most `parts` rows
        if not touched:
            return
        first = one.select(*ingest.IDENTITY, "git_blob_sha", *keep, F.col(seen_at).alias("first_seen_at"), F.col(seen_at).alias("last_seen_at"))
        stored = target.read(touched)
        merged = first if stored is None else ingest.merge(stored, one, seen_at, keep).drop("action").select(*first.columns)
        target.write_parts(merged, part, touched, unique)

    def unique(written: DataFrame) -> None:
        checks.require_none(checks.duplicates(written, *ingest.IDENTITY), "identities are not unique")

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, time: str, *by: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(window_start, by..., n): rows later than the watermark are left out, all others count once their window closes."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")
