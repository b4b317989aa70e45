"""Set-based incremental ingest: candidates are classified against what is stored in one plan, and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import checks

IDENTITY = ["repository_id", "path"]
#: Bounds of a discovery plan.
MOST_QUERIES, MOST_TARGET, MOST_PAGE_ITEMS, MOST_PAGES = 20, 1_000, 100, 10


def discovery_plan(seeds: DataFrame, markers: list[str], name: str = "SKILL.md") -> DataFrame:
    """(position, query): each marker for each seed (repository, position), then each marker alone.

    Seeds differing in case only count once, in the spelling that comes first by `position` (by text, where there is none).
    """
    name_of = F.trim("repository")
    first = F.min_by(name_of, F.struct("position", name_of)) if "position" in seeds.columns else F.min(name_of)
    unique = seeds.where(name_of != "").groupBy(F.lower(name_of).alias("_k")).agg(first.alias("repository"))
    listed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("marker")) for i, m in enumerate(markers)])
    spark = seeds.sparkSession
    narrow = unique.select("_k", "repository", F.inline(listed)).select(F.lit(0).alias("_b"), "_k", "i", F.concat_ws("", "marker", F.lit(f" filename:{name} repo:"), "repository").alias("query"))
    broad = spark.range(1).select(F.inline(listed)).select(F.lit(1).alias("_b"), F.lit("").alias("_k"), "i", F.concat(F.col("marker"), F.lit(f" filename:{name}")).alias("query"))
    return narrow.unionByName(broad).select(F.struct("_b", "_k", "i").alias("position"), "query")


def public_files(found: DataFrame, name: str = "SKILL.md") -> DataFrame:
    return found.where(~F.col("private") & (F.substring_index("path", "/", -1) == name))


def merge_found(found: DataFrame, evidence: list[str], plan: list[str] | None = None) -> DataFrame:
    """One row for each identity with the union of its matched_queries; `versions` counts its distinct evidence, which should be 1.

    plan: the queries in the order they were asked (at most MOST_QUERIES); matched_queries follow it, others come after, by text.
    """
    if plan is not None and len(plan) > MOST_QUERIES:
        raise checks.ContractError(f"more than {MOST_QUERIES} queries")
    union = F.array_sort(F.array_distinct(F.flatten(F.collect_set("matched_queries"))))
    if plan:
        place = lambda q: F.coalesce(F.nullif(F.array_position(F.lit(plan), q), F.lit(0)), F.lit(MOST_QUERIES + 1))
        union = F.transform(F.array_sort(F.transform(union, lambda q: F.struct(place(q).alias("p"), q.alias("q")))), lambda x: x["q"])
    return found.groupBy(*IDENTITY).agg(
        union.alias("matched_queries"),
        F.count_distinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in evidence])).alias("versions"),
    )


def conflicts(found: DataFrame, evidence: list[str]) -> DataFrame:
    """Identities that were found with differing evidence."""
    return merge_found(found, evidence).where("versions > 1").drop("matched_queries")


def repository_conflicts(repositories: DataFrame) -> DataFrame:
    """(problem, repository): ids that come with several names, and names (without regard to case) that come with several ids."""
    name = F.lower("full_name")
    renamed = repositories.where("full_name IS NOT NULL").groupBy("github_repository_id").agg(F.count_distinct(name).alias("n")).where("n > 1").select(F.lit("id_with_names").alias("problem"), F.col("github_repository_id").cast("string").alias("repository"))
    shared = repositories.where("full_name IS NOT NULL").groupBy(name.alias("repository")).agg(F.count_distinct("github_repository_id").alias("n")).where("n > 1").select(F.lit("name_with_ids").alias("problem"), "repository")
    return renamed.unionByName(shared)


def classify(candidates: DataFrame, stored: DataFrame, version: str = "git_blob_sha") -> DataFrame:
    """candidates with `change`: unchanged (same version is stored), changed, new, or skipped (without a version). Identities are unique on both sides."""
    known = stored.select(*IDENTITY, F.col(version).alias("_v"), F.lit(True).alias("_there"))
    change = F.when(F.col(version).isNull(), "skipped").when(F.col("_there").isNull(), "new").when(F.col(version) == F.col("_v"), "unchanged").otherwise("changed")
    return candidates.join(known, IDENTITY, "left").withColumn("change", change).drop("_v", "_there")


def merge(stored: DataFrame, incoming: DataFrame, seen_at: str, keep: list[str], skip: bool = False, clear: tuple[str, ...] = ()) -> DataFrame:
    """The new version of a table with identity keys: incoming rows replace stored ones; an unchanged one only moves last_seen_at.

    With `skip`, an incoming row without git_blob_sha is reported as `skipped` and replaces nothing: what is stored stays as it is, but
    for last_seen_at; if nothing is stored, its row is not part of the new version.
    Both have IDENTITY, git_blob_sha and the columns `keep`. stored has first_seen_at and last_seen_at, incoming has seen_at.
    Columns `clear` of stored (what was derived from a version, as its embedding) stay while the version does, and are null else.
    """
    old = stored.select(*IDENTITY, F.struct("git_blob_sha", "first_seen_at", "last_seen_at", *keep, *clear).alias("o"))
    new = incoming.select(*IDENTITY, F.struct("git_blob_sha", F.col(seen_at).alias("seen"), *keep).alias("n"))
    both = old.join(new, IDENTITY, "full_outer")
    blank = F.lit(skip) & F.col("n").isNotNull() & F.col("n.git_blob_sha").isNull()
    same = F.col("o").isNotNull() & F.col("n").isNotNull() & F.col("o.git_blob_sha").eqNullSafe(F.col("n.git_blob_sha"))
    pick = lambda c: F.when(F.col("n").isNull() | blank | same, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return both.select(
        *IDENTITY, pick("git_blob_sha"), *[pick(c) for c in keep],
        *[F.when(F.col("n").isNull() | blank | same, F.col(f"o.{c}")).alias(c) for c in clear],
        F.coalesce("o.first_seen_at", "n.seen").alias("first_seen_at"),
        F.greatest("o.last_seen_at", "n.seen").alias("last_seen_at"),
        F.when(F.col("n").isNull(), "kept").when(blank, "skipped").when(F.col("o").isNull(), "inserted").when(same, "unchanged").otherwise("updated").alias("action"),
    )


def replace_children(children: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Children of parents that came in are replaced as a whole; an incoming parent without children loses its own."""
    rest = children.join(incoming.select(parent).distinct(), parent, "left_anti")
    return rest.unionByName(incoming.where("relative_path IS NOT NULL").select(*children.columns))


def snapshot_counts(items: DataFrame) -> DataFrame:
    """One row: the totals of a snapshot's items (repository_id, status, stored, validation_status)."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    status = F.col("status")
    return items.agg(
        F.count("*").alias("item_count"),
        F.count_distinct(F.when(F.col("stored"), F.col("repository_id"))).alias("repository_count"),
        n(F.col("stored")).alias("stored_count"),
        *[n(status == s).alias(f"{s}_count") for s in ("ingested", "unchanged", "invalid", "skipped", "error")],
        *[n(F.col("stored") & (F.col("validation_status") == v)).alias(f"{v}_skill_count") for v in ("valid", "warning", "invalid")],
    )


def snapshot_problems(items: DataFrame) -> DataFrame:
    """Items whose outcome contradicts their evidence. items: status, stored, failure, validation_status, content_sha256."""
    good = F.col("status").isin("ingested", "unchanged")
    rules: list[tuple[str, Column]] = [
        ("stored_without_success", ~good & F.col("status").isin("skipped", "error") & F.col("stored")),
        ("success_not_stored", good & ~F.col("stored")),
        ("success_with_failure", good & F.col("failure").isNotNull()),
        ("failure_without_evidence", ~good & F.col("failure").isNull()),
        ("stored_without_validation", F.col("stored") & F.col("validation_status").isNull()),
        ("validation_without_store", ~F.col("stored") & F.col("validation_status").isNotNull()),
        ("stored_without_hash", F.col("stored") & F.col("content_sha256").isNull()),
    ]
    return items.withColumn("problems", F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules]))).where(F.size("problems") > 0)


def reconcile(counts: DataFrame, recounted: DataFrame) -> None:
    if not checks.same_rows(counts, recounted):
        raise checks.ContractError("stored counters differ from a recount")


def relative_entries(entries: DataFrame) -> DataFrame:
    """Directory entries (candidate_path, entry_path, type) with paths relative to the candidate's directory; outside it they are null."""
    parent = F.regexp_extract("candidate_path", r"^(.*/)?[^/]+$", 1)
    inside = F.col("entry_path").startswith(parent) & (F.length("entry_path") > F.length(parent))
    return entries.where(F.col("type").isin("file", "dir")).withColumn("relative_path", F.when(inside, F.expr("substring(entry_path, length(regexp_extract(candidate_path, '^(.*/)?[^/]+$', 1)) + 1)")))
