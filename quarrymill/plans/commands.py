"""What the commands of indexing, evaluation and ingest do."""

from __future__ import annotations

import hashlib
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.checks import ContractError
from quarrymill.operators import corpus, evidence, ingest, metrics, parse, pooling, runs
from quarrymill.plans import evaluation
from quarrymill.plans.engine import Engine
from quarrymill.sources import artefacts, files, listing
from quarrymill.sources.tables import VersionedTable


def _sha(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read(artefacts.MOST_BYTES + 1)).hexdigest()


def make_pool(engine: Engine, queries: str, out: str, worksheet: str | None) -> dict:
    """Writes the pool of a query set, and its blinded worksheet."""
    header, asked = artefacts.read(engine.spark, artefacts.QUERY_SET, queries)
    ranking = engine.retriever("bm25", 20)(asked)
    seeds = asked.select("query_id", F.explode("pool_seed_document_ids").alias("document_id"))
    docs = engine._table("corpus_documents").dropDuplicates(["document_id"]).select(
        "document_id", F.coalesce("content_sha256", F.sha2("body_text", 256)).alias("content_sha256"), F.col("repository_full_name").alias("repository"), "path", "name", F.col("safe_snippet").alias("snippet"), "validation_status"
    )
    unknown = pooling.unknown_seeds(seeds, docs)
    if not unknown.isEmpty():
        raise ContractError("a query names a document that is not in the corpus")
    pool = pooling.pool(ranking, seeds).join(docs, "document_id")
    sha = artefacts.write(artefacts.POOL, out, {"query_set_sha256": _sha(queries), "name": header.get("name")}, pool)
    if worksheet:
        files.write_worksheet(pooling.worksheet(pool.select("query_id", "document_id"), asked, docs), worksheet)
    return {"pool_sha256": sha, "items": pool.count()}


def import_labels(spark: SparkSession, expected: str, filled: str, out: str, queries_sha256: str) -> dict:
    """Judgements of a filled-in worksheet as an artefact, with their counts."""
    judged = pooling.qrels(files.read_worksheet(spark, filled), files.read_worksheet(spark, expected))
    counts = evidence.qrel_counts(judged).first().asDict()
    sha = artefacts.write(artefacts.QRELS, out, {**counts, "query_set_sha256": queries_sha256, "relevance_threshold": 1, "max_relevance_grade": 2}, judged)
    return {"qrels_sha256": sha, **counts}


def validate(engine: Engine, queries: str, qrels: str) -> DataFrame:
    """(query_id, document_id, problem) of everything that is wrong with a query set and its judgements."""
    _, asked = artefacts.read(engine.spark, artefacts.QUERY_SET, queries)
    header, judged = artefacts.read(engine.spark, artefacts.QRELS, qrels)
    if header.get("query_set_sha256") not in (None, _sha(queries)):
        raise ContractError("the judgements are of another query set")
    docs = engine._table("corpus_documents").select("document_id", F.coalesce("content_sha256", F.sha2("body_text", 256)).alias("content_sha256"))
    records = evidence.query_problems(asked).select("query_id", F.lit(None).cast("string").alias("document_id"), F.explode("problems").alias("problem"))
    rows = evidence.qrel_problems(judged).select("query_id", "document_id", F.explode("problems").alias("problem"))
    return metrics.problems(asked, judged, docs).unionByName(records).unionByName(rows)


def evaluate(engine: Engine, queries: str, qrels: str, out: str, methods: str, split: str, allow_test: bool, now: datetime, refuse: bool) -> dict:
    """A report of the methods over a split, written as one canonical file."""
    _, asked = artefacts.read(engine.spark, artefacts.QUERY_SET, queries)
    _, judged = artefacts.read(engine.spark, artefacts.QRELS, qrels)
    asked = evaluation.of_split(asked, split, allow_test)
    judged = judged.join(asked.select("query_id"), "query_id", "left_semi")
    chosen = ("bm25",) if methods == "bm25" else evaluation.METHODS
    retrievers = {m: engine.retriever(m) for m in chosen}
    rankings, scored = evaluation.compare(retrievers, asked, judged, chosen)
    made = evaluation.report(rankings, scored, now, {"query_set_sha256": _sha(queries), "qrels_sha256": _sha(qrels), "split": split}, {m: evaluation.timed(r, asked) for m, r in retrievers.items()}, chosen)
    return {"report_sha256": evaluation.write_report(made, out, refuse), "methods": {m["method"]: m["ndcg_at_10"] for m in made["methods"]}}


def discover(spark: SparkSession, root: str, seeds: str, out: str, markers: list[str], target: int, git_commit: str, now: datetime) -> dict:
    """A manifest of candidates from the pages of a listing: pages as evidence, then candidates by repository and path, cut at the target.

    The folder of a query is named by its place in the plan, from 1.
    """
    named = files.seeds(spark, seeds)
    plan = [r.query for r in ingest.discovery_plan(named, markers).orderBy("position").limit(ingest.MOST_QUERIES + 1).collect()]  # the bound is checked
    evidence.discovery_bounds(len(plan), target, ingest.MOST_PAGE_ITEMS, ingest.MOST_PAGES)
    spark.dataSource.register(listing.PagedListing)
    asked = spark.createDataFrame([(str(i), q) for i, q in enumerate(plan, 1)], "folder string, plan_query string")
    items = spark.read.format("paged_listing").option("root", root).load().join(asked, F.col("query") == F.col("folder")).withColumn("query", F.col("plan_query")).drop("folder", "plan_query")
    public = ingest.public_files(items)
    good = public.select("query", "page", "repository_id", "path").withColumn("_ok", F.lit(True)).distinct()
    pages = items.join(good, ["query", "page", "repository_id", "path"], "left").groupBy("query", F.col("page").alias("page_number")).agg(
        F.count("*").cast("int").alias("item_count"), F.count("_ok").cast("int").alias("accepted_item_count"), F.min("path").alias("first_result"), F.max("path").alias("last_result"))
    pages = pages.withColumn("total_count", F.col("item_count"))
    if not evidence.page_problems(pages).isEmpty() or not evidence.page_gaps(pages).isEmpty():
        raise ContractError("the pages of the listing contradict each other")
    fields = ["repository_full_name", "git_blob_sha", "html_url"]
    merged = ingest.merge_found(public.withColumn("matched_queries", F.array("query")), fields, plan)
    if not merged.where("versions > 1").isEmpty():
        raise ContractError("a candidate was found with differing evidence")
    one = public.groupBy(*ingest.IDENTITY).agg(F.first(F.struct(*fields)).alias("r")).select(*ingest.IDENTITY, "r.*")
    every = one.join(merged.drop("versions"), ingest.IDENTITY).withColumn("repository_html_url", F.regexp_extract("html_url", "^(https://[^/]+/[^/]+/[^/]+)", 1))
    count = every.count()
    kept = every.orderBy("repository_full_name", "path").limit(target)  # the target is what the caller asks for
    header = {
        "generated_at": artefacts.utc(now), "git_commit": git_commit, "queries": plan, "seed_repositories": sorted({r.repository for r in named.collect()}, key=str.lower),
        "target_skills": target, "target_reached": count >= target,
    }
    sha = artefacts.write_manifest(out, header, pages, kept)
    return {"manifest_sha256": sha, "candidates": min(count, target), "queries": len(plan)}


def ingest_run(spark: SparkSession, manifest: str, root: str, store: str, git_commit: str, now: datetime) -> dict:
    """Ingests the candidates of a manifest from files below `root`/<repository_full_name>/<path>, into the table and audit below `store`. Returns the totals."""
    header, _, candidates = artefacts.read_manifest(spark, manifest)
    audit, target = runs.Audit(spark, f"{store}/audit"), VersionedTable(spark, f"{store}/skills")
    run_id = uuid.uuid4().hex
    audit.create(run_id, now, header["queries"], header["candidate_count"], git_commit, manifest, _sha(manifest))
    try:
        found = files.documents(spark, root).withColumn("full", F.regexp_extract("path", "^([^/]+/[^/]+)/", 1))
        mine = candidates.select(*ingest.IDENTITY, "repository_full_name", F.concat_ws("/", "repository_full_name", "path").alias("at"))
        joined = mine.join(found.select(F.col("path").alias("at"), "content", F.col("git_blob_sha").alias("fetched_sha"), "content_sha256"), "at")
        parsed = parse.parse_documents(joined.select(F.struct(*ingest.IDENTITY).alias("k"), "path", "content"), "k", "path", "content")
        said = parsed.select("k.*", F.when(F.col("name").isNotNull(), F.col("status")).alias("validation_status"), F.transform("messages", lambda m: m["code"]).alias("codes"), F.col("name").alias("parsed_name"))
        fetched = joined.select(*ingest.IDENTITY, "fetched_sha", "content_sha256").join(said, ingest.IDENTITY).withColumn("failure", F.lit(None).cast("string"))
        stored = target.read()
        if stored is None:
            stored = spark.createDataFrame([], "repository_id bigint, path string, git_blob_sha string, content_sha256 string, validation_status string, first_seen_at timestamp, last_seen_at timestamp")
        items = runs.outcomes(candidates, stored, fetched)
        audit.add_items(run_id, items)
        totals = runs.summary(items)
        taken = items.where("status IN ('ingested', 'unchanged')").select(*ingest.IDENTITY, "git_blob_sha", "content_sha256", "validation_status", F.lit(now).alias("seen_at"))
        target.write(ingest.merge(stored, taken, "seen_at", ["content_sha256", "validation_status"]).drop("action").select(*stored.columns))
        audit.complete(run_id, now, totals)
        return {"run_id": run_id, **totals.first().asDict()}
    except Exception:
        audit.fail(run_id, now)
        raise


def snapshot(items: DataFrame, out: str, manifest_sha256: str, now: datetime) -> str:
    """Writes the items of a run (repository_full_name, path, status, stored, ...) as a snapshot whose header holds their totals; raises if an item contradicts itself."""
    wrong = ingest.snapshot_problems(items)
    if not wrong.isEmpty():
        raise ContractError(f"items contradict their evidence: {[r.problems for r in wrong.select('problems').limit(3).collect()]}")
    totals = ingest.snapshot_counts(items).first().asDict()
    return artefacts.write(artefacts.SNAPSHOT, out, {**totals, "manifest_sha256": manifest_sha256, "generated_at": artefacts.utc(now)}, items)


def read_snapshot(spark: SparkSession, path: str, expected_sha256: str, manifest_sha256: str, stored: DataFrame) -> DataFrame:
    """The stored corpus that a snapshot froze; its bytes, its manifest, its totals and every stored row must agree with it."""
    header, items = artefacts.read(spark, artefacts.SNAPSHOT, path, expected_sha256)
    artefacts.require_snapshot_counts(header, ingest.snapshot_counts(items))
    return corpus.frozen(items, header, stored, manifest_sha256)
