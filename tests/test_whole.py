"""Queries that take whole tables, on tables made by hand with the rows that narrower queries leave out."""

import hashlib
from datetime import datetime

from quarrymill.plans import catalog

T1, T2, T3 = (datetime(2025, m, 1) for m in (1, 2, 3))


def written(spark, tmp_path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_every_skill_has_a_metadata_text(spark, tmp_path):
    rows = [(1, "MIT", "linux", ["b", None, "a"], {"k": "v"}, T1), (2, "MIT", None, None, {"k": "v"}, T1), (3, "MIT", None, ["a"], None, T1), (4, None, None, None, None, T1)]
    d = written(spark, tmp_path, skills=(rows, "skill_id long, declared_license string, compatibility string, allowed_tools array<string>, metadata map<string,string>, last_seen_at timestamp"))
    got = {r.skill_id: r.metadata_text.split() for r in catalog.QUERIES["metadata_texts"](spark, d).collect()}
    assert got == {1: ["MIT", "linux", "a", "b", "k", "v"], 2: ["MIT", "k", "v"], 3: ["MIT", "a"], 4: []}


def test_candidates_without_a_blob_have_an_outcome(spark, tmp_path):
    old = [(1, 1, "a", "s1", T1, "h1"), (2, 1, "b", "s2", T1, "h2"), (3, 5, "f", "s6", T1, "h3")]
    new = [(11, 1, "a", None, T2, "t"), (12, 2, "c", None, T2, "t"), (13, 1, "b", "s9", T2, "t"), (14, 1, "b", None, T3, "t"), (15, 3, "d", "s3", T2, "t"), (16, 4, "e", "s5", T2, " "), (17, 5, "f", "s6", T2, None), (18, 6, "g", "s7", T2, None)]
    skills = [(1, 1, "a", "valid", T1), (2, 1, "b", "valid", T1), (3, 3, "d", "warning", T1)]
    d = written(
        spark, tmp_path, existing_skills=(old, "record_id long, repository_id long, path string, git_blob_sha string, accepted_at timestamp, content_sha256 string"),
        skill_candidates=(new, "record_id long, repository_id long, path string, git_blob_sha string, arrived_at timestamp, content_text string"),
        skills=(skills, "skill_id long, repository_id long, path string, validation_status string, last_seen_at timestamp"),
    )
    assert {r.record_id: r.change for r in catalog.QUERIES["classify_changes"](spark, d).collect()} == {11: "skipped", 12: "skipped", 13: "changed", 15: "new", 16: "new", 17: "unchanged", 18: "new"}
    got = {r.path: (r.action, r.git_blob_sha, r.first_seen_at, r.last_seen_at) for r in catalog.QUERIES["merge_upsert"](spark, d).collect()}
    assert got == {
        "a": ("skipped", "s1", T1, T2), "b": ("updated", "s9", T1, T2), "c": ("skipped", None, T2, T2), "d": ("inserted", "s3", T2, T2), "e": ("inserted", "s5", T2, T2), "f": ("unchanged", "s6", T1, T2), "g": ("inserted", "s7", T2, T2),
    }
    # the last candidate of b has no version any more: it changed after its discovery
    assert {r.record_id: r.status for r in catalog.QUERIES["ingest_outcomes"](spark, d).collect()} == {11: "skipped", 12: "skipped", 13: "error", 15: "ingested", 16: "invalid", 17: "unchanged", 18: "error"}
    c = catalog.QUERIES["snapshot_counts"](spark, d).first()
    assert (c.item_count, c.skipped_count, c.ingested_count, c.unchanged_count, c.invalid_count, c.error_count, c.stored_count, c.repository_count, c.valid_skill_count, c.warning_skill_count) == (7, 2, 1, 1, 1, 2, 2, 2, 0, 1)


def test_every_document_counts_in_the_shares(spark, tmp_path):
    rows = [(i, lang) for i, lang in enumerate(["en", "en", "de", "zh", "EN", "de-XX", None, "th"])]
    d = written(spark, tmp_path, documents=(rows, "doc_id long, lang string"))
    got = {r.value: (r.n, r.share) for r in catalog.QUERIES["source_stats_zero_filled"](spark, d).collect()}
    assert len(got) == 11 and sum(n for n, _ in got.values()) == 8
    assert [got[v] for v in ("en", "zh", "th", "ja", "other")] == [(2, 0.25), (1, 0.125), (1, 0.125), (0, 0.0), (3, 0.375)]


def test_every_repository_is_a_seed(spark, tmp_path):
    d = written(spark, tmp_path, repositories=([("a/x", 500, 1), ("b/y", 3, 2), ("c/z", None, 3), ("B/Y", 2, 4), (None, 900, 5)], "full_name string, stars_count int, github_repository_id long"))
    got = sorted(r.query for r in catalog.QUERIES["discovery_plan"](spark, d).collect())
    assert got == sorted([f"{m} filename:SKILL.md{r}" for m in ("name:", "description:") for r in ("", " repo:b/y", " repo:a/x", " repo:c/z")])


def test_vectors_of_another_revision_are_stale(spark, tmp_path):
    fields = ("name_text", "description_text", "metadata_text", "heading_text", "body_text")
    text = "name: a\ndescription: a\nmetadata: a\nheadings: a\nbody: a"
    sha = hashlib.sha256(text.encode()).hexdigest()
    vectors = [("now", catalog.MODEL, catalog.REVISION), ("before", catalog.MODEL, "0" * 40)]
    d = written(
        spark, tmp_path, corpus_documents=([(k, *"aaaaa") for k in ("now", "before", "none")], "document_id string, " + ", ".join(f"{f} string" for f in fields)),
        skill_embeddings=([(k, m, r, 384, [1.0], sha) for k, m, r in vectors], "document_id string, model_id string, model_revision string, model_dimension int, embedding array<float>, embedding_text_sha256 string"),
    )
    assert {r.state: r.n for r in catalog.QUERIES["embedding_coverage"](spark, d).collect()} == {"current": 1, "stale": 1, "missing": 1}
