"""Ingest runs, evidence rules, manifests with pages, payloads and commands."""

import base64
import hashlib
import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quarrymill.__main__ import main
from quarrymill.functions import payload
from quarrymill.functions.checks import ContractError
from quarrymill.operators import dense, evidence, ingest, lexical, metrics, pooling, runs
from quarrymill.plans import commands, evaluation
from quarrymill.sources import artefacts, files

NOW = datetime(2025, 1, 2, 3, tzinfo=timezone.utc)
SHA = "a" * 40


def test_every_candidate_has_one_outcome(spark):
    c = spark.createDataFrame([(1, "a", "s1"), (1, "b", "s2"), (1, "c", "s3"), (1, "d", None), (1, "e", "s5"), (1, "f", "s6"), (1, "g", "s7")], "repository_id long, path string, git_blob_sha string")
    stored = spark.createDataFrame([(1, "a", "s1", "h1"), (1, "b", "s0", "h0")], "repository_id long, path string, git_blob_sha string, content_sha256 string")
    fetched = spark.createDataFrame(
        [(1, "b", "s2", "h2", "warning", None, None), (1, "c", "s3", "h3", "invalid", ["z", "y", "z"], None), (1, "e", "other", "h5", "valid", None, None), (1, "f", None, None, None, None, "Not found."), (1, "a", "s1", "hx", "valid", None, None)],
        "repository_id long, path string, fetched_sha string, content_sha256 string, validation_status string, codes array<string>, failure string",
    )
    items = runs.outcomes(c, stored, fetched)
    got = {r.path: r for r in items.collect()}
    assert {p: r.status for p, r in got.items()} == {"a": "unchanged", "b": "ingested", "c": "invalid", "d": "skipped", "e": "error", "f": "error", "g": "error"}
    assert {p: r.content_sha256 for p, r in got.items()} == {"a": "h1", "b": "h2", "c": "h3", "d": None, "e": None, "f": None, "g": None}
    assert json.loads(got["c"].reason) == {"category": "validation", "codes": ["y", "z"], "message": "The parser reported invalid content."} and list(json.loads(got["c"].reason)) == ["category", "codes", "message"]
    assert json.loads(got["e"].reason)["category"] == "changed" and json.loads(got["f"].reason)["message"] == "Not found." and got["b"].reason is None
    t = runs.summary(items).first()
    assert (t.discovered_count, t.fetched_count, t.unchanged_count, t.parsed_count, t.invalid_count, t.skipped_count, t.error_count) == (7, 3, 1, 2, 1, 1, 3)
    assert {(r.category, r.code): r.n for r in runs.failures(items).collect()} == {("validation", "y"): 1, ("validation", "z"): 1, ("candidate", None): 1, ("changed", None): 1, ("fetch", None): 2}
    assert runs.summary(items.where("false")).first().discovered_count == 0


def test_audit_keeps_the_last_state_of_every_run(spark, tmp_path):
    a = runs.Audit(spark, "file://" + str(tmp_path))
    assert a.runs().count() == 0
    a.create("r1", NOW.replace(tzinfo=None), ["q"], 3, SHA, "m.jsonl", "0" * 64)
    a.create("r2", NOW.replace(tzinfo=None), ["q"], 3, SHA, "m.jsonl", "0" * 64)
    with pytest.raises(ContractError):
        a.create("r1", NOW.replace(tzinfo=None), ["q"], 3, SHA, "m.jsonl", "0" * 64)
    with pytest.raises(ContractError):
        a.create("r3", NOW.replace(tzinfo=None), ["q"], 3, "not a commit", "m.jsonl", "0" * 64)
    items = spark.createDataFrame([(2, "b", "error", "{}", None), (1, "a", "ingested", None, "h")], "repository_id long, path string, status string, reason string, content_sha256 string")
    a.add_items("r1", items)
    a.add_items("r1", items)
    assert [r.path for r in a.items("r1").collect()] == ["a", "b"]
    totals = spark.createDataFrame([(2, 0, 1, 0, 0, 1)], "fetched_count long, unchanged_count long, parsed_count long, invalid_count long, skipped_count long, error_count long")
    a.complete("r1", datetime(2025, 1, 3), totals)
    a.fail("r2", datetime(2025, 1, 4))
    with pytest.raises(ContractError):
        a.complete("r2", datetime(2025, 1, 5), totals)
    assert {r.run_id: (r.status, r.error_count) for r in a.runs().collect()} == {"r1": ("completed", 1), "r2": ("failed", None)}
    assert a.last_completed().first().last_completed == datetime(2025, 1, 3)


def test_record_rules(spark):
    p = spark.createDataFrame([("q", 1, 2, 1, 2, "a", "b"), ("q", 2, 0, 0, 2, None, None), ("q", 4, 2, 3, 1, "a", None), ("r", 2, 1, 1, 1, "a", "a")], artefacts.PAGE_SCHEMA)
    assert {(r.query, r.page_number): r.problems for r in evidence.page_problems(p).collect()} == {("q", 4): ["accepted_over_items", "items_over_total", "boundaries"]}
    assert {r.query for r in evidence.page_gaps(p).collect()} == {"q", "r"}
    good = ("q001", "find a thing", "kind_a", "development", "to find a thing here", ["github:1:a/SKILL.md"])
    bad = ("x", " y", "Kind", "train", "short", ["github:1:a", "github:1:a", "z"])
    q = spark.createDataFrame([good, bad], "query_id string, query_text string, category string, split string, intent string, pool_seed_document_ids array<string>")
    assert {r.query_id: r.problems for r in evidence.query_problems(q).collect()} == {"x": ["query_id", "query_text", "intent", "category", "split", "seeds_unique", "seed_ids"]}
    assert evidence.split_counts(q).first().asDict() == {"query_count": 2, "development_count": 1, "test_count": 0}
    with pytest.raises(ContractError):
        evidence.require_query_set(q)
    j = spark.createDataFrame([("q001", "github:1:a", "0" * 64, 2, "why"), ("q001", "a", "x", 3, " why "), ("q002", "github:1:a", "0" * 64, 0, None)], "query_id string, document_id string, content_sha256 string, relevance int, rationale string")
    assert [r.problems for r in evidence.qrel_problems(j).collect()] == [["document_id", "content_sha256", "relevance", "rationale"]]
    assert evidence.qrel_counts(j).first().asDict() == {"query_count": 2, "judgement_count": 3, "relevant_judgement_count": 2}
    pool = spark.createDataFrame([("q", "github:1:a", ["bm25", "query_seed"], 1), ("q", "github:1:b", ["query_seed", "bm25"], 1), ("q", "github:1:c", ["bm25"], None)], "query_id string, document_id string, sources array<string>, bm25_rank int")
    assert {r.document_id: r.problems for r in evidence.pool_problems(pool).collect()} == {"github:1:b": ["sources"], "github:1:c": ["bm25_rank"]}
    for bounds in ((21, 1, 1, 1), (1, 1_001, 1, 1), (1, 1, 0, 1), (1, 1, 1, 11)):
        with pytest.raises(ContractError):
            evidence.discovery_bounds(*bounds)
    evidence.discovery_bounds(20, 1_000, 100, 10)


HEADER = {"generated_at": "2025-01-01T00:00:00Z", "queries": ["q1", "q2"], "seed_repositories": ["a/x", "B/y"], "target_skills": 2, "target_reached": True}


def test_manifest_with_pages(spark, tmp_path):
    pages = spark.createDataFrame([("q2", 1, 1, 1, 1, "b", "b"), ("q1", 2, 0, 0, 1, None, None), ("q1", 1, 1, 1, 1, "a", "a")], artefacts.PAGE_SCHEMA)
    rows = spark.createDataFrame([(1, "z/r", "https://x", "p", SHA, "u", ["q1"]), (2, "a/r", "https://x", "p", SHA, "u", ["q1", "q2"])], artefacts.MANIFEST.schema)
    path = str(tmp_path / "m.jsonl")
    sha = artefacts.write_manifest(path, HEADER, pages, rows)
    header, p, c = artefacts.read_manifest(spark, path, sha)
    assert (header["page_count"], header["candidate_count"], p.count()) == (3, 2, 3)
    assert [r.repository_full_name for r in c.collect()] == ["a/r", "z/r"] and [(r.query, r.page_number) for r in p.collect()] == [("q1", 1), ("q1", 2), ("q2", 1)]
    lines = open(path).read().splitlines()
    swap = lambda i, j: [lines[j] if k == i else lines[i] if k == j else x for k, x in enumerate(lines)]
    for bad in (swap(1, 2), swap(4, 5), swap(3, 4), lines[:-1], lines + lines[-1:], [lines[0].replace('"target_reached":true', '"target_reached":false'), *lines[1:]], [lines[0], lines[0], *lines[1:]], [*lines[:1], lines[1].replace("{", '{"odd":1,', 1), *lines[2:]], lines[:1] + lines[2:]):
        open(path, "w").write("\n".join(bad) + "\n")
        with pytest.raises(ContractError):
            artefacts.read_manifest(spark, path)
    with pytest.raises(ContractError):
        artefacts.write_manifest(path, {**HEADER, "queries": ["q1"]}, pages, rows)
    assert set(evidence.header_problems({"generated_at": "2025-01-01T00:00:00", "queries": ["q", "q "], "seed_repositories": ["b", "A"], "target_skills": 0})) == {"generated_at_without_zone", "queries_not_unique_and_trimmed", "seeds_not_normalised", "target_out_of_range"}


def test_payloads_are_decoded_strictly(spark):
    body = b"hello\n" * 20
    wrapped = base64.encodebytes(body).decode()
    sha = hashlib.sha1(b"blob %d\0" % len(body) + body).hexdigest()
    rows = [("ok", sha, len(body), "base64", wrapped), ("size", sha, 1, "base64", wrapped), ("sha", "0" * 40, len(body), "base64", wrapped), ("odd", sha, 5, "base64", "a?b="), ("cut", sha, 5, "base64", "abc"), ("kind", sha, 5, "utf-8", wrapped), ("none", sha, 0, "base64", None), ("void", hashlib.sha1(b"blob 0\0").hexdigest(), 0, "base64", "")]
    got = {r.path: r for r in payload.files(spark.createDataFrame(rows, "path string, sha string, size long, encoding string, content string")).collect()}
    assert {p: r.problem for p, r in got.items()} == {"ok": None, "size": "size", "sha": "sha", "odd": "encoding", "cut": "encoding", "kind": "encoding", "none": "encoding", "void": None}
    assert bytes(got["ok"].bytes) == body


def test_first_spelling_and_order_of_the_plan_count(spark):
    seeds = spark.createDataFrame([("b/X", 2), ("B/x", 1), ("a/y", 3)], "repository string, position long")
    assert [r.query for r in ingest.discovery_plan(seeds, ["m:"]).orderBy("position").collect()][:2] == ["m: filename:SKILL.md repo:a/y", "m: filename:SKILL.md repo:B/x"]
    f = spark.createDataFrame([(1, "p", "s", ["q1", "zz"]), (1, "p", "s", ["q9"])], "repository_id long, path string, git_blob_sha string, matched_queries array<string>")
    assert ingest.merge_found(f, ["git_blob_sha"], ["q9", "q1"]).first().matched_queries == ["q9", "q1", "zz"]
    with pytest.raises(ContractError):
        ingest.merge_found(f, ["git_blob_sha"], [str(i) for i in range(21)])


def test_a_changed_version_loses_what_was_derived(spark):
    t = datetime(2025, 1, 1)
    stored = spark.createDataFrame([(1, "a", "s1", t, t, [1.0]), (1, "b", "s2", t, t, [2.0]), (1, "c", "s3", t, t, [3.0])], "repository_id long, path string, git_blob_sha string, first_seen_at timestamp, last_seen_at timestamp, embedding array<double>")
    new = spark.createDataFrame([(1, "a", "s1", t), (1, "b", "s9", t), (2, "d", "s4", t)], "repository_id long, path string, git_blob_sha string, seen_at timestamp")
    got = {r.path: r.embedding for r in ingest.merge(stored, new, "seen_at", [], clear=("embedding",)).collect()}
    assert got == {"a": [1.0], "b": None, "c": [3.0], "d": None}


def test_blinded_order_is_the_fixed_one(spark):
    pool = spark.createDataFrame([("q", d) for d in "abcd"], "query_id string, document_id string")
    want = sorted("abcd", key=lambda d: hashlib.sha256(f"sha256-query-document-v1\0q\0{d}".encode()).hexdigest())
    assert [r.document_id for r in pooling.blinded(pool).orderBy("label_order").collect()] == want


def test_ties_between_equal_vectors_are_cut_in_their_block(spark):
    docs = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40, 0, -1)] + [(99, [0.9, 0.1]), (98, [1.0, 0.001])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    got = dense.search(q, docs, 3, dimension=2).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3]
    named = docs.select(F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("vec_id"), "embedding")
    assert [r.vec_id for r in dense.search(q, named, 3, dimension=2).orderBy("rank").collect()] == ["d1", "d10", "d11"]


def test_encoders_are_what_was_pinned():
    assert dense.encoder_for(dense.HASHING, "1", 16).identity == (dense.HASHING, "1", 16)
    with pytest.raises(ContractError):
        dense.encoder_for("nobody/knows", "1", 16)
    dense.register_encoder("test/shifty", lambda revision, dimension: dense.Encoder("test/shifty", "other", dimension, lambda t: t))
    with pytest.raises(ContractError):
        dense.encoder_for("test/shifty", "1", 16)


def test_vectors_of_other_models_are_left_out(spark):
    rows = [(1, "m", "r", 2, [1.0, 0.0], "c"), (2, "m", "old", 2, [1.0, 0.0], "c"), (3, "x", "r", 2, [1.0, 0.0], "c"), (4, "m", "r", 2, None, "c"), (5, "m", "r", 2, [0.0, 1.0], "d")]
    e = spark.createDataFrame(rows, "vec_id long, model_id string, model_revision string, model_dimension int, embedding array<float>, embedding_config_sha256 string")
    assert [r.vec_id for r in dense.of_model(e, "m", "r", 2).orderBy("vec_id").collect()] == [1, 5] and [r.vec_id for r in dense.of_model(e, "m", "r", 2, "c").collect()] == [1]


def test_index_prunes_by_term(spark):
    t = spark.createDataFrame([(f"d{i}", ["common", f"w{i}"], 2, "o/r", f"p{i}", i % 2 == 0) for i in range(30)], "document_id string, tokens array<string>, doc_len int, repository_full_name string, path string, has_scripts boolean")
    index = lexical.Index.build(t)
    assert (index.size, index.avg_len) == (30, 2.0)
    posts, terms = index.terms_of(["w3"])
    assert [(r.term, r.document_id, r.tf) for r in posts.collect()] == [("w3", "d3", 1)] and terms.first().df == 1
    assert "PartitionFilters: [isnotnull(bucket" in posts._jdf.queryExecution().toString() or "PartitionFilters: [(bucket" in posts._jdf.queryExecution().toString()
    assert index.terms_of([])[0].count() == 0
    q = spark.createDataFrame([("q", "w3 common")], "query_id string, query_text string")
    whole, known = (lexical.search(q, index, 5, asked=a).select("document_id", "score").collect() for a in (None, ["w3", "common"]))
    assert whole == known and whole[0].document_id == "d3"


def test_rankings_must_be_of_the_queries(spark):
    q = spark.createDataFrame([("q1",), ("q2",)], "query_id string")
    j = spark.createDataFrame([("q1", "a", 2), ("q2", "b", 0)], "query_id string, document_id string, relevance int")
    with pytest.raises(ContractError, match="without a relevant"):
        metrics.require_rankings(j, j, q)
    with pytest.raises(ContractError, match="unknown"):
        metrics.require_rankings(j, j, q.where("query_id = 'q1'"))


def test_more_queries_than_can_be_timed(spark):
    with pytest.raises(ContractError, match="more than 1000"):
        evaluation.timed(lambda q: q, spark.range(1_001).select(F.col("id").cast("string").alias("query_id"), F.lit("x").alias("query_text")))


def test_paths_and_bound_settings(tmp_path):
    assert files.safe_path("a/b.jsonl", ".jsonl") == "a/b.jsonl"
    for bad in ("", "/a.jsonl", "a/../b.jsonl", "a\\b.jsonl", "a.json", " a.jsonl", "./a.jsonl"):
        with pytest.raises(ContractError):
            files.safe_path(bad, ".jsonl")
    (tmp_path / "c.json").write_text('{"k1": 1.5}')
    sha = hashlib.sha256(b'{"k1": 1.5}').hexdigest()
    assert files.bound_settings(str(tmp_path / "c.json"), files.Bm25Settings, sha).k1 == 1.5
    with pytest.raises(ContractError):
        files.bound_settings(str(tmp_path / "c.json"), files.Bm25Settings, "0" * 64)
    with pytest.raises(ContractError):
        files.HybridSettings("m", "r", metric="euclid")


def test_discover_and_ingest_commands(spark, tmp_path, capsys):
    front = b"---\nname: demo-skill\ndescription: Does a thing.\n---\n# T\nbody"
    good = hashlib.sha1(b"blob %d\0" % len(front) + front).hexdigest()
    for folder in ("1", "2", "3"):
        os.makedirs(tmp_path / "listing" / folder)
    item = lambda n, repo, path, sha: {"repository": {"id": n, "full_name": repo, "private": False}, "path": path, "sha": sha, "html_url": f"https://git.example.org/{repo}/blob/x/{path}"}
    a, b = item(1, "o/r", "demo-skill/SKILL.md", good), item(2, "p/s", "x/SKILL.md", "b" * 40)
    (tmp_path / "listing" / "1" / "1.json").write_text(json.dumps({"total": 2, "items": [a, b]}))
    (tmp_path / "listing" / "2" / "1.json").write_text(json.dumps({"total": 1, "items": [a]}))
    (tmp_path / "seeds.txt").write_text("o/r\n")
    out = str(tmp_path / "m.jsonl")
    made = commands.discover(spark, str(tmp_path / "listing"), str(tmp_path / "seeds.txt"), out, ["m:"], 5, SHA, NOW)
    assert made["candidates"] == 2
    _, pages, c = artefacts.read_manifest(spark, out, made["manifest_sha256"])
    assert pages.count() == 2 and {r.path: len(r.matched_queries) for r in c.collect()} == {"demo-skill/SKILL.md": 2, "x/SKILL.md": 1}
    os.makedirs(tmp_path / "files/o/r/demo-skill")
    (tmp_path / "files/o/r/demo-skill/SKILL.md").write_bytes(front)
    run = lambda: commands.ingest_run(spark, out, str(tmp_path / "files"), "file://" + str(tmp_path / "store"), SHA, NOW.replace(tzinfo=None))
    one, two = run(), run()
    assert (one["discovered_count"], one["parsed_count"], one["error_count"], one["unchanged_count"]) == (2, 1, 1, 0)
    assert (two["parsed_count"], two["error_count"], two["unchanged_count"]) == (0, 1, 1)
    with pytest.raises(SystemExit):
        main(["--version"])
    assert "quarrymill" in capsys.readouterr().out


def test_pool_labels_and_evaluation_commands(spark, tmp_path):
    from quarrymill.plans.engine import Engine

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    engine = Engine(spark, data)
    docs = engine._table("corpus_documents").where("validation_status = 'valid' and body_text is not null and content_sha256 is not null").dropDuplicates(["document_id"]).orderBy("document_id").limit(20).collect()
    rows = [(f"q{i:03d}", " ".join(d.name.split("-")) + " for all", "kind", "test" if i % 4 == 0 else "development", "to find what it says", [d.document_id]) for i, d in enumerate(docs)]
    schema = artefacts.QUERY_SET.schema
    queries = str(tmp_path / "q.jsonl")
    artefacts.write(artefacts.QUERY_SET, queries, {"name": "set"}, spark.createDataFrame(rows, schema))
    made = commands.make_pool(engine, queries, str(tmp_path / "pool.jsonl"), str(tmp_path / "sheet"))
    assert made["items"] >= 20
    sheet = files.read_worksheet(spark, str(tmp_path / "sheet"))
    seeds = {(q[0], q[5][0]) for q in rows}
    own = F.concat_ws("|", "query_id", "document_id").isin([f"{a}|{b}" for a, b in seeds])
    filled = sheet.withColumn("relevance", F.when(own, "2").otherwise("0")).withColumn("rationale", F.when(own, "its own").otherwise(""))
    files.write_worksheet(filled, str(tmp_path / "filled"))
    got = commands.import_labels(spark, str(tmp_path / "sheet"), str(tmp_path / "filled"), str(tmp_path / "j.jsonl"), commands._sha(queries))
    assert (got["query_count"], got["relevant_judgement_count"]) == (20, 20)
    found = commands.validate(engine, queries, str(tmp_path / "j.jsonl"))
    assert {r.problem for r in found.collect()} <= {"stale_content", "content_sha256"}
    out = str(tmp_path / "report.json")
    said = commands.evaluate(engine, queries, str(tmp_path / "j.jsonl"), out, "bm25", "test", True, NOW, True)
    assert 0 < said["methods"]["bm25"] <= 1 and json.load(open(out))["methods"][0]["query_count"] == 5
    with pytest.raises(ContractError):
        commands.evaluate(engine, queries, str(tmp_path / "j.jsonl"), out, "bm25", "test", False, NOW, True)


def test_snapshot_is_bound_to_what_is_stored(spark, tmp_path):
    schema = artefacts.SNAPSHOT.schema
    rows = [(1, "o/r", "a/SKILL.md", SHA, "ingested", "h1", True, "valid", None), (1, "o/r", "b/SKILL.md", SHA, "invalid", "h2", True, "invalid", {"category": "validation"}), (2, "p/s", "SKILL.md", SHA, "error", None, False, None, {"category": "fetch"})]
    items = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "s.jsonl")
    sha = commands.snapshot(items, path, "m" * 64, NOW)
    stored = spark.createDataFrame([(1, "a/SKILL.md", "O/R", "h1", "valid"), (1, "b/SKILL.md", "o/r", "h2", "invalid"), (9, "x", "z/z", "h", "valid")], "repository_id long, path string, repository_full_name string, content_sha256 string, validation_status string")
    assert [r.path for r in commands.read_snapshot(spark, path, sha, "m" * 64, stored).collect()] == ["a/SKILL.md"]
    for hashes in (("0" * 64, "m" * 64), (sha, "n" * 64)):
        with pytest.raises(ContractError):
            commands.read_snapshot(spark, path, *hashes, stored)
    with pytest.raises(ContractError, match="differs"):
        commands.read_snapshot(spark, path, sha, "m" * 64, stored.withColumn("content_sha256", F.lit("other")))
    with pytest.raises(ContractError, match="contradict"):
        commands.snapshot(items.withColumn("stored", ~F.col("stored")), path, "m" * 64, NOW)


def test_repositories_that_contradict_each_other(spark):
    r = spark.createDataFrame([(1, "a/x"), (1, "A/X"), (2, "a/y"), (2, "b/y"), (3, "B/Y"), (4, None)], "github_repository_id long, full_name string")
    assert sorted(map(tuple, ingest.repository_conflicts(r).collect())) == [("id_with_names", "2"), ("name_with_ids", "b/y")]
