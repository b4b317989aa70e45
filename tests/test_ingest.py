import json
import os

import pytest
from pyspark.sql import functions as F

from quarrymill.functions.checks import ContractError
from quarrymill.operators import corpus, ingest, parse, stats
from quarrymill.sources import artefacts, files, listing
from quarrymill.sources.tables import VersionedTable


def front(**fields):
    return ("---\n" + "".join(f"{k}: {v}\n" for k, v in fields.items()) + "---\n").encode()


GOOD = front(name="demo-skill", description="Does a thing.")


@pytest.mark.parametrize(
    "content,status,codes",
    [
        (GOOD + b"# Title\ntext", "valid", []),
        (GOOD, "warning", ["empty_body"]),
        (front(name="demo-skill", description="x", **{"x-vendor": "1"}) + b"b", "warning", ["extension_field"]),
        (front(name="Bad_Name", description="x") + b"b", "invalid", ["field_invalid"]),
        (front(description="x") + b"b", "invalid", ["field_required"]),
        (front(name="demo-skill", description="x", metadata="{a: 1}") + b"b", "invalid", ["field_invalid"]),
        (front(name="demo-skill", description="x", when="2024-01-01") + b"b", "invalid", ["extension_value_not_json"]),
        (GOOD + b"[x](http://[invalid)", "warning", ["malformed_link_destination"]),
        (GOOD + b"[x](../up) [y](%2e%2e/up)", "invalid", ["unsafe_referenced_path", "unsafe_referenced_path"]),
        (front(name="other", description="x") + b"b", "invalid", ["name_directory_mismatch"]),
        (b"no front matter", "invalid", ["missing_opening_delimiter"]),
        (b"---\nname: x\n", "invalid", ["missing_closing_delimiter"]),
        (b"\xff\xfe", "invalid", ["invalid_utf8"]),
        (b"---\n" + b"a: " + b"x" * 17000 + b"\n---\n", "invalid", ["frontmatter_too_large"]),
        (b"x" * (256 * 1024 + 1), "invalid", ["file_too_large"]),
        (b"---\n- a\n---\nb", "invalid", ["frontmatter_not_mapping"]),
        (b"---\na: &x 1\nb: *x\n---\nb", "invalid", ["invalid_yaml"]),
        (b"---\na: 1\na: 2\n---\nb", "invalid", ["invalid_yaml"]),
        (b"", "invalid", ["missing_opening_delimiter"]),
    ],
)
def test_parse_findings(content, status, codes):
    got = parse.parse("skills/demo-skill/SKILL.md", content)
    assert (got["status"], [m["code"] for m in got["messages"]]) == (status, codes)


def test_parse_signals():
    body = b"# One #\n\n```py\n# no\n```\n## Two\n[a](docs/x.md 'T') <https://e.example/> ![i](https://e.example/i.png)\n[r]: scripts/run.sh\nfive words don't lie here"
    entries = [{"relative_path": p, "kind": k} for p, k in (("scripts", "directory"), ("scripts/run.sh", "file"), ("scripts/run.sh", "file"), ("../x", "file"), ("assets/a.png", "file"), ("SKILL.md", "file"))]
    got = parse.parse("demo-skill/SKILL.md", front(name="demo-skill", description="x", **{"allowed-tools": "Read Grep Read"}) + body, entries)
    assert got["headings"] == ["One", "Two"] and got["code_block_count"] == 1
    assert (got["link_count"], got["external_link_count"]) == (4, 2)
    assert got["referenced_paths"] == ["docs/x.md", "scripts/run.sh"] and got["declared_tools"] == ["Read", "Grep"]
    assert (got["has_scripts"], got["script_count"], got["has_references"], got["asset_count"]) == (True, 1, False, 1)
    assert {m["code"] for m in got["messages"]} == {"unsafe_supporting_path", "duplicate_supporting_path"}


def test_parse_documents_in_spark(spark):
    df = spark.createDataFrame([(1, "demo-skill/SKILL.md", bytearray(GOOD + b"x")), (2, None, None)], "i int, p string, c binary")
    got = {r.i: r for r in parse.parse_documents(df, "i", "p", "c").collect()}
    assert got[1].status == "valid" and got[1].name == "demo-skill" and got[2].status == "invalid"


def candidates(spark, rows):
    return spark.createDataFrame(rows, "repository_id long, path string, git_blob_sha string, seen_at timestamp, name string")


def test_merge_is_idempotent(spark):
    from datetime import datetime

    one, two = datetime(2025, 1, 1), datetime(2025, 2, 1)
    stored = spark.createDataFrame([(1, "a", "s1", one, one, "n1"), (1, "b", "s2", one, one, "n2")], "repository_id long, path string, git_blob_sha string, first_seen_at timestamp, last_seen_at timestamp, name string")
    new = candidates(spark, [(1, "a", "s1", two, "other"), (1, "b", "s9", two, "n9"), (2, "c", "s3", two, "n3")])
    assert {r.path: r.change for r in ingest.classify(new, stored).collect()} == {"a": "unchanged", "b": "changed", "c": "new"}
    merged = ingest.merge(stored, new, "seen_at", ["name"])
    got = {r.path: r for r in merged.collect()}
    assert {p: (r.action, r.name, r.git_blob_sha) for p, r in got.items()} == {"a": ("unchanged", "n1", "s1"), "b": ("updated", "n9", "s9"), "c": ("inserted", "n3", "s3")}
    assert got["a"].first_seen_at == one and got["a"].last_seen_at == two
    again = ingest.merge(merged.drop("action"), new, "seen_at", ["name"])
    assert {r.action for r in again.collect()} == {"unchanged"}


def test_found_files_are_merged_and_conflicts_reported(spark):
    f = spark.createDataFrame([(1, "a/SKILL.md", "s", ["q2"], False), (1, "a/SKILL.md", "s", ["q1"], False), (2, "b/SKILL.md", "x", ["q1"], False), (2, "b/SKILL.md", "y", ["q1"], False), (3, "c/README.md", "s", ["q"], False), (4, "SKILL.md", "s", ["q"], True)], "repository_id long, path string, git_blob_sha string, matched_queries array<string>, private boolean")
    f = ingest.public_files(f)
    assert {r.repository_id: (r.matched_queries, r.versions) for r in ingest.merge_found(f, ["git_blob_sha"]).collect()} == {1: (["q1", "q2"], 1), 2: (["q1"], 2)}
    assert ingest.conflicts(f, ["git_blob_sha"]).count() == 1


def test_discovery_plan_and_children(spark):
    seeds = spark.createDataFrame([("B/x",), ("a/y",), ("A/Y",), (" ",)], "repository string")
    assert [r.query for r in ingest.discovery_plan(seeds, ["m:"]).orderBy("position").collect()] == ["m: filename:SKILL.md repo:A/Y", "m: filename:SKILL.md repo:B/x", "m: filename:SKILL.md"]
    kids = spark.createDataFrame([(1, "a"), (2, "b")], "skill_id int, relative_path string")
    assert sorted(map(tuple, ingest.replace_children(kids, spark.createDataFrame([(1, "c"), (1, "d")], kids.schema), "skill_id").collect())) == [(1, "c"), (1, "d"), (2, "b")]
    e = spark.createDataFrame([("s/a/SKILL.md", "s/a/x/y.md", "file"), ("s/a/SKILL.md", "t/z", "file"), ("SKILL.md", "q", "dir"), ("SKILL.md", "l", "symlink")], "candidate_path string, entry_path string, type string")
    assert sorted(str(r.relative_path) for r in ingest.relative_entries(e).collect()) == ["None", "q", "x/y.md"]


def test_snapshot_rules(spark):
    items = spark.createDataFrame([(1, "ingested", True, "valid", "h", None), (1, "error", False, None, None, "x"), (2, "unchanged", False, None, None, None), (2, "skipped", True, "valid", "h", None)], "repository_id int, status string, stored boolean, validation_status string, content_sha256 string, failure string")
    c = ingest.snapshot_counts(items).first()
    assert (c.item_count, c.repository_count, c.stored_count, c.error_count, c.valid_skill_count) == (4, 2, 2, 1, 2)
    assert {tuple(r.problems) for r in ingest.snapshot_problems(items).collect()} == {("success_not_stored",), ("stored_without_success", "failure_without_evidence")}
    with pytest.raises(ContractError):
        ingest.reconcile(ingest.snapshot_counts(items), ingest.snapshot_counts(items.limit(1)))


def test_drift_and_fingerprint(spark):
    schema = "repository_id int, path string, repository_full_name string, content_sha256 string, validation_status string"
    a = spark.createDataFrame([(1, "a", "O/R", "h", "valid"), (1, "b", "o/r", "h", "valid"), (1, "c", "o/x", "h", "valid"), (1, "d", "o/r", "h", "valid")], schema)
    b = spark.createDataFrame([(1, "a", "o/r", "h", "valid"), (1, "b", "o/r", "i", "valid"), (1, "c", "o/r", "h", "valid")], schema)
    assert {r.path: r.problem for r in corpus.drift(a, b).collect()} == {"b": "stale", "c": "renamed", "d": "missing"}
    one = corpus.fingerprint(a, *a.columns).first()
    assert one == corpus.fingerprint(a.repartition(3).orderBy(F.desc("path")), *a.columns).first()
    assert one != corpus.fingerprint(a.where("path <> 'a'"), *a.columns).first()
    assert corpus.fingerprint(a.where("false"), *a.columns).first().rows == 0


def test_lexical_fields_and_stats(spark):
    s = spark.createDataFrame([(1, "My *Name*", "D", "MIT", None, ["b", "a"], {"z": "1", "k": "2"}, "# H\nbody")], "i int, name string, description string, declared_license string, compatibility string, allowed_tools array<string>, metadata map<string,string>, body_text string")
    r = corpus.lexical_fields(s).first()
    assert (r.name_text, r.metadata_text, r.heading_text, r.body_normalized) == ("my name", "mit a b k 2 z 1", "h", "body")
    t = spark.createDataFrame([(["Read,", "Grep;", " "],), (["Read"],), (None,)], "allowed_tools array<string>")
    assert [(x.tool, x.n) for x in stats.top_tools(t).collect()] == [("read", 2), ("grep", 1)]
    z = stats.zero_filled(s.where("false").select(F.lit("x").alias("v")), "v", ["a"]).first()
    assert (z.n, z.share) == (0, 0.0)


def test_artefacts_round_trip_and_corruption(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "repository_id long, path string").select("repository_id", F.lit("o/r").alias("repository_full_name"), F.lit("https://x").alias("repository_html_url"), "path", F.lit("s").alias("git_blob_sha"), F.lit("u").alias("html_url"), F.array(F.lit("q")).alias("matched_queries"))
    path = str(tmp_path / "m.jsonl")
    sha = artefacts.write(artefacts.MANIFEST, path, {"name": "x"}, rows)
    header, back = artefacts.read(spark, artefacts.MANIFEST, path, sha)
    assert header["candidate_count"] == 2 and [r.path for r in back.orderBy("repository_id").collect()] == ["a", "b"]
    assert artefacts.write(artefacts.MANIFEST, path, {"name": "x"}, rows.repartition(2)) == sha
    with pytest.raises(FileExistsError):
        artefacts.write(artefacts.MANIFEST, path, {"name": "x"}, rows, refuse_overwrite=True)
    lines = open(path).read().split("\n")
    for bad in (lines[:1] + lines[2:1:-1] + lines[1:2] + lines[3:], lines[:2] + lines[3:], [lines[0], lines[1].replace("{", '{"odd":1,', 1), *lines[2:]], lines[:-1]):
        with open(path, "w") as f:
            f.write("\n".join(bad))
        with pytest.raises(ContractError):
            artefacts.read(spark, artefacts.MANIFEST, path)
    assert artefacts.utc(__import__("datetime").datetime(2025, 1, 1, tzinfo=__import__("datetime").timezone.utc)) == "2025-01-01T00:00:00Z"


def test_files_settings_and_worksheet(spark, tmp_path):
    os.makedirs(tmp_path / "s/demo-skill")
    (tmp_path / "s/demo-skill/SKILL.md").write_bytes(b"hello\n")
    r = files.documents(spark, str(tmp_path / "s")).first()
    assert (r.path, r.git_blob_sha, r.byte_count) == ("demo-skill/SKILL.md", "ce013625030ba8dba906f756967f9e9ca394464a", 6)
    (tmp_path / "seeds.txt").write_text("# all\no/r # why\n\n")
    assert [x.repository for x in files.seeds(spark, str(tmp_path / "seeds.txt")).collect()] == ["o/r"]
    (tmp_path / "c.json").write_text('{"k1": 1.2}')
    assert files.settings(str(tmp_path / "c.json"), files.Bm25Settings).k1 == 1.2
    for bad in ('{"k9": 1}', '{"k1": -1}', "[]", '{"k1": "1.2"}', '{"default_top_k": 1.5}', '{"default_top_k": true}', '{"eligible_validation_statuses": "valid"}'):
        (tmp_path / "c.json").write_text(bad)
        with pytest.raises(ContractError):
            files.settings(str(tmp_path / "c.json"), files.Bm25Settings)
    sheet = spark.createDataFrame([("a,\"b\"", "line\nbreak", "")], "x string, y string, z string")
    files.write_worksheet(sheet, str(tmp_path / "w"))
    assert files.read_worksheet(spark, str(tmp_path / "w")).collect() == sheet.collect()


def test_paged_listing(spark, tmp_path):
    os.makedirs(tmp_path / "q1")
    for page in (1, 2):
        item = {"repository": {"id": page, "full_name": "o/r", "private": False}, "path": "SKILL.md", "sha": "s", "html_url": "u"}
        (tmp_path / "q1" / f"{page}.json").write_text(json.dumps({"total": 2, "items": [item]}))
    spark.dataSource.register(listing.PagedListing)
    got = spark.read.format("paged_listing").option("root", str(tmp_path)).load()
    assert sorted((r.query, r.page, r.repository_id) for r in got.collect()) == [("q1", 1, 1), ("q1", 2, 2)]
    assert spark.read.format("paged_listing").option("root", str(tmp_path)).option("pages", 1).load().count() == 1
    item = json.loads((tmp_path / "q1" / "2.json").read_text())
    for page in range(3, 12):
        (tmp_path / "q1" / f"{page}.json").write_text(json.dumps(item))
    with pytest.raises(Exception, match="more than 10 pages"):  # nothing is left out silently
        spark.read.format("paged_listing").option("root", str(tmp_path)).load().count()
    with pytest.raises(Exception, match="pages must be"):
        spark.read.format("paged_listing").option("root", str(tmp_path)).option("pages", 11).load().count()
    # a Link header says where the next page is, or that there is none
    (tmp_path / "q1" / "1.json").write_text(json.dumps({**item, "headers": {"Link": '<https://x/q1/7.json>; rel="next"'}}))
    (tmp_path / "q1" / "7.json").write_text(json.dumps({**item, "headers": {"Link": '<https://x/q1/1.json>; rel="prev"'}}))
    assert spark.read.format("paged_listing").option("root", str(tmp_path)).load().count() == 2
    # a page that says that the limit is used up never becomes one
    (tmp_path / "q1" / "7.json").write_text(json.dumps({"status": 403, "headers": {"Retry-After": "0"}}))
    with pytest.raises(Exception, match="no page after"):
        spark.read.format("paged_listing").option("root", str(tmp_path)).load().count()
    assert listing.rate_limit({"X-RateLimit-Remaining": "0", "x-ratelimit-reset": "oops"}) == {"limit": None, "remaining": 0, "reset": None, "retry_after": None}
    assert listing.pause(3, {}, 0) == 4.0 and listing.pause(0, {"Retry-After": "7"}, 0) == 7
    assert listing.next_page('<https://x/2>; rel="next", <https://x/9>; rel="last"') == "https://x/2"


def test_versioned_table_and_streams(spark, tmp_path):
    from datetime import datetime

    from quarrymill.streaming import incremental

    t = VersionedTable(spark, "file://" + str(tmp_path / "t"))
    assert t.read() is None
    src = str(tmp_path / "src")
    day = lambda n: datetime(2025, 1, n)
    candidates(spark, [(1, "a", "s1", day(1), "n1"), (1, "a", "s2", day(2), "n2")]).write.parquet(src)
    stream = lambda: spark.readStream.schema("repository_id long, path string, git_blob_sha string, seen_at timestamp, name string").parquet(src)
    incremental.upsert_stream(stream(), t, str(tmp_path / "ck"), ["name"]).awaitTermination()
    candidates(spark, [(1, "a", "s2", day(3), "n2"), (2, "b", "s3", day(3), "n3")]).write.mode("append").parquet(src)
    incremental.upsert_stream(stream(), t, str(tmp_path / "ck"), ["name"]).awaitTermination()
    got = {r.path: r for r in t.read().collect()}
    assert {p: (r.git_blob_sha, r.name, r.last_seen_at) for p, r in got.items()} == {"a": ("s2", "n2", day(3)), "b": ("s3", "n3", day(3))}
    with pytest.raises(ContractError):
        t.write(t.read(), lambda df: (_ for _ in ()).throw(ContractError("no")))
    assert t.version() == 2 and t.read().count() == 2
    # a version without its commit file does not count, whatever it holds
    os.makedirs(tmp_path / "t" / "v00000009" / "data")
    assert t.version() == 2 and t.read().count() == 2
    before = t.parts()
    candidates(spark, [(1, "a", "s4", day(4), "n4")]).write.mode("append").parquet(src)
    incremental.upsert_stream(stream(), t, str(tmp_path / "ck"), ["name"]).awaitTermination()
    assert {r.path: r.git_blob_sha for r in t.read().collect()} == {"a": "s4", "b": "s3"}
    assert len({p for p, f in t.parts().items() if before.get(p) != f}) == 1  # only the part of the changed row was written
    events = spark.createDataFrame([(datetime(2025, 1, 1, 0, m), "x") for m in (1, 2, 11)], "ts timestamp, kind string")
    assert sorted(r.n for r in incremental.counts_by_window(events, "ts", "kind").collect()) == [1, 2]
