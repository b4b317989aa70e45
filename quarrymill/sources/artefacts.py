"""Small evidence files as canonical JSON lines: one header record, then records in a fixed order.

They are bounded (bytes, records), written on the driver in one canonical form and replaced atomically, so equal contents
are equal bytes and a hash binds them. They are read by Spark with the schema of their record type; a record with fields
the schema doesn't know, a wrong order or counts that don't add up is refused.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions.checks import ContractError

MOST_BYTES, MOST_RECORD_BYTES = 16 * 1024 * 1024, 1024 * 1024


@dataclass(frozen=True)
class Kind:
    """record: the type name of the records after the header; key: what they are sorted by and unique in."""

    header: str
    record: str
    schema: str
    key: tuple[str, ...]
    most: int
    count_field: str


# The record types and field names of the file formats.
MANIFEST = Kind(
    "manifest", "candidate",
    "repository_id bigint, repository_full_name string, repository_html_url string, path string, git_blob_sha string, html_url string, matched_queries array<string>",
    ("repository_id", "path"), 1_000, "candidate_count",
)
SNAPSHOT = Kind(
    "snapshot", "item",
    "repository_id bigint, repository_full_name string, path string, git_blob_sha string, status string, content_sha256 string, stored boolean, validation_status string, failure map<string,string>",
    ("repository_id", "path"), 1_000, "item_count",
)
QUERY_SET = Kind("query_set", "query", "query_id string, query_text string, category string, split string, intent string, pool_seed_document_ids array<string>", ("query_id",), 30, "query_count")
QRELS = Kind("qrels", "qrel", "query_id string, document_id string, content_sha256 string, relevance int, rationale string", ("query_id", "document_id"), 5_000, "qrel_count")
POOL = Kind(
    "pool", "pool_item",
    "query_id string, document_id string, content_sha256 string, repository string, path string, name string, snippet string, validation_status string, sources array<string>, bm25_rank int",
    ("query_id", "document_id"), 3_000, "item_count",
)


def canonical(record: dict) -> bytes:
    return (json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n").encode("utf-8")


def utc(moment: datetime) -> str:
    if moment.tzinfo is None:
        raise ContractError("a time needs its zone")
    return moment.astimezone(timezone.utc).isoformat().replace("+00:00", "Z")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def replace_atomically(path: str, data: bytes, refuse_overwrite: bool = False) -> str:
    """Writes the bytes beside the path and moves them there; returns their hash."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    handle, part = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if refuse_overwrite:
            os.link(part, path)
            os.unlink(part)
        else:
            os.replace(part, path)
    except BaseException:
        if os.path.exists(part):
            os.unlink(part)
        raise
    return sha256(data)


def write(kind: Kind, path: str, header: dict, rows: DataFrame, refuse_overwrite: bool = False) -> str:
    """Writes an artefact from a small table; its records are sorted by the key. Returns the hash of its bytes."""
    names = T.StructType.fromDDL(kind.schema).names
    records = [r.asDict(recursive=True) for r in rows.select(*names).limit(kind.most + 1).collect()]  # the bound is checked
    if len(records) > kind.most:
        raise ContractError(f"more than {kind.most} records")
    records.sort(key=lambda r: tuple(r[k] for k in kind.key))
    keys = [tuple(r[k] for k in kind.key) for r in records]
    if len(set(keys)) != len(keys):
        raise ContractError("records are not unique")
    head = canonical({**header, "record_type": kind.header, "schema_version": 1, kind.count_field: len(records)})
    parts = [head, *[canonical({"record_type": kind.record, **r}) for r in records]]
    if any(len(p) > MOST_RECORD_BYTES for p in parts) or sum(map(len, parts)) > MOST_BYTES:
        raise ContractError("the artefact is too large")
    return replace_atomically(path, b"".join(parts), refuse_overwrite)


def read(spark: SparkSession, kind: Kind, path: str, expected_sha256: str | None = None) -> tuple[dict, DataFrame]:
    """(header, records). The file's bounds, hash, order, uniqueness, count and field names are checked."""
    if os.path.getsize(path) > MOST_BYTES:
        raise ContractError("the artefact is too large")
    with open(path, "rb") as f:
        data = f.read()
    if expected_sha256 is not None and sha256(data) != expected_sha256:
        raise ContractError("the artefact has other bytes than expected")
    lines = data.decode("utf-8").split("\n")
    if lines[-1] != "" or not lines[0]:
        raise ContractError("the artefact doesn't end with a line break")
    header = json.loads(lines[0])
    if header.get("record_type") != kind.header or header.get(kind.count_field) != len(lines) - 2:
        raise ContractError("the header doesn't fit the records")
    schema = T.StructType.fromDDL(kind.schema)
    allowed = {*schema.names, "record_type"}
    keys = []
    for line in lines[1:-1]:
        record = json.loads(line)
        if record.get("record_type") != kind.record or set(record) - allowed:
            raise ContractError("a record has an unknown type or field")
        keys.append(tuple(record[k] for k in kind.key))
    if any(a >= b for a, b in zip(keys, keys[1:], strict=False)):
        raise ContractError("records are not in strictly increasing order")
    rows = spark.read.schema(T.StructType([T.StructField("record_type", T.StringType()), *schema.fields])).json("file://" + os.path.abspath(path), mode="FAILFAST")
    return header, rows.where(F.col("record_type") == kind.record).drop("record_type")


def require_snapshot_counts(header: dict, counted: DataFrame) -> None:
    """The totals in a header must be those of its items (see operators.ingest.snapshot_counts)."""
    row = counted.first().asDict()
    if any(header.get(k) != v for k, v in row.items() if k in header):
        raise ContractError("the header's totals are not those of the items")


PAGE_SCHEMA = "query string, page_number int, item_count int, accepted_item_count int, total_count int, first_result string, last_result string"
MOST_PAGE_RECORDS = 200


def write_manifest(path: str, header: dict, pages: DataFrame, candidates: DataFrame, refuse_overwrite: bool = False) -> str:
    """Header, then pages in the order of the header's queries, then candidates by repository and path. Returns the hash of the bytes."""
    rank = {q: i for i, q in enumerate(header["queries"])}
    listed = [r.asDict() for r in pages.select(*T.StructType.fromDDL(PAGE_SCHEMA).names).limit(MOST_PAGE_RECORDS + 1).collect()]
    rows = [r.asDict(recursive=True) for r in candidates.select(*T.StructType.fromDDL(MANIFEST.schema).names).limit(MANIFEST.most + 1).collect()]
    if len(listed) > MOST_PAGE_RECORDS or len(rows) > MANIFEST.most:
        raise ContractError("too many records for a manifest")
    listed.sort(key=lambda p: (rank.get(p["query"], -1), p["page_number"]))
    rows.sort(key=lambda c: (c["repository_full_name"], c["path"]))
    head = {**header, "record_type": MANIFEST.header, "schema_version": 1, "candidate_count": len(rows), "page_count": len(listed)}
    require_manifest(head, listed, rows)
    parts = [canonical(head), *[canonical({"record_type": "page", **p}) for p in listed], *[canonical({"record_type": MANIFEST.record, **c}) for c in rows]]
    if any(len(p) > MOST_RECORD_BYTES for p in parts) or sum(map(len, parts)) > MOST_BYTES:
        raise ContractError("the artefact is too large")
    return replace_atomically(path, b"".join(parts), refuse_overwrite)


def read_manifest(spark: SparkSession, path: str, expected_sha256: str | None = None) -> tuple[dict, DataFrame, DataFrame]:
    """(header, pages, candidates). The file's bounds, hash, order of records and agreement with its header are checked."""
    if os.path.getsize(path) > MOST_BYTES:
        raise ContractError("the artefact is too large")
    with open(path, "rb") as f:
        data = f.read()
    if expected_sha256 is not None and sha256(data) != expected_sha256:
        raise ContractError("the artefact has other bytes than expected")
    if not data.endswith(b"\n") or b"\n\n" in data:
        raise ContractError("the artefact doesn't end with a line break, or has an empty line")
    if any(len(line) > MOST_RECORD_BYTES for line in data.split(b"\n")):
        raise ContractError("a record is too large")
    records = [json.loads(line) for line in data.decode("utf-8").splitlines()]
    kinds = [r.get("record_type") for r in records]
    pages = kinds.count("page")
    if kinds != [MANIFEST.header] + ["page"] * pages + [MANIFEST.record] * (len(records) - 1 - pages):
        raise ContractError("a manifest is a header, then pages, then candidates")
    schemas = [T.StructType.fromDDL(d) for d in (PAGE_SCHEMA, MANIFEST.schema)]
    parts = [records[1 : 1 + pages], records[1 + pages :]]
    for part, schema in zip(parts, schemas, strict=True):
        if any(set(r) - {"record_type", *schema.names} for r in part):
            raise ContractError("a record has an unknown field")
    require_manifest(records[0], *parts)
    out = [spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in part], schema) for part, schema in zip(parts, schemas, strict=True)]
    return records[0], *out


def require_manifest(header: dict, pages: list[dict], candidates: list[dict]) -> None:
    """The records of a manifest agree with each other and with the header (small lists)."""
    from quarrymill.operators.evidence import header_problems

    wrong = header_problems(header)
    if header.get("page_count") != len(pages) or header.get("candidate_count") != len(candidates):
        wrong.append("counts")
    rank = {q: i for i, q in enumerate(header["queries"])}
    expected: dict[str, int] = {}
    keys = []
    for p in pages:
        if p["query"] not in rank or p["page_number"] != expected.get(p["query"], 1):
            wrong.append("pages_not_contiguous")
            break
        expected[p["query"]] = p["page_number"] + 1
        keys.append((rank[p["query"]], p["page_number"]))
        shown = (p["first_result"] is not None) + (p["last_result"] is not None)
        if not 0 <= p["accepted_item_count"] <= p["item_count"] <= p["total_count"] or shown != (2 if p["item_count"] else 0):
            wrong.append("page_contradicts_itself")
    places = [(c["repository_full_name"], c["path"]) for c in candidates]
    for name, listed in (("pages_out_of_order", keys), ("candidates_out_of_order", places)):
        if any(a >= b for a, b in zip(listed, listed[1:], strict=False)):
            wrong.append(name)
    if len({(c["repository_id"], c["path"]) for c in candidates}) != len(candidates):
        wrong.append("candidates_twice")
    for c in candidates:
        ranks = [rank.get(q, -1) for q in c["matched_queries"]]
        if not ranks or -1 in ranks or ranks != sorted(set(ranks)):
            wrong.append("matched_queries")
            break
    if wrong:
        raise ContractError(f"the manifest is not consistent: {sorted(set(wrong))}")
