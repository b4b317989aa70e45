"""Markdown documents with YAML front matter: fields, findings and structural signals, in one Arrow pass."""

from __future__ import annotations

import json
import re
from collections.abc import Hashable, Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Limits and names of the document format, and the patterns of its names, links, headings, fences and words.
DOCUMENT_BYTES, FRONT_BYTES, PATH_CHARACTERS, ENTRIES = 256 * 1024, 16 * 1024, 1_024, 1_000
STANDARD = ("name", "description", "license", "compatibility", "metadata", "allowed-tools")
NAME = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")
LINKS = (re.compile(r"!?\[[^\]\n]*\]\(([^)\n]+)\)"), re.compile(r"^ {0,3}\[[^\]\n]+\]:\s*(\S+)", re.M), re.compile(r"<((?:https?://)[^>\s]+)>"))
HEADING = re.compile(r" {0,3}#{1,6}[ \t]+(.+?)(?:[ \t]+#+)?[ \t]*")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_WORDS = re.compile(r"\b\w[\w'+-]*\b")

SCHEMA = (
    "name string, description string, license string, compatibility string, allowed_tools string, metadata map<string,string>, extensions string, body string, status string, "
    "messages array<struct<code:string,severity:string,field:string>>, headings array<string>, referenced_paths array<string>, declared_tools array<string>, "
    "code_block_count int, link_count int, external_link_count int, word_count int, byte_count int, "
    "has_scripts boolean, has_references boolean, has_assets boolean, script_count int, reference_count int, asset_count int"
)


class Findings(list):
    def add(self, code: str, field: str | None = None, warning: bool = False) -> None:
        self.append({"code": code, "severity": "warning" if warning else "invalid", "field": field})


def split_front(content: bytes) -> tuple[str | None, str, str | None]:
    """(front matter, body, error code)."""
    if len(content) > DOCUMENT_BYTES:
        return None, "", "file_too_large"
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        return None, "", "invalid_utf8"
    lines = re.sub("\r\n?", "\n", text).split("\n")
    if lines[0] != "---":
        return None, "", "missing_opening_delimiter"
    try:
        end = lines.index("---", 1)
    except ValueError:
        return None, "", "missing_closing_delimiter"
    front = "\n".join(lines[1:end])
    if len(front.encode("utf-8")) > FRONT_BYTES:
        return None, "", "frontmatter_too_large"
    return front, "\n".join(lines[end + 1 :]), None


def load_yaml(front: str) -> object:
    """Plain YAML: no anchors or aliases, no key twice. Raises yaml.YAMLError."""
    import yaml

    for token in yaml.scan(front, Loader=yaml.SafeLoader):
        if isinstance(token, (yaml.AnchorToken, yaml.AliasToken)):
            raise yaml.YAMLError("anchors and aliases are not allowed")

    class Strict(yaml.SafeLoader):
        pass

    def mapping(loader: yaml.SafeLoader, node: yaml.MappingNode) -> dict:
        loader.flatten_mapping(node)
        out: dict = {}
        for k, v in node.value:
            key = loader.construct_object(k, deep=True)
            if not isinstance(key, Hashable) or key in out:
                raise yaml.YAMLError("keys must be plain and different")
            out[key] = loader.construct_object(v, deep=True)
        return out

    Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return yaml.load(front, Loader=Strict)


def is_json(value: object) -> bool:
    if isinstance(value, dict):
        return all(isinstance(k, str) and is_json(v) for k, v in value.items())
    if isinstance(value, list):
        return all(map(is_json, value))
    return value is None or isinstance(value, (str, bool, int, float))


def read_fields(loaded: object, found: Findings) -> tuple[dict, dict]:
    """(standard fields, extensions); a field that is wrong is reported."""
    fields, extensions = {}, {}
    if not isinstance(loaded, dict):
        found.add("frontmatter_not_mapping")
        return {}, {}
    for key, value in loaded.items():
        if not isinstance(key, str):
            found.add("non_string_field_name")
        elif key in STANDARD:
            fields[key] = value
        elif is_json(value):
            extensions[key] = value
            found.add("extension_field", key, warning=True)
        else:
            found.add("extension_value_not_json", key)
    bad = len(found)
    for key in STANDARD:
        value = fields.get(key)
        if value is None and key not in fields:
            if key in ("name", "description"):
                found.add("field_required", key)
            continue
        if key == "metadata":
            ok = isinstance(value, dict) and all(isinstance(k, str) and isinstance(v, str) for k, v in value.items())
        elif key == "name":
            ok = isinstance(value, str) and len(value) <= 64 and NAME.fullmatch(value) is not None
        elif value is None and key not in ("name", "description"):
            continue
        else:
            most = {"description": 1024, "compatibility": 500}.get(key, 1 << 30)
            ok = isinstance(value, str) and 1 <= len(value.strip()) <= most
            if ok:
                fields[key] = value.strip()
        if not ok:
            found.add("field_invalid", key)
    return ({} if any(f["severity"] == "invalid" and f["code"].startswith("field_") for f in found[bad:]) else fields), extensions


def safe_path(path: str) -> bool:
    plain = unquote(path)
    if not plain or len(plain) > PATH_CHARACTERS or "\\" in plain or any(ord(c) < 32 for c in plain):
        return False
    return not {"", ".", ".."} & set(plain.split("/"))


def visible(body: str) -> tuple[list[str], list[str], int]:
    """(lines outside fences, headings, number of fences); a fence is closed by a line of its marks alone."""
    lines, headings, blocks, mark = [], [], 0, ""
    for line in body.splitlines():
        m = FENCE.match(line)
        if mark:
            if m and m.group(1)[0] == mark[0] and len(m.group(1)) >= len(mark) and not line[m.end() :].strip():
                mark = ""
        elif m:
            mark, blocks = m.group(1), blocks + 1
        else:
            lines.append(line)
            if (h := HEADING.fullmatch(line)) and h.group(1).strip():
                headings.append(h.group(1).strip())
    return lines, headings, blocks


def destinations(text: str) -> list[str]:
    out = []
    for k, pattern in enumerate(LINKS):
        for raw in pattern.findall(text):
            raw = raw.strip()
            if k == 0 and raw.startswith("<") and ">" in raw:
                raw = raw[1 : raw.index(">")]
            elif k == 0:
                raw = raw.split(maxsplit=1)[0] if raw else ""
            if raw:
                out.append(raw)
    return out


def parse(path: str, content: bytes, entries: list[dict] | None = None) -> dict:
    """One document; see SCHEMA. A document that can't be read has null fields and its findings."""
    import yaml

    found = Findings()
    whole = unquote(path or "")
    good_path = safe_path(path or "") and whole.split("/")[-1] == "SKILL.md"
    if not good_path:
        found.add("invalid_source_path", "path")
    front, body, error = split_front(content)
    fields: dict = {}
    extensions: dict = {}
    if error:
        found.add(error)
    else:
        try:
            loaded = load_yaml(front)
        except yaml.YAMLError:
            found.add("invalid_yaml")
        else:
            fields, extensions = read_fields(loaded, found)
            if fields and good_path:
                parent = whole.split("/")[-2] if "/" in whole else ""
                if not parent:
                    found.add("root_directory_name_unverified", "name", warning=True)
                elif parent != fields["name"]:
                    found.add("name_directory_mismatch", "name")
            if isinstance(loaded, dict) and not body.strip():
                found.add("empty_body", warning=True)
    lines, headings, blocks = visible(body)
    text = "\n".join(lines)
    links = destinations(text)
    inside, external = [], 0
    for d in links:
        try:
            parts = urlsplit(d)
        except ValueError:
            found.add("malformed_link_destination", "body", warning=True)
            continue
        external += parts.scheme.lower() in ("http", "https") and bool(parts.netloc)
        if not parts.scheme and not parts.netloc and parts.path:
            if safe_path(unquote(parts.path)):
                inside.append(unquote(parts.path))
            else:
                found.add("unsafe_referenced_path", "body")
    kinds = {"scripts": [False, 0], "references": [False, 0], "assets": [False, 0]}
    if entries is not None and len(entries) > ENTRIES:
        found.add("too_many_directory_entries", "directory_entries")
        entries = None
    seen: set[str] = set()
    for e in sorted(entries if entries is not None else (), key=lambda x: x["relative_path"]):
        p = e["relative_path"]
        if not safe_path(p):
            found.add("unsafe_supporting_path", "directory_entries")
        elif p in seen:
            found.add("duplicate_supporting_path", "directory_entries", warning=True)
        else:
            seen.add(p)
            top = p.split("/")[0]
            if top in kinds:
                kinds[top][0] = True
                kinds[top][1] += e["kind"] != "directory"
    tools = fields.get("allowed-tools") or ""
    status = "invalid" if any(f["severity"] == "invalid" for f in found) else "warning" if found else "valid"
    return {
        "name": fields.get("name"), "description": fields.get("description"), "license": fields.get("license"), "compatibility": fields.get("compatibility"),
        "allowed_tools": fields.get("allowed-tools"), "metadata": fields.get("metadata") or {}, "extensions": json.dumps(extensions, sort_keys=True), "body": body, "status": status,
        "messages": list(found), "headings": headings, "referenced_paths": list(dict.fromkeys(inside)), "declared_tools": list(dict.fromkeys(tools.split())),
        "code_block_count": blocks, "link_count": len(links), "external_link_count": external, "word_count": len(_WORDS.findall(text)), "byte_count": len(content),
        "has_scripts": kinds["scripts"][0], "has_references": kinds["references"][0], "has_assets": kinds["assets"][0],
        "script_count": kinds["scripts"][1], "reference_count": kinds["references"][1], "asset_count": kinds["assets"][1],
    }


def parse_documents(df: DataFrame, key: str, path: str, content: str, entries: str | None = None) -> DataFrame:
    """(key, the fields of SCHEMA) of every document; content is binary. Null content counts as empty."""
    kind = df.schema[key].dataType.simpleString()
    chosen = df.select(F.col(key).alias("k"), F.col(path).alias("p"), F.col(content).alias("c"), (F.col(entries) if entries else F.lit(None).cast("array<struct<relative_path:string,kind:string>>")).alias("e"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, p, c, e in frame.itertuples(index=False):
                row = parse(p, bytes(c) if c is not None else b"", list(e) if e is not None else None)
                rows.append({"k": k, **row})
            yield pd.DataFrame(rows, columns=["k", *[x.split()[0] for x in _COLUMNS]])

    return chosen.mapInPandas(run, f"k {kind}, {SCHEMA}").withColumnRenamed("k", key)


_COLUMNS = ["name", "description", "license", "compatibility", "allowed_tools", "metadata", "extensions", "body", "status", "messages", "headings", "referenced_paths", "declared_tools", "code_block_count", "link_count", "external_link_count", "word_count", "byte_count", "has_scripts", "has_references", "has_assets", "script_count", "reference_count", "asset_count"]
