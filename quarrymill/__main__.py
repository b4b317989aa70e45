"""python -m quarrymill: search, stats, detail, query, report, index, evaluate and ingest over a folder of tables."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarrymill")
    top.add_argument("--version", action="version", version="quarrymill 0.2")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, **options) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for x in positional:
            p.add_argument(x)
        for x, given in options.items():
            p.add_argument("--" + x.replace("_", "-"), **given)
        return p

    command("search", "tables", "query", mode={"choices": ("bm25", "dense", "hybrid"), "default": "bm25"}, limit={"type": int, "default": 10}, license={"action": "append"}, status={"action": "append"}, has_scripts={"choices": ("true", "false")}, vectors={})
    command("stats", "tables")
    command("detail", "tables", "skill_id")
    command("query", "tables", "name")
    command("report", "folder")
    command("index", "tables", "vectors")
    command("pool", "tables", "queries", "out", worksheet={})
    command("import-labels", "pool_worksheet", "filled_worksheet", "out", queries_sha256={"required": True})
    command("validate", "tables", "queries", "qrels")
    command("evaluate", "tables", "queries", "qrels", "out", methods={"choices": ("bm25", "all"), "default": "all"}, split={"choices": ("development", "test"), "default": "development"}, allow_test={"action": "store_true"}, vectors={}, refuse_overwrite={"action": "store_true"})
    command("discover", "listing", "seeds", "out", marker={"action": "append", "required": True}, target={"type": int, "default": 200}, git_commit={"required": True})
    command("ingest", "manifest", "files", "root", fail_on_errors={"action": "store_true"}, git_commit={"required": True})
    return top


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    if a.command == "report":
        from quarrymill.plans import evaluation

        print(json.dumps(evaluation.latest(a.folder), sort_keys=True))
        return 0

    from pyspark.sql import SparkSession

    from quarrymill.functions.checks import ContractError

    spark = SparkSession.builder.appName("quarrymill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        shown, code = run(spark, a)
    except (ContractError, KeyError) as error:
        print(f"quarrymill: {error}", file=sys.stderr)
        return 2
    for df in shown:
        if isinstance(df, dict):
            print(json.dumps(df, sort_keys=True, default=str))
            continue
        for row in df.toJSON().toLocalIterator():
            print(row)
    return code


def run(spark, a) -> tuple[list, int]:
    """(tables and objects to show, exit code) of a parsed command."""
    from quarrymill.plans import catalog, commands
    from quarrymill.plans.engine import Engine
    from quarrymill.sources.tables import VersionedTable

    vectors = getattr(a, "vectors", None)
    engine = Engine(spark, a.tables, vectors=VersionedTable(spark, vectors) if vectors else None) if hasattr(a, "tables") else None
    now = datetime.now(timezone.utc)
    if a.command == "search":
        scripts = None if a.has_scripts is None else a.has_scripts == "true"
        return [engine.search(a.query, a.mode, a.limit, a.license, a.status, scripts)], 0
    if a.command == "stats":
        return list(engine.stats().values()), 0
    if a.command == "detail":
        return list(engine.detail(int(a.skill_id))), 0
    if a.command == "query":
        return [catalog.QUERIES[a.name](spark, a.tables)], 0
    if a.command == "index":
        return [{"made": engine.index_dense()}], 0
    if a.command == "pool":
        return [commands.make_pool(engine, a.queries, a.out, a.worksheet)], 0
    if a.command == "import-labels":
        return [commands.import_labels(spark, a.pool_worksheet, a.filled_worksheet, a.out, a.queries_sha256)], 0
    if a.command == "validate":
        found = commands.validate(engine, a.queries, a.qrels)
        return [found], 0 if found.isEmpty() else 1
    if a.command == "evaluate":
        return [commands.evaluate(engine, a.queries, a.qrels, a.out, a.methods, a.split, a.allow_test, now, a.refuse_overwrite)], 0
    if a.command == "discover":
        return [commands.discover(spark, a.listing, a.seeds, a.out, a.marker, a.target, a.git_commit, now)], 0
    totals = commands.ingest_run(spark, a.manifest, a.files, a.root, a.git_commit, now)
    return [totals], 2 if a.fail_on_errors and totals["error_count"] else 0


if __name__ == "__main__":
    raise SystemExit(main())
