"""Evaluation runs: all methods over a query set, as one canonical report."""

from __future__ import annotations

import json
import math
import os
import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.checks import ContractError
from quarrymill.operators import metrics
from quarrymill.sources import artefacts

METHODS = ("bm25", "dense", "hybrid")
MOST_QUERIES = 1_000
Retriever = Callable[[DataFrame], DataFrame]


def of_split(queries: DataFrame, split: str, allow_test: bool = False) -> DataFrame:
    """The queries of a split; the test split is locked unless it is asked for."""
    if split not in ("development", "test"):
        raise ContractError("unknown split")
    if split == "test" and not allow_test:
        raise ContractError("the test split is locked")
    return queries.where(F.col("split") == split)


def nearest_rank(values: list[float], share: float) -> float:
    if not values:
        raise ContractError("a percentile needs a value")
    return sorted(values)[max(1, math.ceil(share * len(values))) - 1]


def timed(retriever: Retriever, queries: DataFrame) -> list[float]:
    """Milliseconds of each query on its own, after one unmeasured run; for query sets of at most MOST_QUERIES."""
    rows = queries.select("query_id", "query_text").limit(MOST_QUERIES + 1).collect()
    if len(rows) > MOST_QUERIES:
        raise ContractError(f"more than {MOST_QUERIES} queries to be timed")
    took = []
    for i, row in enumerate([*rows[:1], *rows]):
        one = queries.where(F.col("query_id") == row.query_id)
        began = time.perf_counter()
        retriever(one).write.format("noop").mode("overwrite").save()
        if i:
            took.append((time.perf_counter() - began) * 1e3)
    return took


def compare(retrievers: dict[str, Retriever], queries: DataFrame, qrels: DataFrame, methods: tuple[str, ...] = METHODS) -> tuple[DataFrame, DataFrame]:
    """(rankings with their method, per-query metrics with their method) of all methods; no loop over queries."""
    metrics.require_rankings(qrels, qrels, queries)
    rankings = scored = None
    for name in methods:
        if name not in retrievers:
            raise ContractError(f"no retriever for {name}")
        ranking = retrievers[name](queries).select("query_id", "document_id", "rank", "score").withColumn("method", F.lit(name))
        per = metrics.per_query(ranking, qrels, queries).withColumn("method", F.lit(name))
        rankings = ranking if rankings is None else rankings.unionByName(ranking)
        scored = per if scored is None else scored.unionByName(per)
    return rankings, scored


def report(rankings: DataFrame, scored: DataFrame, generated_at: datetime, evidence: dict[str, str], latencies: dict[str, list[float]] | None = None, methods: tuple[str, ...] = METHODS) -> dict:
    """A report of small size: aggregates, every query's metrics and the three worst queries of each method."""
    rows = [r.asDict() for r in scored.limit(MOST_QUERIES * len(methods) + 1).collect()]
    if len(rows) > MOST_QUERIES * len(methods):
        raise ContractError("too many queries for a report")
    found = {(r.method, r.query_id): r.ids for r in rankings.where("rank <= 10").groupBy("method", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "document_id"))), lambda x: x["document_id"]).alias("ids")).collect()}
    out = []
    for method in methods:
        mine = sorted((r for r in rows if r["method"] == method), key=lambda r: r["query_id"])
        mean = lambda k, of=mine: math.fsum(r[k] for r in of) / len(of) if of else 0.0
        worst = sorted((r for r in mine if min(r["ndcg"], r["reciprocal_rank"], r["recall"]) < 1), key=lambda r: (r["ndcg"], r["reciprocal_rank"], r["recall"], r["query_id"]))[:3]
        took = (latencies or {}).get(method)
        out.append({
            "method": method, "query_count": len(mine), "ndcg_at_10": mean("ndcg"), "mrr_at_10": mean("reciprocal_rank"), "recall_at_10": mean("recall"),
            "latency_ms": {"p50": nearest_rank(took, 0.5), "p95": nearest_rank(took, 0.95)} if took else None,
            "queries": [{"query_id": r["query_id"], "ndcg_at_10": r["ndcg"], "reciprocal_rank_at_10": r["reciprocal_rank"], "recall_at_10": r["recall"], "results": found.get((method, r["query_id"]), [])} for r in mine],
            "failures": [r["query_id"] for r in worst],
        })
    return {"schema_version": 1, "generated_at": artefacts.utc(generated_at), "evidence": evidence, "methods": out}


def write_report(made: dict, path: str, refuse_overwrite: bool = False) -> str:
    return artefacts.replace_atomically(path, artefacts.canonical(made), refuse_overwrite)


def latest(folder: str) -> dict | None:
    """The report with the latest generated_at in a folder."""
    found = []
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        if name.endswith(".json"):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                found.append(json.load(f))
    return max(found, key=lambda r: r["generated_at"], default=None)
