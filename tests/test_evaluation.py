from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quarrymill.__main__ import main
from quarrymill.functions.checks import ContractError
from quarrymill.plans import evaluation


def test_report(spark, tmp_path):
    q = spark.createDataFrame([("q1", "a", "development"), ("q2", "b", "development"), ("q3", "c", "test")], "query_id string, query_text string, split string")
    j = spark.createDataFrame([("q1", "x", 2), ("q2", "y", 2)], "query_id string, document_id string, relevance int")
    dev = evaluation.of_split(q, "development")
    with pytest.raises(ContractError):
        evaluation.of_split(q, "test")
    assert evaluation.of_split(q, "test", allow_test=True).count() == 1
    ranks = {"bm25": "xy", "dense": "yx", "hybrid": "zz"}
    retrievers = {m: (lambda qs, s=s: qs.select("query_id", F.posexplode(F.array(*[F.lit(c) for c in dict.fromkeys(s)])).alias("rank", "document_id")).withColumn("rank", F.col("rank") + 1).withColumn("score", 1.0 / F.col("rank"))) for m, s in ranks.items()}
    rankings, scored = evaluation.compare(retrievers, dev, j)
    took = {m: evaluation.timed(r, dev) for m, r in list(retrievers.items())[:1]}
    made = evaluation.report(rankings, scored, datetime(2025, 1, 1, tzinfo=timezone.utc), {"queries_sha256": "x"}, took)
    by = {m["method"]: m for m in made["methods"]}
    assert by["bm25"]["mrr_at_10"] == 0.75 == by["dense"]["mrr_at_10"] and by["hybrid"]["mrr_at_10"] == 0
    assert by["bm25"]["failures"] == ["q2"] and by["hybrid"]["failures"] == ["q1", "q2"] and by["bm25"]["latency_ms"]["p95"] > 0
    path = str(tmp_path / "r.json")
    assert evaluation.write_report(made, path) == evaluation.write_report(made, path)
    with pytest.raises(FileExistsError):
        evaluation.write_report(made, path, refuse_overwrite=True)
    assert evaluation.latest(str(tmp_path))["methods"][0]["method"] == "bm25" and evaluation.latest(str(tmp_path / "none")) is None
    with pytest.raises(ContractError):
        evaluation.compare({}, dev, j)


def test_command_line(capsys, spark, tmp_path):
    assert main(["report", str(tmp_path)]) == 0 and capsys.readouterr().out.strip() == "null"
    with pytest.raises(SystemExit):
        main(["search"])
