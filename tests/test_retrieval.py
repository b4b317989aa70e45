import math

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import corpus, dense, fusion, lexical, metrics, pooling


def docs(spark, texts, repositories=None, scripts=None):
    rows = [(f"github:{i}:p{i}", (repositories or ["o/r"] * len(texts))[i], f"p{i}", (scripts or [False] * len(texts))[i], "permissive", "valid", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "document_id string, repository_full_name string, path string, has_scripts boolean, license_status string, validation_status string, text string")
    return corpus.tokenized(df)


def ask(spark, text, name="q"):
    return spark.createDataFrame([(name, text)], "query_id string, query_text string")


def bm25(tf, df, n, dl, avg, k1=1.5, b=0.75):
    return math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg))


def test_bm25_by_hand(spark):
    t = docs(spark, ["alpha beta beta", "alpha gamma"])
    got = {r.document_id: r.score for r in lexical.search(ask(spark, "beta alpha"), t, digits=None).collect()}
    assert got["github:0:p0"] == pytest.approx(bm25(2, 1, 2, 3, 2.5) + bm25(1, 2, 2, 3, 2.5))
    assert got["github:1:p1"] == pytest.approx(bm25(1, 2, 2, 2, 2.5))


def test_bm25_repeated_terms_count_once_and_empty_query_finds_nothing(spark):
    t = docs(spark, ["alpha alpha", "alpha"])
    once = lexical.search(ask(spark, "alpha"), t).select("document_id", "score").collect()
    assert once == lexical.search(ask(spark, "alpha Alpha ALPHA"), t).select("document_id", "score").collect()
    assert lexical.search(ask(spark, "**"), t).count() == 0
    assert lexical.search(ask(spark, "unseen"), t).count() == 0


def test_bm25_ties_by_repository_and_filters_keep_statistics(spark):
    t = docs(spark, ["same text", "same text"], ["zeta/r", "Alpha/r"], [True, False])
    ranked = [r.document_id for r in lexical.search(ask(spark, "same"), t).orderBy("rank").collect()]
    assert ranked == ["github:1:p1", "github:0:p0"]
    full = {r.document_id: r.score for r in lexical.search(ask(spark, "same"), t).collect()}
    kept = lexical.search(ask(spark, "same"), t, allowed=corpus.allows(has_scripts=True)).collect()
    assert [(r.document_id, r.score) for r in kept] == [("github:0:p0", full["github:0:p0"])]


def test_bm25_does_not_depend_on_partitions(spark):
    t = docs(spark, [f"w{i % 7} w{i % 5} w{i % 3} common" for i in range(60)])
    q = ask(spark, "w1 w2 common w3 w4")
    one = sorted(map(tuple, lexical.scores(q, t.coalesce(1)).select("document_id", "score").collect()))
    many = sorted(map(tuple, lexical.scores(q, t.repartition(9)).select("document_id", "score").collect()))
    assert one == many


def test_empty_corpus(spark):
    t = docs(spark, ["x"]).where("false")
    assert lexical.search(ask(spark, "x"), t).count() == 0
    assert lexical.statistics(t).first().avg_len == 0


def test_rrf_by_hand(spark):
    rank = lambda ids: spark.createDataFrame([("q", i, r) for r, i in enumerate(ids, 1)], "query_id string, document_id string, rank int")
    names = spark.createDataFrame([(i, "o/r", i) for i in ("alpha", "beta", "gamma")], "document_id string, repository_full_name string, path string")
    got = fusion.fuse(rank(["alpha", "beta"]), rank(["beta", "gamma"]), names, digits=None).orderBy("rank").collect()
    assert [r.document_id for r in got] == ["beta", "alpha", "gamma"]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61)
    two = fusion.fuse(rank(["alpha"]), rank(["beta"]), names, weights=(2.0, 1.0), digits=None).orderBy("rank").collect()
    assert [r.score for r in two] == [pytest.approx(2 / 61), pytest.approx(1 / 61)]
    with pytest.raises(ValueError):
        fusion.fuse(rank([]), rank([]), names, rrf_k=0)


def test_dense_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 8)).astype("float32")
    x[5] = 0
    rows = [(i, [float(v) for v in x[i]]) for i in range(200)] + [(200, None), (201, [float("nan")] * 8), (202, [1.0])]
    e = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    q = e.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), "embedding")
    got = dense.search(q, e, 5, dimension=8).collect()
    n = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1), 1e-30)[:, None]
    for i in range(3):
        s = np.round(n @ n[i], 6)
        s[5] = -9
        best = sorted(range(200), key=lambda j: (-s[j], j))[:5]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == best
    one = dense.search_one([float(v) for v in x[0]], e, 5).collect()
    assert [r.vec_id for r in one][0] == 0


def test_embedding_problems_and_encoder(spark):
    e = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, None)], "i int, v array<float>")
    assert [r.p for r in e.orderBy("i").select(dense.problem(F.col("v"), 2).alias("p")).collect()] == ["norm", None, "zero", "not_finite", "dimension", "null"]
    t = spark.createDataFrame([(["a", "b"],), (["a", "b"],), ([],)], "t array<string>").coalesce(1)
    v = [r.v for r in t.select(dense.hashing_encoder(16)("t").alias("v")).collect()]
    assert v[0] == v[1] and v[2][0] == 1.0
    assert sum(x * x for x in v[0]) == pytest.approx(1)


def test_incremental_index_does_nothing_twice(spark):
    c = spark.createDataFrame([("d1", ["a"], "t1", "h1"), ("d2", ["b"], "t2", "h2")], "document_id string, tokens array<string>, embedding_text string, embedding_text_sha256 string")
    none = spark.createDataFrame([], "document_id string, model_id string, model_revision string, model_dimension int, embedding array<float>, embedding_text string, embedding_text_sha256 string, indexed_at timestamp")
    made, kept = dense.index_incrementally(c, none, dense.encoder_for(dense.HASHING, "r", 8), F.lit("2025-01-01").cast("timestamp"))
    assert (made.count(), kept.count()) == (2, 0)
    again, kept = dense.index_incrementally(c, made, dense.encoder_for(dense.HASHING, "r", 8), F.current_timestamp())
    assert (again.count(), kept.count()) == (0, 2)
    stale, kept = dense.index_incrementally(c.withColumn("embedding_text_sha256", F.concat("embedding_text_sha256", F.when(F.col("document_id") == "d1", "x").otherwise(""))), made, dense.encoder_for(dense.HASHING, "r", 8), F.current_timestamp())
    assert [r.document_id for r in stale.collect()] == ["d1"] and kept.count() == 1


def ranking(spark, ids):
    return spark.createDataFrame([("q", i, r) for r, i in enumerate(ids, 1)], "query_id string, document_id string, rank int")


@pytest.mark.parametrize("ids,ndcg,rr", [("abc", 1.0, 1.0), ("bac", (1 + 3 / math.log2(3)) / (3 + 1 / math.log2(3)), 1.0), ("xa", None, 0.5), ("xyz", 0.0, 0.0)])
def test_metrics_by_hand(spark, ids, ndcg, rr):
    q = spark.createDataFrame([("q",)], "query_id string")
    j = spark.createDataFrame([("q", "a", 2), ("q", "b", 1), ("q", "c", 0)], "query_id string, document_id string, relevance int")
    r = metrics.per_query(ranking(spark, ids), j, q).first()
    assert r.reciprocal_rank == pytest.approx(rr)
    assert r.recall == pytest.approx(len(set(ids) & {"a", "b"}) / 2)
    if ndcg is not None:
        assert r.ndcg == pytest.approx(ndcg)


def test_metrics_problems_and_percentiles(spark):
    q = spark.createDataFrame([("q",), ("r",)], "query_id string")
    d = spark.createDataFrame([("a", "h"), ("b", "h")], "document_id string, content_sha256 string")
    j = spark.createDataFrame([("q", "a", "h", 2), ("q", "b", "other", 1), ("q", "z", "h", 1), ("s", "a", "h", 1), ("q", "a", "h", 5)], "query_id string, document_id string, content_sha256 string, relevance int")
    got = sorted(r.problem for r in metrics.problems(q, j, d).collect())
    assert got == ["grade", "judged_twice", "missing_document", "no_relevant_document", "stale_content", "unknown_query"]
    v = spark.createDataFrame([(float(i),) for i in range(1, 17)], "v double")
    r = metrics.nearest_rank(v, "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (r.p50, r.p95) == (8.0, 16.0)


def test_pool_and_worksheet(spark):
    from quarrymill.functions.checks import ContractError

    pooled = pooling.pool(ranking(spark, ["a", "b"]), spark.createDataFrame([("q", "b"), ("q", "c")], "query_id string, document_id string"))
    assert {r.document_id: (r.sources, r.bm25_rank) for r in pooled.collect()} == {"a": (["bm25"], 1), "b": (["bm25", "query_seed"], 2), "c": (["query_seed"], None)}
    d = spark.createDataFrame([(i, "h", "=n", "o/r", i, "s") for i in "abc"], "document_id string, content_sha256 string, name string, repository string, path string, snippet string")
    sheet = pooling.worksheet(pooled, spark.createDataFrame([("q", "text")], "query_id string, query_text string"), d)
    rows = sheet.orderBy("label_order").collect()
    assert [r.label_order for r in rows] == [1, 2, 3] and rows[0].name == "'=n"
    filled = sheet.withColumn("relevance", F.lit("1")).withColumn("rationale", F.lit("why"))
    assert pooling.qrels(filled, sheet).count() == 3
    for bad in (filled.withColumn("name", F.lit("x")), filled.withColumn("relevance", F.lit("3")), filled.withColumn("rationale", F.lit(" ")), filled.limit(2), filled.withColumn("more", F.lit(1))):
        with pytest.raises(ContractError):
            pooling.qrels(bad, sheet)
