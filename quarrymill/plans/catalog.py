"""Every query of the core with its SQL counterpart.

Batch searches take as queries every row whose id is divisible by 100, against all rows. Scores are rounded to 6 digits
before rows are ordered by them, in both, so that the last bits of floating point don't decide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import checks, payload
from quarrymill.functions import text as X
from quarrymill.operators import corpus, dense, evidence, fusion, ingest, lexical, metrics, parse, pooling, runs, stats
from quarrymill.plans import sql as S
from quarrymill.runtime import Stage, spread, state_of, table
from quarrymill.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

QUESTION = "escaped ledger review before the next run of the ledger"
MODEL, REVISION, DIMENSION = "lumen/mini-encoder-384", "e3c43c44602b97fdddcc73dca1dfd9af4d05d1d2", 384


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _skills(spark: SparkSession, d: str) -> DataFrame:
    return corpus.latest(table(spark, d, "skills"), ["skill_id"], "last_seen_at")


def _repositories(spark: SparkSession, d: str) -> DataFrame:
    return corpus.latest(table(spark, d, "repositories"), ["github_repository_id"], "fetched_at")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return corpus.documents(table(spark, d, "corpus_documents"))


_KEPT: dict[tuple[str, str], tuple] = {}


def _index(spark: SparkSession, d: str) -> lexical.Index:
    """The stored index of a corpus; it is built again when the stored table changes."""
    key = spark.sparkContext.applicationId, d
    now = state_of(spark, f"{d}/corpus_documents.parquet")
    if key not in _KEPT or _KEPT[key][0] != now:
        _KEPT[key] = now, lexical.Index.build(corpus.tokenized(spread(_documents(spark, d))))
    return _KEPT[key][1]


def _one(spark: SparkSession, text: str = QUESTION) -> DataFrame:
    return spark.range(1).select(F.lit("q").alias("query_id"), F.lit(text).alias("query_text"))


#: The terms of the fixed question, which a search for it reads.
_ASKED = sorted(set(QUESTION.split()))


def _batch(spark: SparkSession, d: str) -> DataFrame:
    """The documents whose skill_id is divisible by 100, their names being the queries."""
    return _documents(spark, d).where("skill_id % 100 = 0").select(F.col("document_id").alias("query_id"), F.regexp_replace("name", "-", " ").alias("query_text"))


_BATCH = "SELECT document_id AS query_id, replace(name, '-', ' ') AS query_text FROM docs WHERE skill_id % 100 = 0"
_WORD = S.WORD.replace("'", "''")
_ONE = f"SELECT 'q' AS query_id, '{QUESTION}' AS query_text"

# --- text -----------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, len(regexp_extract_all(lower(text), '{S.TOKEN}'))::INT AS n, array_to_string(regexp_extract_all(lower(text), '{S.TOKEN}'), ' ') AS tokens FROM documents")
def tokenize_documents(spark, d):
    t = X.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.when(F.col("text").isNotNull(), F.size(t)).alias("n"), F.array_join(t, " ").alias("tokens"))


@query()
def normalize_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize("text").alias("normalized"))


@query()
def partition_markdown(spark, d):
    p = table(spark, d, "documents").select("doc_id", X.partition_markdown("text").alias("p"))
    return p.select("doc_id", "p.headings", "p.body")


@query(f"SELECT doc_id, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::INT AS words FROM documents")
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(X.word_count(F.col("text")), F.lit(0)).alias("words"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\x00-\x08\x0b-\x1f\x7f-\x{9f}\x{ad}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]', '', 'g'),
 '^[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ''), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '') AS plain FROM documents""")
def plain_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.plain_text(F.col("text")).alias("plain"))


@query(f"WITH {S.SKILLS} SELECT skill_id, substr(trim(regexp_replace(description, '\\s+', ' ', 'g')), 1, 500) AS snippet FROM sk")
def safe_snippets(spark, d):
    return _skills(spark, d).select("skill_id", X.safe_snippet(F.col("description")).alias("snippet"))


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '^[ \t\r\n]*[=+@-]') OR regexp_matches(text, '^[\t\r\n]') THEN '''' || text ELSE text END AS safe FROM documents")
def csv_safe_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.csv_safe(F.col("text")).alias("safe"))


@query(r"""WITH p AS (SELECT record_id, 'https://git.example.org/' || repository_full_name || '/blob/' || lower(git_blob_sha) || '/' || path AS url, path FROM skill_candidates)
SELECT DISTINCT record_id, CASE WHEN regexp_extract(url, '^https://[^/]+/[^/]+/[^/]+/blob/([0-9a-f]{40})/(.+)$', 2) = path THEN nullif(regexp_extract(url, '^https://[^/]+/[^/]+/[^/]+/blob/([0-9a-f]{40})/(.+)$', 1), '') END AS pinned FROM p""")
def permalink_extract(spark, d):
    c = table(spark, d, "skill_candidates")
    url = F.concat(F.lit("https://git.example.org/"), "repository_full_name", F.lit("/blob/"), F.lower("git_blob_sha"), F.lit("/"), "path")
    return c.select("record_id", X.pinned_commit(url, F.col("path")).alias("pinned")).distinct()


@query(r"""SELECT DISTINCT record_id,
 (path <> '' AND NOT regexp_matches(path, '^\s|\s$') AND strlen(path) <= 4096 AND NOT regexp_matches(path, '[\\%]') AND NOT regexp_matches(path, '(^|/)\.{0,2}(/|$)')) AS good_path,
 coalesce(regexp_matches(git_blob_sha, '^([0-9a-f]{40}|[0-9a-f]{64})$'), false) AS good_sha,
 (regexp_matches(split_part(repository_full_name, '/', 1), '^[A-Za-z0-9]([A-Za-z0-9-]{0,37}[A-Za-z0-9])?$') AND NOT contains(split_part(repository_full_name, '/', 1), '--')
  AND len(string_split(repository_full_name, '/')) = 2 AND regexp_matches(split_part(repository_full_name, '/', 2), '^[A-Za-z0-9_.-]{1,100}$')
  AND NOT contains(split_part(repository_full_name, '/', 2), '..') AND NOT suffix(split_part(repository_full_name, '/', 2), '.')) AS good_name FROM skill_candidates""")
def validate_identifiers(spark, d):
    c = table(spark, d, "skill_candidates")
    return c.select("record_id", checks.relative_path(F.col("path")).alias("good_path"), checks.object_sha(F.col("git_blob_sha")).alias("good_sha"), checks.full_name(F.col("repository_full_name")).alias("good_name")).distinct()


@query(r"""SELECT DISTINCT github_repository_id, regexp_matches(html_url, '^https://git\.example\.org(/[^?#]*)?$') AND NOT regexp_matches(html_url, '/\.{1,2}(/|$)') AS good_url FROM repositories""")
def validate_urls(spark, d):
    return table(spark, d, "repositories").select("github_repository_id", checks.https_url(F.col("html_url"), "git.example.org").alias("good_url")).distinct()


@query(f"""WITH {S.SKILLS}, m AS (SELECT skill_id, list_sort(map_entries(metadata)) AS e, * FROM sk)
SELECT skill_id, concat_ws(' ', nullif(declared_license, ''), nullif(compatibility, ''), coalesce(array_to_string(list_sort(list_filter(allowed_tools, lambda t: t IS NOT NULL)), ' '), ''),
 coalesce(array_to_string(list_transform(e, lambda x: concat_ws(' ', x.key, x.value)), ' '), '')) AS metadata_text FROM m""")
def metadata_texts(spark, d):
    """A row for every skill: null allowed_tools are an empty list, null metadata is an empty map."""
    tools = F.coalesce(F.filter("allowed_tools", lambda t: t.isNotNull()), F.array().cast("array<string>"))
    keyed = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    return _skills(spark, d).select("skill_id", X.metadata_text(F.col("declared_license"), F.col("compatibility"), tools, keyed).alias("metadata_text"))


@query("SELECT DISTINCT document_id, sha256('name: ' || coalesce(name_text, '') || chr(10) || 'description: ' || coalesce(description_text, '') || chr(10) || 'metadata: ' || coalesce(metadata_text, '') || chr(10) || 'headings: ' || coalesce(heading_text, '') || chr(10) || 'body: ' || coalesce(body_text, '')) AS sha FROM corpus_documents")
def embedding_text_hashes(spark, d):
    c = table(spark, d, "corpus_documents")
    return c.select("document_id", F.sha2(X.embedding_text(*[F.col(f) for f in corpus.FIELDS]), 256).alias("sha")).distinct()


# --- lexical --------------------------------------------------------------------------------------------------------


@query(f"WITH {S.DOCS}, {S.TOKENS} SELECT document_id, term, tf FROM tf")
def term_frequencies(spark, d):
    return _index(spark, d).postings.select("document_id", "term", "tf")


@query(f"WITH {S.DOCS}, {S.TOKENS} SELECT term, df FROM dfr")
def document_frequencies(spark, d):
    return _index(spark, d).terms.select("term", "df")


@query(f"WITH {S.DOCS}, {S.TOKENS} SELECT n_docs, total_len, round(avg_len, 6) AS avg_len FROM st")
def corpus_stats(spark, d):
    return lexical.statistics(_index(spark, d).docs).select("n_docs", "total_len", F.round("avg_len", 6).alias("avg_len"))


@query(f"WITH {S.DOCS}, {S.TOKENS} SELECT term, df, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfr CROSS JOIN st")
def idf_table(spark, d):
    index = _index(spark, d)
    return index.terms.select("term", "df", F.round(lexical.idf(F.lit(index.n_docs), F.col("df")), 6).alias("idf"))


@query(f"WITH {S.DOCS}, {S.TOKENS}, {S.bm25(_ONE, 10)} SELECT query_id, rank::INT AS rank, document_id, score FROM bm25")
def bm25_search(spark, d):
    return lexical.search(_one(spark), _index(spark, d), asked=_ASKED).select("query_id", "rank", "document_id", "score")


@query(f"""WITH {S.DOCS}, {S.TOKENS}, {S.bm25(_ONE, 10)}
SELECT b.document_id, s.term, s.tf::BIGINT AS tf, s.df, round(s.idf, 6) AS idf, round(s.s, 6) AS part FROM bm25 b JOIN sco s USING (query_id, document_id)""")
def bm25_explain(spark, d):
    t = lexical.search(_one(spark), _index(spark, d), asked=_ASKED).select("document_id", F.inline("terms"))
    return t.select("document_id", "term", "tf", "df", F.round("idf", 6).alias("idf"), F.round("score", 6).alias("part"))


@query(f"WITH {S.DOCS}, {S.TOKENS}, {S.bm25(_BATCH, 10)} SELECT query_id, rank::INT AS rank, document_id, score FROM bm25")
def bm25_batch(spark, d):
    return lexical.search(_batch(spark, d), _index(spark, d)).select("query_id", "rank", "document_id", "score")


_ALLOWED = "o.license_status IN ('permissive', 'restrictive') AND o.validation_status = 'valid' AND NOT o.has_scripts"


@query(f"WITH {S.DOCS}, {S.TOKENS}, {S.bm25(_ONE, 10, _ALLOWED)} SELECT query_id, rank::INT AS rank, document_id, score FROM bm25")
def bm25_filtered(spark, d):
    rule = corpus.allows(["permissive", "restrictive"], ["valid"], False)
    return lexical.search(_one(spark), _index(spark, d), allowed=rule, asked=_ASKED).select("query_id", "rank", "document_id", "score")


_AGAIN = "ledger ledger LEDGER review"


@query(f"WITH {S.DOCS}, {S.TOKENS}, {S.bm25(f'''SELECT 'q' AS query_id, '{_AGAIN}' AS query_text''', 10)} SELECT query_id, rank::INT AS rank, document_id, score FROM bm25")
def bm25_repeated_terms(spark, d):
    return lexical.search(_one(spark, _AGAIN), _index(spark, d)).select("query_id", "rank", "document_id", "score")


@query()
def bm25_normalized(spark, d):
    """With the full normalisation of queries and texts, as texts from outside need it."""
    t = lexical.Index.build(corpus.tokenized(spread(_documents(spark, d)), normalize=True))
    return lexical.search(_one(spark, "**Escaped** [ledger](x) `review`"), t, normalize=True).select("query_id", "rank", "document_id", "score")


# --- dense ----------------------------------------------------------------------------------------------------------

_E64 = S.USABLE.format(v="embedding", d=64)


@query(f"SELECT vec_id, {S.cosine('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')} AS similarity FROM embeddings ORDER BY 2 DESC, 1 LIMIT 10")
def dense_search(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()
    return dense.search_one(list(q.embedding), e, 10)


_DENSE_BATCH = """SELECT query_id, rank::INT AS rank, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM
 (SELECT q.vec_id AS query_id, e.vec_id, {s} AS similarity FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 100 = 0{f})) WHERE rank <= 10"""


@query(_DENSE_BATCH.format(s=S.cosine("q.embedding", "e.embedding"), f=""))
def dense_batch(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.search(q, e, 10, dimension=64).select("query_id", "rank", "vec_id", "similarity")


@query(_DENSE_BATCH.format(s=S.cosine("q.embedding", "e.embedding"), f=" AND e.label IN (1, 2, 3)"))
def dense_filtered(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.search(q, e.where("label IN (1, 2, 3)"), 10, dimension=64).select("query_id", "rank", "vec_id", "similarity")


@query(f"""WITH e AS (SELECT DISTINCT vec_id, embedding FROM skill_embeddings WHERE model_id = '{MODEL}' AND model_revision = '{REVISION}' AND model_dimension = {DIMENSION} AND {S.USABLE.format(v="embedding", d=384)})
SELECT query_id, rank::INT AS rank, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM
 (SELECT q.vec_id AS query_id, e.vec_id, {S.cosine("q.embedding", "e.embedding")} AS similarity FROM e q CROSS JOIN e WHERE q.vec_id % 100 = 0)) WHERE rank <= 10""")
def dense_pinned(spark, d):
    """Only vectors of the pinned model and revision are compared."""
    e = dense.of_model(table(spark, d, "skill_embeddings"), MODEL, REVISION, DIMENSION).select("vec_id", "embedding").dropDuplicates(["vec_id"])
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.search(q, e, 10, dimension=DIMENSION).select("query_id", "rank", "vec_id", "similarity")


@query("""WITH v AS (SELECT DISTINCT vec_id, embedding AS e FROM skill_embeddings), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM v)
SELECT coalesce(CASE WHEN e IS NULL THEN 'null' WHEN len(e) <> 384 THEN 'dimension' WHEN len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'not_finite' WHEN n = 0 THEN 'zero' WHEN abs(n - 1) > 1e-4 THEN 'norm' END, 'ok') AS problem, count(*) AS n FROM n GROUP BY 1""")
def embedding_validation(spark, d):
    e = table(spark, d, "skill_embeddings").select("vec_id", "embedding").dropDuplicates(["vec_id"])
    return e.groupBy(F.coalesce(dense.problem(F.col("embedding"), DIMENSION), F.lit("ok")).alias("problem")).agg(F.count("*").alias("n"))


@query(f"""WITH {S.SKILLS}, c AS (SELECT DISTINCT document_id, sha256('name: ' || coalesce(name_text, '') || chr(10) || 'description: ' || coalesce(description_text, '') || chr(10) || 'metadata: ' || coalesce(metadata_text, '') || chr(10) || 'headings: ' || coalesce(heading_text, '') || chr(10) || 'body: ' || coalesce(body_text, '')) AS h FROM corpus_documents),
e AS (SELECT document_id, list(DISTINCT CASE WHEN model_id = '{MODEL}' AND model_revision = '{REVISION}' AND model_dimension = {DIMENSION} THEN embedding_text_sha256 END) AS hs FROM skill_embeddings WHERE embedding IS NOT NULL GROUP BY 1)
SELECT CASE WHEN e.document_id IS NULL THEN 'missing' WHEN list_contains(hs, h) THEN 'current' ELSE 'stale' END AS state, count(*) AS n FROM c LEFT JOIN e USING (document_id) GROUP BY 1""")
def embedding_coverage(spark, d):
    c = table(spark, d, "corpus_documents").select("document_id", F.sha2(X.embedding_text(*[F.col(f) for f in corpus.FIELDS]), 256).alias("embedding_text_sha256")).distinct()
    return dense.coverage(c, table(spark, d, "skill_embeddings"), MODEL, REVISION, DIMENSION).groupBy("state").agg(F.count("*").alias("n"))


@query()
def hashing_encoder(spark, d):
    return corpus.tokenized(spread(_documents(spark, d))).select("document_id", dense.hashing_encoder()("tokens").alias("embedding"))


def _dense_ranking(spark: SparkSession, d: str, k: int) -> DataFrame:
    """For the batch queries, the documents nearest to the query document's own vector."""
    docs = _documents(spark, d).select("document_id", "skill_id")
    e = table(spark, d, "skill_embeddings").select("document_id", "embedding").dropDuplicates(["document_id"]).join(docs, "document_id")
    e = Stage(spark, "vectors").write(e, "vectors")  # read for both sides and their counts
    q = e.where("skill_id % 100 = 0").select(F.col("document_id").alias("query_id"), "embedding")
    return dense.search(q, e, k, key="document_id")


_DENSE = f"""de AS (SELECT e.document_id, d.skill_id, any_value(e.embedding) AS embedding FROM skill_embeddings e JOIN docs d USING (document_id) GROUP BY 1, 2),
du AS (SELECT * FROM de WHERE {S.USABLE.format(v="embedding", d=384)}),
dsim AS (SELECT q.document_id AS query_id, e.document_id, {S.cosine("q.embedding", "e.embedding")} AS similarity FROM du q CROSS JOIN du e WHERE q.skill_id % 100 = 0),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, document_id) AS rank FROM dsim) WHERE rank <= 50)"""


def _fused(weights: tuple[float, float]) -> str:
    return f"""fz AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.document_id, b.document_id) AS document_id, a.rank AS rank_1, b.rank AS rank_2,
 round(coalesce({weights[0]} / (60 + a.rank), 0.0) + coalesce({weights[1]} / (60 + b.rank), 0.0), 6) AS score FROM bm25 a FULL OUTER JOIN dense b ON a.query_id = b.query_id AND a.document_id = b.document_id),
hybrid AS (SELECT query_id, rank, document_id, score, rank_1, rank_2 FROM (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, least(rank_1, rank_2), lower(repository_full_name), lower(path), document_id) AS rank FROM fz f JOIN docs USING (document_id)) WHERE rank <= 10)"""


_HYBRID_OUT = "SELECT query_id, rank::INT AS rank, document_id, score, rank_1::INT AS rank_1, rank_2::INT AS rank_2 FROM hybrid"


def _hybrid(spark: SparkSession, d: str, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    docs = _documents(spark, d)
    lex = lexical.search(_batch(spark, d), _index(spark, d), k=fusion.DEPTH)
    return fusion.fuse(lex, _dense_ranking(spark, d, fusion.DEPTH), docs, weights=weights)


@query(f"WITH {S.DOCS}, {S.TOKENS}, {S.bm25(_BATCH, 50)}, {_DENSE}, {_fused((1.0, 1.0))} {_HYBRID_OUT}")
def rrf_hybrid(spark, d):
    return _hybrid(spark, d)


@query(f"WITH {S.DOCS}, {S.TOKENS}, {S.bm25(_BATCH, 50)}, {_DENSE}, {_fused((2.0, 1.0))} {_HYBRID_OUT}")
def rrf_weighted(spark, d):
    return _hybrid(spark, d, (2.0, 1.0))


# --- evaluation -----------------------------------------------------------------------------------------------------

#: The query's own document has grade 2, others with the same first two words of the name grade 1.
_STEM = "regexp_extract(name, '^[^-]*-[^-]*', 0)"
_QRELS = f"qrels AS (SELECT q.document_id AS query_id, x.document_id, CASE WHEN q.document_id = x.document_id THEN 2 ELSE 1 END AS relevance FROM docs q JOIN docs x ON {_STEM.replace('name', 'q.name')} = {_STEM.replace('name', 'x.name')} WHERE q.skill_id % 100 = 0 AND {_STEM.replace('name', 'q.name')} <> '')"


def _qrels(spark: SparkSession, d: str) -> DataFrame:
    stem = F.regexp_extract("name", "^[^-]*-[^-]*", 0).alias("stem")
    docs = _documents(spark, d)
    q = docs.where("skill_id % 100 = 0").select(F.col("document_id").alias("query_id"), stem).where("stem <> ''")
    return q.join(docs.select("document_id", stem), "stem").select("query_id", "document_id", F.when(F.col("query_id") == F.col("document_id"), 2).otherwise(1).alias("relevance"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _batch(spark, d).select("query_id")


_PER = "SELECT query_id, round(ndcg, 6) AS ndcg, round(reciprocal_rank, 6) AS reciprocal_rank, round(recall, 6) AS recall, first_relevant::INT AS first_relevant FROM per"
_METRICS = f"WITH {S.DOCS}, {S.TOKENS}, {S.bm25(_BATCH, 10)}, {_QRELS}, {S.metrics('bm25', 'qrels', 'qs')}"


def _per(spark: SparkSession, d: str) -> DataFrame:
    return metrics.per_query(bm25_batch(spark, d), _qrels(spark, d), _queries(spark, d))


def _rounded(per: DataFrame) -> DataFrame:
    return per.select(*[F.round(c, 6).alias(c) if c in ("ndcg", "reciprocal_rank", "recall", "mrr") else c for c in per.columns])


@query(f"{_METRICS} {_PER}")
def per_query_metrics(spark, d):
    return _rounded(_per(spark, d))


@query(f"{_METRICS} SELECT count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(reciprocal_rank), 6) AS mrr, round(avg(recall), 6) AS recall FROM per")
def macro_metrics(spark, d):
    return _rounded(metrics.macro(_per(spark, d)))


_VAGUE = "SELECT document_id AS query_id, split_part(name, '-', 1) AS query_text FROM docs WHERE skill_id % 100 = 0"


@query(f"""WITH {S.DOCS}, {S.TOKENS}, {S.bm25(_VAGUE, 10)}, {_QRELS}, {S.metrics('bm25', 'qrels', 'qs')}
SELECT query_id, round(ndcg, 6) AS ndcg, CASE WHEN first_relevant IS NULL THEN 'no_relevant_result_in_top_10' WHEN first_relevant > 3 THEN 'first_relevant_result_below_rank_3' WHEN recall < 1 THEN 'relevant_pool_items_missed' ELSE 'relative_ordering_error' END AS failure_type
FROM per WHERE ndcg < 1 OR reciprocal_rank < 1 OR recall < 1 ORDER BY round(ndcg, 9), reciprocal_rank, recall, query_id LIMIT 3""")
def failure_examples(spark, d):
    """The queries are the first words of the names, which say little."""
    vague = _documents(spark, d).where("skill_id % 100 = 0").select(F.col("document_id").alias("query_id"), F.split_part("name", F.lit("-"), F.lit(1)).alias("query_text"))
    per = metrics.per_query(lexical.search(vague, _index(spark, d)), _qrels(spark, d), vague).withColumn("ndcg", F.round("ndcg", 9))
    return metrics.failures(per).select("query_id", F.round("ndcg", 6).alias("ndcg"), "failure_type")


@query(f"""WITH {S.DOCS}, {S.TOKENS}, {S.bm25(_BATCH, 50)}, {_DENSE}, {_fused((1.0, 1.0))}, {_QRELS}, {S.metrics('bm25', 'qrels', 'qs', 'l')}, {S.metrics('dense', 'qrels', 'qs', 'd')}, {S.metrics('hybrid', 'qrels', 'qs', 'h')},
al AS (SELECT 'bm25' AS method, * FROM lper UNION ALL SELECT 'dense', * FROM dper UNION ALL SELECT 'hybrid', * FROM hper)
SELECT method, count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(reciprocal_rank), 6) AS mrr, round(avg(recall), 6) AS recall FROM al GROUP BY method""")
def method_comparison(spark, d):
    q, j = _queries(spark, d), _qrels(spark, d)
    one = lambda name, r: metrics.per_query(r, j, q).withColumn("method", F.lit(name))
    stage = Stage(spark, "methods")  # both rankings are read twice, alone and fused
    lex = stage.write(lexical.search(_batch(spark, d), _index(spark, d), k=fusion.DEPTH).drop("terms"), "lexical")
    vec = stage.write(_dense_ranking(spark, d, fusion.DEPTH), "dense")
    every = one("bm25", lex).unionByName(one("dense", vec)).unionByName(one("hybrid", fusion.fuse(lex, vec, _documents(spark, d))))
    return _rounded(metrics.macro(every, "method"))


@query("SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return metrics.nearest_rank(table(spark, d, "events"), "value", {"p50": 0.5, "p95": 0.95}, "event_type")


@query(f"""WITH {S.DOCS}, {S.TOKENS}, {S.bm25(_BATCH, 20)}, sd AS (SELECT document_id AS query_id, document_id FROM docs WHERE skill_id % 100 = 0)
SELECT coalesce(b.query_id, s.query_id) AS query_id, coalesce(b.document_id, s.document_id) AS document_id, array_to_string(list_filter([CASE WHEN b.rank IS NOT NULL THEN 'bm25' END, CASE WHEN s.query_id IS NOT NULL THEN 'query_seed' END], lambda x: x IS NOT NULL), '+') AS sources, b.rank::INT AS bm25_rank
FROM bm25 b FULL OUTER JOIN sd s ON b.query_id = s.query_id AND b.document_id = s.document_id""")
def candidate_pool(spark, d):
    return _pool(spark, d).withColumn("sources", F.array_join("sources", "+"))


def _pool(spark: SparkSession, d: str) -> DataFrame:
    q = _batch(spark, d)
    return pooling.pool(lexical.search(q, _index(spark, d), k=20), q.select("query_id", F.col("query_id").alias("document_id")))


def _safe(column: str, name: str) -> str:
    return rf"CASE WHEN regexp_matches({column}, '^[ \t\r\n]*[=+@-]') OR regexp_matches({column}, '^[\t\r\n]') THEN chr(39) || {column} ELSE {column} END AS {name}"


@query(f"""WITH {S.DOCS}, {S.TOKENS}, {S.bm25(_BATCH, 20)}, sd AS (SELECT document_id AS query_id, document_id FROM docs WHERE skill_id % 100 = 0),
po AS (SELECT query_id, document_id FROM bm25 UNION SELECT query_id, document_id FROM sd)
SELECT p.query_id, row_number() OVER (PARTITION BY p.query_id ORDER BY sha256('sha256-query-document-v1' || chr(0) || p.query_id || chr(0) || p.document_id))::INT AS label_order, sha256(d.text) AS content_sha256,
 {_safe("q.query_text", "query_text")}, {_safe("p.document_id", "document_id")}, {_safe("d.name", "name")}, {_safe("d.repository_full_name", "repository")}, {_safe("d.path", "path")}, {_safe("substr(d.text, 1, 200)", "snippet")}, '' AS relevance, '' AS rationale
FROM po p JOIN docs d USING (document_id) JOIN qs q USING (query_id)""")
def blinded_worksheet(spark, d):
    docs = _documents(spark, d).select("document_id", F.sha2("text", 256).alias("content_sha256"), "name", F.col("repository_full_name").alias("repository"), "path", F.substring("text", 1, 200).alias("snippet"))
    return pooling.worksheet(_pool(spark, d), _batch(spark, d), docs)


#: Judgements with faults planted by id: grades out of range, judged twice, of an unknown query, of a missing document, queries without a relevant document.
_JUDGED = """jb AS (SELECT d.document_id, d.skill_id, c.said FROM docs d JOIN cc c USING (document_id)),
j AS (SELECT document_id AS query_id, document_id, CASE WHEN skill_id % 50 = 0 THEN 3 ELSE 2 END AS relevance, said FROM jb UNION ALL SELECT document_id, document_id, 2, said FROM jb WHERE skill_id % 70 = 0
 UNION ALL SELECT 'nobody', document_id, 1, said FROM jb WHERE skill_id % 90 = 0 UNION ALL SELECT document_id, 'github:1:none', 0, said FROM jb WHERE skill_id % 110 = 0),
aq AS (SELECT document_id AS query_id FROM jb UNION ALL SELECT document_id || '?' FROM jb WHERE skill_id % 130 = 0)"""


@query(f"""WITH {S.DOCS}, cc AS (SELECT document_id, any_value(sha256(body_text)) AS now, any_value(content_sha256) AS said FROM corpus_documents GROUP BY 1), {_JUDGED}
SELECT j.query_id, j.document_id, CASE WHEN q.query_id IS NULL THEN 'unknown_query' WHEN c.document_id IS NULL THEN 'missing_document' WHEN j.said IS DISTINCT FROM c.now THEN 'stale_content' ELSE 'grade' END AS problem
FROM j LEFT JOIN cc c USING (document_id) LEFT JOIN (SELECT DISTINCT query_id FROM aq) q ON q.query_id = j.query_id WHERE q.query_id IS NULL OR c.document_id IS NULL OR j.said IS DISTINCT FROM c.now OR j.relevance NOT BETWEEN 0 AND 2
UNION ALL SELECT query_id, document_id, 'judged_twice' FROM j GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT query_id, NULL, 'no_relevant_document' FROM aq WHERE query_id NOT IN (SELECT query_id FROM j WHERE relevance >= 1)""")
def qrel_integrity(spark, d):
    """Every document is judged for itself, with the hash that the corpus says its body has, and faults of every kind besides."""
    c = table(spark, d, "corpus_documents").dropDuplicates(["document_id"])
    base = _documents(spark, d).select("document_id", "skill_id").join(c.select("document_id", "content_sha256"), "document_id")
    part = lambda n, q, doc, grade: base.where(F.col("skill_id") % n == 0).select(q.alias("query_id"), doc.alias("document_id"), grade.alias("relevance"), "content_sha256")
    own = F.col("document_id")
    judged = part(1, own, own, F.when(F.col("skill_id") % 50 == 0, 3).otherwise(2)).unionByName(part(70, own, own, F.lit(2)))
    judged = judged.unionByName(part(90, F.lit("nobody"), own, F.lit(1))).unionByName(part(110, own, F.lit("github:1:none"), F.lit(0)))
    asked = base.select(own.alias("query_id")).unionByName(base.where("skill_id % 130 = 0").select(F.concat("document_id", F.lit("?")).alias("query_id")))
    return metrics.problems(asked, judged, c.select("document_id", F.sha2("body_text", 256).alias("content_sha256")))


# --- statistics, records and integrity ------------------------------------------------------------------------------


@query("""WITH c AS (SELECT validation_status AS value, count(*) AS n FROM (SELECT DISTINCT skill_id, validation_status FROM skills) GROUP BY 1), v AS (SELECT unnest(['valid', 'warning', 'invalid', 'unknown']) AS value), f AS (SELECT value, coalesce(n, 0) AS n FROM v LEFT JOIN c USING (value))
SELECT value, n, round(n / sum(n) OVER (), 6) AS share FROM f""")
def validation_counts(spark, d):
    return stats.zero_filled(_skills(spark, d), "validation_status", ["valid", "warning", "invalid", "unknown"])


@query(f"""WITH {S.REPOSITORIES}, c AS (SELECT license_status AS value, count(*) AS n FROM rp GROUP BY 1), v AS (SELECT unnest(['permissive', 'restrictive', 'missing', 'unknown']) AS value), f AS (SELECT value, coalesce(n, 0) AS n FROM v LEFT JOIN c USING (value))
SELECT value, n, round(n / sum(n) OVER (), 6) AS share FROM f""")
def license_counts(spark, d):
    return stats.zero_filled(_repositories(spark, d), "license_status", ["permissive", "restrictive", "missing", "unknown"])


LANGUAGES = ["en", "de", "fr", "es", "ru", "zh", "ja", "hi", "ar", "th"]


@query(f"""WITH v AS (SELECT unnest({[*LANGUAGES, 'other']}) AS value), f AS (SELECT CASE WHEN lang IN ({str(LANGUAGES)[1:-1]}) THEN lang ELSE 'other' END AS value, count(*) AS n FROM documents GROUP BY 1)
SELECT value, coalesce(n, 0) AS n, CASE WHEN (SELECT count(*) FROM documents) > 0 THEN round(coalesce(n, 0) / (SELECT count(*) FROM documents), 6) ELSE 0.0 END AS share FROM v LEFT JOIN f USING (value)""")
def source_stats_zero_filled(spark, d):
    """Every document counts: a row for each language, and `other` for other spellings and null."""
    return stats.zero_filled(table(spark, d, "documents"), "lang", LANGUAGES, "other")


@query(f"""WITH {S.SKILLS}, {S.REPOSITORIES}, r AS (SELECT count(*) AS repositories, count(CASE WHEN is_archived THEN 1 END) AS archived, count(CASE WHEN is_fork THEN 1 END) AS forks FROM rp)
SELECT r.*, s.* FROM r, (SELECT count(*) AS skills, count(CASE WHEN has_scripts THEN 1 END) AS with_scripts, count(declared_license) AS with_license, count(CASE WHEN len(allowed_tools) > 0 THEN 1 END) AS with_tools, max(indexed_at) AS last_indexed FROM sk) s""")
def feature_counts(spark, d):
    return stats.overview(_repositories(spark, d), _skills(spark, d))


@query(f"""WITH {S.SKILLS}, t AS (SELECT unnest(allowed_tools) AS raw FROM sk), n AS (SELECT lower(trim(regexp_replace(trim(raw, ' '), '^[,;]+|[,;]+$', '', 'g'), ' ')) AS tool FROM t)
SELECT tool, count(*) AS n FROM n WHERE tool <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def top_tools(spark, d):
    return stats.top_tools(_skills(spark, d))


@query("SELECT event_type, max(ts) AS latest FROM events GROUP BY 1")
def latest_event(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.max("ts").alias("latest"))


_DIGEST = "md5(concat_ws(':', coalesce(content_sha256, ''), validation_status, has_scripts::VARCHAR, license_status))"


@query(f"""WITH c AS (SELECT DISTINCT * FROM corpus_documents), h AS (SELECT {_DIGEST} AS h FROM c)
SELECT count(*) AS rows, concat_ws('-', {', '.join(f"coalesce(sum(('0x' || substr(h, {8 * k + 1}, 8))::BIGINT), 0)::VARCHAR" for k in range(4))}) AS digest FROM h""")
def fingerprint(spark, d):
    return corpus.corpus_fingerprint(table(spark, d, "corpus_documents"))


@query(f"""WITH {S.SKILLS}, {S.REPOSITORIES} SELECT s.skill_id, s.name, r.full_name, r.stars_count, r.license_status, c.excerpt, coalesce(c.truncated, false) AS truncated
FROM sk s JOIN rp r ON r.github_repository_id = s.repository_id LEFT JOIN (SELECT DISTINCT skill_id, trim(substr(body_text, 1, 2000), E' \\n\\r\\t') AS excerpt, coalesce(len(body_text) > 2000, false) AS truncated FROM corpus_documents) c USING (skill_id) WHERE s.skill_id = 93""")
def detail_lookup(spark, d):
    return stats.detail(_skills(spark, d), _repositories(spark, d), table(spark, d, "corpus_documents"), 93).select("skill_id", "name", "full_name", "stars_count", "license_status", "excerpt", F.coalesce("truncated", F.lit(False)).alias("truncated"))


@query(f"WITH {S.FILES} SELECT file_id, relative_path, file_type, size_bytes FROM fi WHERE skill_id = 93")
def detail_files(spark, d):
    return stats.files(table(spark, d, "skill_files").drop("header_text", "listed_at"), 93).select("file_id", "relative_path", "file_type", "size_bytes")


@query(f"""WITH {S.FILES} SELECT skill_id, count(CASE WHEN file_type = 'script' THEN 1 END) AS scripts, count(CASE WHEN file_type = 'reference' THEN 1 END) AS refs, count(CASE WHEN file_type = 'asset' THEN 1 END) AS assets, sum(size_bytes)::BIGINT AS bytes FROM fi WHERE skill_id IS NOT NULL GROUP BY 1""")
def supporting_files(spark, d):
    f = table(spark, d, "skill_files").select("file_id", "skill_id", "file_type", "size_bytes").dropDuplicates().where("skill_id IS NOT NULL")
    kind = lambda k: F.count_if(F.col("file_type") == k)
    return f.groupBy("skill_id").agg(kind("script").alias("scripts"), kind("reference").alias("refs"), kind("asset").alias("assets"), F.sum("size_bytes").alias("bytes"))


@query(f"""WITH {S.SKILLS}, {S.REPOSITORIES}, {S.FILES},
a AS (SELECT 'skill_identity' AS rule, count(*) AS broken FROM (SELECT repository_id, path FROM sk GROUP BY ALL HAVING count(*) > 1)),
b AS (SELECT 'full_name' AS rule, count(*) AS broken FROM (SELECT full_name FROM rp GROUP BY 1 HAVING count(*) > 1)),
c AS (SELECT 'file_path' AS rule, count(*) AS broken FROM (SELECT skill_id, relative_path FROM fi WHERE skill_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1)),
d AS (SELECT 'skill_repository' AS rule, count(*) AS broken FROM sk WHERE repository_id IS NOT NULL AND repository_id NOT IN (SELECT github_repository_id FROM rp)),
e AS (SELECT 'file_skill' AS rule, count(*) AS broken FROM fi WHERE skill_id IS NOT NULL AND skill_id NOT IN (SELECT skill_id FROM sk)),
f AS (SELECT 'counters' AS rule, count(*) AS broken FROM rp WHERE stars_count < 0 OR forks_count < 0 OR open_issues_count < 0),
g AS (SELECT 'seen_order' AS rule, count(*) AS broken FROM sk WHERE last_seen_at < first_seen_at)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d UNION ALL SELECT * FROM e UNION ALL SELECT * FROM f UNION ALL SELECT * FROM g""")
def integrity(spark, d):
    s, r = _skills(spark, d), _repositories(spark, d)
    f = table(spark, d, "skill_files").select("file_id", "skill_id", "relative_path").dropDuplicates()
    broken = {
        "skill_identity": checks.duplicates(s, "repository_id", "path"),
        "full_name": checks.duplicates(r, "full_name"),
        "file_path": checks.duplicates(f.where("skill_id IS NOT NULL"), "skill_id", "relative_path"),
        "skill_repository": checks.orphans(s, "repository_id", r, "github_repository_id"),
        "file_skill": checks.orphans(f, "skill_id", s, "skill_id"),
        "counters": r.where("stars_count < 0 OR forks_count < 0 OR open_issues_count < 0"),
        "seen_order": s.where("last_seen_at < first_seen_at"),
    }
    out = None
    for rule, rows in broken.items():
        one = rows.agg(F.count("*").alias("broken")).select(F.lit(rule).alias("rule"), "broken")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH m AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT event_id, user_id, value FROM m WHERE before IS NOT NULL AND value <= before""")
def increasing_check(spark, d):
    return checks.increasing(table(spark, d, "events"), "event_id", "user_id", "value").select("event_id", "user_id", "value")


@query(f"WITH {S.REPOSITORIES} SELECT github_repository_id, CASE WHEN license_spdx_id IS NULL THEN 'missing' WHEN upper(license_spdx_id) IN ('NOASSERTION', 'OTHER') THEN 'unknown' WHEN license_spdx_id IN ('0BSD', 'Apache-2.0', 'BSD-2-Clause', 'BSD-3-Clause', 'CC0-1.0', 'ISC', 'MIT', 'MPL-2.0', 'Unlicense') THEN 'permissive' ELSE 'restrictive' END AS status FROM rp")
def license_classification(spark, d):
    # The identifiers that count as permissive and as saying nothing.
    permissive = ["0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "ISC", "MIT", "MPL-2.0", "Unlicense"]
    spdx = F.col("license_spdx_id")
    status = F.when(spdx.isNull(), "missing").when(F.upper(spdx).isin("NOASSERTION", "OTHER"), "unknown").when(spdx.isin(permissive), "permissive").otherwise("restrictive")
    return _repositories(spark, d).select("github_repository_id", status.alias("status"))


# --- ingest ---------------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT arg_min(trim(full_name), github_repository_id) AS repository, lower(trim(full_name)) AS k FROM repositories WHERE trim(full_name) <> '' GROUP BY 2), m AS (SELECT unnest(['name:', 'description:']) AS marker)
SELECT marker || ' filename:SKILL.md repo:' || repository AS query FROM s CROSS JOIN m UNION ALL SELECT marker || ' filename:SKILL.md' FROM m""")
def discovery_plan(spark, d):
    """Every repository is a seed, in the spelling of the one that has the smallest id."""
    seeds = table(spark, d, "repositories").select(F.col("full_name").alias("repository"), F.col("github_repository_id").alias("position"))
    return ingest.discovery_plan(seeds, ["name:", "description:"]).select("query")


#: The order in which the queries of the tables were asked.
PLAN = ["marker:tools scope:seed", "marker:agents scope:seed", "marker:docs scope:wide", "marker:any scope:wide"]


@query(f"""WITH u AS (SELECT repository_id, path, list_distinct(flatten(list(matched_queries))) AS m, count(DISTINCT coalesce(git_blob_sha, '') || '|' || coalesce(repository_full_name, '')) AS versions FROM skill_candidates GROUP BY 1, 2)
SELECT repository_id, path, array_to_string(list_concat(list_filter({PLAN}, lambda q: list_contains(m, q)), list_sort(list_filter(m, lambda q: NOT list_contains({PLAN}, q)))), '|') AS matched_queries, versions FROM u""")
def dedupe_candidates(spark, d):
    return ingest.merge_found(table(spark, d, "skill_candidates"), ["git_blob_sha", "repository_full_name"], PLAN).withColumn("matched_queries", F.array_join("matched_queries", "|"))


@query("""SELECT repository_id, path, count(DISTINCT coalesce(git_blob_sha, '')) AS versions FROM skill_candidates GROUP BY 1, 2 HAVING count(DISTINCT coalesce(git_blob_sha, '')) > 1""")
def conflict_candidates(spark, d):
    return ingest.conflicts(table(spark, d, "skill_candidates"), ["git_blob_sha"])


#: Of the candidates of an identity the last with a blob decides; an identity without any is skipped.
_INCOMING = f"{S.CANDIDATES}, inc AS (SELECT DISTINCT ON (repository_id, path) repository_id, path, git_blob_sha, record_id, arrived_at AS seen_at FROM ca ORDER BY repository_id, path, git_blob_sha IS NULL, record_id DESC), old AS (SELECT DISTINCT ON (repository_id, path) repository_id, path, git_blob_sha, record_id, accepted_at, content_sha256 FROM existing_skills ORDER BY repository_id, path, record_id)"


def _incoming(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "skill_candidates").groupBy("record_id").agg(F.min_by(F.struct("repository_id", "path", "git_blob_sha", "arrived_at"), "arrived_at").alias("r")).select("record_id", "r.*")
    last = F.max_by(F.struct("git_blob_sha", "record_id", F.col("arrived_at").alias("seen_at")), F.struct(F.col("git_blob_sha").isNotNull(), "record_id"))
    return c.groupBy("repository_id", "path").agg(last.alias("r")).select("repository_id", "path", "r.*")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "existing_skills")
    return e.groupBy("repository_id", "path").agg(F.min_by(F.struct("git_blob_sha", "record_id", "accepted_at", "content_sha256"), "record_id").alias("r")).select("repository_id", "path", "r.*")


@query(f"""WITH {_INCOMING} SELECT i.record_id, CASE WHEN i.git_blob_sha IS NULL THEN 'skipped' WHEN o.repository_id IS NULL THEN 'new' WHEN i.git_blob_sha = o.git_blob_sha THEN 'unchanged' ELSE 'changed' END AS change FROM inc i LEFT JOIN old o USING (repository_id, path)""")
def classify_changes(spark, d):
    return ingest.classify(_incoming(spark, d), _stored(spark, d)).select("record_id", "change")


@query(f"""WITH {_INCOMING} SELECT coalesce(o.repository_id, i.repository_id) AS repository_id, coalesce(o.path, i.path) AS path, CASE WHEN i.git_blob_sha IS NULL THEN o.git_blob_sha ELSE i.git_blob_sha END AS git_blob_sha,
 CASE WHEN i.path IS NULL THEN 'kept' WHEN i.git_blob_sha IS NULL THEN 'skipped' WHEN o.path IS NULL THEN 'inserted' WHEN o.git_blob_sha = i.git_blob_sha THEN 'unchanged' ELSE 'updated' END AS action,
 coalesce(o.accepted_at, i.seen_at) AS first_seen_at, greatest(o.accepted_at, i.seen_at) AS last_seen_at
FROM old o FULL OUTER JOIN inc i ON o.repository_id = i.repository_id AND o.path = i.path""")
def merge_upsert(spark, d):
    stored = _stored(spark, d).withColumn("first_seen_at", F.col("accepted_at")).withColumn("last_seen_at", F.col("accepted_at"))
    return ingest.merge(stored, _incoming(spark, d), "seen_at", ["record_id"], skip=True).select("repository_id", "path", "git_blob_sha", "action", "first_seen_at", "last_seen_at")


@query(f"""WITH {S.SKILLS}, {S.REPOSITORIES}, c AS (SELECT DISTINCT repository_id, path, lower(repository_full_name) AS n, validation_status, content_sha256, sha256(body_text) AS now FROM corpus_documents)
SELECT c.repository_id, c.path, CASE WHEN s.skill_id IS NULL THEN 'missing' WHEN c.n IS DISTINCT FROM lower(r.full_name) THEN 'renamed' WHEN content_sha256 IS DISTINCT FROM now THEN 'stale' ELSE 'status' END AS problem
FROM c LEFT JOIN sk s USING (repository_id, path) LEFT JOIN rp r ON r.github_repository_id = c.repository_id
WHERE s.skill_id IS NULL OR c.n IS DISTINCT FROM lower(r.full_name) OR content_sha256 IS DISTINCT FROM now OR c.validation_status IS DISTINCT FROM s.validation_status""")
def corpus_drift(spark, d):
    c = table(spark, d, "corpus_documents").select("repository_id", "path", F.lower("repository_full_name").alias("repository_full_name"), "content_sha256", "validation_status", F.sha2("body_text", 256).alias("now")).distinct()
    names = _repositories(spark, d).select(F.col("github_repository_id").alias("repository_id"), F.col("full_name").alias("repository_full_name"))
    hashes = c.select("repository_id", "path", F.col("now").alias("content_sha256"))
    stored = _skills(spark, d).select("repository_id", "path", "validation_status").join(names, "repository_id", "left").join(hashes, ["repository_id", "path"])
    return corpus.drift(c.drop("now"), stored)


# --- parsing --------------------------------------------------------------------------------------------------------


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents")).select("doc_id", F.coalesce("path", F.lit("SKILL.md")).alias("path"), F.col("text").cast("binary").alias("content"))
    return parse.parse_documents(docs, "doc_id", "path", "content")


@query()
def frontmatter_parse(spark, d):
    return _parsed(spark, d).select("doc_id", "name", "description", "license", "status", F.array_join(F.transform("messages", lambda m: m["code"]), ",").alias("codes"))


@query()
def structural_signals(spark, d):
    return _parsed(spark, d).select("doc_id", F.size("headings").alias("headings"), "code_block_count", "link_count", "external_link_count", "word_count", "byte_count")


@query("SELECT doc_id, coalesce(strlen(text), 0)::INT AS byte_count, (text IS NOT NULL AND (starts_with(text, '---' || chr(10)) OR starts_with(text, '---' || chr(13)))) AS opens_front_matter FROM documents")
def front_matter_openings(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.octet_length(t), F.lit(0)).alias("byte_count"), F.coalesce(t.rlike("^---[\r\n]"), F.lit(False)).alias("opens_front_matter"))


# --- relational smoke queries on the star schema ---------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


@query("""SELECT n_name, count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def orders_by_nation(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return o.join(c, "c_custkey").join(n, "c_nationkey").groupBy("n_name").agg(F.count("*").alias("orders"), F.count_distinct("c_custkey").alias("customers"))


@query(f"""WITH {_INCOMING} SELECT coalesce(o.repository_id, i.repository_id) AS repository_id, coalesce(o.path, i.path) AS path, CASE WHEN i.path IS NULL OR i.git_blob_sha IS NULL OR o.git_blob_sha = i.git_blob_sha THEN o.content_sha256 END AS content_sha256
FROM old o FULL OUTER JOIN inc i ON o.repository_id = i.repository_id AND o.path = i.path""")
def merge_clears_derived(spark, d):
    """What was derived from a stored version goes with it."""
    stored = _stored(spark, d).withColumn("first_seen_at", F.col("accepted_at")).withColumn("last_seen_at", F.col("accepted_at"))
    return ingest.merge(stored, _incoming(spark, d), "seen_at", ["record_id"], skip=True, clear=("content_sha256",)).select("repository_id", "path", "content_sha256")


#: The last candidate of an identity is what a fetch of it finds.
_FETCHED = """fe AS (SELECT DISTINCT ON (repository_id, path) repository_id, path, git_blob_sha AS fetched_sha, content_text FROM ca ORDER BY repository_id, path, record_id DESC),
ou AS (SELECT i.record_id, i.repository_id, i.path, i.git_blob_sha, o.content_sha256 AS old_hash, o.path IS NULL AS fresh, coalesce(o.git_blob_sha = i.git_blob_sha, false) AS same, f.content_text IS NOT NULL AS came, f.fetched_sha IS DISTINCT FROM i.git_blob_sha AS other,
 CASE WHEN trim(f.content_text) = '' THEN 'invalid' WHEN starts_with(f.content_text, '---') THEN 'valid' ELSE 'warning' END AS vs, sha256(f.content_text) AS hash
 FROM inc i LEFT JOIN old o USING (repository_id, path) LEFT JOIN fe f USING (repository_id, path)),
st AS (SELECT *, CASE WHEN git_blob_sha IS NULL THEN 'skipped' WHEN same THEN 'unchanged' WHEN NOT came OR other THEN 'error' WHEN vs = 'invalid' THEN 'invalid' ELSE 'ingested' END AS status FROM ou)"""


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    fields = F.struct("repository_id", "path", "git_blob_sha", "content_text")
    ca = table(spark, d, "skill_candidates").groupBy("record_id").agg(F.min_by(fields, "arrived_at").alias("r")).select("record_id", "r.*")
    last = ca.groupBy("repository_id", "path").agg(F.max_by(F.struct("git_blob_sha", "content_text"), "record_id").alias("r")).select("repository_id", "path", "r.*")
    text = F.col("content_text")
    status = F.when(text.isNotNull(), F.when(F.trim(text) == "", "invalid").when(F.startswith(text, F.lit("---")), "valid").otherwise("warning"))
    fetched = last.select(
        "repository_id", "path", F.col("git_blob_sha").alias("fetched_sha"), F.sha2(text, 256).alias("content_sha256"), status.alias("validation_status"),
        F.when(status == "invalid", F.array(F.lit("empty_body"))).alias("codes"), F.when(text.isNull(), "The file has no content.").alias("failure"),
    )
    return runs.outcomes(_incoming(spark, d), _stored(spark, d), fetched)


@query(f"""WITH {_INCOMING}, {_FETCHED} SELECT record_id, CASE WHEN fresh THEN 'new' WHEN same THEN 'unchanged' ELSE 'changed' END AS change, status,
 CASE status WHEN 'skipped' THEN '{{"category":"candidate","message":"The candidate names no version."}}' WHEN 'invalid' THEN '{{"category":"validation","codes":["empty_body"],"message":"The parser reported invalid content."}}'
  WHEN 'error' THEN CASE WHEN came THEN '{{"category":"changed","message":"The file changed after its discovery."}}' ELSE '{{"category":"fetch","message":"The file has no content."}}' END END AS reason,
 CASE WHEN status = 'unchanged' THEN old_hash WHEN status IN ('invalid', 'ingested') THEN hash END AS content_sha256, status IN ('invalid', 'ingested') OR status = 'error' AND came AS fetched, status IN ('invalid', 'ingested') AS parsed FROM st""")
def ingest_outcomes(spark, d):
    return _outcomes(spark, d).select("record_id", "change", "status", "reason", "content_sha256", "fetched", "parsed")


@query(f"""WITH {_INCOMING}, {_FETCHED} SELECT count(*) AS discovered_count, count(CASE WHEN status IN ('invalid', 'ingested') OR status = 'error' AND came THEN 1 END) AS fetched_count, count(CASE WHEN status = 'unchanged' THEN 1 END) AS unchanged_count,
 count(CASE WHEN status IN ('invalid', 'ingested') THEN 1 END) AS parsed_count, count(CASE WHEN status = 'invalid' THEN 1 END) AS invalid_count, count(CASE WHEN status = 'skipped' THEN 1 END) AS skipped_count, count(CASE WHEN status = 'error' THEN 1 END) AS error_count FROM st""")
def run_summary(spark, d):
    return runs.summary(_outcomes(spark, d))


@query(f"""WITH {_INCOMING}, {_FETCHED} SELECT CASE status WHEN 'skipped' THEN 'candidate' WHEN 'invalid' THEN 'validation' ELSE CASE WHEN came THEN 'changed' ELSE 'fetch' END END AS category, CASE WHEN status = 'invalid' THEN 'empty_body' END AS code, count(*) AS n
FROM st WHERE status IN ('skipped', 'invalid', 'error') GROUP BY ALL""")
def failure_reasons(spark, d):
    """The reasons are read back from their JSON."""
    return runs.failures(_outcomes(spark, d))


@query(f"""WITH {_INCOMING}, {_FETCHED}, {S.SKILLS}, it AS (SELECT x.repository_id, x.status, x.status IN ('ingested', 'unchanged') AS stored, CASE WHEN x.status IN ('invalid', 'ingested') THEN x.vs ELSE s.validation_status END AS validation_status FROM st x LEFT JOIN sk s USING (repository_id, path))
SELECT count(*) AS item_count, count(DISTINCT CASE WHEN stored THEN repository_id END) AS repository_count, count(CASE WHEN stored THEN 1 END) AS stored_count, count(CASE WHEN status = 'ingested' THEN 1 END) AS ingested_count, count(CASE WHEN status = 'unchanged' THEN 1 END) AS unchanged_count,
 count(CASE WHEN status = 'invalid' THEN 1 END) AS invalid_count, count(CASE WHEN status = 'skipped' THEN 1 END) AS skipped_count, count(CASE WHEN status = 'error' THEN 1 END) AS error_count, count(CASE WHEN stored AND validation_status = 'valid' THEN 1 END) AS valid_skill_count,
 count(CASE WHEN stored AND validation_status = 'warning' THEN 1 END) AS warning_skill_count, count(CASE WHEN stored AND validation_status = 'invalid' THEN 1 END) AS invalid_skill_count FROM it""")
def snapshot_counts(spark, d):
    known = _skills(spark, d).select("repository_id", "path", F.col("validation_status").alias("known"))
    done = F.col("status").isin("invalid", "ingested")
    items = _outcomes(spark, d).join(known, ["repository_id", "path"], "left")
    return ingest.snapshot_counts(items.select("repository_id", "status", F.col("status").isin("ingested", "unchanged").alias("stored"), F.when(done, F.col("validation_status")).otherwise(F.col("known")).alias("validation_status")))


# --- evidence -------------------------------------------------------------------------------------------------------

#: Candidates as pages of a listing: ten record ids a page, a batch being a query.
_PAGES = """lo AS (SELECT batch_id, min(record_id) AS low, count(*) AS total FROM ca GROUP BY 1),
pg AS (SELECT 'batch ' || batch_id AS query, ((record_id - low) // 10 + 1)::INT AS page_number, count(*)::INT AS item_count, count(CASE WHEN git_blob_sha IS NOT NULL THEN 1 END)::INT AS accepted_item_count, any_value(total)::INT AS total_count, arg_min(path, record_id) AS first_result, arg_max(path, record_id) AS last_result
 FROM ca JOIN lo USING (batch_id) GROUP BY 1, 2)"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    ca = table(spark, d, "skill_candidates").groupBy("record_id").agg(F.min_by(F.struct("batch_id", "path", "git_blob_sha"), "arrived_at").alias("r")).select("record_id", "r.*")
    low = ca.groupBy("batch_id").agg(F.min("record_id").alias("low"), F.count("*").cast("int").alias("total"))
    page = F.floor((F.col("record_id") - F.col("low")) / 10).cast("int") + 1
    return ca.join(low, "batch_id").groupBy(F.concat(F.lit("batch "), F.col("batch_id")).alias("query"), page.alias("page_number")).agg(
        F.count("*").cast("int").alias("item_count"), F.count("git_blob_sha").cast("int").alias("accepted_item_count"), F.max("total").alias("total_count"),
        F.min_by("path", "record_id").alias("first_result"), F.max_by("path", "record_id").alias("last_result"),
    )


@query(f"WITH {S.CANDIDATES}, {_PAGES} SELECT * FROM pg")
def listing_pages(spark, d):
    return _pages(spark, d)


@query(f"""WITH {S.CANDIDATES}, {_PAGES}, b AS (SELECT query, page_number, array_to_string(list_filter([CASE WHEN page_number NOT BETWEEN 1 AND 10 THEN 'page_number' END, CASE WHEN item_count NOT BETWEEN 0 AND 100 THEN 'item_count' END, CASE WHEN accepted_item_count NOT BETWEEN 0 AND item_count THEN 'accepted_over_items' END,
 CASE WHEN total_count < item_count THEN 'items_over_total' END, CASE WHEN (item_count > 0) <> (first_result IS NOT NULL AND last_result IS NOT NULL) THEN 'boundaries' END], lambda x: x IS NOT NULL), '+') AS problems FROM pg) SELECT * FROM b WHERE problems <> ''""")
def listing_page_problems(spark, d):
    return evidence.page_problems(_pages(spark, d)).select("query", "page_number", F.array_join("problems", "+").alias("problems"))


@query(f"WITH {S.CANDIDATES}, {_PAGES} SELECT query, count(*) AS pages, max(page_number) AS last_page FROM pg GROUP BY 1 HAVING min(page_number) <> 1 OR max(page_number) <> count(*)")
def listing_page_gaps(spark, d):
    return evidence.page_gaps(_pages(spark, d))


_QUERY_SET = "qset AS (SELECT document_id AS query_id, replace(name, '-', ' ') AS query_text, validation_status AS category, CASE WHEN skill_id % 300 = 0 THEN 'test' ELSE 'development' END AS split, text AS intent, document_id AS seed FROM docs WHERE skill_id % 100 = 0)"


def _query_set(spark: SparkSession, d: str) -> DataFrame:
    q = _documents(spark, d).where("skill_id % 100 = 0")
    return q.select(
        F.col("document_id").alias("query_id"), F.regexp_replace("name", "-", " ").alias("query_text"), F.col("validation_status").alias("category"),
        F.when(F.col("skill_id") % 300 == 0, "test").otherwise("development").alias("split"), F.col("text").alias("intent"), F.array("document_id").alias("pool_seed_document_ids"),
    )


@query(f"WITH {S.DOCS}, {_QUERY_SET} SELECT count(*) AS query_count, count(CASE WHEN split = 'development' THEN 1 END) AS development_count, count(CASE WHEN split = 'test' THEN 1 END) AS test_count FROM qset")
def query_split_counts(spark, d):
    return evidence.split_counts(_query_set(spark, d))


@query(rf"""WITH {S.DOCS}, {_QUERY_SET}, b AS (SELECT query_id, array_to_string(list_filter([CASE WHEN NOT regexp_matches(query_id, '^q[0-9]{{3}}$') THEN 'query_id' END, CASE WHEN trim(query_text) <> query_text OR regexp_matches(query_text, '[\r\n]') OR length(query_text) NOT BETWEEN 3 AND 200 THEN 'query_text' END,
 CASE WHEN trim(intent) <> intent OR regexp_matches(intent, '[\r\n]') OR length(intent) NOT BETWEEN 10 AND 500 THEN 'intent' END, CASE WHEN NOT regexp_matches(category, '^[a-z][a-z0-9_]{{1,49}}$') THEN 'category' END,
 CASE WHEN NOT regexp_matches(seed, '^github:[1-9][0-9]*:[^/].*$') THEN 'seed_ids' END], lambda x: x IS NOT NULL), '+') AS problems FROM qset) SELECT * FROM b WHERE problems <> ''""")
def query_record_problems(spark, d):
    return evidence.query_problems(_query_set(spark, d)).select("query_id", F.array_join("problems", "+").alias("problems"))


@query(f"WITH {S.DOCS}, {_QRELS} SELECT count(DISTINCT query_id) AS query_count, count(*) AS judgement_count, count(CASE WHEN relevance >= 1 THEN 1 END) AS relevant_judgement_count FROM qrels")
def qrel_counts(spark, d):
    return evidence.qrel_counts(_qrels(spark, d))


@query("""SELECT doc_id, strlen(text) AS size, sha1('blob ' || strlen(text)::VARCHAR || chr(0) || text) AS sha, CASE WHEN strlen(text) <> n_chars THEN 'size' END AS problem FROM documents WHERE text IS NOT NULL""")
def decoded_payloads(spark, d):
    """Texts as payloads of a service, with the sizes that the table says; wrong where it counted characters."""
    t = table(spark, d, "documents").where("text IS NOT NULL").withColumn("raw", F.encode("text", "UTF-8"))
    sent = t.select("doc_id", F.base64("raw").alias("content"), F.lit("base64").alias("encoding"), F.col("n_chars").alias("size"), files.git_blob_sha(F.col("raw")).alias("sha"))
    got = payload.files(sent)
    return got.select("doc_id", F.octet_length("bytes").cast("bigint").alias("size"), files.git_blob_sha(F.col("bytes")).alias("sha"), "problem")


@query("SELECT max(CASE WHEN event_type = 'purchase' THEN ts END) AS last_completed FROM events")
def last_completed_run(spark, d):
    """Events as runs of which some were completed."""
    state = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    return runs.last_completed(table(spark, d, "events").select(state.alias("status"), F.col("ts").alias("completed_at")))


@query("""SELECT 'id_with_names' AS problem, github_repository_id::VARCHAR AS repository FROM repositories WHERE full_name IS NOT NULL GROUP BY github_repository_id HAVING count(DISTINCT lower(full_name)) > 1
UNION ALL SELECT 'name_with_ids', lower(full_name) FROM (SELECT github_repository_id, full_name FROM repositories UNION ALL SELECT repository_id, repository_full_name FROM skill_candidates) r WHERE full_name IS NOT NULL AND github_repository_id IS NOT NULL GROUP BY 2 HAVING count(DISTINCT github_repository_id) > 1""")
def repository_conflicts(spark, d):
    """Names are looked for among the candidates as well."""
    r = table(spark, d, "repositories").select("github_repository_id", "full_name")
    c = table(spark, d, "skill_candidates").select(F.col("repository_id").alias("github_repository_id"), F.col("repository_full_name").alias("full_name"))
    found = ingest.repository_conflicts(r).where("problem = 'id_with_names'")
    return found.unionByName(ingest.repository_conflicts(r.unionByName(c)).where("problem = 'name_with_ids'"))


@query(r"""SELECT DISTINCT document_id, coalesce(regexp_matches(document_id, '^github:[1-9][0-9]*:[^/].*$'), false) AS good_id,
 (path <> '' AND NOT regexp_matches(path, '^\s|\s$') AND strlen(path) <= 4096 AND NOT regexp_matches(path, '[\\%]') AND NOT regexp_matches(path, '(^|/)\.{0,2}(/|$)')) AS good_path FROM corpus_documents""")
def validate_document_ids(spark, d):
    c = table(spark, d, "corpus_documents")
    return c.select("document_id", checks.document_id(F.col("document_id")).alias("good_id"), checks.relative_path(F.col("path")).alias("good_path")).distinct()
