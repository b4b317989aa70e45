"""SQL pieces that the oracle statements are put together from."""

from __future__ import annotations

TOKEN = r"[\pL\pN]+(?:(?:[./:_-][\pL\pN]+)|(?:\+\+|\+|#))*"
WORD = r"[\pL\pN_](?:[\pL\pN_'+-]*[\pL\pN_])?"

SKILLS = "sk AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY last_seen_at DESC) rn FROM skills) WHERE rn = 1)"
REPOSITORIES = "rp AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY github_repository_id ORDER BY fetched_at DESC) rn FROM repositories) WHERE rn = 1)"
CANDIDATES = "ca AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY arrived_at) rn FROM skill_candidates) WHERE rn = 1)"
FILES = "fi AS (SELECT DISTINCT file_id, skill_id, repository_id, relative_path, file_type, size_bytes, git_blob_sha, extension FROM skill_files)"

_FIELDS = "name_text, description_text, metadata_text, heading_text, body_text"
DOCS = f"""docs AS (SELECT document_id, any_value(skill_id) skill_id, any_value(repository_full_name) repository_full_name, any_value(path) path, any_value(name) name,
  any_value(validation_status) validation_status, any_value(license_status) license_status, any_value(has_scripts) has_scripts,
  any_value(array_to_string(list_filter([{_FIELDS}], lambda x: x IS NOT NULL AND x <> ''), ' ')) AS text
  FROM corpus_documents WHERE validation_status IN ('valid', 'warning') GROUP BY document_id)"""
TOKENS = f"""tk AS (SELECT document_id, regexp_extract_all(lower(text), '{TOKEN}') AS tokens FROM docs),
tok AS (SELECT document_id, unnest(tokens) AS term FROM tk),
tf AS (SELECT document_id, term, count(*)::INT AS tf FROM tok GROUP BY ALL),
dl AS (SELECT document_id, len(tokens) AS doc_len FROM tk),
st AS (SELECT count(*) AS n_docs, coalesce(sum(doc_len), 0)::BIGINT AS total_len, coalesce(avg(doc_len), 0.0) AS avg_len FROM dl),
dfr AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""


def bm25(queries: str, k: int, allowed: str = "true", depth_name: str = "bm25") -> str:
    """Ranking CTEs over DOCS and TOKENS; queries gives (query_id, query_text)."""
    return f"""
qs AS ({queries}),
qraw AS (SELECT query_id, unnest(regexp_extract_all(lower(query_text), '{TOKEN}')) AS term, generate_subscripts(regexp_extract_all(lower(query_text), '{TOKEN}'), 1) AS nth FROM qs),
qt AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY min(nth)) - 1 AS pos FROM qraw GROUP BY query_id, term),
hit AS (SELECT q.query_id, q.pos, q.term, t.document_id, t.tf, d.df, ln(1 + (s.n_docs - d.df + 0.5) / (d.df + 0.5)) AS idf, l.doc_len, s.avg_len
  FROM qt q JOIN dfr d USING (term) JOIN tf t USING (term) JOIN dl l USING (document_id) CROSS JOIN st s JOIN docs o USING (document_id) WHERE {allowed}),
sco AS (SELECT *, idf * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * (doc_len / avg_len))) AS s FROM hit),
tot AS (SELECT query_id, document_id, round(sum(s ORDER BY pos), 6) AS score FROM sco GROUP BY ALL HAVING sum(s) > 0),
{depth_name} AS (SELECT query_id, document_id, score, rank FROM (SELECT t.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(repository_full_name), lower(path), document_id) AS rank
  FROM tot t JOIN docs USING (document_id)) WHERE rank <= {k})"""


USABLE = "len({v}) = {d} AND len(list_filter({v}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0"


def cosine(a: str, b: str) -> str:
    return f"round(greatest(-1.0, least(1.0, list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]))), 6)"


def metrics(ranking: str, qrels: str, queries: str, prefix: str = "") -> str:
    """per_query CTE from (query_id, document_id, rank), (query_id, document_id, relevance), (query_id)."""
    p = prefix
    return f"""
{p}jd AS (SELECT r.query_id, r.rank, coalesce(q.relevance, 0) AS g FROM {ranking} r LEFT JOIN {qrels} q USING (query_id, document_id) WHERE r.rank <= 10),
{p}got AS (SELECT query_id, sum((2.0 ** g - 1) / (ln(rank + 1.0) / ln(2.0)) ORDER BY rank) AS dcg, min(CASE WHEN g >= 1 THEN rank END) AS first_relevant, count(CASE WHEN g >= 1 THEN 1 END) AS hits FROM {p}jd GROUP BY query_id),
{p}idl AS (SELECT query_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC) AS rank FROM {qrels} WHERE relevance > 0),
{p}bst AS (SELECT query_id, sum((2.0 ** relevance - 1) / (ln(rank + 1.0) / ln(2.0)) ORDER BY rank) AS idcg FROM {p}idl WHERE rank <= 10 GROUP BY query_id),
{p}rel AS (SELECT query_id, count(CASE WHEN relevance >= 1 THEN 1 END) AS relevant FROM {qrels} GROUP BY query_id),
{p}per AS (SELECT q.query_id, coalesce(CASE WHEN idcg > 0 THEN dcg / idcg END, 0.0) AS ndcg, coalesce(1.0 / first_relevant, 0.0) AS reciprocal_rank,
  coalesce(CASE WHEN relevant > 0 THEN hits / relevant END, 0.0) AS recall, first_relevant
  FROM {queries} q LEFT JOIN {p}got USING (query_id) LEFT JOIN {p}bst USING (query_id) LEFT JOIN {p}rel USING (query_id))"""
