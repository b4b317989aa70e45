"""The serving surface: search, single records, statistics and readiness over one corpus handle."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import text as X
from quarrymill.functions.checks import ContractError
from quarrymill.operators import corpus, dense, fusion, lexical, stats
from quarrymill.runtime import spread, state_of, table
from quarrymill.sources.files import HybridSettings
from quarrymill.sources.tables import VersionedTable

#: What a score of each mode means; every answer says it.
SEMANTICS = {
    "bm25": "Lexical score; compare only within one answer.",
    "dense": "Cosine similarity of embeddings.",
    "hybrid": "Sum of reciprocal ranks; compare only within one answer.",
}
#: The rows of an answer. Of the components, those of the mode are set.
RESULT_SCHEMA = (
    "rank int, document_id string, skill_id bigint, score double, mode string, semantics string, "
    "bm25 struct<matched_terms: array<string>, terms: array<struct<term: string, tf: int, df: bigint, idf: double, score: double>>>, "
    "dense struct<cosine_similarity: double, cosine_distance: double>, hybrid struct<bm25_rank: int, dense_rank: int>, "
    "name string, description string, html_url string, repository string, stars_count int, path string, license_status string, validation_status string, has_scripts boolean"
)
DETAIL_SCHEMA = "skill_id bigint, name string, description string, full_name string, stars_count int, license_status string, excerpt string, truncated boolean"
FILE_SCHEMA = "file_id bigint, relative_path string, file_type string, size_bytes bigint"
COUNT_SCHEMA = "value string, n bigint, share double"
SETTINGS = HybridSettings(model_id=dense.HASHING, model_revision="1")


class Engine:
    """The index of the corpus is kept between searches, and built again when the stored table changes.

    Vectors are compared with queries of the same model and revision only: the encoder is the one that the settings pin, and
    the stored vectors are those of its identity, from `vectors` (see index_dense), else from the table skill_embeddings.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, settings: HybridSettings = SETTINGS, vectors: VersionedTable | None = None):
        self.spark, self.dir, self.settings, self.vectors = spark, sf_dir, settings, vectors
        self._kept: tuple[tuple, lexical.Index] | None = None

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @cached_property
    def skills(self) -> DataFrame:
        return corpus.latest(self._table("skills"), ["skill_id"], "last_seen_at")

    @cached_property
    def repositories(self) -> DataFrame:
        return corpus.latest(self._table("repositories"), ["github_repository_id"], "fetched_at")

    @cached_property
    def encoder(self) -> dense.Encoder:
        s = self.settings
        return dense.encoder_for(s.model_id, s.model_revision, s.model_dimension)

    def fingerprint(self) -> str:
        row = corpus.corpus_fingerprint(self._table("corpus_documents")).first()
        return f"{row.rows}:{row.digest}"

    def index(self) -> lexical.Index:
        now = state_of(self.spark, f"{self.dir}/corpus_documents.parquet")
        if self._kept is None or self._kept[0] != now:
            self._kept = now, lexical.Index.build(corpus.tokenized(spread(corpus.documents(self._table("corpus_documents")))))
        return self._kept[1]

    def readiness(self) -> dict[str, bool]:
        """Which tables can be read and hold rows."""
        out = {}
        for name in ("repositories", "skills", "corpus_documents", "skill_embeddings"):
            try:
                out[name] = not self._table(name).limit(1).isEmpty()
            except Exception:
                out[name] = False
        return out

    def _texts(self) -> DataFrame:
        """(document_id, embedding_text, embedding_text_sha256) of the eligible documents."""
        c = self._table("corpus_documents").where(F.col("validation_status").isin(*corpus.ELIGIBLE)).dropDuplicates(["document_id"])
        text = X.embedding_text(*[F.col(f) for f in corpus.FIELDS])
        return c.select("document_id", text.alias("embedding_text")).withColumn("embedding_text_sha256", F.sha2("embedding_text", 256))

    def index_dense(self) -> int:
        """Makes the vectors that are missing or stale, into `vectors`; returns how many."""
        if self.vectors is None:
            raise ContractError("no table for vectors")
        held = self.vectors.read()
        if held is None:
            held = self.spark.createDataFrame([], "document_id string, model_id string, model_revision string, model_dimension int, embedding array<float>, embedding_text string, embedding_text_sha256 string, indexed_at timestamp")
        made, kept = dense.index_incrementally(self._texts(), held, self.encoder, F.current_timestamp())
        written = self.vectors.write(made.select(*held.columns).unionByName(kept))
        return self.vectors.read().join(held.select("document_id", "embedding_text_sha256"), ["document_id", "embedding_text_sha256"], "left_anti").count() if written else 0

    def embeddings(self) -> DataFrame:
        """(document_id, embedding) of the pinned model. Raises if a document of the corpus has no current vector of it."""
        stored = self.vectors.read() if self.vectors is not None else self._table("skill_embeddings")
        mine = dense.of_model(stored, *self.encoder.identity) if stored is not None else None
        if mine is None or mine.isEmpty():
            raise ContractError(f"no vectors of {self.encoder.model_id} in revision {self.encoder.model_revision}")
        state = dense.coverage(self._texts(), mine, *self.encoder.identity)
        lacking = state.where("state <> 'current'").count()
        if lacking:
            raise ContractError(f"{lacking} documents have no current vector of {self.encoder.model_id}")
        return mine.select("document_id", "embedding").dropDuplicates(["document_id"])

    def retriever(self, mode: str, limit: int = 10):
        """A function of queries (query_id, query_text) that ranks documents (query_id, rank, document_id, score) for all of them in one plan."""
        return lambda queries: self._ranked(queries, mode, limit).select("query_id", "rank", "document_id", "score")

    def _ranked(self, queries: DataFrame, mode: str, limit: int, rule=None, asked: list[str] | None = None) -> DataFrame:
        if mode not in SEMANTICS:
            raise ContractError(f"unknown mode {mode}")
        index, s = self.index(), self.settings
        depth = limit if mode != "hybrid" else s.rrf_candidate_depth
        if mode != "dense":
            lex = lexical.search(queries, index, depth, rule, normalize=True, asked=asked)
            if mode == "bm25":
                return lex
        vectors = queries.select("query_id", self.encoder.encode(X.normalize("query_text")).alias("embedding"))
        allowed = index.docs if rule is None else index.docs.where(rule)
        near = dense.search(vectors, self.embeddings().join(allowed.select("document_id"), "document_id", "left_semi"), depth, key="document_id", dimension=s.model_dimension)
        if mode == "dense":
            return near.withColumnRenamed("similarity", "score")
        return fusion.fuse(lex, near, index.docs, limit, weights=(s.bm25_weight, s.dense_weight))

    def search(self, query: str, mode: str = "bm25", limit: int = 10, licenses: list[str] | None = None, statuses: list[str] | None = None, has_scripts: bool | None = None) -> DataFrame:
        """An answer of at most `limit` rows (RESULT_SCHEMA). Filters apply before ranking. Raises if a ranked document is not stored any more."""
        if not query.strip() or len(query) > 500 or not 1 <= limit <= 50:
            raise ContractError("query or limit out of range")
        rule = None if licenses is None and statuses is None and has_scripts is None else corpus.allows(licenses, statuses, has_scripts)
        one = self.spark.createDataFrame([("q", query)], "query_id string, query_text string")
        asked = [r.term for r in lexical.query_terms(one, True).collect()]  # the terms of one query
        found = self._ranked(one, mode, limit, rule, asked).orderBy("rank").collect()  # at most `limit` rows
        ids = [r.document_id for r in found]
        shown = self._table("repositories").select("github_repository_id", "fetched_at", "full_name", "stars_count")
        named = self._table("skills").where(F.col("document_id").isin(ids)).select("skill_id", "document_id", "repository_id", "name", "description", "html_url", "last_seen_at")
        named = corpus.latest(named, ["document_id"], "last_seen_at").join(corpus.latest(shown, ["github_repository_id"], "fetched_at"), F.col("repository_id") == F.col("github_repository_id"))
        docs = self.index().docs.where(F.col("document_id").isin(ids)).select("document_id", "path", "license_status", "validation_status", "has_scripts")
        stored = {r.document_id: r for r in named.drop("last_seen_at", "fetched_at").join(docs, "document_id").collect()}
        missing = [i for i in ids if i not in stored]
        if missing:
            raise ContractError(f"ranked documents are not stored: {missing}")
        rows = []
        for r in found:
            s = stored[r.document_id]
            parts = {"bm25": None, "dense": None, "hybrid": None}
            if mode == "bm25":
                parts["bm25"] = ([t.term for t in r.terms], [(t.term, t.tf, t.df, t.idf, t.score) for t in r.terms])
            elif mode == "dense":
                parts["dense"] = (r.score, 1.0 - r.score)
            else:
                parts["hybrid"] = (r.rank_1, r.rank_2)
            rows.append((r["rank"], r.document_id, s.skill_id, r.score, mode, SEMANTICS[mode], *parts.values(), s.name, s.description, s.html_url, s.full_name, s.stars_count, s.path, s.license_status, s.validation_status, s.has_scripts))
        return self.spark.createDataFrame(rows, RESULT_SCHEMA)

    def detail(self, skill_id: int) -> tuple[DataFrame, DataFrame]:
        """(the record, its files)."""
        return stats.detail(self.skills, self.repositories, self._table("corpus_documents"), skill_id), stats.files(self._table("skill_files"), skill_id)

    def stats(self) -> dict[str, DataFrame]:
        return {
            "overview": stats.overview(self.repositories, self.skills),
            "validation": stats.zero_filled(self.skills, "validation_status", ["valid", "warning", "invalid"]),
            "licenses": stats.zero_filled(self.repositories, "license_status", ["permissive", "restrictive", "missing", "unknown"]),
            "tools": stats.top_tools(self.skills),
        }
