"""Okapi BM25 over a stored postings table, for all queries of a table at once.

Statistics (number of documents, mean length, document frequency) are those of the whole corpus; filters only take out
documents while scoring. Repeated query terms count once. Scores add the terms in the order of the query, so they do not
depend on the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import text as X
from quarrymill.runtime import Stage

K1, B = 1.5, 0.75
#: Folders that postings are spread over by term, and rows that one task writes of a folder.
BUCKETS, BUCKET_ROWS = 16, 5_000_000


def statistics(tokenized: DataFrame) -> DataFrame:
    """One row: n_docs, total_len, avg_len (0 without documents)."""
    return tokenized.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_len"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avg_len"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_score(tf: Column, doc_len: Column, avg_len: Column, idf_: Column, k1: float = K1, b: float = B) -> Column:
    return F.when(avg_len > 0, idf_ * (tf * (k1 + 1.0)) / (tf + k1 * (1.0 - b + b * (doc_len / avg_len)))).otherwise(0.0)


def query_terms(queries: DataFrame, normalize: bool = False) -> DataFrame:
    """(query_id, pos, term): distinct terms in order of first occurrence."""
    text = X.normalize("query_text") if normalize else F.col("query_text")
    return queries.select("query_id", F.posexplode(F.array_distinct(X.tokens(text))).alias("pos", "term"))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class Index:
    """A stored inverted index: postings by term, document frequencies, documents, and the statistics of the corpus.

    Postings are laid out in folders by a hash of the term, so a search reads the folders and row groups of its terms only.
    They carry the filter columns; the documents are read for the rows that are ranked. Built once, read by any number of
    searches.
    """

    def __init__(self, postings: DataFrame, terms: DataFrame, docs: DataFrame, n_docs: int, total_len: int, buckets: int):
        self.postings, self.terms, self.docs, self.n_docs, self.total_len, self.buckets = postings, terms, docs, n_docs, total_len, buckets
        self.avg_len = total_len / n_docs if n_docs else 0.0

    @classmethod
    def build(cls, tokenized: DataFrame, stage: Stage | None = None, buckets: int = BUCKETS) -> "Index":
        """From (document_id, tokens, doc_len, repository_full_name, path, filter columns)."""
        stage = stage or Stage(tokenized.sparkSession, "index")
        kept = stage.write(tokenized, "tokens")
        stats = statistics(kept).first()
        carried = ["document_id", "doc_len", *[c for c in FILTERS if c in tokenized.columns]]
        counted = kept.select(*carried, F.explode("tokens").alias("term")).groupBy(*carried, "term").agg(F.count("*").cast("int").alias("tf"))
        counted = counted.withColumn("bucket", _bucket(F.col("term"), buckets))
        # a term that every document has is written by many tasks
        parts = 1 + stats.total_len // (buckets * BUCKET_ROWS)
        placed = counted.repartition(buckets * parts, "bucket", F.pmod(F.xxhash64("document_id"), F.lit(parts))).sortWithinPartitions("bucket", "term")
        postings = stage.write(placed, "postings", partition_by=("bucket",))
        terms = stage.write(postings.groupBy("bucket", "term").agg(F.count("*").alias("df")).coalesce(buckets).sortWithinPartitions("bucket", "term"), "terms", partition_by=("bucket",))
        docs = stage.write(kept.drop("tokens"), "docs")
        stage.drop(kept)
        return cls(postings, terms, docs, stats.n_docs, stats.total_len, buckets)

    @property
    def size(self) -> int:
        return self.n_docs

    def terms_of(self, asked: list[str]) -> tuple[DataFrame, DataFrame]:
        """(postings, document frequencies) of given terms: filters that prune folders and row groups."""
        rule = F.col("term").isin(asked) & F.col("bucket").isin([F.pmod(F.xxhash64(F.lit(t)), F.lit(self.buckets)).cast("int") for t in asked]) if asked else F.lit(False)
        return self.postings.where(rule), self.terms.where(rule)


FILTERS = ("license_status", "validation_status", "has_scripts")


def scores(queries: DataFrame, corpus: "Index | DataFrame", allowed: Column | None = None, k1: float = K1, b: float = B, normalize: bool = False, asked: list[str] | None = None) -> DataFrame:
    """(query_id, document_id, score, terms) of every match; terms is [(pos, term, tf, df, idf, score)] in query order.

    corpus: an index, or a tokenised corpus that is indexed now. allowed: a predicate over the filter columns. asked: the
    terms of the queries, where the caller knows them; else the terms of all queries are joined by folder and term, by
    whatever strategy their measured size allows.
    """
    index = corpus if isinstance(corpus, Index) else Index.build(corpus)
    terms = query_terms(queries, normalize)
    postings, df = (index.postings, index.terms) if asked is None else index.terms_of(asked)
    hits = postings if allowed is None else postings.where(allowed)
    keyed = terms.withColumn("bucket", _bucket(F.col("term"), index.buckets)).join(df, ["bucket", "term"])
    scored = (
        keyed.withColumn("idf", idf(F.lit(index.n_docs), F.col("df")))
        .join(hits.select("bucket", "term", "document_id", "doc_len", "tf"), ["bucket", "term"])
        .withColumn("s", term_score(F.col("tf"), F.col("doc_len"), F.lit(index.avg_len), F.col("idf"), k1, b))
    )
    item = F.struct("pos", "term", "tf", "df", "idf", F.col("s").alias("score"))
    return (
        scored.groupBy("query_id", "document_id")
        .agg(F.array_sort(F.collect_list(item)).alias("terms"))  # at most the terms of a query
        .select("query_id", "document_id", F.aggregate("terms", F.lit(0.0), lambda a, t: a + t["score"]).alias("score"), "terms")
        .where("score > 0")
    )


def ranked(scored: DataFrame, docs: DataFrame, k: int, digits: int | None = 6) -> DataFrame:
    """The best k of each query with rank from 1: score, then repository and path without regard to case, then id.

    Without the identities of the documents a ranking by score alone is cut first with room for ties, so that only few
    rows are joined with them.
    """
    score = F.round("score", digits) if digits is not None else F.col("score")
    some = scored.withColumn("score", score).withColumn("_dense", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("_dense") <= k).drop("_dense")
    named = some.join(docs.select("document_id", F.lower("repository_full_name").alias("_r"), F.lower("path").alias("_p")), "document_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "_r", "_p", "document_id")
    return named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_r", "_p")


def search(
    queries: DataFrame, corpus: "Index | DataFrame", k: int = 10, allowed: Column | None = None, k1: float = K1, b: float = B, normalize: bool = False, digits: int | None = 6, asked: list[str] | None = None
) -> DataFrame:
    """(query_id, rank, document_id, score, terms)."""
    if not 1 <= k <= 100:
        raise ValueError("k must be between 1 and 100")
    index = corpus if isinstance(corpus, Index) else Index.build(corpus)
    return ranked(scores(queries, index, allowed, k1, b, normalize, asked), index.docs, k, digits)
