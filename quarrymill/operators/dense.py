"""Exact cosine search, embedding checks and the hashing encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions import text as X
from quarrymill.functions.checks import ContractError

#: Rows of a block of documents and of queries that one task multiplies.
DOC_BLOCK, QUERY_BLOCK = 8_192, 2_048
NORM_TOLERANCE = 1e-4


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def similarity(a: Column, b: Column) -> Column:
    """Cosine, kept within -1 and 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b))))


def problem(v: Column, dimension: int, unit: bool = True) -> Column:
    """What is wrong with an embedding: null, dimension, not_finite, zero, norm; null if nothing."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    out = F.when(v.isNull(), "null").when(F.size(v) != dimension, "dimension").when(~finite, "not_finite").when(norm(v) == 0, "zero")
    return out.when(F.abs(norm(v) - 1) > NORM_TOLERANCE, "norm") if unit else out


def search_one(query: list[float], docs: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id", digits: int | None = 6) -> DataFrame:
    """(key, similarity) of the best k rows for one vector, within the JVM."""
    q = F.array(*[F.lit(float(x)) for x in query])
    s = similarity(F.col(vector), q)
    return docs.where(problem(F.col(vector), len(query), unit=False).isNull()).select(key, (F.round(s, digits) if digits is not None else s).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def search(queries: DataFrame, docs: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id", dimension: int = 384, digits: int = 6) -> DataFrame:
    """(query_id, rank, key, similarity): the best k rows of docs for every row (query_id, vector) of queries, exactly.

    Both sides are cut into blocks of fixed size; a task multiplies one block of queries with one of documents and keeps
    the best k of each query, ties by key. Unusable vectors take no part.
    """
    q, d = (df.where(F.size(F.col(vector)) == dimension) for df in (queries.select("query_id", vector), docs.select(key, vector)))
    many_q = max(1, -(-queries.count() // QUERY_BLOCK))
    many_d = max(1, -(-docs.count() // DOC_BLOCK))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    kind_q, kind_d = queries.schema["query_id"].dataType, docs.schema[key].dataType
    none_q, none_d = F.lit(None).cast(kind_q).alias("query_id"), F.lit(None).cast(kind_d).alias("id")
    left = q.select(block("query_id", many_q).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(many_d - 1))).alias("db"), "query_id", none_d, F.lit(True).alias("is_query"), F.col(vector).cast("array<float>").alias("v"))
    right = d.select(F.explode(F.sequence(F.lit(0), F.lit(many_q - 1))).alias("qb"), block(key, many_d).alias("db"), none_q, F.col(key).alias("id"), F.lit(False).alias("is_query"), F.col(vector).cast("array<float>").alias("v"))

    def multiply(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        flat = t.column("v").chunk(0).flatten()
        x = np.asarray(flat.fill_null(float("nan")) if flat.null_count else flat, dtype=np.float64).reshape(t.num_rows, -1)
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        t, x = t.filter(pa.array(good)).combine_chunks(), x[good]
        is_query = t.column("is_query").to_numpy()
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1)[:, None]
        qs, ds = np.nonzero(is_query)[0], np.nonzero(~is_query)[0]
        # documents in the order of their keys (text by its bytes), so that ties are cut in that order
        keys = t.column("id").take(pa.array(ds)).to_pylist()
        ds = ds[sorted(range(len(ds)), key=lambda i: keys[i].encode() if isinstance(keys[i], str) else keys[i])]
        out_q, out_d, out_s = [], [], []
        for low in range(0, len(qs) if len(ds) else 0, 256):
            rows = qs[low : low + 256]
            s = np.round(np.clip(x[rows] @ x[ds].T, -1, 1), digits)
            cut = max(0, s.shape[1] - k)
            least = np.partition(s, cut, axis=1)[:, cut : cut + 1]
            above, tied = s > least, s == least
            tied &= np.cumsum(tied, axis=1) <= k - above.sum(1, keepdims=True)
            r, c = np.nonzero(above | tied)
            out_q.append(rows[r])
            out_d.append(ds[c])
            out_s.append(s[r, c])
        flat = lambda a: np.concatenate(a) if a else np.zeros(0, np.int64)
        return pa.table({"query_id": t.column("query_id").take(pa.array(flat(out_q))), key: t.column("id").take(pa.array(flat(out_d))), "similarity": pa.array(flat(out_s).astype(np.float64))})

    best = left.unionByName(right).groupBy("qb", "db").applyInArrow(multiply, f"query_id {kind_q.simpleString()}, {key} {kind_d.simpleString()}, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def of_model(embeddings: DataFrame, model_id: str, model_revision: str, dimension: int, config_sha256: str | None = None) -> DataFrame:
    """The vectors that one model in one revision made (and one configuration, where the table names it): only these may be compared with its queries."""
    rule = F.col("embedding").isNotNull() & (F.col("model_id") == model_id) & (F.col("model_revision") == model_revision) & (F.col("model_dimension") == dimension)
    if config_sha256 is not None:
        rule &= F.col("embedding_config_sha256") == config_sha256
    return embeddings.where(rule)


def coverage(corpus: DataFrame, embeddings: DataFrame, model_id: str, model_revision: str, dimension: int) -> DataFrame:
    """(document_id, state) of every document: current, stale, or missing. corpus has document_id, embedding_text_sha256."""
    mine = embeddings.where("embedding IS NOT NULL").select(
        "document_id", F.lit(True).alias("_there"),
        (F.col("model_id").eqNullSafe(F.lit(model_id)) & F.col("model_revision").eqNullSafe(F.lit(model_revision)) & F.col("model_dimension").eqNullSafe(F.lit(dimension))).alias("_model"),
        F.col("embedding_text_sha256").alias("_hash"),
    ).groupBy("document_id").agg(F.max("_there").alias("_there"), F.collect_set(F.when(F.col("_model"), F.col("_hash"))).alias("_hashes"))
    return corpus.join(mine, "document_id", "left").select(
        "document_id", F.when(F.col("_there").isNull(), "missing").when(F.array_contains("_hashes", F.col("embedding_text_sha256")), "current").otherwise("stale").alias("state")
    )


@dataclass(frozen=True)
class Encoder:
    """What makes vectors of texts: its identity, and a function of a column of texts that gives a column of unit vectors."""

    model_id: str
    model_revision: str
    dimension: int
    encode: Callable[[Column], Column]

    @property
    def identity(self) -> tuple[str, str, int]:
        return self.model_id, self.model_revision, self.dimension


_ENCODERS: dict[str, Callable[[str, int], Encoder]] = {}
HASHING = "quarrymill/token-hashing"


def register_encoder(model_id: str, make: Callable[[str, int], Encoder]) -> None:
    """make: (revision, dimension) -> Encoder, called when a configuration first names the model."""
    _ENCODERS[model_id] = make
    encoder_for.cache_clear()


@lru_cache(16)
def encoder_for(model_id: str, model_revision: str, dimension: int) -> Encoder:
    """The encoder that a configuration pins; raises if there is none or if it differs from what was pinned."""
    if model_id not in _ENCODERS:
        raise ContractError(f"no encoder for the model {model_id}")
    made = _ENCODERS[model_id](model_revision, dimension)
    if made.identity != (model_id, model_revision, dimension):
        raise ContractError("the encoder differs from the pinned configuration")
    return made


# The coordinate and sign that a token's hash names, as the results demand.
def hashing_encoder(dimension: int = 384):
    """A pandas UDF from tokens to a unit vector: every token adds 1 or -1 at a coordinate that its hash names; without tokens, the first axis."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places: dict[str, tuple[int, float]] = {}
        for tokens in batches:
            out = []
            for words in tokens:
                v = np.zeros(dimension, dtype=np.float32)
                for w in words if words is not None else ():
                    at = places.get(w)
                    if at is None:
                        d = hashlib.blake2b(w.encode("utf-8"), digest_size=8).digest()
                        at = places[w] = int.from_bytes(d[:4], "big") % dimension, 1.0 if d[4] & 1 else -1.0
                    v[at[0]] += at[1]
                length = float(np.linalg.norm(v))
                if length:
                    v /= length
                else:
                    v[0] = 1.0
                out.append(v)
            if len(places) > 500_000:
                places.clear()
            yield pd.Series(out)

    return encode


def index_incrementally(corpus: DataFrame, embeddings: DataFrame, encoder: Encoder, indexed_at: Column) -> tuple[DataFrame, DataFrame]:
    """(new embedding rows for what is stale or missing, rows kept as they are). corpus has document_id, embedding_text, embedding_text_sha256."""
    state = coverage(corpus, embeddings, *encoder.identity)
    todo = corpus.join(state.where("state <> 'current'"), "document_id", "left_semi")
    made = todo.select(
        "document_id", F.lit(encoder.model_id).alias("model_id"), F.lit(encoder.model_revision).alias("model_revision"), F.lit(encoder.dimension).alias("model_dimension"),
        encoder.encode(F.col("embedding_text")).alias("embedding"), "embedding_text", "embedding_text_sha256", indexed_at.alias("indexed_at"),
    )
    return made, embeddings.join(todo.select("document_id"), "document_id", "left_anti")


register_encoder(HASHING, lambda revision, dimension: Encoder(HASHING, revision, dimension, lambda text: hashing_encoder(dimension)(X.tokens(text))))
