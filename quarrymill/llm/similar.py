"""The k most similar vectors of every vector: a small-world graph per shard, shard results merged.

Shards are the regions of centroids that are fitted on a bounded sample (`SAMPLE` vectors); every usable vector is
indexed, in the shard of its nearest centroid, and searches that shard and those of its next nearest centroids
(`VISITS` in all). A search result that is better than what the found vector knows in its own shard is offered to that
vector too. Similarities are cosines in double precision from the full vectors, rounded to 6 decimals.

Vectors that are equal are one node: tasks fold the copies of their rows before the shuffle, and only the k + 1 smallest
ids of a group of copies travel with it, as no neighbour list can hold more of them. The other copies get their
neighbours by a salted join.

The number of centroids is bounded by what the sample can fit. A shard that the sample says is too large is cut into
pieces by fixed hyperplanes through its centroid; a vector that visits the shard searches the piece on its own side and
those across the `PROBES` planes it is nearest to, so its work does not depend on how many pieces there are. A piece that
has too many visitors is copied, and they share its copies. Every piece or copy is a partition of its own.

Defined results: vectors that are null, of another length, not finite or all zero are not usable and take no part; a
vector is not its own neighbour; rows repeated verbatim count once; equal similarities are ordered by smaller id; an
empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm import hnsw
from quarrymill.runtime import Stage

SAMPLE = 20_000
SHARD = 4_096
VISITS = 3
MOST_SHARDS = 4_000
ROUNDS = 8
SALTS = 64
PROBES = 2
#: Rows of one shard or visitors of one piece, in shards' sizes, beyond which they are divided.
CROWD = 4
MOST_PARTITIONS = 50_000


def usable(batch_ids: pa.Array, lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of the usable rows of a batch."""
    ids = batch_ids.to_numpy(zero_copy_only=False)
    lengths = np.asarray(pa.compute.list_value_length(lists).fill_null(-1))
    rows = np.nonzero(lengths == dim)[0]
    kept = lists.take(pa.array(rows))
    flat = kept.flatten()
    values = np.asarray(flat.fill_null(float("nan")) if flat.null_count else flat, dtype=np.float32).reshape(-1, dim)
    ok = np.isfinite(values).all(1) & (values != 0).any(1)
    return ids[rows][ok], values[ok]


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)  # against overflow and underflow of the squares
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def fit_centroids(sample: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroids, share of the sample in the region of each, share of the sample that visits each from another)."""
    x = unit(sample).astype(np.float32)
    x = np.unique(x, axis=0) if len(x) else x
    count = max(1, min(count, len(x)))
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), count, replace=False)] if len(x) else np.zeros((1, sample.shape[1]), np.float32)
    nearest = np.zeros(len(x), dtype=np.int64)
    for _ in range(ROUNDS if len(x) else 0):
        nearest = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        order = np.argsort(nearest, kind="stable")
        starts = np.searchsorted(nearest[order], np.arange(count))
        full = np.nonzero(np.diff(np.append(starts, len(x))))[0]
        sums = np.add.reduceat(x[order], starts[full], axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c[full] = np.where(norm > 1e-6, sums / np.maximum(norm, 1e-6), c[full])
    visited = np.zeros(count)
    for i in range(0, len(x) if count > 1 else 0, 4096):
        next_ = np.argsort(-(x[i : i + 4096] @ c.T), axis=1, kind="stable")[:, 1:VISITS]
        visited += np.bincount(next_.ravel(), minlength=count)
    return c, np.bincount(nearest, minlength=count) / max(1, len(x)), visited / max(1, len(x))


def _lists(flat: np.ndarray, dim: int) -> pa.Array:
    n = len(flat)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(flat.reshape(-1)))


def _ragged(parts: list) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _fold(keys: list[bytes], ids: list[list[int]], many: list[bool], most: int) -> dict[bytes, tuple[int, list[int], bool]]:
    """key -> (first row, smallest ids, whether there are more) of the rows with a key."""
    groups: dict[bytes, list] = {}
    for row, key in enumerate(keys):
        g = groups.get(key)
        if g is None:
            groups[key] = [row, set(ids[row]), many[row]]
        else:
            g[1].update(ids[row])
            g[2] |= many[row]
            if len(g[1]) > 4 * most:
                g[1], g[2] = set(sorted(g[1])[:most]), True
    return {k: (r, sorted(s)[:most], m or len(s) > most) for k, (r, s, m) in groups.items()}


def neighbours(df: DataFrame, key: str, vector: str, dim: int, k: int = 10) -> DataFrame:
    """(id, neighbour, rank) of the k most similar usable vectors of every usable vector."""
    spark = df.sparkSession
    source = df.select(df[key].cast("long").alias("id"), df[vector].cast("array<float>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") == dim))
    total = source.count()
    wanted = max(1, min(MOST_SHARDS, -(-total // SHARD)))
    most = k + 1

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [usable(b.column(0), b.column(1), dim)[1] for b in batches]
        sample = np.concatenate(parts) if parts else np.zeros((0, dim), np.float32)
        c, share, visited = fit_centroids(sample, wanted)
        yield pa.RecordBatch.from_arrays([_lists(c, dim), pa.array(share), pa.array(visited)], names=["c", "share", "visited"])

    ratio = min(1.0, SAMPLE / max(1, total))
    chosen = source.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(ratio * (1 << 30)) + 1).limit(2 * SAMPLE)
    fitted = chosen.repartition(1).mapInArrow(fit, "c array<float>, share double, visited double").toArrow()  # at most MOST_SHARDS rows
    centroids = np.asarray(fitted.column("c").combine_chunks().flatten(), dtype=np.float32).reshape(-1, dim)
    if not len(centroids):  # nothing usable
        return spark.createDataFrame([], "id bigint, neighbour bigint, rank int")
    sizes, guests = (np.maximum(1, fitted.column(name).to_numpy() * total / (CROWD * SHARD)) for name in ("share", "visited"))
    bits = np.ceil(np.log2(sizes)).astype(np.int64)  # a shard has 2 ** bits pieces
    copies_of = np.ceil(guests * np.minimum(1, (1 + PROBES) / 2.0**bits)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum((1 << bits) * copies_of)])  # number of a shard's first piece and copy
    groups_all = int(first[-1])
    partitions = min(groups_all, MOST_PARTITIONS)
    visits = min(VISITS, len(centroids))
    planes = np.random.default_rng(5).standard_normal((dim, int(bits.max()))).astype(np.float32)

    def places(x: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, group, whether the row is at home there) of every place that rows are sent to."""
        u = unit(x).astype(np.float32)
        best = np.argsort(-(u @ centroids.T), axis=1, kind="stable")[:, :visits]
        row = np.repeat(np.arange(len(x)), visits)
        shard = best.ravel()
        home = np.tile(np.arange(visits) == 0, len(x))
        piece = np.zeros(len(row), dtype=np.int64)
        split = bits[shard] > 0
        if split.any():
            side = (u[row[split]] - centroids[shard[split]]) @ planes
            there = np.arange(planes.shape[1]) < bits[shard[split]][:, None]
            piece[split] = ((side > 0) & there) @ (1 << np.arange(planes.shape[1]))
            near = np.argsort(np.where(there, np.abs(side), np.inf), axis=1, kind="stable")[:, :PROBES]
            at = np.nonzero(split)[0]
            more = [(at[ok], piece[at][ok] ^ (1 << near[ok, p])) for p in range(near.shape[1]) if (ok := p < bits[shard[at]]).any()]
            row = np.concatenate([row, *[row[a] for a, _ in more]])
            shard = np.concatenate([shard, *[shard[a] for a, _ in more]])
            home = np.concatenate([home, *[np.zeros(len(a), dtype=bool) for a, _ in more]])
            piece = np.concatenate([piece, *[q for _, q in more]])
        # a row at home is in every copy of its piece, a visitor in one
        many = np.where(home, copies_of[shard], 1)
        copy = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row, shard, home, piece = (np.repeat(v, many) for v in (row, shard, home, piece))
        copy = np.where(home, copy, (digest[row] % copies_of[shard].astype(np.uint64)).astype(np.int64))
        return row, first[shard] + piece * copies_of[shard] + copy, home

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = usable(batch.column(0), batch.column(1), dim)
            if not len(ids):
                continue
            keys = [hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in x]
            folded = _fold(keys, [[int(i)] for i in ids], [False] * len(ids), most)
            x = x[np.array([g[0] for g in folded.values()])]
            digest = np.frombuffer(b"".join(folded), dtype=">u8").reshape(-1, 2)[:, 1].astype(np.uint64)
            take, group, home = places(x, digest)
            names = pa.array(list(folded), pa.binary())
            heads = _ragged([np.array(g[1], dtype=np.int64) for g in folded.values()])
            many = pa.array([g[2] for g in folded.values()], pa.bool_())
            for low in range(0, len(take), 4096):
                part = slice(low, low + 4096)
                t = pa.array(take[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[part] % partitions, pa.int32()), pa.array(group[part]), pa.array(home[part]), names.take(t), heads.take(t), many.take(t), _lists(x[take[part]], dim)],
                    names=["at", "group", "home", "key", "ids", "many", "v"],
                )

    routed = source.mapInArrow(route, "at int, group bigint, home boolean, key binary, ids array<bigint>, many boolean, v array<float>")

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        home = table.column("home").to_numpy()
        raw = table.column("key").to_pylist()
        ids = table.column("ids").to_pylist()
        many = table.column("many").to_pylist()
        flat = np.asarray(table.column("v").chunk(0).flatten() if table.num_rows else [], dtype=np.float32).reshape(-1, dim)
        parts = []
        for side in (True, False):
            rows = np.nonzero(home == side)[0]
            groups = _fold([raw[r] for r in rows], [ids[r] for r in rows], [many[r] for r in rows], most)
            parts.append((list(groups), [rows[g[0]] for g in groups.values()], list(groups.values())))
        (hk, hr, hg), (fk, fr, fg) = parts
        own = unit(flat[hr]) if hr else np.zeros((0, dim))
        visitors = unit(flat[fr]) if fr else np.zeros((0, dim))
        graph = hnsw.Graph(own.astype(np.float32))
        head = [np.array(g[1], dtype=np.int64) for g in hg]
        out_key, out_sim, out_id = [], [], []

        def ranked(q: np.ndarray, found: np.ndarray) -> np.ndarray:
            sims = np.full(found.shape, -9.0)
            for low in range(0, len(q), 256):
                f = found[low : low + 256]
                s = np.einsum("ij,ikj->ik", q[low : low + 256], own[np.where(f >= 0, f, 0)])
                sims[low : low + 256] = np.where(f >= 0, np.round(s, 6), -9.0)
            return sims

        offers: list[list[tuple[float, int]]] = [[] for _ in hk]
        if len(own):
            found = graph.search(own.astype(np.float32), hnsw.EF_SEARCH, np.arange(len(own)))
            sims = ranked(own, found)
            lists = []
            for i in range(len(own)):
                got = [(-s, int(x)) for s, j in zip(sims[i].tolist(), found[i].tolist(), strict=True) if j >= 0 and j != i for x in head[j]]
                got += [(-1.0, int(x)) for x in head[i]]
                got.sort()
                lists.append(got[:most])
            # a visitor is offered to a node if it is as good as the worst that the node needs
            need = np.array([got[-1][0] if len(got) >= most else 9.0 for got in lists])
            if len(visitors):
                found = graph.search(visitors.astype(np.float32))
                sims = ranked(visitors, found)
                for i in range(len(visitors)):
                    got = []
                    for s, j in zip(sims[i].tolist(), found[i].tolist(), strict=True):
                        if j < 0:
                            continue
                        got.extend((-s, int(x)) for x in head[j])
                        if -s <= need[j]:
                            offers[j].extend((-s, x) for x in fg[i][1])
                    got.sort()
                    out_key.append(fk[i])
                    out_sim.append([g[0] for g in got[:most]])
                    out_id.append([g[1] for g in got[:most]])
            for i, got in enumerate(lists):
                if offers[i]:
                    got = sorted(set(got + offers[i]))[:most]
                out_key.append(hk[i])
                out_sim.append([g[0] for g in got])
                out_id.append([g[1] for g in got])
        n = len(out_key)
        owners = dict(zip(hk, hg, strict=True))
        return pa.table(
            {
                "key": pa.array(out_key, pa.binary()),
                "sims": _ragged([np.array(s, dtype=np.float64) for s in out_sim]) if n else pa.array([], pa.list_(pa.float64())),
                "near": _ragged([np.array(s, dtype=np.int64) for s in out_id]) if n else pa.array([], pa.list_(pa.int64())),
                "ids": pa.array([owners[x][1] if i >= len(fk) or not len(own) else None for i, x in enumerate(out_key)], pa.list_(pa.int64())),
                "many": pa.array([owners[x][2] if i >= len(fk) or not len(own) else None for i, x in enumerate(out_key)], pa.bool_()),
            }
        )

    def search_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The groups of a partition, one after the other; its rows come sorted by group."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            group = batch.column(1).to_numpy()
            cuts = [0, *(np.nonzero(group[1:] != group[:-1])[0] + 1).tolist(), len(group)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if held and held[0].column(1)[0].as_py() != group[low]:
                    yield from search(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(batch.slice(low, high - low))
        if held:
            yield from search(pa.Table.from_batches(held)).to_batches()

    # a number of its own for each piece: none is put together with others, as their cost is not in their bytes
    placed = routed.repartitionById(partitions, F.col("at")).sortWithinPartitions("group")
    searched = placed.mapInArrow(search_groups, "key binary, sims array<double>, near array<bigint>, ids array<bigint>, many boolean")
    best = (
        searched.groupBy("key")
        .agg(F.flatten(F.collect_list(F.arrays_zip("sims", "near"))).alias("c"), F.first("ids", ignorenulls=True).alias("ids"), F.max("many").alias("many"))
        .select("key", "ids", "many", F.slice(F.array_sort(F.array_distinct("c")), 1, most).alias("c"))
    )
    best = Stage(spark, "similar").write(best, "lists")
    few = best.select(F.explode("ids").alias("id"), "c")
    # copies beyond the k + 1 smallest ids of their group
    lists = best.where("many").select("key", "ids", "c", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))

    def key_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = usable(batch.column(0), batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x], pa.binary())], names=["id", "key"])

    parts = few
    if not best.where("many").isEmpty():
        copies = source.mapInArrow(key_of, "id bigint, key binary").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).distinct()
        parts = few.unionByName(copies.join(lists, ["key", "salt"]).where(~F.array_contains("ids", F.col("id"))).select("id", "c"))
    return parts.select("id", F.posexplode(F.slice(F.filter("c", lambda x: x["near"] != F.col("id")), 1, k)).alias("rank", "x")).select(
        "id", F.col("x.near").alias("neighbour"), (F.col("rank") + 1).alias("rank")
    )


def similar_pairs(df: DataFrame, key: str, vector: str, dim: int, k: int = 10) -> DataFrame:
    """(a, b), a < b, for each pair where at least one is among the k most similar of the other."""
    n = neighbours(df, key, vector, dim, k)
    return n.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()
