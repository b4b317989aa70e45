"""A hierarchical navigable small-world graph over the vectors of one shard, in flat neighbour arrays.

Nodes are inserted in batches that search the graph built so far, as single insertions would; the members of a batch are
candidates of each other too. All searches of a batch run in step: one numpy operation expands one node of every query.
Similarities that steer a search are dot products of an orthogonal projection to `STEER` dimensions; what a search
returns is ranked again by the full vectors. Up to `STEER` dimensions the vectors steer the search themselves.
"""

from __future__ import annotations

import numpy as np

LINKS = 12
WIDTH = 32  # places for the neighbours of a node on the lowest level
EF_BUILD, EF_SEARCH = 32, 32
#: Nodes kept on the levels above; all of them are starts on the level below.
EF_ABOVE = 16
STEER = 384
BATCH = 512


def steering(vectors: np.ndarray) -> np.ndarray:
    """What steers the search for vectors; every shard uses the same projection."""
    dim = vectors.shape[1]
    if dim <= STEER:
        return vectors
    q, _ = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, STEER)))
    return vectors @ np.ascontiguousarray(q.astype(np.float32) * np.sqrt(dim / STEER))


def beam(points: np.ndarray, links: np.ndarray, queries: np.ndarray, starts: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the up to ef best nodes found for each query, best first; -1 where there are fewer."""
    b, n, width = len(queries), len(points), links.shape[1]
    ids = np.full((b, ef), -1, dtype=np.int32)
    sims = np.full((b, ef), -np.inf, dtype=np.float32)
    todo = np.zeros((b, ef), dtype=bool)
    seen = np.zeros((b, n), dtype=bool)
    every = np.arange(b)
    e = starts.shape[1]
    there = starts >= 0
    ids[:, :e] = starts
    sims[:, :e] = np.where(there, np.einsum("ij,ikj->ik", queries, points[np.where(there, starts, 0)]), -np.inf)
    todo[:, :e] = there
    seen[every[:, None], np.where(there, starts, starts[:, :1])] = True
    rows = every
    while len(rows):
        part = np.where(todo[rows], sims[rows], -np.inf)
        pick = part.argmax(1)
        at = np.arange(len(rows))
        go = part[at, pick] > -np.inf
        if not go.all():
            rows, pick = rows[go], pick[go]
            if not len(rows):
                break
            at = at[: len(rows)]
        todo[rows, pick] = False
        near = links[ids[rows, pick]]
        fresh = near >= 0
        fresh &= ~seen[rows[:, None], np.where(fresh, near, 0)]
        r, c = np.nonzero(fresh)
        if not len(r):
            continue
        j = near[r, c]
        owner = rows[r]
        seen[owner, j] = True
        s = np.einsum("ij,ij->i", queries[owner], points[j])
        good = s > sims[owner].min(1) if ef > 8 else np.ones(len(s), bool)
        found = np.full((len(rows), width), -np.inf, dtype=np.float32)
        found[r[good], c[good]] = s[good]
        some = np.unique(r[good])
        if not len(some):
            continue
        own = rows[some]
        all_s = np.concatenate([sims[own], found[some]], 1)
        all_i = np.concatenate([ids[own], near[some]], 1)
        all_t = np.concatenate([todo[own], found[some] > -np.inf], 1)
        keep = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        sims[own] = np.take_along_axis(all_s, keep, 1)
        ids[own] = np.take_along_axis(all_i, keep, 1)
        todo[own] = np.take_along_axis(all_t, keep, 1) & (sims[own] > -np.inf)
    ids[sims == -np.inf] = -1
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def diverse(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` neighbours a node: candidates, nearest first, that are nearer to the node than to a neighbour already taken. -1 fills up."""
    order = np.argsort(-sims, axis=1, kind="stable")
    candidates, sims = np.take_along_axis(candidates, order, 1), np.take_along_axis(sims, order, 1)
    a, c = candidates.shape
    valid = (candidates >= 0) & (candidates != own[:, None])
    vectors = points[np.where(valid, candidates, 0)]
    between = vectors @ vectors.transpose(0, 2, 1)
    taken = np.zeros((a, c), dtype=bool)
    count = np.zeros(a, dtype=np.int64)
    closest = np.full((a, c), -np.inf, dtype=np.float32)  # to the neighbours taken so far
    for k in range(c):
        take = valid[:, k] & (count < most) & (closest[:, k] < sims[:, k])
        taken[:, k] = take
        count += take
        closest = np.where(take[:, None], np.maximum(closest, between[:, k, :]), closest)
    first = np.argsort(~taken, axis=1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(taken, first, 1), np.take_along_axis(candidates, first, 1), -1)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out.astype(np.int32)


class Graph:
    def __init__(self, vectors: np.ndarray):
        """vectors: unit length, float32."""
        self.points = steering(vectors)
        n = len(vectors)
        u = (np.random.default_rng(n).random(n) + 1e-12).clip(max=1.0)
        levels = np.minimum((-np.log(u) / np.log(LINKS)).astype(np.int64), 4) if n else np.zeros(0, np.int64)
        self.top = int(levels.max()) if n else 0
        self.levels = levels
        self.links = [np.full((n, WIDTH if k == 0 else 2 * LINKS), -1, dtype=np.int32) for k in range(self.top + 1)]
        self.filled = [np.zeros(n, dtype=np.int64) for _ in range(self.top + 1)]
        # nodes of high levels come first, so that the upper levels guide the rest
        order = np.argsort(-levels, kind="stable")
        self.entry = int(order[0]) if n else -1
        at = 1
        while at < n:
            size = min(BATCH, max(32, at), n - at)
            self._insert(order[at : at + size])
            at += size

    def _insert(self, nodes: np.ndarray) -> None:
        q = self.points[nodes]
        at = np.full((len(nodes), 1), self.entry)
        mutual = q @ q.T
        np.fill_diagonal(mutual, -np.inf)
        for level in range(self.top, -1, -1):
            member = self.levels[nodes] >= level
            ef = EF_BUILD if member.any() else EF_ABOVE
            ids, sims = beam(self.points, self.links[level], q, at, ef)
            if member.any():
                own = np.nonzero(member)[0]
                peers = mutual[np.ix_(own, own)]
                k = min(LINKS, len(own) - 1)
                cand, cand_s = ids[own], sims[own]
                if k > 0:
                    best = np.argpartition(-peers, k - 1, axis=1)[:, :k]
                    cand = np.concatenate([cand, nodes[own][best]], 1)
                    cand_s = np.concatenate([cand_s, np.take_along_axis(peers, best, 1)], 1)
                self._link(level, nodes[own], diverse(self.points, nodes[own], cand, cand_s, LINKS))
            at = ids[:, :EF_ABOVE]

    def _link(self, level: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        links, filled = self.links[level], self.filled[level]
        links[nodes, :LINKS] = chosen
        filled[nodes] = (chosen >= 0).sum(1)
        a = np.repeat(nodes, LINKS)
        b = chosen.ravel()
        a, b = a[b >= 0], b[b >= 0].astype(np.int64)
        known = (links[b] == a[:, None]).any(1)  # members of a batch may have chosen each other
        a, b = a[~known], b[~known]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        width = links.shape[1]
        while len(b):
            first = np.concatenate([[True], b[1:] != b[:-1]])
            run = np.arange(len(b)) - np.maximum.accumulate(np.where(first, np.arange(len(b)), 0))
            place = filled[b] + run
            fits = place < width
            links[b[fits], place[fits]] = a[fits]
            np.add.at(filled, b[fits], 1)
            a, b = a[~fits], b[~fits]
            full = np.unique(b)
            if len(full):
                cand = links[full]
                sims = np.einsum("ijk,ik->ij", self.points[np.where(cand >= 0, cand, 0)], self.points[full])
                sims = np.where(cand >= 0, sims, -np.inf)
                kept = diverse(self.points, full, cand, sims, width // 2)
                links[full] = -1
                links[full, : width // 2] = kept
                filled[full] = (kept >= 0).sum(1)

    def search(self, vectors: np.ndarray, ef: int = EF_SEARCH, own: np.ndarray | None = None) -> np.ndarray:
        """Ids of the up to ef nodes nearest to each vector; -1 where there are fewer. own: the nodes that the vectors are, if they are; a search starts there too."""
        out = []
        for low in range(0, len(vectors), BATCH):
            q = steering(vectors[low : low + BATCH])
            at = np.full((len(q), 1), self.entry)
            for level in range(self.top, 0, -1):
                at, _ = beam(self.points, self.links[level], q, at, EF_ABOVE)
            if own is not None:
                at = np.concatenate([own[low : low + BATCH, None], np.where(at == own[low : low + BATCH, None], -1, at)], 1)
            out.append(beam(self.points, self.links[0], q, at, ef)[0])
        return np.concatenate(out) if out else np.zeros((0, ef), np.int32)
