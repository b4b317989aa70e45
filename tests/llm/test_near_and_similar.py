import hashlib
import random
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import history, near, pivots, planes, similar
from quarrymill.llm.words import Elements, words


def degree(a, b):
    x, y = Counter(words(a)), Counter(words(b))
    n = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / n if n else 0.0


def corpus(n, seed, vocabulary=400):
    """Texts, many of them small edits of others."""
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(vocabulary)]
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.5:
            t = rng.choice(texts).split()
            for _ in range(rng.randint(0, max(1, len(t) // 6))):
                t[rng.randrange(len(t))] = rng.choice(pool)
            if rng.random() < 0.3:
                rng.shuffle(t)
            texts.append(" ".join(t))
        else:
            texts.append(" ".join(rng.choice(pool) if rng.random() < 0.7 else "the" for _ in range(rng.randint(20, 60))))
    return texts


@pytest.mark.parametrize("bound", [planes.Bits, pivots.Pivots])
@pytest.mark.parametrize("factor", [1, 25])
def test_bounds_lose_nothing(bound, factor):
    texts = [" ".join(f"{w}x{k}" for k in range(factor) for w in t.split()) for t in corpus(200, 4)]
    sets = Elements().sets(sorted(texts, key=lambda t: len(words(t))))
    n = sets.n
    raw = bound.sketch(sets)
    run = np.sort(np.arange(len(sets)) % 3)
    order = np.lexsort((n, run))
    sizes = np.array([len(raw[i]) for i in order])
    got = set()
    for size in np.unique(sizes):
        at = np.nonzero((sizes == size) | (sizes == 2 * size))[0]
        table = np.concatenate([bound.fold(np.frombuffer(raw[order[i]], dtype=np.uint8)[None, :], int(size)) for i in at])
        i, j = bound.pairs_of(np.unique(run[order][at], return_inverse=True)[1], n[order][at], table, sizes[at] > size, np.ones(len(at), bool))
        got |= {tuple(sorted((int(order[at[x]]), int(order[at[y]])))) for x, y in zip(i, j, strict=True)}
    pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if run[np.nonzero(order == a)[0][0]] == run[np.nonzero(order == b)[0][0]]]
    true = {(a, b) for a, b in pairs if 2 * len(np.intersect1d(sets[a], sets[b])) >= 0.8 * (n[a] + n[b]) - 1e-9}
    assert true and true <= got


@pytest.mark.parametrize("bound", [planes.Bits, pivots.Pivots])
def test_bounds_prune_long_texts(bound):
    """Of pairs of unrelated texts of 2,000 words at most one in a hundred is left."""
    rng = np.random.default_rng(1)
    sets = Elements().sets([" ".join(f"w{x}" for x in rng.zipf(1.2, size=2_000) % 20_000) for _ in range(64)])
    raw = bound.sketch(sets)
    table = bound.fold(np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(64, -1), len(raw[0]))
    i, _ = bound.pairs_of(np.zeros(64, int), sets.n, table, np.zeros(64, bool), np.ones(64, bool))
    assert len(i) <= 20


def test_equal_words_are_equal_elements():
    e = Elements()
    assert e.of("a b a").tolist() == e.of("A, a; b").tolist() and len(e.of("a b a")) == 3
    assert len(np.intersect1d(e.of("a a a"), e.of("a a"))) == 2
    assert not len(e.of(None)) and not len(e.of(" -- "))


def groups_by_hand(texts, least=20):
    keep = [i for i, t in enumerate(texts) if t and len(words(t)) >= least]
    root = {i: i for i in keep}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in keep:
        for b in keep:
            if a < b and degree(texts[a], texts[b]) >= 0.8:
                root[find(b)] = find(a)
    return {(a, b) for a in keep for b in keep if a < b and find(a) == find(b)}


@pytest.mark.parametrize("tile", [1_024, 8])
def test_groups_against_brute_force(spark, tile):
    texts = corpus(150, 8) + [None, "", "short text"] + ["a third of all rows is this one text " * 4] * 70
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:20], "skill_id long, body_text string, node string")
    got = near.pairs_within(near.linked_groups(df, "skill_id", "body_text", 20, planes.Bits, tile))
    pairs = list(map(tuple, got.collect()))
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == groups_by_hand(texts)
    assert near.linked_groups(df.where("false"), "skill_id", "body_text", 20, planes.Bits).count() == 0


def test_components(spark):
    from quarrymill.runtime import Stage

    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (102, 100), (200, 200)] + [(300, 300 + i) for i in range(1, 40)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in near.components(df, Stage(spark, "t")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in (100, 101, 102)} | {i: 300 for i in range(300, 340)}


@pytest.mark.parametrize("given,expected", [("a/b/SKILL.md", "a/b/SKILL.md"), ("./a//b/./SKILL.md ", "a/b/SKILL.md"), ("/a\\b\\SKILL.md", "a/b/SKILL.md"), ("a%2Fb%2FSKILL.md", "a/b/SKILL.md"), ("x/../a/b/SKILL.md", "a/b/SKILL.md"), ("A/b", "A/b"), ("  ", None), (None, None), ("..", None)])
def test_paths(given, expected):
    assert history.file_path(given) == expected


def repeats_by_hand(old, new):
    """What the statement of the problem says, one candidate after the other."""
    kept, out = [dict(r, old=True) for r in old], set()
    seen = {}
    for r in sorted(new, key=lambda r: r["arrived_at"]):
        seen.setdefault(r["record_id"], r)
    for r in sorted(seen.values(), key=lambda r: (r["batch_id"], r["record_id"])):
        low = lambda v: v.strip().lower() if v and v.strip() else None
        hits = []
        for k in kept:
            path = history.file_path(r["path"])
            same = path is not None and r["repository_id"] is not None and r["repository_id"] == k["repository_id"] and path == history.file_path(k["path"])
            same |= low(r["git_blob_sha"]) is not None and low(r["git_blob_sha"]) == low(k["git_blob_sha"])
            text = r["content_text"]
            if text is not None:
                same |= k.get("old", False) and low(k["content_sha256"]) == hashlib.sha256(text.encode()).hexdigest()
                same |= k["content_text"] is not None and degree(text, k["content_text"]) >= 0.8
            if same:
                hits.append(k["record_id"])
        if hits:
            out |= {(h, r["record_id"]) for h in hits}
        else:
            kept.append(r)
    return out


def test_history_against_brute_force(spark):
    rng = random.Random(6)
    texts = corpus(160, 12)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    blob = lambda: rng.choice([None, "  ", "ab" * 20, "AB" * 20 + " ", f"{rng.randrange(60):040d}", f"{rng.randrange(60):040d}"])
    path = lambda: rng.choice(["", "./", "/"]) + f"s/{rng.randrange(60)}/SKILL.md"
    old = []
    for i in range(60):
        t = texts[i] if rng.random() < 0.8 else None
        said = rng.choice([None, sha(texts[i]), sha(texts[i]).upper()])
        old.append({"record_id": i, "repository_id": rng.choice([1, 2, None]), "path": path(), "git_blob_sha": blob(), "content_sha256": said, "content_text": t, "accepted_at": datetime(2025, 1, 1)})
    new = []
    for i in range(60, 160):
        t = rng.choice([texts[i], texts[i], texts[i - 60], None, "", "..."])
        new.append({"record_id": i, "batch_id": (i - 60) // 30, "repository_id": rng.choice([1, 2, None]), "path": path(), "git_blob_sha": blob(), "content_text": t, "arrived_at": datetime(2025, 2, 1)})
    new += [dict(r, arrived_at=datetime(2025, 3, 1)) for r in new[:15]]
    o = spark.createDataFrame(old, "record_id long, repository_id long, path string, git_blob_sha string, content_sha256 string, content_text string, accepted_at timestamp")
    c = spark.createDataFrame(new, "record_id long, batch_id int, repository_id long, path string, git_blob_sha string, content_text string, arrived_at timestamp").withColumn("node", F.lit(1))
    got = list(map(tuple, history.repeated(o.unionByName(o.limit(5)), c).collect()))
    assert len(got) == len(set(got)) and set(got) == repeats_by_hand(old, new)
    assert history.repeated(o, c.where("false")).count() == 0
    alone = {tuple(r) for r in history.repeated(o.where("false"), c).collect()}
    assert alone == repeats_by_hand([], new)


def exact_pairs(ids, x, k):
    n = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    s = np.round(n @ n.T, 6)
    out = set()
    for i in range(len(ids)):
        best = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in best}
    return out


def test_similar_recall_copies_and_dirt(spark, monkeypatch):
    monkeypatch.setattr(similar, "SHARD", 150)
    rng = np.random.default_rng(9)
    centre = rng.standard_normal((30, 16))
    x = (centre[rng.integers(0, 30, 600)] + 0.4 * rng.standard_normal((600, 16))).astype("float32")
    x[100:300] = x[7]  # a third of all rows are copies of one vector
    ids = list(range(600))
    rows = [(i, [float(v) for v in x[i]], "c") for i in ids]
    dirt = [(1000, None, "c"), (1001, [0.0] * 16, "c"), (1002, [float("nan")] * 16, "c"), (1003, [float("inf")] + [1.0] * 15, "c"), (1004, [1.0], "c"), (None, rows[0][1], "c")]
    df = spark.createDataFrame(rows + dirt + rows[:50], "vec_id long, embedding array<float>, key string")
    pairs = [tuple(r) for r in similar.similar_pairs(df, "vec_id", "embedding", 16, 10).collect()]
    want = exact_pairs(ids, x, 10)
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
    assert len(want & set(pairs)) / len(want) >= 0.95
    copies = {(a, b) for a, b in want if a in range(100, 300) or b in range(100, 300)}
    assert len(copies & set(pairs)) / len(copies) >= 0.99


def test_similar_with_more_rows_than_shards_hold(spark, monkeypatch):
    """Shards of four times their size and more are cut by planes, popular ones are copied; most neighbours are still found."""
    monkeypatch.setattr(similar, "SHARD", 40)
    monkeypatch.setattr(similar, "MOST_SHARDS", 2)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((40, 16))
    x = (centre[rng.integers(0, 40, 1_200)] + 0.25 * rng.standard_normal((1_200, 16))).astype("float32")
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(1_200)], "vec_id long, embedding array<float>")
    pairs = [tuple(r) for r in similar.similar_pairs(df, "vec_id", "embedding", 16, 10).collect()]
    want = exact_pairs(list(range(1_200)), x, 10)
    assert len(pairs) == len(set(pairs)) and len(want & set(pairs)) / len(want) >= 0.9


def test_similar_small(spark):
    schema = "vec_id long, embedding array<float>"
    assert similar.similar_pairs(spark.createDataFrame([], schema), "vec_id", "embedding", 2).count() == 0
    assert similar.similar_pairs(spark.createDataFrame([(1, [1.0, 0.0])], schema), "vec_id", "embedding", 2).count() == 0
    two = spark.createDataFrame([(5, [1.0, 0.0]), (3, [2.0, 0.0]), (9, [0.0, 1.0])], schema)
    assert sorted(map(tuple, similar.similar_pairs(two, "vec_id", "embedding", 2, 1).collect())) == [(3, 5), (3, 9)]


@pytest.mark.parametrize("growth", [4, 1])
def test_batches_added_one_by_one(spark, tmp_path, monkeypatch, growth):
    """Whatever step makes the weights anew, and if a step has to be run again, the rows are those of brute force."""
    monkeypatch.setattr(history.History, "REWEIGH", growth)
    monkeypatch.setattr(near, "TILE", 6)
    rng = random.Random(3)
    texts = corpus(90, 21)
    names = ["record_id", "repository_id", "path", "git_blob_sha", "content_sha256", "content_text", "accepted_at"]
    old = [(i, 1, f"s/{i % 20}/SKILL.md", f"{i % 23:040d}", None, texts[i], datetime(2025, 1, 1)) for i in range(30)]
    o = spark.createDataFrame(old, "record_id long, repository_id long, path string, git_blob_sha string, content_sha256 string, content_text string, accepted_at timestamp")
    fields = ["record_id", "batch_id", "repository_id", "path", "git_blob_sha", "content_text", "arrived_at"]
    rows = [(i, (i - 30) // 20, rng.choice([1, 2, 3]), f"s/{rng.randrange(90)}/SKILL.md", f"{rng.randrange(200):040d}", rng.choice([texts[i], texts[i - 30]]), datetime(2025, 2, 1)) for i in range(30, 90)]
    c = spark.createDataFrame(rows, "record_id long, batch_id int, repository_id long, path string, git_blob_sha string, content_text string, arrived_at timestamp")
    kept = history.History(spark, "file://" + str(tmp_path / "h"))
    with pytest.raises(ValueError):
        kept.add(c)
    kept.start(o)
    parts = []
    for b in range(3):
        parts += [tuple(r) for r in kept.add(c.where(F.col("batch_id") == b)).collect()]
        if b == 1:  # a step that broke off before its commit leaves files that the next run replaces
            (tmp_path / "h" / "000003" / "nodes").mkdir(parents=True)
            (tmp_path / "h" / "000003" / "nodes" / "broken.parquet").write_bytes(b"no")
    want = repeats_by_hand([dict(zip(names, r, strict=True)) for r in old], [dict(zip(fields, r, strict=True)) for r in rows])
    assert len(parts) == len(set(parts)) and set(parts) == want and want


def test_crowded_bucket_of_texts_alike(spark):
    """A third of all rows are small edits of one text: leaders connect them, few pairs are left to compare."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(300)}" for _ in range(60)]
    alike = [" ".join(f"e{i}x{j}" if j in at else w for j, w in enumerate(base)) for i in range(120) for at in [set(rng.sample(range(60), 3))]]
    texts = alike + corpus(120, 30)
    df = spark.createDataFrame(list(enumerate(texts)), "skill_id long, body_text string")
    got = set(map(tuple, near.pairs_within(near.linked_groups(df, "skill_id", "body_text", 20, planes.Bits, 16)).collect()))
    assert got == groups_by_hand(texts)
