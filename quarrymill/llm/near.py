"""Near-duplicate links between texts by shared-word degree, and the groups they form.

Texts with equal words are one class from the start; a class has one node, so a group of copies of any size costs one
row. Classes meet in buckets of weighted min-hash bands (`BANDS` bands of `ROWS`). The weights come from how many texts
hold a word; only words held by at least one text in `RARE` are listed, so that list has at most RARE times the mean
number of words entries whatever the number of texts, and all others weigh alike.

Of a text two things are kept: its band keys, and a sketch as wide as the text is long (see planes.py, pivots.py). Keys
are counted with partial aggregation, and only rows of buckets with two rows or more go on and get their sketches, so
neither a window nor a sketch is spent on the others. A bucket of more than `TILE` rows is compared in tiles, block by block, in different tasks. Where only
groups are asked for, the rows of such a bucket are first held against a few leaders: rows alike to the same leader are
connected by that and are not compared with each other, so a huge group of texts alike costs no more than its rows.

Inside a bucket a lossless bound drops what is too far apart, and what is left is verified with the full texts; nothing
is capped or sampled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.words import DEGREE, Elements, Weights, alike, band_keys
from quarrymill.runtime import Stage

BANDS, ROWS = 36, 4
RARE = 500
TILE = 1_024
#: Leaders of a crowded bucket, and parts that its rows are spread over when they meet its count.
LEADERS, SALTS = 4, 8
#: Rows that are cut into words at a time.
CUT = 2_000


def bags(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(id, bag, text) of every text of at least `least` words; equal bags are equal words."""
    kind = df.schema[key].dataType.simpleString()

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        elements = Elements()
        for whole in batches:
            for low in range(0, whole.num_rows, CUT):
                batch = whole.slice(low, CUT)
                sets = elements.sets(batch.column(1).to_pylist())
                rows = np.nonzero(sets.n >= max(1, least))[0]
                digests = [hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest() for i in rows]
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(digests, pa.binary()), batch.column(1).take(take)], names=["id", "bag", "text"])

    return df.select(df[key].alias("id"), df[text].alias("text")).where("id IS NOT NULL AND text IS NOT NULL").mapInArrow(bag, f"id {kind}, bag binary, text string")


def classes(df: DataFrame, key: str, text: str, least: int, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """(members, nodes): members (id, node) of every text of at least `least` words; nodes (node, text, bag), one for each class.

    A node is the smallest id of its class.
    """
    cut = stage.write(bags(df, key, text, least), "bags")
    nodes = stage.write(cut.groupBy("bag").agg(F.min("id").alias("node"), F.min_by("text", "id").alias("text")), "nodes")
    members = stage.write(cut.select("id", "bag").distinct().join(nodes.select("bag", "node"), "bag").select("id", "node"), "members")
    stage.drop(cut)
    return members, nodes.select("node", "text", "bag")


def word_weights(nodes: DataFrame) -> Weights:
    """Weights of the elements that at least one text in RARE holds: the root of the logarithm of how rare they are, so that rare edits do not outweigh a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        elements, parts, texts, size = Elements(), [], 0, 0

        def out() -> pa.RecordBatch:
            e, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.append(e, -1)), pa.array(np.append(n, texts).astype(np.int64))], names=["e", "n"])

        for whole in batches:
            for low in range(0, whole.num_rows, CUT):
                sets = elements.sets(whole.slice(low, CUT).column(0).to_pylist())
                parts.append(sets.flat)
                texts += len(sets)
                size += len(sets.flat)
                if size > 4_000_000:
                    yield out()
                    parts, texts, size = [], 0, 0
        yield out()

    counted = nodes.select("text").mapInArrow(count, "e bigint, n bigint").groupBy("e").agg(F.sum("n").alias("n"))
    total = counted.where("e = -1").select(F.col("n").alias("total"))
    listed = counted.where("e >= 0").crossJoin(F.broadcast(total)).where(F.col("n") * RARE >= F.col("total")).where("n > 1")  # the other side is one row
    rows = listed.select("e", F.sqrt(F.greatest(F.log(F.col("total") / F.col("n")), F.lit(0.05))).alias("w")).toArrow()
    return Weights(rows.column("e").to_numpy(), rows.column("w").to_numpy())


def marks(nodes: DataFrame, weights: Weights, bound: Any) -> DataFrame:
    """(node, n, sketch, keys) of every node: its size, its sketch, its band keys."""
    kind = nodes.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        elements = Elements()
        for batch in batches:
            for low in range(0, batch.num_rows, CUT):
                part = batch.slice(low, CUT)
                sets = elements.sets(part.column(1).to_pylist())
                keys = band_keys(sets, weights, BANDS, ROWS)
                offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sets.n.astype(np.int32)), pa.array(bound.sketch(sets), pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))],
                    names=["node", "n", "sketch", "keys"],
                )

    return nodes.select("node", "text").mapInArrow(run, f"node {kind}, n int, sketch binary, keys array<bigint>")


def slim(marked: DataFrame) -> DataFrame:
    """(band, node) for each band key: what buckets are counted by."""
    return marked.select("node", F.explode("keys").alias("band"))


def shared(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with `c`, how many rows have their bucket, of the buckets with two rows or more.

    Rows are a few bytes each. The counts are made with partial aggregation; a bucket that holds much of all rows is a
    skewed side of an inner join, whose partitions adaptive execution splits.
    """
    return rows.join(rows.groupBy(*by).agg(F.count("*").alias("c")).where("c > 1"), by)


def tiled(rows: DataFrame, tile: int) -> DataFrame:
    """rows of crowded buckets (with c), once for each tile they are in; a tile is a pair of blocks of a bucket."""
    m = F.ceil(F.col("c") / tile).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(1)), m).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), m - 1), lambda j: _tile(mine, j))
    return rows.withColumn("block", mine).withColumn("tile", F.explode(tiles))


def _tile(i, j):
    return F.least(i, j).cast("long") * (1 << 31) + F.greatest(i, j) + 1


def compared(rows: DataFrame, by: list[str], bound: Any) -> DataFrame:
    """(a, b), a < b: pairs of nodes within the bound in a tile of a bucket. rows: by, tile, block, node, n, sketch, new; at least one of a pair is new.

    Rows of one block meet in their own tile only.
    """
    kind = rows.schema["node"].dataType.simpleString()
    keys = [*by, "tile"]
    # with a number, as tiles cost far more than their bytes and must not be put together in one task
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.select(*keys, "block", "node", "n", "sketch", "new").repartition(parts, *keys).sortWithinPartitions(*keys, "n")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 4 * TILE:
                continue
            differs = np.zeros(held.num_rows, dtype=bool)
            for k in keys:
                v = held.column(k).to_numpy()
                differs |= v != v[-1]
            last = int(np.nonzero(differs)[0][-1]) + 1 if differs.any() else 0
            if last:
                yield from pairs(held.slice(0, last))
                held = held.slice(last)
        if held is not None:
            yield from pairs(held)

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        change = np.zeros(t.num_rows, dtype=bool)
        change[:1] = True
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        run = np.cumsum(change) - 1
        new = t.column("new").to_numpy(zero_copy_only=False)
        some = (np.bincount(run)[run] > 1) & (np.bincount(run, weights=new)[run] > 0)
        if not some.any():
            return
        t = t.filter(pa.array(some)).combine_chunks()
        run, new = np.unique(run[some], return_inverse=True)[1], new[some]
        n = t.column("n").to_numpy().astype(np.int64)
        tile, block = t.column("tile").to_numpy(), t.column("block").to_numpy()
        node = t.column("node").to_numpy(zero_copy_only=False)
        low, high = (tile - 1) >> 31, (tile - 1) & ((1 << 31) - 1)
        raw = t.column("sketch").to_pylist()
        sizes = np.array([len(x) for x in raw])
        for size in np.unique(sizes):
            mine = sizes == size
            # rows of the next width are folded, where there is a row for them to meet
            held_in = np.bincount(run[mine], minlength=int(run[-1]) + 1)[run] > 0
            at = np.nonzero(mine | (sizes == 2 * size) & held_in)[0]
            if len(at) < 2:
                continue
            wide = sizes[at] > size
            table = None
            for part, s in ((~wide, size), (wide, 2 * size)):
                if part.any():
                    folded = bound.fold(np.frombuffer(b"".join([raw[r] for r in at[part]]), dtype=np.uint8).reshape(-1, s), int(size))
                    table = np.zeros((len(at), size), dtype=folded.dtype) if table is None else table
                    table[part] = folded
            i, j = bound.pairs_of(np.unique(run[at], return_inverse=True)[1], n[at], table, wide, new[at])
            i, j = at[i], at[j]
            ok = (tile[i] == 0) | (low[i] == high[i]) | (block[i] != block[j])
            a, b = node[i[ok]], node[j[ok]]
            ok = a != b
            a, b = a[ok], b[ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.where(a < b, a, b)), pa.array(np.where(a < b, b, a))], names=["a", "b"])

    return placed.mapInArrow(compare, f"a {kind}, b {kind}").distinct()


def verified(pairs: DataFrame, nodes: DataFrame, degree: float = DEGREE) -> DataFrame:
    """The pairs whose texts have the degree."""
    kind = nodes.schema["node"].dataType.simpleString()
    texts = nodes.select("node", "text")
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        elements = Elements()
        for whole in batches:
            for low in range(0, whole.num_rows, CUT):
                batch = whole.slice(low, CUT)
                # a text of many pairs is cut once
                place: dict[str, int] = {}
                x, y = ([place.setdefault(t, len(place)) for t in batch.column(c).to_pylist()] for c in (2, 3))
                sets = elements.sets(list(place))
                ok = [alike(sets[i], sets[j], degree) for i, j in zip(x, y, strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(check, f"a {kind}, b {kind}")


def with_sketches(rows: DataFrame, marked: DataFrame) -> DataFrame:
    return rows.join(marked.select("node", "n", "sketch"), "node")


def links(marked: DataFrame, nodes: DataFrame, bound: Any, stage: Stage, tile: int = TILE) -> DataFrame:
    """(a, b) verified links between nodes, enough of them to connect all that is connected by links.

    In buckets of up to `tile` rows all links are found; in crowded ones, links between rows alike to the same leader are left out.
    """
    rows = stage.write(shared(slim(marked), ["band"]), "shared")
    usual = with_sketches(rows.where(F.col("c") <= tile), marked).withColumn("tile", F.lit(0).cast("long")).withColumn("block", F.lit(0)).withColumn("new", F.lit(True))
    found = verified(compared(usual, ["band"], bound), nodes)
    crowded = rows.where(F.col("c") > tile)
    if crowded.isEmpty():
        return found
    # leaders: the least hash of each of LEADERS parts of a bucket, found with partial aggregation
    part = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(LEADERS))
    leaders = crowded.groupBy("band", part.alias("p"), "c").agg(F.min(F.struct(F.xxhash64("node", F.lit(3)).alias("h"), "node")).alias("m")).select("band", F.col("m.node").alias("leader"), "c")
    spread = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("c") / tile).cast("int") - 1))).drop("c")
    salted = crowded.withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / tile).cast("int")).cast("int"))
    led = stage.write(salted.join(spread, ["band", "salt"]).where("node <> leader").select("band", "node", "leader"), "led")
    near = stage.write(verified(led.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), nodes), "near")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = leaders.select("band", F.col("leader").alias("node"), "leader")
    labels = led.join(both.toDF("node", "leader"), ["node", "leader"]).select("band", "node", "leader").unionByName(own).groupBy("band", "node").agg(F.min("leader").alias("label"))
    labelled = stage.write(crowded.join(labels, ["band", "node"], "left"), "labelled")
    # blocks hold rows of one label; blocks of a label are numbered one after the other
    sizes = labelled.groupBy("band", "label").agg(F.ceil(F.count("*") / tile).cast("int").alias("m"))
    before = Window.partitionBy("band").orderBy(F.col("label").asc_nulls_first())  # at most LEADERS + 1 rows a band
    blocks = sizes.withColumn("base", F.sum("m").over(before).cast("int") - F.col("m")).withColumn("all", F.sum("m").over(Window.partitionBy("band")).cast("int"))
    blocks = blocks.select("band", F.col("label").alias("of"), "m", "base", "all", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = labelled.select("band", "node", "label", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"))
    numbered = salted.join(blocks, ["band", "salt"]).where(F.col("label").eqNullSafe(F.col("of"))).select("band", "node", "label", "m", "base", "all")
    mine = (F.col("base") + F.pmod(F.xxhash64("node", F.lit(1)), F.col("m"))).cast("int")
    met = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda j: F.col("label").isNull() | (j < F.col("base")) | (j >= F.col("base") + F.col("m")))
    tiles = with_sketches(numbered, marked).withColumn("block", mine).withColumn("tile", F.explode(F.transform(met, lambda j: _tile(F.col("block"), j)))).withColumn("new", F.lit(True))
    return found.unionByName(near).unionByName(verified(compared(tiles, ["band"], bound), nodes))


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """(node, root) of every node with an edge; the root is the smallest node it is connected with.

    Large-star and small-star rounds; each round is a written table, none of it goes to the driver.
    """
    now = stage.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = stage.write(small, "edges")
        same = now.count() == after.count() and after.exceptAll(now).isEmpty()
        stage.drop(now)
        now = after
        if same:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).distinct()


def linked_groups(df: DataFrame, key: str, text: str, least: int, bound: Any, tile: int = TILE) -> DataFrame:
    """(id, group) of every text of at least `least` words that is linked with another; the group is its smallest id.

    Null and empty texts take no part; rows repeated verbatim count once; an empty table gives no rows; other columns play
    no part. All that is connected by links is one group.
    """
    stage = Stage(df.sparkSession, "near")
    members, nodes = classes(df, key, text, least, stage)
    marked = stage.write(marks(nodes, word_weights(nodes), bound), "marks")
    roots = components(links(marked, nodes, bound, stage, tile), stage)
    placed = members.join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("group"))
    alone = placed.groupBy("group").agg(F.count("*").alias("c")).where("c > 1").select("group")
    return stage.write(placed, "groups").join(alone, "group", "left_semi").select("id", "group")


def pairs_within(groups: DataFrame) -> DataFrame:
    """(a, b), a < b, for each two members of a group."""
    return groups.select(F.col("id").alias("a"), "group").join(groups.select(F.col("id").alias("b"), "group"), "group").where("a < b").select("a", "b")
