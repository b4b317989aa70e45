"""Items of varying length into containers of fixed capacity, by non-negative least squares over a histogram.

The lengths are counted; the histogram has at most `capacity` entries whatever the number of items, so it may go to the
driver. There, shallow combinations of lengths that fill a container up to a small window are enumerated; non-negative
least squares finds how often to repeat each so that the histogram is met; the counts are rounded down; what remains is
packed greedily (best fit, longest first), still as counts of equal lengths. The plan names, for each length, ranges of
ranks and the containers they go to; every item finds its place by its rank among the items of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.runtime import Stage

#: Items of one length that are ranked together; a length of more items is split into as many parts as it takes.
RANKED = 250_000
#: Unused places a combination may leave.
WINDOW = 2
STEPS = 120


def combinations(hist: np.ndarray, capacity: int, window: int = WINDOW) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c >= 0, of present lengths with capacity - window <= a + b + c <= capacity; 0 is no item.

    Among the sums in the window only the fullest is taken for a pair, so there are at most capacity**2 / 4 rows.
    """
    present = np.nonzero(hist)[0]
    present = present[present > 0]
    fits = np.full(capacity + 1, -1, dtype=np.int64)  # the largest present length within the window below each gap
    has = np.zeros(capacity + 1, dtype=bool)
    has[present] = True
    has[0] = True
    for gap in range(capacity + 1):
        for length in range(gap, max(-1, gap - window - 1), -1):
            if has[length]:
                fits[gap] = length
                break
    found = []
    for a in present[present * 3 >= capacity - window]:
        b = np.concatenate([[0], present[present <= min(a, capacity - a)]])
        c = fits[capacity - a - b]
        ok = (c >= 0) & (c <= b)
        found.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)


def solve(combos: np.ndarray, hist: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 with A x close to hist in the least squares sense, by multiplicative updates from a positive start."""
    if not len(combos):
        return np.zeros(0)
    size = len(hist)
    real = combos > 0
    target = hist.astype(float)
    gather = lambda v: (np.where(real, v[combos], 0.0)).sum(1)
    spread = lambda x: np.bincount(combos[real], weights=np.repeat(x, real.sum(1)), minlength=size)
    goal = gather(target)
    x = goal / np.maximum(gather(spread(np.ones(len(combos)))), 1e-12)
    for _ in range(steps):
        x *= goal / np.maximum(gather(spread(x)), 1e-12)
    return x


def plan(hist: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """[(contents, times)]: contents is [(length, how many)]; together they use up hist exactly."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[list[tuple[int, int]], int]] = []
    combos = combinations(left, capacity)
    x = solve(combos, left)
    for k in np.argsort(-x, kind="stable"):
        if x[k] < 1:
            break
        lengths, each = np.unique(combos[k][combos[k] > 0], return_counts=True)
        times = min(int(x[k]), *(int(left[v]) // int(e) for v, e in zip(lengths, each, strict=True)))
        if times > 0:
            for v, e in zip(lengths, each, strict=True):
                left[v] -= times * int(e)
            out.append(([(int(v), int(e)) for v, e in zip(lengths, each, strict=True)], times))
    # best fit, longest first; containers alike are one entry with a count
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    spaces: set[int] = set()

    def put(space: int, contents: list[tuple[int, int]], times: int) -> None:
        if space == 0:
            out.append((contents, times))
        else:
            open_.setdefault(space, []).append((contents, times))
            spaces.add(space)

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            space = min((s for s in spaces if s >= length), default=None)
            if space is None:
                each = capacity // length
                if full := n // each:
                    put(capacity - each * length, [(length, each)], full)
                if rest := n % each:
                    put(capacity - rest * length, [(length, rest)], 1)
                break
            contents, times = open_[space].pop()
            if not open_[space]:
                del open_[space]
                spaces.discard(space)
            each = min(space // length, n)
            used = min(times, n // each)
            if used < times:
                put(space, contents, times - used)
            put(space - each * length, [*contents, (length, each)], used)
            n -= used * each
    for entries in open_.values():
        out.extend(entries)
    return out


def slots(packed: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """Rows (length, from rank, how many a container, first container, start in it), sorted by length and rank."""
    used: dict[int, int] = {}
    rows = []
    container = 1
    for contents, times in packed:
        start = 0
        for length, each in contents:
            rows.append((length, used.get(length, 0), each, container, start))
            used[length] = used.get(length, 0) + each * times
            start += length * each
        container += times
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {"key": (a[:, 0] << 44) | a[:, 1], "each": a[:, 2], "container": a[:, 3], "start": a[:, 4]}


def pack(df: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece, size, container, start) of every row of df.

    key: unique and not null; size: null, 0 or less takes no space: one row with size 0 and null container. A size over
    capacity is cut into pieces of capacity and a rest, numbered from 0; nothing else is cut. Ties are taken in the
    order of key. An empty df gives no rows. Other columns of df play no part.
    """
    spark = df.sparkSession
    stage = Stage(spark, "packing")
    sized = stage.write(df.select(F.col(key).alias("k"), F.coalesce(F.greatest(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("n")), "sizes")
    pieces = sized.select(
        "k",
        F.posexplode(
            F.when(F.col("n") <= capacity, F.array("n")).otherwise(
                F.concat(
                    F.array_repeat(F.lit(capacity).cast("long"), (F.col("n") / capacity).cast("int")),
                    F.when(F.col("n") % capacity > 0, F.array(F.col("n") % capacity)).otherwise(F.array().cast("array<bigint>")),
                )
            )
        ).alias("piece", "n"),
    )
    space = pieces.where("n > 0")
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for row in space.groupBy("n").count().collect():  # at most `capacity` rows
        hist[row.n] = row["count"]
    parts = F.lit((hist // RANKED + 1).tolist())
    space = space.withColumn("part", F.pmod(F.xxhash64("k", "piece"), F.element_at(parts, F.col("n").cast("int") + 1)))
    counted = space.groupBy("n", "part").count()
    before = Window.partitionBy("n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("n", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    where = slots(plan(hist, capacity))
    # joined by the keys that the ranking is partitioned by anyway
    ranked = space.join(offsets, ["n", "part"]).select(
        "k", "piece", "n", (F.col("base") + F.row_number().over(Window.partitionBy("n", "part").orderBy("k", "piece")) - 1).alias("rank")
    )
    kind = df.schema[key].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            at = np.searchsorted(where["key"], (n << 44) | rank, side="right") - 1
            since = rank - (where["key"][at] & ((1 << 44) - 1))
            each = where["each"][at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(where["container"][at] + since // each), pa.array(where["start"][at] + since % each * n)],
                names=["k", "piece", "n", "container", "start"],
            )

    placed = ranked.mapInArrow(place, f"k {kind}, piece int, n long, container long, start long")
    none = pieces.where("n = 0").select("k", "piece", "n", F.lit(None).cast("long").alias("container"), F.lit(None).cast("long").alias("start"))
    return placed.unionByName(none).toDF(key, "piece", size, "container", "start")
