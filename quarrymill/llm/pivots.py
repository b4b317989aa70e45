"""Distances to fixed pivots, and what the triangle inequality leaves.

The metric is the number of elements that are in one of two sets only. The pivots are fixed and know nothing of the
data, so a table of distances is only ever appended to: the empty set, and one set for each class of elements that holds
every element of its class. A set's distance to the empty set is its size n; its distance to the (large) pivot of a class
is a constant plus n minus twice the number of its elements in the class. The table stores these numbers of elements. By
the triangle inequality two sets are at least as far apart as their distances to any pivot differ - and, as the classes
are disjoint, to all pivots together: the sum of the differences in the classes.

A set of n elements has distances to at least n / 2 pivots (a power of two), so long sets are told apart as well as short
ones: sums of random differences grow with the square root of n times the number of pivots, the radius grows with n. The
classes of a smaller number of pivots are unions of those of a larger one, so two sets are compared at the smaller.

The distance to the empty set also parts the table into ranges (`cell`): all sets within reach of a set are in two of them.
"""

from __future__ import annotations

import numpy as np

from quarrymill.llm.words import DEGREE, LONGEST, Sets, mix

FEWEST = 64


def classes_for(n: int) -> int:
    """How many pivots a set of n elements is measured against."""
    c = FEWEST
    while 2 * c < n:
        c *= 2
    return c


def cell(n: np.ndarray) -> np.ndarray:
    """The range of sizes that a set is stored in; ranges are as wide as the reach of a set in both directions."""
    return np.floor(np.log(np.maximum(n, 1e-9)) / (2 * np.log(LONGEST)) + 1e-9).astype(np.int64)


def reach(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two ranges (which may be the same) that hold every partner of a set."""
    return cell(n / LONGEST * (1 - 1e-9)), cell(n * LONGEST * (1 + 1e-9))


def distances(sets: Sets) -> list[bytes]:
    """For each set, how many of its elements each class has (up to 255; beyond, the bound stays a lower bound)."""
    h = mix(sets.flat.astype(np.uint64), 5151)
    out = []
    for i, n in enumerate(sets.n.tolist()):
        c = classes_for(n)
        counts = np.bincount((h[sets.start[i] : sets.start[i + 1]] & np.uint64(c - 1)).astype(np.int64), minlength=c)
        out.append(counts.clip(max=255).astype(np.uint8).tobytes())
    return out


def fold(table: np.ndarray, size: int) -> np.ndarray:
    """Distances to a smaller number of pivots. Sums of bounded counts differ no more than the counts do."""
    table = table.astype(np.int32)
    while table.shape[1] > size:
        half = table.shape[1] // 2
        table = table[:, :half] + table[:, half:]
    return table


def pairs_of(run: np.ndarray, n: np.ndarray, table: np.ndarray, wide: np.ndarray, asked: np.ndarray, degree: float = DEGREE) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): rows of the same run that the pivots do not keep apart, i being asked for.

    Rows of a run are adjacent and ordered by n. A row's partners are a range, those whose distance to the empty set is
    within reach. Pairs of two rows asked for come once; rows marked `wide` were folded and meet the others only.
    """
    rows = len(n)
    counts = table.astype(np.int32)
    start, end = np.searchsorted(run, run, side="left"), np.searchsorted(run, run, side="right")
    # in a run the wide rows come last, as they are longer
    narrow_end = start + np.bincount(run, weights=~wide, minlength=int(run[-1]) + 1 if rows else 0).astype(np.int64)[run]
    share = 1 - degree
    span = int(n.max()) + 1
    key = run * span + n
    low = np.maximum(start, np.searchsorted(key, run * span + np.ceil(n / LONGEST - 1e-9).astype(np.int64), side="left"))
    high = np.minimum(end, np.searchsorted(key, run * span + np.floor(n * LONGEST + 1e-9).astype(np.int64).clip(max=span - 1), side="right"))
    high = np.where(wide, np.minimum(high, narrow_end), high)
    many = np.where(asked, np.maximum(0, high - low), 0)
    out_i, out_j = [], []
    bound = np.cumsum(many)
    pivots = counts.shape[1]
    at = 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(bound, (bound[at - 1] if at else 0) + 100_000, side="right")))
        m = many[at:to]
        i = np.repeat(np.arange(at, to), m)
        if len(i):
            j = low[i] + (np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m))
            ok = (j != i) & (~asked[j] | (j > i))
            i, j = i[ok], j[ok]
            most = share * (n[i] + n[j]) + 1e-9
            far = np.zeros(len(i))
            # a quarter of the pivots at a time: most pairs end with the first
            for p in range(0, pivots, max(1, pivots // 4)):
                part = slice(p, p + max(1, pivots // 4))
                far = far + np.abs(counts[i, part] - counts[j, part]).sum(1)
                ok = far <= most
                i, j, most, far = i[ok], j[ok], most[ok], far[ok]
            out_i.append(i)
            out_j.append(j)
        at = to
    if not out_i:
        none = np.zeros(0, np.int64)
        return none, none
    return np.concatenate(out_i), np.concatenate(out_j)


class Pivots:
    """Distances to pivots, pruned by the triangle inequality."""

    sketch, fold, pairs_of = staticmethod(distances), staticmethod(fold), staticmethod(pairs_of)
