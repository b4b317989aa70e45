"""Bit-sliced comparison of sketches.

Every element of a set flips one bit of a sketch, which is the parity. An element that is in one set only flips at most
one bit between the two sketches, so their Hamming distance is never more than the number of elements that are in one set
only - and that is at most 0.2 (a + b) for a shared-word degree of 0.8. A sketch has at least 1.5 bits an element, always
a power of two, so that long sets are kept apart as well as short ones; sketches of two widths are compared at the
narrower one, to which the wider folds by exclusive or.

Rows are laid out in blocks of 64; the bit planes of a block are words, one for each bit, so one operation compares a row
with 64 others. Carry-save adders count the differing planes of many (row, block) pairs at once; pairs whose 64 lanes all
exceed the radius are abandoned as soon as they do.
"""

from __future__ import annotations

import numpy as np

from quarrymill.llm.words import DEGREE, LONGEST, Sets, mix

NARROWEST = 128
BITS_PER_ELEMENT = 1.5


def width(n: int) -> int:
    """Bits of the sketch of n elements."""
    w = NARROWEST
    while w < BITS_PER_ELEMENT * n:
        w *= 2
    return w


def sketch(sets: Sets) -> list[bytes]:
    h = mix(sets.flat.astype(np.uint64), 4242)
    out = []
    for i, n in enumerate(sets.n.tolist()):
        w = width(n)
        bits = np.bincount((h[sets.start[i] : sets.start[i + 1]] & np.uint64(w - 1)).astype(np.int64), minlength=w)
        out.append(np.packbits((bits & 1).astype(np.uint8)).tobytes())
    return out


def fold(sketches: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows of bytes) at a narrower size: bit k of the narrow one is the parity of the bits k modulo its width."""
    while sketches.shape[1] > size:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _planes(sketches: np.ndarray) -> np.ndarray:
    """(bits, blocks) words; lane k of a block is row 64 * block + k."""
    n, bits = len(sketches), sketches.shape[1] * 8
    blocks = -(-n // 64)
    flat = np.zeros((blocks * 64, bits), dtype=np.uint8)
    flat[:n] = np.unpackbits(sketches, axis=1)
    packed = np.packbits(flat.reshape(blocks, 64, bits).transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64).reshape(bits, blocks)


def _add(counter: list[np.ndarray], at: int, x: np.ndarray) -> None:
    """Adds a word of weight 2 ** at in every lane."""
    for k in range(at, len(counter)):
        carry = counter[k] & x
        counter[k] = counter[k] ^ x
        x = carry


def _csa(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum, carry) of three words of equal weight."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _exceeds(counter: list[np.ndarray], radius: np.ndarray) -> np.ndarray:
    """Lanes whose count is more than the radius of their row."""
    more = np.zeros_like(counter[0])
    equal = ~more
    for k in range(len(counter) - 1, -1, -1):
        want = (np.uint64(0) - ((radius >> k) & 1).astype(np.uint64)).astype(np.uint64)
        more |= equal & counter[k] & ~want
        equal &= ~(counter[k] ^ want)
    return more


def pairs_of(run: np.ndarray, n: np.ndarray, sketches: np.ndarray, wide: np.ndarray, asked: np.ndarray, degree: float = DEGREE) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j: rows of the same run whose sketches allow the degree.

    Rows of a run are adjacent and ordered by n. Sketches have one width; rows marked `wide` were folded to it and are
    partners only. Of every pair one row is asked for.
    """
    rows, bits = len(n), sketches.shape[1] * 8
    planes = _planes(sketches)
    row_bits = np.unpackbits(sketches, axis=1)
    counters = bits.bit_length()
    end = np.searchsorted(run, run, side="right")
    # no partner is longer than LONGEST * n
    span = int(n.max()) + 1
    end = np.minimum(end, np.searchsorted(run * span + n, run * span + np.floor(n * LONGEST + 1e-9).astype(np.int64).clip(max=span - 1), side="right"))
    first = (np.arange(rows) + 1) // 64
    many = np.where((end > np.arange(rows) + 1) & ~wide, (end - 1) // 64 - first + 1, 0)
    share = 1 - degree
    radius_of = np.floor(share * (n + n * LONGEST) + 1e-9).astype(np.int64).clip(max=(1 << counters) - 1)
    out_i, out_j = [], []
    bound = np.cumsum(many)
    low = 0
    while low < rows:
        high = max(low + 1, int(np.searchsorted(bound, (bound[low - 1] if low else 0) + 60_000, side="right")))
        m = many[low:high]
        q = np.repeat(np.arange(low, high), m)
        if len(q):
            b = first[q] + (np.arange(len(q)) - np.repeat(np.cumsum(m) - m, m))
            i, j = _search(q, b, planes, row_bits, radius_of, end, counters)
            # the radius of the very pair
            apart = np.bitwise_count(sketches[i] ^ sketches[j]).sum(1)
            ok = (apart <= share * (n[i] + n[j]) + 1e-9) & (asked[i] | asked[j])
            out_i.append(i[ok])
            out_j.append(j[ok])
        low = high
    if not out_i:
        none = np.zeros(0, np.int64)
        return none, none
    return np.concatenate(out_i), np.concatenate(out_j)


def _search(q: np.ndarray, b: np.ndarray, planes: np.ndarray, row_bits: np.ndarray, radius_of: np.ndarray, end: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray]:
    # lanes that are rows after q in its run
    lane = np.arange(64)
    at = b[:, None] * 64 + lane
    bits = ((at > q[:, None]) & (at < end[q][:, None])).astype(np.uint8)
    wanted = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    counter = [np.zeros(len(q), dtype=np.uint64) for _ in range(counters)]
    step = max(64, len(planes) // 8)
    for p in range(0, len(planes), 8):
        x = [planes[p + k][b] ^ (np.uint64(0) - row_bits[q, p + k].astype(np.uint64)) for k in range(8)]
        counter[0], t1 = _csa(counter[0], x[0], x[1])
        counter[0], t2 = _csa(counter[0], x[2], x[3])
        counter[1], f1 = _csa(counter[1], t1, t2)
        counter[0], t1 = _csa(counter[0], x[4], x[5])
        counter[0], t2 = _csa(counter[0], x[6], x[7])
        counter[1], f2 = _csa(counter[1], t1, t2)
        counter[2], eight = _csa(counter[2], f1, f2)
        _add(counter, 3, eight)
        if (p + 8) % step == 0:
            left = wanted & ~_exceeds(counter, radius_of[q])
            alive = left != 0
            if not alive.all():
                q, b, wanted = q[alive], b[alive], left[alive]
                counter = [c[alive] for c in counter]
            else:
                wanted = left
            if not len(q):
                break
    if not len(q):
        none = np.zeros(0, np.int64)
        return none, none
    hits = np.unpackbits(wanted.view(np.uint8).reshape(len(q), 8), axis=1, bitorder="little")
    r, k = np.nonzero(hits)
    return q[r], b[r] * 64 + k


class Bits:
    """Parity sketches, compared bit-sliced."""

    sketch, fold, pairs_of = staticmethod(sketch), staticmethod(fold), staticmethod(pairs_of)
