"""Byte-level BPE of whole columns by a pair occurrence index.

The distinct words of a block of rows are laid out as one array of symbols. An index maps every adjacent pair that has
a rank to all of its positions in the block; the active ranks are taken in ascending order from a heap, each is applied
at all of its positions, and only the lists of the pairs beside a merge are updated. Texts then become ids by gathering
the encoded words. Words already encoded by the same Python worker are not encoded again.

Defined results: null and empty texts give an empty list; text that looks like a special token is ordinary text; rows
are never dropped, so equal rows give equal rows.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: how byte-level BPE vocabularies of this kind split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words a worker remembers at most; beyond it the memory starts anew.
REMEMBERED = 400_000
#: Characters in a block of rows that is encoded at once.
BLOCK_CHARS = 4_000_000

_LOADED: dict[str, "PairIndexEncoder"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in kept}
    moved = (b for b in range(256) if b not in set(kept))
    letters.update({chr(256 + i): b for i, b in enumerate(moved)})
    return letters


class PairIndexEncoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        letters = _byte_letters()
        self.byte_id = [0] * 256
        for letter, byte in letters.items():
            self.byte_id[byte] = vocab[letter]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.pairs = list(self.merges)
        self.split = regex.compile(SPLIT)
        self.index: dict[str, int] = {}
        self.encoded: list[list[int]] = []

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; all words are merged together, rank by rank."""
        byte_id, merges, pairs = self.byte_id, self.merges, self.pairs
        token: list[int] = []
        starts: list[int] = []
        for word in words:
            starts.append(len(token))
            token.extend([byte_id[b] for b in word.encode("utf-8")])
            token.append(-1)
        n = len(token)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        where: dict[int, list[int]] = {}
        for i in range(n - 1):
            found = merges.get((token[i], token[i + 1]))
            if found is not None:
                where.setdefault(found[0], []).append(i)
        active = list(where)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            positions = where.pop(rank)
            positions.sort()
            left, right = pairs[rank]
            merged = merges[left, right][1]
            for i in positions:
                if token[i] != left:
                    continue
                j = after[i]
                if j >= n or token[j] != right:
                    continue
                k = after[j]
                token[i], token[j] = merged, -2
                after[i] = k
                if k < n:
                    before[k] = i
                    found = merges.get((merged, token[k]))
                    if found is not None:
                        at = where.get(found[0])
                        if at is None:
                            where[found[0]] = [i]
                            heapq.heappush(active, found[0])
                        else:
                            at.append(i)
                h = before[i]
                if h >= 0:
                    found = merges.get((token[h], merged))
                    if found is not None:
                        at = where.get(found[0])
                        if at is None:
                            where[found[0]] = [h]
                            heapq.heappush(active, found[0])
                        else:
                            at.append(h)
        out = []
        for i in starts:
            ids = []
            while token[i] != -1:
                ids.append(token[i])
                i = after[i]
            out.append(ids)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts, as in an Arrow list array."""
        if len(self.index) > REMEMBERED:
            self.index, self.encoded = {}, []
        index, findall = self.index, self.split.findall
        known = len(index)
        refs: list[int] = []
        counts = np.zeros(len(texts) + 1, dtype=np.int64)
        new: list[str] = []
        for i, text in enumerate(texts):
            if text:
                found = findall(text)
                counts[i + 1] = len(found)
                for word in found:
                    at = index.get(word)
                    if at is None:
                        at = index[word] = known + len(new)
                        new.append(word)
                    refs.append(at)
        if new:
            self.encoded.extend(self.encode_words(new))
        lengths = np.fromiter(map(len, self.encoded), dtype=np.int64, count=len(self.encoded))
        firsts = np.zeros(len(lengths) + 1, dtype=np.int64)
        np.cumsum(lengths, out=firsts[1:])
        flat = np.fromiter((x for ids in self.encoded for x in ids), dtype=np.int32, count=int(firsts[-1]))
        r = np.asarray(refs, dtype=np.int64)
        size = lengths[r]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total, dtype=np.int64) + np.repeat(firsts[r] - (ends - size), size)
        ids = flat[take]
        word_ends = np.concatenate([[0], ends])
        return word_ends[np.cumsum(counts)], ids


def encoder(path: str) -> PairIndexEncoder:
    if path not in _LOADED:
        _LOADED[path] = PairIndexEncoder(path)
    return _LOADED[path]


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most BLOCK_CHARS characters; one longer text is a block of its own."""
    start = held = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if held + n > BLOCK_CHARS and i > start:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def encode_column(
    df: DataFrame, text: str, keep: tuple[str, ...], into: str = "ids", vocabulary: str | None = None, count_only: bool = False
) -> DataFrame:
    """The columns `keep` with the token ids of column `text` (or, with count_only, their number) in column `into`.

    One row for each row of df; columns of df that are not named play no part, whatever their names. `into` may carry
    the name of a column that is not kept. No shuffle: one pass over the rows.
    """
    path = vocabulary or default_vocabulary()
    fields = [df.schema[c] for c in keep]
    kind = T.IntegerType() if count_only else T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([*fields, T.StructField(into, kind, False)])
    source = df.select(*keep, df[text].alias("\u0001text"))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(os.fspath(path))
        for batch in batches:
            texts = batch.column(n).to_pylist()
            for a, b in blocks(texts):
                offsets, ids = enc.encode(texts[a:b])
                part = batch.slice(a, b - a)
                if count_only:
                    made = pa.array(np.diff(offsets).astype(np.int32))
                else:
                    made = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(n)], made], names=[*keep, into])

    return source.mapInArrow(run, schema)
