"""Byte-level BPE encoding and decoding by a hierarchical-bitmap rank queue.

All pre-tokens of a batch lie one after another in a linked list with
barriers between them.  The queue has a bucket of list positions for every
merge rank and a three-level bitmap over the buckets in use; find-first-set
gives the lowest rank, and every entry of its bucket whose pair no longer has
that rank is stale and skipped.  A whole bucket is merged at once, leftmost
first where pairs overlap, which equals merging one by one unless a merge
makes a pair of a lower rank; the pre-tokens where that happens are encoded
again one merge at a time through the same queue.  Work is near-linear in the
bytes, also for pre-tokens of millions of bytes.

Edge cases: null and empty texts have no ids and decode to nothing.  Special
tokens are ordinary text.  Repeated rows are encoded alike; other columns are
not read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkEncoder, blobs, spans
from .common import extended, ship
from .hashing import column, slices

NONE = np.int64(1 << 40)


class Bitmap:
    """Which of ``64 ** 3`` ranks are in use; ``first`` is find-first-set."""

    def __init__(self) -> None:
        self.low, self.mid, self.top = [0] * 4096, [0] * 64, 0

    def set(self, i: int) -> None:
        self.low[i >> 6] |= 1 << (i & 63)
        self.mid[i >> 12] |= 1 << (i >> 6 & 63)
        self.top |= 1 << (i >> 12)

    def clear(self, i: int) -> None:
        self.low[i >> 6] &= ~(1 << (i & 63))
        if not self.low[i >> 6]:
            self.mid[i >> 12] &= ~(1 << (i >> 6 & 63))
            if not self.mid[i >> 12]:
                self.top &= ~(1 << (i >> 12))

    def first(self) -> int:
        """The lowest rank in use, -1 if none is."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        b = a << 6 | (self.mid[a] & -self.mid[a]).bit_length() - 1
        return b << 6 | (self.low[b] & -self.low[b]).bit_length() - 1


class BytePairs:
    """A vocabulary of ranks (``token bytes -> id``) and its merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if max(ranks.values()) >= 64**3:
            raise ValueError("more ranks than the bitmap holds")
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.words = [b""] * (max(ranks.values()) + 1)
        for word, i in ranks.items():
            self.words[i] = word
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        merges = {}
        for word, i in ranks.items():
            for k in range(1, len(word)):
                a, b = ranks.get(word[:k]), ranks.get(word[k:])
                if a is not None and b is not None:
                    merges[a << 20 | b] = i
        self.merges = merges
        self.keys = np.array(sorted(merges), np.int64)
        self.targets = np.array([merges[k] for k in self.keys.tolist()], np.int64)

    @classmethod
    def load(cls, path: str, pattern: str) -> BytePairs:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.targets[at], NONE)

    # one merge at a time

    def encode_one(self, word: bytes) -> list[int]:
        """Ids of one pre-token: always the leftmost pair of the lowest rank."""
        if word in self.ranks:
            return [self.ranks[word]]
        ids, n, merges = self.single[list(word)].tolist(), len(word), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [merges.get(ids[i] << 20 | ids[i + 1], -1) for i in range(n - 1)] + [-1]
        used, buckets = Bitmap(), {}

        def put(i: int) -> None:
            r = pair[i] = merges.get(ids[i] << 20 | ids[after[i]], -1) if after[i] < n else -1
            if r >= 0:
                heapq.heappush(buckets.setdefault(r, []), i)
                used.set(r)

        for i, r in enumerate(pair):
            if r >= 0:
                buckets.setdefault(r, []).append(i)  # in order, so a heap
                used.set(r)
        while (r := used.first()) >= 0:
            i = heapq.heappop(buckets[r])
            if not buckets[r]:
                del buckets[r]
                used.clear(r)
            if pair[i] != r:
                continue  # stale
            j = after[i]
            ids[i], after[i], pair[j], ids[j] = r, after[j], -1, -1
            if after[i] < n:
                before[after[i]] = i
            put(i)
            if before[i] >= 0:
                put(before[i])
        return [x for x in ids if x >= 0]

    # whole buckets at a time

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit integers."""
        known = [self.ranks.get(w) for w in words]
        todo = [w for w, k in zip(words, known, strict=True) if k is None]
        found = iter(self._queue(todo))
        return [k.to_bytes(4, "little") if k is not None else next(found) for k in known]

    def _queue(self, words: list[bytes]) -> list[bytes]:
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        n, first = len(data), np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(words)), sizes)
        ids = self.single[data]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = first[sizes > 0] + sizes[sizes > 0] - 1
        after[last], before[first[sizes > 0]] = -1, -1
        pair = np.full(n, NONE)
        inner = np.flatnonzero(after >= 0)
        pair[inner] = self.rank(ids[inner], ids[inner + 1])
        used, buckets = Bitmap(), {}

        def put(at: np.ndarray) -> None:
            at = at[pair[at] < NONE]
            if not len(at):
                return
            ranks = pair[at]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            edges = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
            for a, b, r in zip(edges, edges[1:], ranks[edges[:-1]].tolist()):
                if r in buckets:
                    buckets[r].append(at[a:b])
                else:
                    buckets[r] = [at[a:b]]
                    used.set(r)

        put(inner)
        odd: set[int] = set()
        while (r := used.first()) >= 0:
            held = buckets.pop(r)
            used.clear(r)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[pair[at] == r]  # the others are stale
            if not len(at):
                continue
            if len(at) > 1:
                follows = np.zeros(len(at), bool)
                follows[1:] = before[at[1:]] == at[:-1]
                if follows.any():  # overlapping pairs: every second of a run, from its left end
                    place = np.arange(len(at))
                    at = at[(place - np.maximum.accumulate(np.where(follows, 0, place))) % 2 == 0]
            gone = after[at]
            right = after[gone]
            ids[at], after[at] = r, right
            ids[gone], pair[gone] = -1, NONE
            has = right >= 0
            before[right[has]] = at[has]
            left = before[at]
            left = left[left >= 0]
            touched = np.unique(np.concatenate([at, left])) if len(at) > 1 else np.concatenate([left, at])
            to = after[touched]
            fresh = np.full(len(touched), NONE)
            ok = to >= 0
            fresh[ok] = self.rank(ids[touched[ok]], ids[to[ok]])
            pair[touched] = fresh
            if (low := fresh < r).any():
                odd.update(owner[touched[low]].tolist())
            put(touched)
        alive = ids >= 0
        total = np.zeros(n + 1, np.int64)
        np.cumsum(alive, out=total[1:])
        blob = ids[alive].astype("<u4").tobytes()
        ends = (total[first + sizes] * 4).tolist()
        out = [blob[a:b] for a, b in zip((total[first] * 4).tolist(), ends)]
        for k in odd:
            out[k] = np.array(self.encode_one(words[k]), "<u4").tobytes()
        return out

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks, one after another, and their numbers."""
        split = self.pattern.findall
        parts = [split(c) for c in chunks]
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = pa.array([p for own in parts for p in own], pa.string()).dictionary_encode()
        words = self.encode_words([x.encode() for x in flat.dictionary.to_pylist()])
        ids, size = np.frombuffer(b"".join(words), "<u4"), np.fromiter(map(len, words), np.int64, len(words)) // 4
        place = flat.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[place])])
        return ids[spans((np.cumsum(size) - size)[place], size[place])], np.diff(ends[np.concatenate([[0], np.cumsum(count)])])

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))


_LOADED: dict[tuple[str, str], tuple[BytePairs, ChunkEncoder]] = {}


def _loaded(path: str, pattern: str) -> tuple[BytePairs, ChunkEncoder]:
    """Once for each worker process."""
    if (path, pattern) not in _LOADED:
        pairs = BytePairs.load(path, pattern)
        _LOADED[path, pattern] = pairs, ChunkEncoder(pairs.encode_chunks)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``ids``, little-endian unsigned 32-bit integers, of whole
    texts.  ``path`` is a file of ranks that every executor has."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder = _loaded(path, pattern)
        for batch in batches:
            texts = column(batch, "text")
            for i, j in slices(texts, 4_000_000):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), blobs(*encoder.encode(texts.slice(i, j - i)))], names=["doc_id", "ids"])

    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The ``bytes`` of ``ids``; the other columns of ``encoded`` stay, but for
    one that is named ``bytes``."""
    ship(encoded.sparkSession)
    encoded = encoded.drop("bytes")
    schema = extended(encoded.schema, bytes="binary")
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, _ = _loaded(path, pattern)
        for batch in batches:
            out = [pairs.decode(np.frombuffer(x, "<u4").tolist()) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "bytes"])

    return encoded.mapInArrow(run, schema)
