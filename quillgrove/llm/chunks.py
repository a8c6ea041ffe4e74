"""Encoding whole texts through a bounded cache of context-free chunks.

A single space between two characters that are not white space always starts
a new pre-token in the tokenizers used here, and a single line feed between
such characters is always one of its own, so a text may be cut there and its
ids are the ids of its chunks one after another.  Any other white space keeps
its neighbours in one chunk.  After a letter or digit, closing punctuation
also starts a pre-token, so a chunk's body and tail are encoded apart.

Chunks repeat much more than texts do.  A slice of texts is cut on its raw
bytes; Arrow finds the distinct chunks and looks their parts up in the cache;
only new parts reach the tokenizer; numpy gathers the ids.  No Python object
is made for a chunk that is known.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .hashing import raw

#: Characters that, after a letter or digit, always start a pre-token.
TAIL = "!#$%&()*+,-./:;<=>?@[]^_`{|}~\""


def strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Neighbouring strings in one buffer of UTF-8; ``ends`` starts with 0."""
    return pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices of all spans, one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(begin - (ends - size), size)


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut before every space and around every line feed: ``(begins of
    the pieces, first piece of each text and one more, texts with a line feed
    that has white space or nothing beside it)``."""
    feed = data == 10
    start = feed | (data == 32)
    start[1:] |= feed[:-1]
    start[offsets[:-1][offsets[:-1] < len(data)]] = True
    begin = np.flatnonzero(start)
    feeds = np.flatnonzero(feed)
    text = np.searchsorted(offsets, feeds, "right") - 1
    after = np.minimum(feeds + 1, max(len(data) - 1, 0))
    lone = (feeds == offsets[text]) | (feeds + 1 == offsets[text + 1]) | (data[after] == 10) | (data[after] == 32)
    return begin, np.searchsorted(begin, offsets), np.unique(text[lone])


def closed(names: pa.Array) -> np.ndarray:
    """Whether a chunk neither starts (after its own space) nor ends with
    white space, or is one line feed."""
    size = pc.binary_length(names).to_numpy(zero_copy_only=False)
    body = pc.binary_length(pc.utf8_trim_whitespace(names)).to_numpy(zero_copy_only=False)
    space = pc.starts_with(names, " ").to_numpy(zero_copy_only=False)
    return ((body > 0) & (body == size - space)) | pc.equal(names, "\n").to_numpy(zero_copy_only=False)


def cut(text: str) -> list[str]:
    """The chunks of any text."""
    out: list[str] = []
    run: list[str] = []
    first, *rest = text.split(" ")
    for p in (first, *(" " + x for x in rest)):
        if run and len(p) > 1 and not p[1].isspace() and (not run[-1] or not run[-1][-1].isspace()):
            out.append("".join(run))
            run = [p]
        else:
            run.append(p)
    out.append("".join(run))
    return out


def bodies(names: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """``(bodies, tails, names that have a tail)`` of closed chunks."""
    base = pc.utf8_rtrim(names, characters=TAIL)
    size, own = (pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (names, base))
    has = (own > 0) & (own < size) & pc.match_substring_regex(base, r"[\p{L}\p{Nd}]$").to_numpy(zero_copy_only=False)
    at = np.flatnonzero(has)
    data, offsets = raw(names.cast(pa.binary()))
    begin, width = offsets[at] + own[at], (size - own)[at].astype(np.int64)
    tails = strings(data[spans(begin, width)], np.concatenate([[0], np.cumsum(width)]))
    return pc.if_else(pa.array(has), base, names), tails, at


class ChunkEncoder:
    """``texts -> ids`` by ``encode_many``, which gives the ids of a list of
    chunks, one after another, and their numbers.  About ``limit`` parts of
    chunks are remembered; when there are more, those that the last slices had
    no use for are forgotten."""

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 800_000):
        self.encode_many, self.limit = encode_many, limit
        self._forget()

    def _forget(self) -> None:
        self.names = pa.array([], pa.string())
        self.ids, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.used = np.zeros(0, bool)

    def _trim(self) -> None:
        if len(self.names) <= self.limit and len(self.ids) <= 8 * self.limit:
            return
        keep = np.flatnonzero(self.used)
        if 2 * len(keep) > self.limit or 2 * int(self.size[keep].sum()) > 8 * self.limit:
            return self._forget()
        self.ids = self.ids[spans((np.cumsum(self.size) - self.size)[keep], self.size[keep])]
        self.names, self.size = self.names.take(pa.array(keep)), self.size[keep]
        self.used = np.zeros(len(keep), bool)

    def _known(self, names: pa.Array) -> np.ndarray:
        """The places of distinct parts among the remembered ones, now all."""
        at = pc.index_in(names, value_set=self.names)
        new = names.filter(at.is_null())
        at = at.fill_null(-1).to_numpy().astype(np.int64)
        if len(new):
            ids, size = self.encode_many(new.to_pylist())
            at[at < 0] = np.arange(len(new)) + len(self.names)
            self.names = pa.concat_arrays([self.names, new])
            self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
            self.used = np.concatenate([self.used, np.zeros(len(new), bool)])
        self.used[at] = True
        return at

    def _encode(self, names: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, numbers of ids)`` of distinct chunks; ``whole`` marks the closed ones."""
        base, tails, at = bodies(names.filter(pa.array(whole)))
        open_ = names.filter(pa.array(~whole))
        parts = pa.concat_arrays([base, tails]).dictionary_encode()
        place = self._known(parts.dictionary)[parts.indices.to_numpy()]
        # of each closed chunk the body, then the tail if it has one
        first = np.zeros(len(base), np.int64)
        first[at] = 1
        first = np.cumsum(first) - first + np.arange(len(base))
        order = np.empty(len(place), np.int64)
        order[first] = place[: len(base)]
        order[first[at] + 1] = place[len(base) :]
        begin = np.cumsum(self.size) - self.size
        ids = self.ids[spans(begin[order], self.size[order])]
        size = np.add.reduceat(self.size[order], first) if len(first) else np.zeros(0, np.int64)
        if not len(open_):
            return ids, size
        more, many = self.encode_many(open_.to_pylist())
        both, out = np.concatenate([ids, more]), np.empty(len(names), np.int64)
        where = np.empty(len(names), np.int64)
        out[whole], out[~whole] = size, many
        where[whole], where[~whole] = np.cumsum(size) - size, len(ids) + np.cumsum(many) - many
        return both[spans(where, out)], out

    def _gather(self, index: np.ndarray, first: np.ndarray, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, numbers of ids)`` of texts whose chunks are ``index[first[i]:first[i + 1]]``."""
        begin, many = np.cumsum(size) - size, size[index]
        ends = np.concatenate([[0], np.cumsum(many)])
        return ids[spans(begin[index], many)], np.diff(ends[first])

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit integers."""
        return blobs(*self.encode(pa.array(texts, pa.string()))).to_pylist()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, ends)`` of a binary or string array without nulls: text ``i``
        has the ids from ``ends[i]`` to ``ends[i + 1]``."""
        self._trim()
        data, offsets = raw(texts.cast(pa.binary()))
        begin, first, lone = pieces(data, offsets)
        found = strings(data, np.concatenate([begin, [len(data)]])).dictionary_encode()
        index, names = found.indices.to_numpy(), found.dictionary
        whole = closed(names)
        odd = np.zeros(len(texts), bool)
        odd[lone] = True
        if not whole.all():
            text = np.repeat(np.arange(len(texts)), np.diff(first))
            odd[text[~whole[index]]] = True
        if not odd.any():
            ids, size = self._gather(index, first, *self._encode(names, whole))
            return ids, np.concatenate([[0], np.cumsum(size)])
        count = np.diff(first)
        index = index[~np.repeat(odd, count)]
        use = np.zeros(len(names), bool)
        use[index] = True
        renamed = np.cumsum(use) - 1
        names = names.filter(pa.array(use))
        ids, size = self._gather(renamed[index], np.concatenate([[0], np.cumsum(count[~odd])]), *self._encode(names, np.ones(len(names), bool)))
        own = [cut(t) for t in texts.filter(pa.array(odd)).cast(pa.string()).to_pylist()]
        found = pa.array([c for x in own for c in x], pa.string()).dictionary_encode()
        first = np.concatenate([[0], np.cumsum([len(x) for x in own])])
        more, many = self._gather(found.indices.to_numpy(), first, *self._encode(found.dictionary, closed(found.dictionary)))
        total, where = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        total[~odd], total[odd] = size, many
        where[~odd], where[odd] = np.cumsum(size) - size, len(ids) + np.cumsum(many) - many
        return np.concatenate([ids, more])[spans(where, total)], np.concatenate([[0], np.cumsum(total)])


def blobs(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The ids of each text as binary, little-endian, in the ids' own width."""
    wide = ids.dtype.itemsize
    ids = ids.astype(f"<u{wide}", copy=False)
    if len(ids) * wide >= 1 << 31:
        return pa.array([ids[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * wide).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
