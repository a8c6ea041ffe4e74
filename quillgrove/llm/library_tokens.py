"""Ids of whole texts by the ``tokenizers`` library, through the chunk cache.

The library's cost for each call on a short chunk is as high as for its
letters, so chunks are encoded many at a time, joined by a separator that is a
pre-token of its own, and the ids are cut at the separator's ids.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .chunks import ChunkEncoder, closed, spans

#: A line feed where white space has ids; else a rare digit, as words of the
#: tokenizers without ids for white space never hold more than one digit.
SEPARATORS = ("\n", " \u2079 ")
_PROBE = ["a", " b", "7", " 8", "!", " ?", "\u00e9", " x-1.", "'s", " '"]
GROUP = 400

_LOADED: dict[str, ChunkEncoder] = {}


def _cut_at(ids: np.ndarray, mark: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of what lies between the places of ``mark``."""
    n = len(ids) - len(mark) + 1
    hit = np.ones(max(n, 0), bool)
    for k, x in enumerate(mark):
        hit &= ids[k : k + n] == x
    at = np.flatnonzero(hit)
    return np.concatenate([[0], at + len(mark)]), np.concatenate([at, [len(ids)]])


def alone(found: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids and numbers of ids of the library's encodings."""
    ids = [np.array(x.ids, np.uint32) for x in found]
    return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)


def joined(encode, chunks: list[str], separator: str, mark: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and numbers of ids of the chunks.  A group that isn't cut into as
    many parts as it has chunks is encoded chunk by chunk."""
    out, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    groups = [chunks[i : i + GROUP] for i in range(0, len(chunks), GROUP)]
    for group, found in zip(groups, encode([separator.join(g) for g in groups]), strict=True):
        ids = np.array(found.ids, np.uint32)
        begin, end = _cut_at(ids, mark)
        if len(begin) == len(group):
            inside = np.ones(len(ids), bool)
            inside[spans(end[:-1], np.full(len(end) - 1, len(mark)))] = False
            ids, size = ids[inside], end - begin
        else:
            ids, size = alone(encode(group))
        out.append(ids)
        sizes.append(size)
    return np.concatenate(out), np.concatenate(sizes)


def encoder(path: str) -> ChunkEncoder:
    """Once for each worker process.  Special tokens' strings in a text are ordinary text."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        tokenizer.no_padding()
        tokenizer.no_truncation()

        encode = lambda texts: tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        want = alone(encode(_PROBE))
        same = lambda got: all(np.array_equal(x, y) for x, y in zip(got, want, strict=True))
        marks = {sep: encode([sep])[0].ids for sep in SEPARATORS}
        found = next((sep for sep, mark in marks.items() if mark and same(joined(encode, _PROBE, sep, mark))), None)

        def encode_many(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
            if found is None:
                return alone(encode(chunks))
            fits = closed(pa.array(chunks, pa.string())) & ~pc.match_substring(pa.array(chunks, pa.string()), found.strip(" ")).to_numpy(zero_copy_only=False)
            ids, size = joined(encode, [c for c, f in zip(chunks, fits, strict=True) if f], found, marks[found])
            if fits.all():
                return ids, size
            more, many = alone(encode([c for c, f in zip(chunks, fits, strict=True) if not f]))
            where, total = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
            total[fits], total[~fits] = size, many
            where[fits], where[~fits] = np.cumsum(size) - size, len(ids) + np.cumsum(many) - many
            return np.concatenate([ids, more])[spans(where, total)], total

        _LOADED[path] = ChunkEncoder(encode_many)
    return _LOADED[path]
