"""Word and window hashing shared by the text operators (numpy, whole texts).

A *word* is a maximal run of bytes other than space and ``\\x09-\\x0D``.  None of
those bytes occurs inside a multi-byte UTF-8 sequence, so words can be found
and hashed on the raw bytes of an Arrow text column, without a Python object
per word.  All hashes come from fixed constants: they agree between processes,
executors and reruns of a lost task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial over word hashes, and of that over bytes.
BASE = np.uint64(0x9E3779B97F4A7C15)
BYTE_BASE = np.uint64(0xD6E8FEB86659FD93)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)

SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
LOWER = np.arange(256)
LOWER[65:91] += 32
LOWER_CODE = BYTE_CODE[LOWER]


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def windows(x: np.ndarray, w: int, base: np.uint64 = BASE) -> np.ndarray:
    """Unmixed polynomial hashes of all ``len(x) - w + 1`` windows of ``w``
    items, by doubling: O(log w) passes over ``x``."""
    n = len(x) - w + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, level, width, power, scale = None, 0, x, 1, int(base), 1
    while w:
        if w & 1:
            part = level[done : done + n]
            part = part * np.uint64(scale) if scale != 1 else part
            out = part if out is None else out + part
            done += width
            scale = scale * power % (1 << 64)
        w >>= 1
        if w:
            level = level[: len(level) - width] + level[width:] * np.uint64(power)
            width *= 2
            power = power * power % (1 << 64)
    return out


class Words:
    """The words of several texts: ``begin``/``end`` are byte positions in
    ``data``, ``first[i]:first[i + 1]`` are the words of text ``i``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~IS_SPACE[data]
        starts, ends = inside.copy(), inside.copy()
        if len(data):
            starts[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            cut = offsets[(offsets > 0) & (offsets < len(data))]  # no word crosses texts
            starts[cut] |= inside[cut]
            ends[cut - 1] |= inside[cut - 1]
        self.begin = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.begin, offsets)
        self.count = np.diff(self.first)
        self.inside = inside

    def __len__(self) -> int:
        return len(self.begin)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word, of ASCII-lower-cased words if asked."""
        if not len(self.begin):
            return np.empty(0, np.uint64)
        lengths = self.end - self.begin
        total = int(lengths.sum())
        at = np.cumsum(lengths) - lengths
        place = np.arange(total) - np.repeat(at, lengths)
        code = (LOWER_CODE if lower else BYTE_CODE)[self.data[self.inside]]
        code *= powers(BYTE_BASE, int(lengths.max()))[place]
        return mix(np.add.reduceat(code, at) + lengths.astype(np.uint64))

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: the text it is in, and its number there."""
        text = np.repeat(np.arange(len(self.count)), self.count)
        return text, np.arange(len(self.begin)) - np.repeat(self.first[:-1], self.count)

    def whole(self, w: int) -> np.ndarray:
        """Indices of the words at which a window of ``w`` words of one text starts."""
        text, place = self.places()
        return np.flatnonzero(place + w <= self.count[text])


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column as binary with null as empty and 32-bit offsets from 0."""
    x = batch.column(batch.schema.get_field_index(name))
    x = x.cast(pa.binary()) if not pa.types.is_large_binary(x.type) else x
    return x.fill_null(b"") if x.null_count else x


def raw(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a binary array without nulls, zero-copy."""
    if not len(x):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, x.offset * 4).astype(np.int64)
    data = x.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(x: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each, one row at least: temporary
    arrays stay bounded by that or by one text, whatever a batch holds."""
    _, offsets = raw(x)
    i = 0
    while i < len(x):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, len(x))
        i = min(j, len(x))
