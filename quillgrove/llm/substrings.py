"""Substring dedup by difference-cover anchors.

A word is removed if a window of ``WINDOW`` words that covers it also starts
in a document with a smaller key.

1. Only windows of ``ANCHOR`` words at positions whose remainder by ``PERIOD``
   is in the difference cover are hashed corpus-wide: 6 positions of 31.  For
   any two positions some common shift below the period puts both in the
   cover, so two equal windows of ``WINDOW = ANCHOR + PERIOD - 1`` words always
   share an aligned anchor.  Anchors that documents of different keys have
   mark their places in each text; whole windows around a mark are candidates.
2. Matches are extended over long stretches first.  A run of candidates is cut
   where the hash of the next ``ANCHOR`` words says so, which is at the same
   words in every copy, into segments of about ``STRIDE`` windows.  A segment
   whose words a document with a smaller key also has is settled: all its
   windows are found there.
3. Windows outside settled segments are hashed one by one (96 bits) and held
   against the smallest key that has each.  The document with the smallest key
   that holds a window has no settled segment around it, as a still smaller
   one would then hold the window too; so nothing is lost.

Scale: there is one path and one plan of joins for all sizes.  Anchors, segments and windows are
aggregated before they are shuffled, so a passage that a third of all
documents hold is summed up first; the joins back are between written tables,
which adaptive execution splits by skewed key.  Texts travel three times, to
their marks, to their settled segments and to what is removed; shuffle files
of a finished step are freed before the next.  Nothing is broadcast by hand
and nothing comes to the driver.

Edge cases: null and empty texts have no words and lose none.  Texts shorter
than a window lose nothing; very long ones are whole, one at a time.  Rows of
one key are one document's: they never remove each other's words, whatever
their texts.  Rows with a null key are left whole.  An empty table gives an
empty result.  Other columns are not read; a carried column with the name of a
result gives way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, beside, extended, release, ship
from .hashing import BASE, Words, column, mix, powers, raw, slices, windows

PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
WINDOW = 50
ANCHOR = WINDOW - PERIOD + 1
STRIDE = 16
SLICE = 1_000_000
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def _anchors(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word indices of the anchors of all texts, and their hashes."""
    at = words.whole(ANCHOR)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    _, place = words.places()
    at = at[_IN_COVER[place[at] % PERIOD]]
    return at, mix(windows(hashes, ANCHOR)[at])


def _source(docs: DataFrame, key: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``row`` tells texts of one key apart."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.hash(text).cast("long").alias("row"), *carry)


def _anchor_rows(source: DataFrame, placed: bool) -> DataFrame:
    """Every anchor's hash with its document, and with its place if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text")
            for i, j in slices(texts, SLICE):
                words = Words(*raw(texts.slice(i, j - i)))
                at, found = _anchors(words, words.hashes())
                if not len(at):
                    continue
                own, place = words.places()
                text = pa.array(own[at])
                rows = [pa.array(found.view(np.int64)), batch.column(0).slice(i, j - i).take(text)]
                if placed:
                    rows.append(pa.array(batch.column(2).slice(i, j - i).take(text).to_numpy() << 32 | place[at]))
                yield pa.RecordBatch.from_arrays(rows, names=["h", "doc_id", "place"][: len(rows)])

    return source.mapInArrow(run, "h long, doc_id long" + ", place long" * placed)


def _shared_anchors(source: DataFrame) -> DataFrame:
    """Hashes of the anchors that documents of different keys have."""
    return _anchor_rows(source, False).groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("h")


def _by_text(placed: DataFrame, *more) -> DataFrame:
    """``(doc_id, row, places)`` of rows ``(doc_id, place)``; ``more`` goes into
    the low bits of each place."""
    low = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    at = F.shiftleft(low, 32).bitwiseOR(more[0].cast("long")) if more else low
    dealt = placed.select("doc_id", F.shiftright("place", 32).alias("row"), at.alias("at")).repartition("doc_id", "row")
    return dealt.groupBy("doc_id", "row").agg(F.collect_set("at").alias("places"))


def _around(words: Words, at: np.ndarray) -> np.ndarray:
    """Starts of the whole windows that hold one of the anchors ``at``."""
    reach = np.zeros(len(words) + 1, np.int32)
    _, place = words.places()
    np.add.at(reach, at - np.minimum(place[at], WINDOW - ANCHOR), 1)
    np.add.at(reach, at + 1, -1)
    starts = words.whole(WINDOW)
    return starts[np.cumsum(reach)[starts] > 0]


def _segments(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(begins, numbers of windows, hashes, second hashes)`` of the segments
    in runs of candidate windows; a segment has the words of all its windows."""
    run = np.cumsum(np.concatenate([[0], starts[1:] != starts[:-1] + 1]))
    chosen = np.flatnonzero(mix(windows(hashes, ANCHOR)[starts]) % np.uint64(STRIDE) == 0)
    inside = run[chosen[1:]] == run[chosen[:-1]]
    begin, end = starts[chosen[:-1]][inside], starts[chosen[1:]][inside]
    out = []
    for base in (BASE, _SECOND):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers(base, len(hashes)), out=total[1:])
        back = powers(np.uint64(pow(int(base), -1, 1 << 64)), len(hashes))
        out.append(mix((total[end + WINDOW - 1] - total[begin]) * back[begin] + (end - begin).astype(np.uint64)))
    return begin, end - begin, out[0], out[1]


def _outside(words: Words, starts: np.ndarray, first: np.ndarray, settled: pa.Array) -> np.ndarray:
    """The starts that are in no settled segment."""
    flat, owner = _flat(settled)
    begin = first[owner] + (flat >> 32)
    change = np.zeros(len(words) + 1, np.int32)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + (flat & 0xFFFFFFFF), -1)
    return starts[np.cumsum(change)[starts] == 0]


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the row of each; a null list is empty."""
    many = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), many)


_ROWS = "h long, g int, doc_id long, place long, size int"


def _matched(texts: DataFrame, whole: bool) -> DataFrame:
    """Rows of segments (``whole``) or of single windows outside ``settled``
    ones, of texts with the ``places`` of their shared anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names = column(batch, "text"), batch.schema.names
            for i, j in slices(texts, SLICE):
                part = batch.slice(i, j - i)
                words = Words(*raw(texts.slice(i, j - i)))
                hashes = words.hashes()
                flat, owner = _flat(part.column(names.index("places")))
                starts = _around(words, np.unique(words.first[owner] + flat))
                if whole:
                    begin, size, first, second = _segments(hashes, starts)
                else:
                    begin = _outside(words, starts, words.first, part.column(names.index("settled")))
                    size = np.ones(len(begin), np.int64)
                    first, second = (mix(windows(hashes, WINDOW, base)[begin]) for base in (BASE, _SECOND))
                own, place = words.places()
                for k in range(0, len(begin), 65536):
                    at = begin[k : k + 65536]
                    text = pa.array(own[at])
                    both = part.column(names.index("row")).take(text).to_numpy() << 32 | place[at]  # one field of a shuffled row
                    high = (second[k : k + 65536] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(first[k : k + 65536].view(np.int64)), pa.array(high), part.column(0).take(text), pa.array(both), pa.array(size[k : k + 65536].astype(np.int32))], names=["h", "g", "doc_id", "place", "size"])

    return texts.mapInArrow(run, _ROWS)


def _late(found: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(doc_id, row, places)`` of the rows whose words a document with a
    smaller key also has; a place is a start and a number of windows."""
    first = found.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("h", "g", "first")
    first = scratch.store(first, name)
    late = found.join(first.hint("merge"), ["h", "g"]).filter("doc_id > first")
    return _by_text(late, F.col("size"))


def _ranges(places: list[int]) -> list[int]:
    """Ends of the word ranges that windows at ``places`` cover, flattened."""
    x = np.unique(np.array(places, np.int64))
    a, b = x >> 32, (x >> 32) + (x & 0xFFFFFFFF) + WINDOW - 1
    b = np.maximum.accumulate(b)
    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return np.stack([a[new], np.concatenate([b[new[1:] - 1], b[-1:]])], 1).ravel().tolist()


def _removed(settled: DataFrame, late: DataFrame) -> DataFrame:
    """``(doc_id, row, ranges)`` of the texts that lose words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_ranges(x) for x in batch.column(2).to_pylist()], pa.list_(pa.int64()))], names=["doc_id", "row", "ranges"])

    both = settled.unionByName(late).groupBy("doc_id", "row").agg(F.flatten(F.collect_list("places")).alias("places"))
    return both.mapInArrow(run, "doc_id long, row long, ranges array<long>")


def cut_words(text: bytes, ranges: list[int]) -> tuple[int, int, bytes]:
    """``(words, words removed, the kept words joined by a space)``."""
    words = text.split()
    kept, at = [], 0
    for a, b in zip(ranges[::2], ranges[1::2], strict=True):
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False, carry: tuple[str, ...] | None = None) -> DataFrame:
    """``n_words``, ``n_removed`` and ``kept_text`` (with ``digest``, instead
    its ``kept_sha256``) of every document.  With ``carry``, the text and those
    columns come along."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "substrings")

    def step(df: DataFrame, name: str) -> DataFrame:
        release(spark)
        return scratch.store(df, name)

    keyed, on = _source(docs, key, text).filter("doc_id is not null"), ["doc_id", "row"]
    shared = step(_shared_anchors(keyed), "shared")
    marks = step(_by_text(_anchor_rows(keyed, True).join(shared.hint("merge"), "h")), "marks")
    scratch.drop("shared")
    segments = step(_matched(keyed.join(marks.hint("merge"), on).select("doc_id", "text", "row", "places"), True), "segments")
    settled = step(_late(segments, scratch, "first"), "settled")
    scratch.drop("segments", "first")
    known = marks.join(settled.withColumnRenamed("places", "settled"), on, "left")
    single = step(_matched(keyed.join(known.hint("merge"), on).select("doc_id", "text", "row", "places", "settled"), False), "windows")
    late = step(_late(single, scratch, "first"), "late")
    scratch.drop("windows", "first", "marks")
    ranges = step(_removed(settled, late), "ranges")
    scratch.drop("settled", "late")
    release(spark)
    last = ("kept_sha256", pa.string()) if digest else ("kept_text", pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = column(batch, "text"), batch.column(len(along)).to_pylist()
            for i, j in slices(texts, 4_000_000):
                rows = [cut_words(t, r or []) for t, r in zip(texts.slice(i, j - i).to_pylist(), found[i:j], strict=True)]
                words, gone, kept = zip(*rows, strict=True)
                kept = [hashlib.sha256(x).hexdigest() for x in kept] if digest else [x.decode() for x in kept]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in out), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, last[1])], names=[*(along[k] for k in out), "n_words", "n_removed", last[0]])

    carry = carry if carry is None else tuple(beside(carry, "doc_id", "text", "row", "ranges", "n_words", "n_removed", last[0]))
    along = ["doc_id", "text", *(carry or ())]
    out = range(1 if carry is None else len(along))
    joined = _source(docs, key, text, carry or ()).join(ranges.hint("merge"), ["doc_id", "row"], "left").select(*along, "ranges")
    schema = extended(joined.select(*(along[k] for k in out)).schema, n_words="long", n_removed="long")
    return joined.mapInArrow(run, schema.add(last[0], "string"))


#: The digest rows in DuckDB, over all windows.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) t(i)
), late AS (
  SELECT doc_id, i FROM win JOIN (SELECT h, min(doc_id) AS f FROM win GROUP BY h HAVING count(*) > 1) USING (h) WHERE doc_id > f
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM late, range(50) t(k)
), cut AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(ps, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
