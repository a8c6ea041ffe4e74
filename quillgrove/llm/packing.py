"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Items of one length are interchangeable, so the packing is planned on the
histogram of lengths alone: at most ``capacity`` counts, whatever the corpus.

* Large items (over a third of the capacity) fit at most twice in a sequence:
  they are matched greedily from the longest, each with the longest that fits.
* Smaller items, from the longest, go into the tightest gap that holds them.

The plan gives each length ranges of ranks, and each range its sequences; a
piece finds its place from its rank among pieces of its length.  Ranks come
from counts by block of rows within parts of the input, so no task sees all
pieces, or all blocks, of a common length.

Edge cases: a null or empty text is one piece with the end id only.  Only
documents over the capacity are cut, their first piece taking what is over.
Repeated rows and ids are packed separately.  An empty table gives an empty
result.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import blobs
from .common import Scratch, extended, ship
from .hashing import column, slices
from .library_tokens import encoder

CAPACITY = 2048
Bin = tuple[tuple[int, int], ...]  # (length, copies) in the order of their places


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Bin, int]]:
    """``(contents, how many sequences)`` that hold exactly the counted items."""
    left = {k: n for k, n in counts.items() if n}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("a length is outside the capacity")
    gaps: dict[int, list[tuple[Bin, int]]] = {}
    order: list[int] = []  # gaps in use, ascending

    def put(contents: Bin, times: int) -> None:
        gap = capacity - sum(k * n for k, n in contents)
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append((contents, times))

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        top = large[-1]
        n = left[top]
        at = bisect_left(large, capacity - top + 1) - 1  # the longest that fits beside it
        other = large[at] if at >= 0 else None
        if other == top:
            if n > 1:
                put(((top, 2),), n // 2)
            left[top] = n % 2
            if left[top]:
                other = large[at - 1] if at else None
                put(((top, 1), (other, 1)) if other else ((top, 1),), 1)
                left[top] = 0
                if other:
                    left[other] -= 1
        elif other is None:
            put(((top, 1),), n)
            left[top] = 0
        else:
            m = min(n, left[other])
            put(((top, 1), (other, 1)), m)
            left[top] -= m
            left[other] -= m
        large = [k for k in large if left[k]]
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect_left(order, s)
            if at == len(order):
                k = min(capacity // s, n)
                put(((s, k),), n // k)
                n -= n // k * k
                continue
            gap = order[at]
            contents, times = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            k = min(gap // s, n)
            used = min(times, n // k)
            put((*contents, (s, k)), used)
            n -= used * k
            if times > used:
                put(contents, times - used)
    return [x for gap in order for x in gaps[gap]]


def places(planned: list[tuple[Bin, int]]) -> np.ndarray:
    """Rows ``length, first rank, sequence, copies in each, offset``, sorted."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for contents, times in planned:
        offset = 0
        for length, copies in contents:
            first = taken.get(length, 0)
            rows.append((length, first, sequence, copies, offset))
            taken[length] = first + copies * times
            offset += length * copies
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _cut(total: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """``document, piece, start, length`` of the pieces of documents of
    ``total`` ids each: the first piece takes what is over."""
    count = -(-total // capacity)
    doc = np.repeat(np.arange(len(total)), count)
    piece = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    over = (total - (count - 1) * capacity)[doc]
    start = np.where(piece > 0, over + (piece - 1) * capacity, 0)
    return doc, piece, start, np.where(piece > 0, capacity, over)


def tokenise(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every document.  ``block`` and ``nth`` number the pieces
    of a length within blocks of rows."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, block = encoder(path).encode, TaskContext.get().partitionId() << 24
        for batch in batches:
            texts = column(batch, "text")
            for i, j in slices(texts, 4_000_000):
                ids, ends = encode(texts.slice(i, j - i))
                ids = np.insert(ids, ends[1:], end_id).astype("<u4", copy=False)
                ends = ends + np.arange(len(ends))
                doc, piece, start, length = _cut(np.diff(ends), capacity)
                at = ends[:-1][doc] + start
                parts = blobs(ids, np.concatenate([at, ends[-1:]]))
                crc = [zlib.crc32(x.as_buffer()) for x in parts]
                order = np.argsort(length, kind="stable")  # numbers within a length
                same = np.concatenate([[True], length[order][1:] != length[order][:-1]])
                nth = np.empty(len(order), np.int64)
                nth[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(same, np.arange(len(order)), 0))
                arrays = [batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), block)), pa.array(nth)]
                arrays += [parts] if with_ids else []
                block += 1
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "block", "nth", *["ids"] * with_ids])

    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, block long, nth long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; also its ``ids`` if
    asked.  ``path`` is a tokenizer file that every executor has."""
    spark = docs.sparkSession
    pieces = Scratch(spark, "packing").store(tokenise(docs, path, end_id, capacity, key, text, with_ids), "pieces")
    blocks = pieces.groupBy("block", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    shared = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    # Ranks of blocks in two levels, so that no task sees every block of a common length.
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    blocks = blocks.withColumn("part", F.shiftright("block", 24))
    parts = blocks.groupBy("length", "part").agg(F.sum("n").alias("n")).select("length", "part", total(before("length", "part")).alias("base"))
    blocks = blocks.join(parts, ["length", "part"]).select("block", "length", (F.col("base") + total(before("length", "part", "block"))).alias("before"))
    ranked = pieces.join(blocks, ["block", "length"]).withColumn("rank", F.col("before") + F.col("nth")).drop("block", "before", "nth")
    names = ranked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        known = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(names.index(c)).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(known, length << 48 | rank, "right") - 1] if len(table) else table
            inside = rank - row[:, 1]
            sequence, offset = row[:, 2] + inside // row[:, 3], row[:, 4] + inside % row[:, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], names=[*batch.schema.names, "sequence_id", "offset"])

    out = ranked.mapInArrow(run, extended(ranked.schema, sequence_id="long", offset="long"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
