"""Token-id files with keyed access by a minimal perfect hash.

A file holds, in ascending key order, the raw ids of its documents
(little-endian, 16 bits each where the vocabulary allows, else 32), one line
feed after each document; then the keys and numbers of ids of its records (for
scans only), the index, and a footer of fixed length with the places of both
and the shard's least and greatest key.  The index is a minimal perfect hash
(levels of bit arrays with rank counts, after Limasset et al., 2017) from keys
to slots; each slot stores a 32-bit fingerprint of its key, the byte offset
and number of ids of its first record and its number of records.  ``TokenFiles``
reads footers and indexes by range and then any key's ids by one range read at
the slot's offset, in constant time; a key that isn't there is told apart by
its fingerprint but for one in 2**32.

Files are written by Spark's own text writer (which copies bytes as they are)
and read by ``binaryFile``, so they can live in any store that Spark reaches,
and task commits keep them whole when executors are lost.  A shard is one
range of keys, written by one task; there are enough for about ``shard_bytes``
of text in each.  Rows of one key, or without one, are dealt to several shards
by the start of their texts.  ``binaryFile`` holds a whole file several times, on
the heap and beside it, so a shard is cut into as many files as it takes for
each to have at most ``file_bytes`` of ids, or those of one slice of texts: how
much a reader holds does not depend on how evenly the ranges were cut.

Edge cases: null and empty texts are records with the end id only.  Very long
texts are encoded whole.  Rows with a null key come first and are not indexed.
Repeated keys are neighbouring records, ordered by text; a file has one slot for
those that it holds.  An empty table gives files without records.  Other
columns are not read.
"""

from __future__ import annotations

import io
import re
import struct
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import blobs, spans
from .common import Scratch, ship
from .hashing import column, mix, slices
from .library_tokens import encoder

MAGIC = b"QGTOKEN2"
#: Begin and size of the keys and of the index, rows without a key, least and greatest key, bytes of an id.
_FOOTER = struct.Struct("<QQQQQqqQ8s")
PREFIX = 32
_LEVEL = 0x9E3779B97F4A7C15


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64(_LEVEL * (level + 1) % (1 << 64))) % np.uint64(size)).astype(np.int64)


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Maps each of ``n`` distinct 64-bit keys to its own slot below ``n``."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        flags = np.unpackbits(bits, bitorder="little").astype(bool)
        self.flags, self.ranks = flags, np.concatenate([[0], np.cumsum(flags)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.5) -> PerfectHash:
        sizes, levels = [], []
        while len(keys):
            size = -(-int(gamma * len(keys) + 1) // 64) * 64
            at = _place(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            keys = keys[~alone[at]]
        flags = np.concatenate(levels) if levels else np.zeros(0, bool)
        return cls(np.array(sizes, np.int64), np.packbits(flags, bitorder="little"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for some keys that were not built in."""
        out, todo, begin = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = begin + _place(keys[todo], level, size)
            hit = self.flags[at]
            out[todo[hit]] = self.ranks[at[hit]]
            todo, begin = todo[~hit], begin + size
        return out


def build_index(keys: np.ndarray, n_null: int, counts: np.ndarray, width: int) -> bytes:
    """``keys``: of the records after the ``n_null`` first, ascending;
    ``counts``: ids of every record."""
    names, first, times = np.unique(keys, return_index=True, return_counts=True)
    names = names.view(np.uint64) if len(names) else np.zeros(0, np.uint64)
    perfect = PerfectHash.build(names)
    slots = perfect.slots(names)
    begins = (np.cumsum(counts) - counts) * width + np.arange(len(counts))  # a line feed after each record
    # of a key with several records, the numbers of ids of the others
    later = np.concatenate([[False], keys[1:] == keys[:-1]])[: len(keys)]
    arrays = {"mark": _fingerprint(names), "offset": begins[n_null:][first], "count": counts[n_null:][first], "run": times, "more": np.cumsum(times - 1) - (times - 1)}
    held = {k: np.zeros(len(names), v.dtype) for k, v in arrays.items()}
    for k, v in arrays.items():
        held[k][slots] = v
    out = io.BytesIO()
    np.savez(out, sizes=perfect.sizes, bits=perfect.bits, others=counts[n_null:][later], **held)
    return out.getvalue()


def closing(keys: np.ndarray, n_null: int, counts: np.ndarray, width: int) -> list[bytes]:
    """The lines after the records: keys and numbers of ids, index, footer."""
    listed, index = keys.astype("<i8").tobytes() + counts.astype("<u4").tobytes(), build_index(keys, n_null, counts, width)
    at = int(counts.sum()) * width + len(counts)
    least, greatest = (int(keys[0]), int(keys[-1])) if len(keys) else (0, -1)
    return [listed, index, _FOOTER.pack(at, len(listed), at + len(listed) + 1, len(index), n_null, least, greatest, width, MAGIC)]


class Shard:
    """One file of a shard, of which ``fetch(begin, size)`` reads a range."""

    def __init__(self, content: bytes | None = None, fetch: Callable[[int, int], bytes] | None = None, size: int = 0):
        self.fetch = fetch or (lambda begin, n: content[begin : begin + n])
        last = (size if content is None else len(content)) - _FOOTER.size - 1
        *places, self.n_null, self.least, self.greatest, self.width, magic = _FOOTER.unpack(self.fetch(last, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self._keys, self._index, self._slots = places[:2], places[2:], None

    def slots(self) -> tuple[PerfectHash, dict[str, np.ndarray]]:
        """The index, read once."""
        if self._slots is None:
            with np.load(io.BytesIO(self.fetch(*self._index))) as x:
                self._slots = PerfectHash(x["sizes"], x["bits"]), {k: x[k] for k in ("mark", "offset", "count", "run", "more", "others")}
        return self._slots

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 if it is absent."""
        perfect, held = self.slots()
        keys = np.asarray(keys, np.int64).view(np.uint64)
        slot = perfect.slots(keys)
        ok = slot >= 0
        ok[ok] = held["mark"][slot[ok]] == _fingerprint(keys[ok])
        return np.where(ok, slot, -1)

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of a key's records, each by a range read at its offset."""
        slot = int(self.find(np.array([key]))[0]) if self.least <= key <= self.greatest else -1
        if slot < 0:
            return []
        _, held = self.slots()
        at, more = int(held["offset"][slot]), int(held["more"][slot])
        out = []
        for n in (int(held["count"][slot]), *held["others"][more : more + int(held["run"][slot]) - 1].tolist()):
            out.append(np.frombuffer(self.fetch(at, n * self.width), f"<u{self.width}"))
            at += n * self.width + 1
        return out

    def records(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(keys of the records after those without one, numbers of ids,
        byte offsets)``; an error where the index says otherwise."""
        listed = self.fetch(*self._keys)
        n = (len(listed) - 4 * self.n_null) // 12
        keys, counts = np.frombuffer(listed, "<i8", n), np.frombuffer(listed, "<u4", n + self.n_null, 8 * n).astype(np.int64)
        begins = (np.cumsum(counts) - counts) * self.width + np.arange(len(counts))
        names, first, times = np.unique(keys, return_index=True, return_counts=True)
        slot, held = self.find(names), self.slots()[1]
        if (slot < 0).any() or (held["offset"][slot] != begins[self.n_null :][first]).any() or (held["run"][slot] != times).any():
            raise ValueError("index and records disagree")
        return keys, counts, begins


#: Shard, and file within the shard, in the names that Spark's writer gives.
_NAME = r"part-(\d+).*-c(\d+)"
#: Spark's writer makes at most 1,000,000 files in a task.
_PLACES = 1 << 20


def number(name: str) -> int:
    """Ascending in the order of the files."""
    shard, file = re.search(_NAME, name).groups()
    return int(shard) * _PLACES + int(file)


class TokenFiles:
    """Keyed access to a folder of shards in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

        def reader(file):
            def fetch(begin: int, size: int) -> bytes:
                stream = fs.open(file)
                try:
                    stream.seek(begin)
                    return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)) if size else b""
                finally:
                    stream.close()

            return fetch

        found = sorted((number(f.getPath().getName()), f) for f in fs.listStatus(path) if f.getPath().getName().startswith("part-"))
        shards = (Shard(fetch=reader(f.getPath()), size=f.getLen()) for _, f in found)
        self.shards = [s for s in shards if s.least <= s.greatest]  # in ascending order, as they were dealt
        self._greatest = [s.greatest for s in self.shards]

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each record of ``key``, from the shards whose range holds it."""
        out = []
        for s in self.shards[bisect_left(self._greatest, key) :]:
            if s.least > key:
                break
            out += s.get(key)
        return out


def id_width(path: str, end_id: int = 2) -> int:
    """Bytes of an id: 2 where every id of the tokenizer fits, else 4."""
    from tokenizers import Tokenizer

    return 2 if max([end_id, *Tokenizer.from_file(path).get_vocab().values()]) < 1 << 16 else 4


def packed(ids: bytes, width: int) -> bytes:
    """32-bit ids in ``width`` bytes each; an error for one that doesn't fit."""
    return narrow(np.frombuffer(ids, "<u4"), width).tobytes()


def narrow(ids: np.ndarray, width: int) -> np.ndarray:
    if width < 4 and len(ids) and int(ids.max()) >> 8 * width:
        raise ValueError(f"an id does not fit in {width} bytes")
    return ids.astype(f"<u{width}")


def write(docs: DataFrame, to: str, path: str, end_id: int = 2, width: int | None = None, key: str = "doc_id", text: str = "text", shards: int | None = None, shard_bytes: int = 64 << 20, file_bytes: int = 8 << 20) -> None:
    """Encodes whole texts, ``end_id`` after each, into files in folder ``to``."""
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if shards is None:
        total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(1, -(-total // shard_bytes))
    width = width or id_width(path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, wrote = encoder(path).encode, False
        held, size, keys, counts, n_null = [], 0, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def file() -> pa.RecordBatch:
            content = b"".join(held) + b"\n".join(closing(np.concatenate(keys), n_null, np.concatenate(counts), width))
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["value"])

        for batch in batches:
            names, texts = batch.column(0), column(batch, "text")
            for i, j in slices(texts, 4_000_000):
                ids, ends = encode(texts.slice(i, j - i))
                ids = narrow(np.insert(ids, ends[1:], end_id), width)
                ends = ends + np.arange(len(ends))
                if held and size + len(ids) * width > file_bytes:
                    yield file()
                    wrote = True
                    held, size, keys, counts, n_null = [], 0, keys[:1], counts[:1], 0
                held.append(np.insert(ids.view(np.uint8), ends[1:] * width, ord("\n")).tobytes())
                size += len(ids) * width
                keys.append(names.slice(i, j - i).drop_null().to_numpy())
                counts.append(np.diff(ends))
                n_null += names.slice(i, j - i).null_count
        if held or not wrote:
            yield file()

    dealt = source.repartitionByRange(shards, F.col("doc_id"), F.substring("text", 1, PREFIX)).sortWithinPartitions("doc_id", "text")
    contents = dealt.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    contents.write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(to)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the files: ``file`` (ascending numbers), ``doc_id``,
    ``start`` within the file, ``n_tokens`` and ``ids`` (32 bits each).  Every
    key's slot must name its record."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = Shard(memoryview(content.as_buffer()))
                keys, counts, begins = x.records()
                keys, starts = pa.concat_arrays([pa.nulls(x.n_null, pa.int64()), pa.array(keys)]), np.cumsum(counts) - counts
                i = 0
                while i < len(counts):
                    j = max(i + 1, int(np.searchsorted(starts, starts[i] + 1_000_000)))  # about a million ids, or one record
                    n = counts[i:j]
                    at = spans(begins[i:j] - begins[i], n * x.width)
                    ids = np.frombuffer(x.fetch(int(begins[i]), int(at[-1]) + 1), np.uint8)[at].view(f"<u{x.width}")
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), file, np.int64)), keys.slice(i, j - i), pa.array(starts[i:j]), pa.array(n), blobs(ids.astype("<u4"), np.concatenate([[0], np.cumsum(n)]))], names=["file", "doc_id", "start", "n_tokens", "ids"])
                    i = j

    shard, file = (F.regexp_extract("path", _NAME, k).cast("long") for k in (1, 2))
    files = spark.read.format("binaryFile").load(folder).select((shard * _PLACES + file).alias("file"), "content")
    return files.mapInArrow(run, "file long, doc_id long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, path: str, to: str | None = None, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files, reads them back and returns each record's ``start``
    among all ids, its ``n_tokens`` and ``ids_crc32``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    written, to = not to, to or scratch.path("files")
    write(docs, to, path, end_id, key=key, text=text)
    found = read(spark, to).select("file", "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    found = scratch.store(found, "found")
    if written:
        scratch.drop("files")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    bases = found.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return found.join(bases, "file").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
