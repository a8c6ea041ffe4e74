"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

Iterative quantisation (Gong and Lazebnik, 2011) learns, on a bounded sample
of distinct vectors, rotations of the principal axes whose signs are balanced
binary codes.  A code is cut into substrings, each the key of one Hamming
table (Norouzi et al., 2012): codes that differ in fewer bits than there are
tables share a bucket.  Substrings grow with the logarithm of the number of
vectors, so buckets keep their size.  Only codes travel to the tables: what has
no other code within ``limit`` bits in its bucket is dropped there.  The pairs
that are left are reranked by the cosine of the original vectors in double
precision; a pair that shares several tables counts in the first of them only.

Longer substrings miss more links, so tables are added (``TABLES`` to
``MOST_TABLES``), and then substrings shortened, until 99 % of the links are
found in each of ``BANDS`` bands of cosine.  The links held against the tables
exist at any number of vectors: ``ASKED`` vectors are compared with all others
by brute force, and the sample's vectors with copies of them turned by exactly
the least cosine in random directions.  Where the sample is the whole table, or the
tables would compare as many, all pairs are compared.

``limit`` is above the distance of every one of those links too.

Equal vectors are one class, known by 128 bits of hash, and classes carry
their sizes.  Buckets are cut into tiles of ``BLOCK`` by ``BLOCK``; a tile
gives each vector's number of links and a spanning forest of the links, never
the pairs themselves.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
values link with nothing, nor do vectors of different lengths (at most
``WIDTHS`` lengths are told apart; more are an error).  A cosine that ties with
the threshold is a link.  Rows that repeat an id are separate members of their
classes.  An empty table gives an
empty result.  Other columns (labels too) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_group, release, ship, tiles
from .components import components

TABLES, MOST_TABLES = 16, 64
WIDTHS = 64
BANDS, ASKED = 4, 1024
BLOCK = 1024


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Quantiser:
    """Rotations learned for balanced codes; ``keys`` gives table keys."""

    def __init__(self, sample: np.ndarray, bits: int, rounds: int = 40, seed: int = 11):
        self.bits = bits
        rng, sample = np.random.default_rng(seed), _unit(sample)
        self.mean = sample.mean(0)
        centred = sample - self.mean
        _, _, axes = np.linalg.svd(centred, full_matrices=False)
        self.maps = []
        for _ in range(-(-MOST_TABLES * bits // len(axes))):
            x = centred @ axes.T
            turn = np.linalg.qr(rng.normal(size=(len(axes), len(axes))))[0]
            for _ in range(rounds):
                left, _, right = np.linalg.svd(np.where(x @ turn >= 0, 1.0, -1.0).T @ x)
                turn = (left @ right).T
            self.maps.append(axes.T @ turn)
        # Bits in a shuffled order, so that a table mixes the rotations.
        self.maps = np.concatenate([np.zeros((sample.shape[1], 0)), *self.maps], 1)
        self.maps = self.maps[:, rng.permutation(self.maps.shape[1])[: MOST_TABLES * bits]]
        self.tables, self.wide = MOST_TABLES if bits else 1, bits
        self.limit = self.tables * self.wide

    def flags(self, x: np.ndarray) -> np.ndarray:
        """``(vectors, tables, bits)``: the codes, cut for the tables."""
        flags = (_unit(x) - self.mean) @ self.maps[:, : self.tables * self.wide] >= 0
        return flags.reshape(len(x), self.tables, self.wide)[:, :, : self.bits]

    def keys(self, x: np.ndarray, flags: np.ndarray | None = None) -> np.ndarray:
        """``(vectors, tables)``: table number and substring in one integer."""
        flags = self.flags(x) if flags is None else flags
        return flags @ (1 << np.arange(self.bits)) + (np.arange(self.tables) << 40)

    def calibrate(self, sample: np.ndarray, cosine: float, links: tuple[np.ndarray, np.ndarray] | None = None, least: float = 0.99, seed: int = 12) -> None:
        """Takes the fewest tables, and substrings as long as ``MOST_TABLES``
        allow, that find ``least`` of the links in every band of cosine: of
        ``links`` (pairs of vectors), and of ``sample`` with copies turned by
        ``cosine``.  With no bits left every pair is met."""
        x = _unit(sample[:4096])
        aside = np.random.default_rng(seed).normal(size=x.shape)
        aside -= (aside * x).sum(1, keepdims=True) * x
        aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
        low = float(np.clip(cosine, -1, 1))
        pairs = [(x, low * x + np.sqrt(1 - low * low) * aside)]
        if x.shape[1] == 1:
            pairs = []  # there is no direction to turn to
        if links is not None and len(links[0]):
            a, b = map(_unit, links)
            band = bands((a * b).sum(1), cosine)
            pairs += [(a[band == k], b[band == k]) for k in np.unique(band)]
        while pairs and self.bits > 0:
            self.tables = MOST_TABLES
            enough = TABLES
            for a, b in pairs:
                same = self.keys(a) == self.keys(b)
                recall = np.logical_or.accumulate(same, 1).mean(0)  # by number of tables
                enough = max(enough, int(np.searchsorted(recall, least)) + 1)
            if enough <= MOST_TABLES:
                self.tables = enough
                break
            self.bits -= 1
        if self.tables >= 1 << self.bits:  # all pairs are no more than those of the tables
            self.bits, self.tables = 0, 1
        apart = [int((self.flags(a) != self.flags(b)).sum((1, 2)).max(initial=0)) for a, b in pairs]
        self.limit = max(apart, default=0) + self.tables * self.bits // 32 if pairs else self.tables * self.bits


def bands(cosines: np.ndarray, cosine: float) -> np.ndarray:
    """The band, 0 to ``BANDS - 1``, of each cosine from ``cosine`` to 1."""
    return np.clip((cosines - cosine) / max(1 - cosine, 1e-9) * BANDS, 0, BANDS - 1).astype(int)


def _sampled_links(classes: DataFrame, asked: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of ``asked`` vectors among all of ``classes``, found by brute
    force in one pass: of each vector and band of cosine, one drawn by hash."""
    width = asked.shape[1]
    shared = classes.sparkSession.sparkContext.broadcast(_unit(asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best, held = np.full(len(q) * BANDS, np.iinfo(np.int64).max), {}
        for batch in (b.slice(i, 256) for b in batches for i in range(0, len(b), 256)):
            raw, draw = _vectors(batch.column(0), width), batch.column(1).to_numpy()
            near = q @ _unit(raw).T
            a, b = np.nonzero((near >= cosine) & (near < 1 - 1e-12))  # not itself
            place = a * BANDS + bands(near[a, b], cosine)
            order = np.lexsort((draw[b], place))
            first = order[np.unique(place[order], return_index=True)[1]]
            for k in first[draw[b[first]] < best[place[first]]].tolist():
                best[place[k]], held[int(place[k])] = draw[b[k]], raw[b[k]].tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([int(best[k]) for k in held], pa.int64()), pa.array(list(held.values()), pa.binary())], names=["place", "draw", "vec"])

    found = classes.filter(F.col("width") == width).select("vec", F.xxhash64("vec").alias("draw"))
    found = found.mapInArrow(run, "place long, draw long, vec binary").groupBy("place").agg(F.min_by("vec", "draw").alias("vec")).toArrow()
    at = found.column("place").to_numpy() // BANDS  # ASKED * BANDS rows at most
    return asked[at], _vectors(found.column("vec").combine_chunks(), width)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of 4- or 8-byte components, in double precision."""
    blob = b"".join(column.to_pylist())
    kind = np.float32 if len(blob) == 4 * len(column) * width else np.float64
    return np.frombuffer(blob, kind).reshape(len(column), width).astype(np.float64)


def _signs(column: pa.Array) -> np.ndarray:
    """Codes as rows of 1 and -1 (padding, alike everywhere, included)."""
    codes = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1


def _prune(limits: dict[int, int]):
    """The rows of a tile that have another code within the limit."""

    def run(group: pa.RecordBatch) -> pa.RecordBatch | None:
        if len(group) < 2:
            return None
        names = group.schema.names
        asks, member = (group.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("asks", "member"))
        signs = _signs(group.column(names.index("code")))
        q, m = np.flatnonzero(asks), np.flatnonzero(member)
        least = signs.shape[1] - 2 * limits[int(group.column(names.index("key"))[0].as_py()) >> 48]
        near = signs[q] @ signs[m].T >= least
        near &= q[:, None] != m[None]
        use = np.zeros(len(group), bool)
        use[q[near.any(1)]] = use[m[near.any(0)]] = True
        return group.filter(pa.array(use)) if use.any() else None

    return run


def _links(percent: float, shapes: dict[int, tuple[int, int]]):
    """Of a tile: each asking vector's number of links, and forest edges."""

    def run(group: pa.RecordBatch) -> pa.RecordBatch | None:
        if len(group) < 2:
            return None
        names = group.schema.names
        rep, size, asks, member = (group.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("rep", "size", "asks", "member"))
        vec, key = group.column(names.index("vec")), int(group.column(names.index("key"))[0].as_py())
        table, (tables, bits) = key >> 40 & 0xFF, shapes[key >> 48]
        codes = np.frombuffer(b"".join(group.column(names.index("code")).to_pylist()), np.uint8).reshape(len(group), -1)
        keys = np.unpackbits(codes, axis=1)[:, : tables * bits].reshape(len(group), tables, bits) @ (1 << np.arange(bits))
        x = _unit(_vectors(vec, key >> 48))
        q, m = np.flatnonzero(asks), np.flatnonzero(member)
        near = x[q] @ x[m].T
        a, b = np.nonzero(near >= percent - 1e-9)
        close = near[a, b] < percent + 1e-9  # so close to the threshold that the order of summing may decide
        a, b = q[a], m[b]
        fresh = a != b
        for i in np.flatnonzero(close & fresh).tolist():
            fresh[i] = float((x[a[i]] * x[b[i]]).sum()) >= percent
        for t in range(table):
            fresh &= keys[a, t] != keys[b, t]
        a, b = a[fresh], b[fresh]
        if not len(a):
            return None
        count = np.bincount(a, size[b], len(group)).astype(np.int64)
        root = np.arange(len(group))  # labels: the row of the smallest id reached
        order = np.argsort(rep, kind="stable")
        rank = np.empty(len(group), np.int64)
        rank[order] = np.arange(len(group))
        label = rank.copy()
        while True:
            new = label.copy()
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, b, label[a])
            if (new == label).all():
                break
            label = new
        root = order[label]
        use = np.flatnonzero((count > 0) | (root != np.arange(len(group))))
        return pa.RecordBatch.from_arrays([pa.array(rep[use]), pa.array(count[use]), pa.array(rep[root[use]])], names=["rep", "n", "root"])

    return run


def embedding_dedup(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, sample: int = 8192) -> DataFrame:
    """``n_links``, ``component_id`` and ``kept`` of every vector.  ``sample``
    distinct vectors, drawn by hash order, fit the quantiser."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "vectors")

    kind = dict(vectors.dtypes)[vector]
    kind = np.float32 if kind == "array<float>" else np.float64

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, width = [], []
            for v in batch.column(1):
                x = v.values if v.is_valid else None
                x = None if x is None or x.null_count or not len(x) else x.to_numpy(zero_copy_only=False).astype(kind)
                ok = x is not None and bool(np.isfinite(x).all()) and bool(x.any())
                blobs.append(x.tobytes() if ok else None)
                width.append(len(x) if ok else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary()), pa.array(width, pa.int32())], names=["vec_id", "vec", "width"])

    every = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("embedding")).mapInArrow(read, "vec_id long, vec binary, width int")
    same = ["h", "g", "width"]  # an equal vector's hashes
    every = scratch.store(every.select("vec_id", "vec", "width", F.xxhash64("vec").alias("h"), F.xxhash64(F.lit(1), "vec").alias("g")), "every")
    classes = every.filter("width > 0").groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("vec").alias("vec"))
    classes = scratch.store(classes.filter("rep is not null").withColumn("cid", F.monotonically_increasing_id()), "classes")
    every = scratch.store(every.drop("vec"), "ids")
    scratch.drop("every")
    release(spark)
    total = classes.count()
    bits = int(np.clip(np.ceil(np.log2(max(total, 2))) - 6, 8, 32))
    widths = [r["width"] for r in classes.select("width").distinct().limit(WIDTHS + 1).collect()]
    if len(widths) > WIDTHS:
        raise ValueError(f"vectors of more than {WIDTHS} lengths")
    fitted = {}
    for w in widths:
        drawn = classes.filter(F.col("width") == w).orderBy(F.xxhash64("vec")).limit(sample).select("vec").toArrow().column(0)
        known = _vectors(drawn.combine_chunks(), w)
        if len(known) < sample:  # the whole table
            fitted[w] = Quantiser(known, 0)
            continue
        fit, apart = known[::2], known[1::2]  # codes suit the vectors that they were fitted to better than others
        fitted[w] = Quantiser(fit, bits)
        fitted[w].calibrate(apart, cosine, _sampled_links(classes, apart[:ASKED], cosine))
    shared = spark.sparkContext.broadcast(fitted)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column(1).to_numpy()
            keys, codes = [None] * len(batch), [None] * len(batch)
            for w in np.unique(width).tolist():
                own = np.flatnonzero(width == w)
                x, model = _vectors(batch.column(0).take(pa.array(own)), w), shared.value[w]
                flags = model.flags(x)
                found = model.keys(x, flags) + (w << 48)
                packed = np.packbits(flags.reshape(len(x), -1), axis=1)
                for n, k in enumerate(own.tolist()):
                    keys[k], codes[k] = found[n], packed[n].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(codes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["rep", "code", "keys"])

    coded = classes.select("vec", "width", "cid").mapInArrow(code, "rep long, code binary, keys array<long>")
    coded = scratch.store(coded, "coded")
    rows = coded.select(F.explode("keys").alias("key"), "rep", "code")
    big = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
    big = scratch.store(big.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "big")
    release(spark)
    blocks = F.coalesce("blocks", F.lit(1))
    rows = rows.join(big, "key", "left").select("key", "rep", "code", blocks.alias("blocks"), blocks.alias("ask_blocks"), F.lit(True).alias("asks"), F.lit(True).alias("member"))
    dealt = tiles(rows, "key", "blocks", "asks", "member", "ask_blocks")
    rest = by_group(dealt, ["key", "tile"], _prune({w: m.limit for w, m in fitted.items()}), dealt.schema)
    rest = scratch.store(rest, "rest")
    release(spark)
    near = rest.join(classes.select(F.col("cid").alias("rep"), "size", "vec"), "rep").select("key", "tile", "rep", "size", "asks", "member", "code", "vec")
    found = by_group(near, ["key", "tile"], _links(cosine, {w: (m.tables, m.bits) for w, m in fitted.items()}), "rep long, n long, root long")
    found = scratch.store(found, "found")
    scratch.drop("coded", "big", "rest")
    release(spark)
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch).withColumnRenamed("node", "cid")
    links = found.groupBy(F.col("rep").alias("cid")).agg(F.sum("n").alias("n"))
    known = classes.select("cid", "rep", "size", *same).join(links, "cid", "left").join(parts, "cid", "left")
    known = scratch.store(known, "linked")
    least = known.filter("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    known = known.join(least, "component", "left")
    known = scratch.store(known.select(*same, (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("least", "rep").alias("least")), "known")
    scratch.drop("classes", "found", "linked")
    out = every.join(known, same, "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
