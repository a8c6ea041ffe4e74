"""Near-duplicate detection by min-max hashing (Ji et al., 2013).

Each of ``PERMS`` hash permutations of a document's shingle set gives two
signature values, its minimum and its maximum, so a signature of
``2 * PERMS`` values costs ``PERMS`` evaluations a shingle; the pair of values
estimates the Jaccard similarity without bias and with less variance than two
independent minima.  Signatures are cut into ``BANDS`` bands of two minima and
two maxima; documents that share a band are candidates.  A pair of similarity
0.85 is missed by all bands with probability 7e-6, and less above.

1. Documents with equal sets are one class, known by its smallest key.
2. In each band bucket, every class is paired with the bucket's smallest key;
   pairs whose sketches agree are confirmed on the full sets, and the links'
   components computed.  Copies of one text become one component here.
3. Buckets that still hold several components are settled exactly: every
   member outside the bucket's largest component is held against all members,
   in tiles of ``BLOCK`` by ``BLOCK``, first by sketches (8 bits of every signature value),
   then by full sets.  Only pairs between components are looked at, and only
   one link to a component is kept, so rows stay linear in the bucket.
4. Components are computed again over the links of both steps.

The sketch test passes pairs whose estimate is within 4.5 standard errors of
the threshold.

Edge cases: null texts and texts without words have empty sets and link with
nothing, not with each other.  Fewer than five words make one shingle.  Very
long texts are taken whole, one at a time.  A similarity that ties with the
threshold is a link; of equals the smallest key is kept.  Rows
that repeat a key count as separate members of their class and get that key's
component.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_group, release, ship, tiles
from .components import components
from .hashing import Words, column, mix, raw, slices, windows

SHINGLE = 5
PERMS = 32
BANDS = PERMS // 2
BLOCK = 256
_ODD = (mix(np.arange(1, PERMS + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)).tolist()
_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingle_sets(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, first)``: text ``i`` has the sorted distinct 64-bit shingle
    hashes ``hashes[first[i]:first[i + 1]]``."""
    words = Words(*raw(part))
    hashes = words.hashes(lower=True)
    own, _ = words.places()
    at = words.whole(SHINGLE)
    value, text = mix(windows(hashes, SHINGLE)[at]), own[at]
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    if len(short):
        few = [mix(windows(hashes[a:b], b - a) + np.uint64(b - a))[0] for a, b in zip(words.first[short], words.first[short + 1], strict=True)]
        value, text = np.concatenate([value, np.array(few, np.uint64)]), np.concatenate([text, short])
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    return value, np.searchsorted(text, np.arange(len(part) + 1))


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``(texts with a set, 2 * PERMS)``: minima, then maxima."""
    begin = first[:-1][np.diff(first) > 0]
    out = np.empty((2 * PERMS, len(begin)), np.uint64)
    for k, odd in enumerate(_ODD):
        x = hashes * np.uint64(odd)
        x ^= x >> np.uint64(32)
        out[k], out[PERMS + k] = np.minimum.reduceat(x, begin), np.maximum.reduceat(x, begin)
    return out.T


def band_keys(found: np.ndarray) -> np.ndarray:
    """``(texts, BANDS)``: one hash for each band of two minima and two maxima."""
    out = np.empty((len(found), BANDS), np.uint64)
    for b in range(BANDS):
        a, c, d, e = (mix(found[:, k]) for k in (2 * b, 2 * b + 1, PERMS + 2 * b, PERMS + 2 * b + 1))
        out[:, b] = mix(a + np.uint64(3) * c + np.uint64(5) * d + np.uint64(7) * e + _SALT[b])
    return out


_FEATURES = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, keys = column(batch, "text"), batch.column(0)
        for i, j in slices(texts, 1_000_000):
            hashes, first = shingle_sets(texts.slice(i, j - i))
            sizes = np.diff(first)
            has = np.flatnonzero(sizes)
            a, b = np.zeros((2, j - i), np.uint64)
            bands, sketch = [None] * (j - i), [None] * (j - i)
            if len(has):
                begin = first[:-1][has]
                a[has] = mix(np.add.reduceat(hashes, begin))
                b[has] = mix(np.add.reduceat(mix(hashes ^ _SALT[0]), begin))
                found = signatures(hashes, first)
                rows, low = band_keys(found).view(np.int64), (mix(found) >> np.uint64(56)).astype(np.uint8)
                for n, k in enumerate(has.tolist()):
                    bands[k], sketch[k] = rows[n], low[n].tobytes()
            yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), pa.array(sizes.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = column(batch, "text")
        for i, j in slices(texts):
            hashes, first = shingle_sets(texts.slice(i, j - i))
            out = [hashes[a:b].tobytes() for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(out, pa.binary())], names=["rep", "shingles"])


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches ``percent``."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * same >= percent * (len(x) + len(y) - same)


def _least(percent: int) -> int:
    """Sketch values that must agree."""
    j, n = percent / 100, 2 * PERMS
    return int(np.floor(n * (j - 4.5 * np.sqrt(j * (1 - j) / n))))


def _alike(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """``(x, y)`` pairs whose sizes and sketches allow a link."""
    out = np.minimum(n[:, None], m[None]) * 100 >= percent * np.maximum(n[:, None], m[None])
    for i in range(len(x)):
        out[i] &= (x[i][None] == y).sum(1) >= _least(percent)
    return out


def _close(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            x, y = (_matrix(batch.column(names.index(c)).to_pylist()) for c in ("s_a", "s_b"))
            ok = pa.array((x == y).sum(1) >= _least(percent))
            yield pa.RecordBatch.from_arrays([batch.column(names.index("a")), batch.column(names.index("b"))], names=["a", "b"]).filter(ok)

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = pa.array([linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(ok)

    return run


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)


def _columns(group: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [group.column(group.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in names]


def _pairs(group: pa.RecordBatch, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of a tile: each asking row, and the members of other components that
    sizes and sketches allow it to link with."""
    n, comp, asks, member = _columns(group, "n", "comp", "asks", "member")
    sketch = _matrix(group.column(group.schema.names.index("sketch")).to_pylist())
    m = np.flatnonzero(member)
    for i in np.flatnonzero(asks).tolist():
        ok = _alike(sketch[i : i + 1], sketch[m], n[i : i + 1], n[m], percent)[0] & (comp[m] != comp[i])
        if ok.any():
            yield i, m[ok]


def _prune(percent: int):
    """The rows of a tile that have a pair to look at."""

    def run(group: pa.RecordBatch) -> pa.RecordBatch | None:
        if len(group) < 2:
            return None
        use = np.zeros(len(group), bool)
        for i, found in _pairs(group, percent):
            use[i] = use[found] = True
        return group.filter(pa.array(use)) if use.any() else None

    return run


def _settle(percent: int):
    """Of a tile: one link from each asking row to each other component."""

    def run(group: pa.RecordBatch) -> pa.RecordBatch | None:
        rep, comp = _columns(group, "rep", "comp")
        blobs, out = group.column(group.schema.names.index("shingles")), []
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in blobs]
        for i, found in _pairs(group, percent):
            done: set[int] = set()
            for k in found.tolist():
                if comp[k] not in done and linked(sets[i], sets[k], percent):
                    done.add(comp[k])
                    out.append((rep[i], rep[k]))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """``n_shingles``, ``component_id`` and ``kept`` of every document: links
    have Jaccard similarity ``percent`` / 100 or more of their shingle sets."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "near")
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    every = scratch.store(source.mapInArrow(_features, _FEATURES), "every")
    same = ["n_shingles", "set_a", "set_b"]
    classes = every.filter("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = scratch.store(classes.withColumnRenamed("n_shingles", "n"), "classes")

    # 2. each class against the smallest of each bucket
    keys = classes.select(F.explode("bands").alias("key"), "rep")
    shared = keys.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("size")).filter("size > 1")
    shared = scratch.store(shared, "shared")
    buckets = scratch.store(keys.join(shared, "key"), "buckets")
    inside = scratch.store(buckets.select("rep").distinct(), "inside")
    known = scratch.store(classes.select("rep", "n", "sketch").join(inside, "rep"), "known")
    release(spark)
    texts = source.withColumnRenamed("doc_id", "rep")
    # one plan at every size: the texts go to the classes that share a bucket
    sets = texts.join(inside.hint("merge"), "rep", "left_semi").mapInArrow(_sets, "rep long, shingles binary")
    sets = scratch.store(sets, "sets")
    release(spark)
    pairs = scratch.store(buckets.filter("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    one, two = (known.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in "ab")
    close = pairs.join(two, "b").join(one, "a").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    close = scratch.store(close.mapInArrow(_close(percent), "a long, b long"), "close")
    one, two = (sets.select(F.col("rep").alias(c), F.col("shingles").alias(f"x_{c}")) for c in "ab")
    links = scratch.store(close.join(two, "b").join(one, "a").select("a", "b", "x_a", "x_b").mapInArrow(_confirm(percent), "a long, b long"), "links")
    parts = components(links, scratch, "first")
    release(spark)

    # 3. buckets with several components, exactly
    members = buckets.select("key", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    members = scratch.store(members, "members")
    counts = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("size"), F.max("n").alias("most"), F.count("*").alias("comps")).filter("comps > 1")
    in_blocks = lambda n, name: F.ceil(n / BLOCK).cast("int").alias(name)
    mixed = scratch.store(mixed.select("key", "main", in_blocks(F.col("size"), "blocks"), in_blocks(F.col("size") - F.col("most"), "ask_blocks")), "mixed")
    open_ = members.join(mixed, "key").join(known, "rep").select("key", "rep", "comp", "n", "sketch", "main", "blocks", "ask_blocks")
    open_ = scratch.store(open_, "open")
    asks = open_.select("key", "rep", "comp", "n", "sketch", "blocks", "ask_blocks", (F.col("comp") != F.col("main")).alias("asks"), F.lit(True).alias("member"))
    dealt = tiles(asks, "key", "blocks", "asks", "member", "ask_blocks")
    rest = scratch.store(by_group(dealt, ["key", "tile"], _prune(percent), dealt.schema), "rest")
    more = by_group(rest.join(sets, "rep").select(*rest.columns, "shingles"), ["key", "tile"], _settle(percent), "a long, b long")
    more = scratch.store(more, "more")

    # 4. all links
    release(spark)
    parts = scratch.store(components(links.unionByName(more), scratch, "second"), "parts")
    found = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    found = scratch.store(found.select(F.col("n").alias("n_shingles"), "set_a", "set_b", F.coalesce("component", "rep").alias("component")), "found")
    scratch.drop("shared", "buckets", "inside", "known", "sets", "pairs", "close", "links", "members", "mixed", "open", "rest", "more", "parts", "classes")
    id_ = F.coalesce("component", "doc_id")
    return every.select("doc_id", *same).join(found, same, "left").select("doc_id", "n_shingles", id_.alias("component_id"), (F.col("doc_id") == id_).alias("kept"))


#: The same rows in DuckDB, through an inverted index of shingles.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS x FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), h AS (
  SELECT x, list(doc_id ORDER BY doc_id) AS ids FROM s GROUP BY x HAVING count(*) > 1
), p AS (
  SELECT a, b, count(*) AS same FROM (SELECT unnest(ids) AS a, ids FROM h), unnest(ids) t(b) WHERE a < b GROUP BY a, b
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 85 * (x.n + y.n - same)
), both_ways AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, b FROM r JOIN both_ways ON a = seen
), c AS (
  SELECT node, min(seen) AS component_id FROM r GROUP BY node
)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON node = doc_id
"""
