"""Quality classifier: supervised subword embeddings (Joulin et al., 2017).

A document is the mean of the learned vectors of its hashed words, word pairs
and character 3- and 4-grams; a softmax over that mean gives the label.  The
vectors are trained by stochastic gradient descent in numpy on a bounded
sample (``per_class`` documents of each label), drawn by hash order from all
labelled rows.  As the softmax is linear in the mean, a fitted model is one
score a bucket: scoring a text is one pass of gathers over all its bytes.

Edge cases: null and empty texts have no features and get the score of the
bias alone.  Very long texts are scored whole.  A score of exactly one half is
predicted 1.  Of several texts of one labelled document that with the smallest
hash is learned from.  Labels that are null, or of no document, are ignored; of several
labels of a document the smallest counts.  With labels of one class only or
none, every score is that class's share (0.5 without any).  Repeated rows are
scored alike; other columns are never read.  A carried column with the name of
a result gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, extended, fold, ship
from .hashing import BASE, BYTE_BASE, BYTE_CODE, Words, column, mix, raw, slices

BUCKET_BITS = 18
GRAMS = (3, 4)


@dataclass(frozen=True)
class Model:
    scores: np.ndarray  # float32, of each bucket: logit of label 1 over label 0
    bias: float


def buckets(part: pa.Array, bits: int = BUCKET_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(bucket, text)`` of every feature of whole texts, by kind of feature."""
    data, offsets = raw(part)
    shift = np.uint64(64 - bits)
    words = Words(data, offsets)
    hashes = words.hashes()
    text, _ = words.places()
    yield (hashes >> shift).astype(np.int64), text
    pairs = words.whole(2)
    if len(pairs):
        pair = mix(hashes[pairs] + hashes[pairs + 1] * BASE)
        pair[hashes[pairs] == hashes[pairs + 1]] = BASE  # a word said twice is one feature, whatever the word
        yield (pair >> shift).astype(np.int64), text[pairs]
    code = np.where(words.inside, BYTE_CODE[data], BYTE_CODE[32])  # any white space is one boundary
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for n in GRAMS:
        if len(data) < n:
            continue
        h, power = code[: len(data) - n + 1].copy(), int(BYTE_BASE)
        for k in range(1, n):
            h += code[k : len(data) - n + 1 + k] * np.uint64(power)
            power = power * int(BYTE_BASE) % (1 << 64)
        own = owner[: len(h)] == owner[n - 1 :]
        for k in range(1, n - 1):
            own &= words.inside[k : len(h) + k]
        at = np.flatnonzero(own)
        yield (mix(h[at] + np.uint64(n)) >> shift).astype(np.int64), owner[at]


def score(part: pa.Array, model: Model) -> np.ndarray:
    """Probability of label 1 of each text."""
    n = len(part)
    total, count = np.zeros(n), np.zeros(n)
    for bucket, text in buckets(part):
        total += np.bincount(text, model.scores[bucket], n)
        count += np.bincount(text, minlength=n)
    return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + model.bias)))


def train(texts: list[bytes], labels: np.ndarray, dim: int = 16, epochs: int = 5, rate: float = 0.5, seed: int = 1) -> Model:
    """Plain SGD, one document a step, the rate falling linearly to zero."""
    size = 1 << BUCKET_BITS
    labels = np.asarray(labels, int)
    if len(np.unique(labels)) < 2:
        share = float(labels[0]) if len(labels) else 0.5
        return Model(np.zeros(size, np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (size, dim)).astype(np.float32)
    heads, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    bags = []
    for t in texts:
        ids = np.concatenate([b for b, _ in buckets(pa.array([t], pa.binary()))])
        ids, times = np.unique(ids, return_counts=True)
        bags.append((ids, (times / max(times.sum(), 1)).astype(np.float32)))
    step, steps = 0, epochs * len(bags)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            lr = np.float32(rate * (1 - step / steps))
            step += 1
            ids, w = bags[i]
            mean = w @ vectors[ids]
            z = heads @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ heads
            heads -= lr * np.outer(p, mean)
            bias -= lr * p
            # The mean spreads a gradient thinly: its vectors move by share of the text, scaled up.
            vectors[ids] -= (lr * 100 * w)[:, None] * back[None]
    scores = vectors @ (heads[1] - heads[0])
    return Model(scores.astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = 1500, class_bytes: int = 32 << 20) -> Model:
    """Trains on at most ``per_class`` documents of each label, and at most
    ``class_bytes`` of whole texts (one document at least), drawn by hash order
    from the labelled rows of ``docs`` whose ``crc32(key) mod 3`` is not 1."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).alias("y"))
    known = known.filter(fold("k", 3) != 1).join(docs.select(F.col(key).alias("k")), "k", "left_semi")
    drawn = [known.filter(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))  # 2 * per_class rows at most
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t")).join(ids, "k").select("k", "y", "t")
    rows = rows.groupBy("k", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("t")).select("k", "y", "t.t")
    before = Window.partitionBy("y").orderBy(F.xxhash64("k"), "k")  # per_class rows at most
    rows = rows.withColumn("bytes", F.sum(F.coalesce(F.octet_length("t"), F.lit(0))).over(before)).withColumn("nth", F.row_number().over(before))
    rows = rows.filter((F.col("bytes") <= class_bytes) | (F.col("nth") == 1))
    found = rows.select("k", "y", "t").toPandas().sort_values("k")
    order = np.random.default_rng(0).permutation(len(found))
    texts = [bytes(t) if t is not None else b"" for t in found["t"]]
    return train([texts[i] for i in order], found["y"].to_numpy()[order].astype(int))


def quality_classifier(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] | None = None) -> DataFrame:
    """``score`` and ``predicted`` of every document.  With ``carry``, the text
    and those columns come along, so that a filter needs no join."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # 2 ** BUCKET_BITS floats: 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text")
            for i, j in slices(texts, 1_000_000):
                p = score(texts.slice(i, j - i), shared.value)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(len(along))), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*along, "score", "predicted"])

    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *beside(carry or (), "doc_id", "text", "score", "predicted"))
    along = ["doc_id"] if carry is None else source.columns
    return source.mapInArrow(run, extended(source.select(*along).schema, score="double", predicted="int"))
