"""Embedding behind one interface: texts in, vectors out.

The default provider needs no network: it hashes code tokens into a signed
bag of features.  Others are any ``list[str] -> list[list[float]]``.
"""

from __future__ import annotations

import logging
import re
import time
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import few_rows, ship

log = logging.getLogger(__name__)
Provider = Callable[[list[str]], list[list[float]]]
MAX_CHARS, BATCH = 50_000, 100


def hashing_provider(dimensions: int = 64) -> Provider:
    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimensions))
        for row, text in zip(out, texts, strict=True):
            words = re.findall(r"[^\W_]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", text))
            h = np.array([zlib.crc32(w.lower().encode()) for w in words], np.int64)
            row[:] = np.bincount(h % dimensions, np.where(h >> 31, 1.0, -1.0), dimensions)
            row /= max(float(np.linalg.norm(row)), 1e-12)
        return out.tolist()

    return embed


def embed_one(text: str, provider: Provider) -> list[float]:
    if not text.strip() or len(text) > MAX_CHARS:
        raise ValueError(f"a text has 1 to {MAX_CHARS} characters")
    return provider([text])[0]


def parts(text: str) -> list[str]:
    """The whole text in pieces of at most ``MAX_CHARS``, cut after white space
    where the second half of a piece has any."""
    out, at = [], 0
    while len(text) - at > MAX_CHARS:
        end = at + MAX_CHARS
        cut = next((i for i in range(end, end - MAX_CHARS // 2, -1) if text[i - 1].isspace()), end)
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def _combined(vectors: list[list[float]], sizes: list[int]) -> list[float]:
    """One vector for the pieces of a text: their mean by number of characters,
    as long as the pieces' vectors are on average."""
    if len(vectors) == 1:
        return vectors[0]
    x, share = np.array(vectors, float), np.array(sizes, float) / sum(sizes)
    mean = share @ x
    return (mean * (share @ np.linalg.norm(x, axis=1)) / max(float(np.linalg.norm(mean)), 1e-12)).tolist()


def by_call(texts: list[str], most: int = BATCH, most_chars: int | None = None) -> Iterator[list[str]]:
    """Texts by calls: at most ``most`` of them and ``most_chars`` characters.  A
    text that alone has more is an error."""
    held, size = [], 0
    for t in texts:
        if most_chars is not None and len(t) > most_chars:
            raise ValueError(f"a text of {len(t)} characters exceeds the batch limit of {most_chars}")
        if held and (len(held) == most or (most_chars is not None and size + len(t) > most_chars)):
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def choose_provider(wanted: str, offered: dict[str, Callable[[], Provider]], fallback: str) -> tuple[str, Provider]:
    """The wanted provider if it is offered and answers a probe with a vector,
    else the fallback, which isn't probed."""
    name = wanted.strip().lower()
    if name in offered and name != fallback:
        try:
            provider = offered[name]()
            if len(probe := provider(["test"])) == 1 and len(probe[0]) > 0:
                return name, provider
            log.warning("embedding provider %s gave no vector", name)
        except Exception:  # whatever a remote service raises
            log.warning("embedding provider %s is not available", name, exc_info=True)
    return fallback, offered[fallback]()


def with_embedding(rows: DataFrame, content: str, provider: Provider, most_chars: int | None = None) -> DataFrame:
    """Adds ``embedding`` of a text column, a batch of texts a call (of at most
    ``most_chars`` characters, where the provider has a limit).  Texts of
    more than ``MAX_CHARS`` characters go to the provider in pieces."""
    ship(rows.sparkSession)
    at = rows.columns.index(content)
    schema = rows.select("*", F.lit(None).cast("array<float>").alias("embedding")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            cut = [parts(t or "") for t in batch.column(at).to_pylist()]
            texts = [p for ps in cut for p in ps]
            made = iter([v for part in by_call(texts, BATCH, most_chars) for v in provider(part)])
            found = [_combined([next(made) for _ in ps], [len(p) for p in ps]) for ps in cut]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float32()))], names=[*batch.schema.names, "embedding"])

    return rows.mapInArrow(run, schema)


def memoised(rows: DataFrame, content: str, provider: Provider, known: DataFrame | None, version: str = "1") -> tuple[DataFrame, DataFrame]:
    """``with_embedding`` that embeds each distinct text once, and none that
    ``known(digest, embedding)`` has.  Also returns the table of what is known
    after it.  ``version`` names the provider's behaviour."""
    keyed = rows.withColumn("_digest", F.sha2(F.concat(F.lit(version + "\0"), F.coalesce(content, F.lit(""))), 256))
    new = keyed.groupBy("_digest").agg(F.first(content).alias("_text"))
    if known is not None:
        new = new.join(known.select(F.col("digest").alias("_digest")), "_digest", "left_anti")
    made = with_embedding(new, "_text", provider).select(F.col("_digest").alias("digest"), "embedding")
    every = made if known is None else known.select("digest", "embedding").unionByName(made)
    return keyed.join(every.withColumnRenamed("digest", "_digest"), "_digest").drop("_digest"), every


class QueryCache:
    """The driver's vectors of recent queries: least recently used go first,
    and all go after ``ttl`` seconds."""

    def __init__(self, provider: Provider, most: int = 1000, ttl: float = 3600.0, clock: Callable[[], float] = time.monotonic):
        self.provider, self.most, self.ttl, self.clock = provider, most, ttl, clock
        self.held: OrderedDict[str, tuple[float, list[float]]] = OrderedDict()
        self.hits = self.misses = 0

    def __call__(self, text: str) -> list[float]:
        at, found = self.held.get(text, (0.0, None))
        if found is not None and self.clock() - at < self.ttl:
            self.hits += 1
            self.held.move_to_end(text)
            return found
        self.misses += 1
        found = embed_one(text, self.provider)
        self.held[text] = (self.clock(), found)
        self.held.move_to_end(text)
        while len(self.held) > self.most:
            self.held.popitem(last=False)
        return found
