"""Cover-density ranking (Clarke, Cormack and Tudhope, 2000): documents that
hold more of the query's terms come first; among equals, the shorter and the
more frequent the passages that hold all those terms, the better."""

from __future__ import annotations

from collections.abc import Hashable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import few_rows, ship

FULL = 16  # words: a cover up to this length counts one


def covers(words: list[str], wanted: set[str]) -> list[tuple[int, int]]:
    """Shortest passages ``[first, last]`` that hold every wanted word and no
    smaller such passage."""
    return covers_at([(i, w) for i, w in enumerate(words) if w in wanted], len(wanted))


def covers_at(held: list[tuple[int, Hashable]], n: int) -> list[tuple[int, int]]:
    """``covers`` of the places of wanted words, of which there are ``n``."""
    last: dict[Hashable, int] = {}
    out: list[tuple[int, int]] = []
    for i, w in held:
        last.pop(w, None)
        last[w] = i  # in the order of the latest places: the first one is the oldest
        if len(last) == n:
            a = next(iter(last.values()))
            if out and out[-1][0] == a:
                continue  # as long as the one before, or longer
            out.append((a, i))
    return out


def cover_density(docs: DataFrame, tokens: list[str], key: str = "doc", content: str = "content", top_k: int = 10, full: int = FULL) -> DataFrame:
    """``(doc, level, score)``: terms held, and the sum over covers.  Python
    sees the places of the terms in the documents that hold any, no other word."""
    from . import lexical

    ship(docs.sparkSession)
    wanted = sorted({t.lower() for t in tokens})
    if not wanted:
        return docs.select(F.col(key).alias("doc"), F.lit(0).alias("level"), F.lit(0.0).alias("score")).limit(0)
    matching = docs.filter(lexical.matches(F.col(content), wanted)).select(F.col(key).alias("doc"), T.word_tokens(F.col(content)).alias("tokens"))
    which = lambda x: F.array_position(F.lit(wanted), x).cast("int")
    places = F.filter(F.transform("tokens", lambda x, i: F.struct(i.alias("i"), which(x).alias("w"))), lambda p: p["w"] > 0)
    held = matching.select("doc", places.alias("places")).select("doc", F.col("places.i").alias("i"), F.col("places.w").alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            levels, scores = [], []
            for places, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                levels.append(len(set(words)))
                scores.append(sum(min(1.0, full / (b - a + 1)) for a, b in covers_at(list(zip(places, words, strict=True)), levels[-1])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(levels, pa.int32()), pa.array(scores, pa.float64())], names=["doc", "level", "score"])

    kind = dict(held.dtypes)["doc"]
    return held.mapInArrow(run, f"doc {kind}, level int, score double").orderBy(F.desc("level"), F.desc("score"), "doc").limit(top_k)
