"""Inverted-file vector search: cells around centroids, few of which are read.

Centroids are fitted on a bounded sample; every vector is indexed, in a table
partitioned by cell, so a search reads the folders of ``probes`` cells only.
Results are approximate; ``vectors.nearest`` is the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import ship
from . import vectors


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(table: DataFrame, cells: int = 64, vector: str = "embedding", key: str = "doc", sample: int = 16_384, rounds: int = 15) -> np.ndarray:
    """Spherical k-means on at most ``sample`` vectors, drawn by key hash."""
    drawn = table.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(vector).collect()
    x = _unit(np.array([r[0] for r in drawn], float).reshape(len(drawn), -1))
    rng = np.random.default_rng(17)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        filled = np.bincount(near, minlength=len(centres)) > 0
        centres = _unit(np.where(filled[:, None], sums, centres))
    return centres


def write(table: DataFrame, centres: np.ndarray, to: str, vector: str = "embedding") -> None:
    """Every row, with its nearest cell, in a table partitioned by cell."""
    ship(table.sparkSession)
    shared = table.sparkSession.sparkContext.broadcast(centres)  # cells x dimensions numbers
    rows = table.filter(F.col(vector).isNotNull())
    at, schema = rows.columns.index(vector), rows.withColumn("cell", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(at).to_pylist(), float).reshape(len(batch), -1)
            cell = (_unit(x) @ shared.value.T).argmax(1).astype(np.int32) if len(batch) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    rows.mapInArrow(run, schema).write.mode("overwrite").partitionBy("cell").parquet(to)


def search(spark: SparkSession, path: str, centres: np.ndarray, query: list[float], key: str = "doc", vector: str = "embedding", top_k: int = 50, probes: int = 8) -> DataFrame:
    """The best rows of the ``probes`` cells nearest to the query."""
    near = np.argsort(-(centres @ np.array(query, float)), kind="stable")[:probes]
    rows = spark.read.parquet(path).filter(F.col("cell").isin(near.tolist()))
    return vectors.nearest(rows, query, key, vector, top_k)
