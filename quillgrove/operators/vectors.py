"""Exact vector similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; an error where lengths differ."""
    size = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths")).cast("double"))
    both = norm(a) * norm(b)
    return F.coalesce(size, F.when(both == 0, 0.0).otherwise(dot(a, b) / both))


def nearest(table: DataFrame, query: list[float], key: str = "doc", vector: str = "embedding", top_k: int = 50) -> DataFrame:
    """Top rows by cosine: one scan with a bounded heap in each task.  The query
    is a literal whose norm is folded into it at plan time."""
    length = sum(x * x for x in query) ** 0.5
    unit = F.lit([float(x) / length if length else 0.0 for x in query])
    same = F.when(F.size(vector) != len(query), F.raise_error(F.lit("vectors of different lengths")).cast("double"))
    own = norm(F.col(vector))
    score = F.coalesce(same, F.when(own == 0, 0.0).otherwise(dot(F.col(vector), unit) / own))
    found = table.filter(F.col(vector).isNotNull()).select(F.col(key).alias("doc"), score.alias("score"))
    return found.orderBy(F.isnan("score"), F.desc("score"), "doc").limit(top_k)


def fit_dimensions(vector: Column, d: int) -> Column:
    """The first ``d`` values; an error for a shorter vector."""
    return F.when(F.size(vector) < d, F.raise_error(F.lit("vector too short")).cast("array<float>")).otherwise(F.slice(vector, 1, d))
