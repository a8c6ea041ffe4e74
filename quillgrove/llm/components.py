"""Connected components of an edge table, without collecting any of it.

Alternating large-star and small-star steps (Kiveris et al., 2014): each
rewires edges towards smaller vertices until every vertex hangs on the
smallest of its component.  Both steps pre-aggregate before they shuffle, so a
vertex with very many edges is not a hot task; each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", most: int = 60) -> DataFrame:
    """``(node, component)`` of every vertex of ``edges(a, b)``: the smallest
    vertex that it reaches.  Self-loops and repeated edges do no harm."""
    pairs = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = scratch.store(pairs, f"{name}-0")
    before = None
    for i in range(1, most + 1):
        # large-star: every neighbour above a vertex hangs on the vertex's smallest
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: every neighbour below a vertex, and itself, hang on the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        pairs = scratch.store(small.filter("u <> v").distinct(), f"{name}-{i}")
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        scratch.drop(f"{name}-{i - 1}")
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
