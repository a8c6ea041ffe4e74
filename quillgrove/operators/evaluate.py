"""Ranking metrics: ``rankings(query, rank from 1, doc)`` against
``relevance(query, doc, rel)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _gain(rel, rank):
    return rel / F.log2(rank + 1)


def evaluate(rankings: DataFrame, relevance: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Reciprocal rank and, for each k, precision, recall and NDCG of every
    query that has a ranking."""
    wanted = relevance.filter("rel > 0")
    ideal = wanted.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rel"), "doc")))
    best = ideal.groupBy("query").agg(F.count("*").alias("n_rel"), *(F.sum(F.when(F.col("place") <= k, _gain(F.col("rel"), F.col("place"))).otherwise(0.0)).alias(f"ideal{k}") for k in ks))
    hits = rankings.join(wanted, ["query", "doc"], "left")
    hit = F.col("rel").isNotNull()
    sums = [F.coalesce(1 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("rr")]
    for k in ks:
        top = F.col("rank") <= k
        sums += [F.count_if(hit & top).alias(f"hits{k}"), F.sum(F.when(hit & top, _gain(F.col("rel"), F.col("rank"))).otherwise(0.0)).alias(f"dcg{k}")]
    found = hits.groupBy("query").agg(*sums).join(best, "query", "left")
    cols = ["query", "rr"]
    for k in ks:
        cols += [(F.col(f"hits{k}") / k).alias(f"precision_{k}"), F.coalesce(F.col(f"hits{k}") / F.col("n_rel"), F.lit(0.0)).alias(f"recall_{k}"), F.coalesce(F.try_divide(f"dcg{k}", f"ideal{k}"), F.lit(0.0)).alias(f"ndcg_{k}")]
    return found.select(*cols)


def aggregate(results: DataFrame) -> DataFrame:
    """Means over queries; zeros without any."""
    return results.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias("mrr" if c == "rr" else c) for c in results.columns if c != "query"))


def aggregate_common(results: DataFrame) -> DataFrame:
    """Means of ``results(query, rr, k, precision, recall, ndcg)`` for each k
    that every query has; queries may have been cut at different places."""
    total = F.broadcast(results.agg(F.count_distinct("query").alias("_n")))  # one row
    per = results.groupBy("k").agg(F.count_distinct("query").alias("_q"), *(F.avg(c).alias(c) for c in ("precision", "recall", "ndcg")))
    mean = results.select("query", "rr").distinct().agg(F.avg("rr").alias("mrr"))
    return per.crossJoin(total).filter("_q = _n").crossJoin(F.broadcast(mean)).select("k", "mrr", "precision", "recall", "ndcg").orderBy("k")


def latency(events: DataFrame, seconds: str = "ms", ok: str = "ok") -> DataFrame:
    """Count, total, extremes and mean of latencies, and the rate of successes."""
    return events.agg(F.count("*").alias("n"), F.sum(seconds).alias("total"), F.min(seconds).alias("least"), F.max(seconds).alias("most"), F.avg(seconds).alias("mean"), F.avg(F.col(ok).cast("double")).alias("success_rate"))
