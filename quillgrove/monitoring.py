"""Latencies and counters: of tables, of DataFrames as they run, of the driver."""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def latencies(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Count, total, extremes and mean of a duration by operation."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))


def success_rate(rows: DataFrame, by: str, ok: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.col(ok).cast("double")).alias("rate"))


def observed(df: DataFrame, **metrics) -> tuple[DataFrame, Observation]:
    """Counts metrics while ``df`` runs, without another pass: read ``.get``
    after an action."""
    seen = Observation()
    named = metrics or {"rows": F.count(F.lit(1))}
    return df.observe(seen, *(c.alias(k) for k, c in named.items())), seen


class Monitor:
    """The driver's own counters."""

    def __init__(self) -> None:
        self.times: dict[str, list[float]] = defaultdict(list)
        self.counts: dict[str, int] = defaultdict(int)

    def record(self, name: str, seconds: float) -> None:
        self.times[name].append(seconds)

    def count(self, name: str, n: int = 1) -> None:
        self.counts[name] += n

    def rate(self, hits: str, misses: str) -> float:
        total = self.counts[hits] + self.counts[misses]
        return self.counts[hits] / total if total else 0.0

    def summary(self) -> dict[str, dict[str, float]]:
        return {k: {"count": len(v), "total": sum(v), "min": min(v), "max": max(v), "avg": sum(v) / len(v)} for k, v in self.times.items()}

    def timed(self, name: str) -> Callable:
        """Decorates a function: its time is recorded, its failures counted."""

        def wrap(f: Callable) -> Callable:
            @wraps(f)
            def run(*args, **kwargs):
                began = time.perf_counter()
                try:
                    return f(*args, **kwargs)
                except Exception:
                    self.count(f"{name}_failed")
                    raise
                finally:
                    self.record(name, time.perf_counter() - began)

            return run

        return wrap
