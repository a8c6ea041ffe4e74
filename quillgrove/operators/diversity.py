"""Maximal marginal relevance over a bounded list of candidates.  The greedy
choice is sequential by nature, so each query's list (tens of rows) is one
group; queries are spread over the cluster."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from ..storage import ship


def pick_contents(scores: list[float], contents: list[str], k: int, weight: float = 0.7) -> list[int]:
    """Indices chosen: the first, then the best mix of score and novelty (of
    words in lower case)."""
    if len(scores) <= k:
        return list(range(len(scores)))
    words = [set(c.lower().split()) for c in contents]
    chosen, near = [0], [0.0] * len(scores)
    while len(chosen) < k:
        last = words[chosen[-1]]
        best, best_value = -1, float("-inf")
        for i, own in enumerate(words):
            if i in chosen:
                continue
            every = len(own | last)
            near[i] = max(near[i], len(own & last) / every if every else 0.0)
            value = weight * scores[i] + (1 - weight) * (1 - near[i])
            if value > best_value:
                best, best_value = i, value
        chosen.append(best)
    return chosen


def pick_files(scores: list[float], kinds: list[str], k: int, weight: float = 0.6) -> list[int]:
    """Indices chosen: the score against how often a category was chosen before."""
    chosen: list[int] = []
    while len(chosen) < min(k, len(scores)):
        value = lambda i: weight * scores[i] - (1 - weight) * sum(kinds[j] == kinds[i] for j in chosen) / max(len(chosen), 1)
        chosen.append(max((i for i in range(len(scores)) if i not in chosen), key=lambda i: (value(i), -i)))
    return chosen


def _spread(found: DataFrame, query: str, column: str, k: int, weight: float, pick) -> DataFrame:
    ship(found.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable").reset_index(drop=True)
        out = pdf.iloc[pick(pdf["score"].tolist(), pdf[column].fillna("").tolist(), k, weight)].copy()
        out["rank"] = range(len(out))
        return out

    return found.groupBy(query).applyInPandas(run, found.schema)


def content_mmr(found: DataFrame, k: int, query: str = "query", content: str = "content", weight: float = 0.7) -> DataFrame:
    return _spread(found, query, content, k, weight, pick_contents)


def file_mmr(found: DataFrame, k: int, query: str = "query", category: str = "category", weight: float = 0.6) -> DataFrame:
    return _spread(found, query, category, k, weight, pick_files)
