"""Reranking of a short candidate list by any scorer of (query, texts)."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import ship

Scorer = Callable[[str, list[str]], list[float]]


def overlap_scorer(query: str, texts: list[str]) -> list[float]:
    """Share of the query's words that a text holds; needs no service."""
    words = lambda t: set(re.findall(r"[^\W_]+", t.lower()))
    wanted = words(query)
    return [len(wanted & words(t)) / max(len(wanted), 1) for t in texts]


def reranker(scorer: Scorer = overlap_scorer, content: str = "content") -> Callable[[DataFrame, str, int], DataFrame]:
    """``(found, query, n) -> found``: the ``n`` best by the scorer, with its
    scores and new ranks.  Where the scorer fails, the first ``n`` as they are.
    The list is a top-k cut, so it is one group."""

    def apply(found: DataFrame, query: str, n: int) -> DataFrame:
        ship(found.sparkSession)
        columns = found.columns

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("rank", kind="stable")
            try:
                pdf = pdf.assign(score=[float(x) for x in scorer(query, pdf[content].fillna("").tolist())]).sort_values("score", ascending=False, kind="stable")
            except Exception:  # noqa: BLE001  a lost service must not lose the search
                pass
            pdf = pdf.head(n)
            return pdf.assign(rank=range(len(pdf)))[columns]

        return found.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(run, found.schema)

    return apply
