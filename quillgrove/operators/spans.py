"""Intervals and lines: merging, budgets, extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(spans: DataFrame, gap: int = 0, group: str = "filename", start: str = "line_start", end: str = "line_end") -> DataFrame:
    """Merges spans of a group that are at most ``gap`` apart."""
    by = Window.partitionBy(group).orderBy(start, end)
    before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.select(group, start, end, F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0).alias("_new"))
    islands = marked.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(group, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def budget(rows: DataFrame, most: int, size: str, order: list, group: str | None = None) -> DataFrame:
    """Rows in ``order`` while their running size is within ``most``."""
    by = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy(*order)
    total = F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", total).filter(F.col("used") <= most)


def extract_lines(files: DataFrame, first: int | Column, last: int | Column, limit: int | None = None, content: str = "content") -> DataFrame:
    """``code, end, n_lines, truncated`` of lines ``first`` to ``last``.  Whole
    lines are taken while their bytes fit; a first line that doesn't is cut by
    characters.  Row by row, so nothing is shuffled."""
    text, first, last = F.col(content), F.lit(first), F.lit(last)
    ends = text.endswith("\n")
    pieces = F.split(text, "\n", -1)
    pieces = F.when(ends, F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    n = F.when(text == "", 0).otherwise(F.size(pieces))
    lines = F.transform(pieces, lambda x, i: F.when((i < F.size(pieces) - 1) | ends, F.concat(x, F.lit("\n"))).otherwise(x))
    wanted = F.slice(lines, first, F.greatest(last - first + 1, F.lit(0)))
    bad = F.when(first > F.greatest(n, F.lit(1)), F.raise_error(F.lit("first line is beyond the file")).cast("string"))
    state = F.struct(F.lit("").alias("code"), F.lit(0).alias("count"), F.lit(False).alias("full"))
    most = F.lit(limit if limit is not None else 1 << 30)

    def add(s, x):
        fits = F.octet_length(s.code) + F.octet_length(x) <= most
        cut = F.struct(F.when(s["count"] == 0, F.substring(x, F.lit(1), most)).otherwise(s.code).alias("code"), F.when(s["count"] == 0, 1).otherwise(s["count"]).alias("count"), F.lit(True).alias("full"))
        return F.when(s.full, s).when(fits, F.struct(F.concat(s.code, x).alias("code"), (s["count"] + 1).alias("count"), F.lit(False).alias("full"))).otherwise(cut)

    got = files.withColumn("_s", F.aggregate(wanted, state, add)).withColumn("_n", n)
    end = first + F.col("_s.count") - 1
    return got.select(*files.columns, F.coalesce(bad, F.col("_s.code")).alias("code"), end.alias("end"), F.col("_n").alias("n_lines"), (F.col("_s.full") | (last > F.col("_n"))).alias("truncated"))
