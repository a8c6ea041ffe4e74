"""Call graphs: edges between symbols with a confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored

LEVEL = 0.7


def resolve(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """The symbol that a call names: of the same file (1.0); a member of the
    object's class (1.0); any public symbol of that name, those in files named
    so first (0.7); else none (0.5).  ``calls``: call_id, file, name, object."""
    s = symbols.select("symbol_id", "filename", "symbol_name", "line_start", "parent_symbol", "visibility")
    # aggregates, combined before the shuffle: a name that very many symbols have is no hot task
    first = lambda rows, by, order: rows.groupBy(*by).agg(F.min(F.struct(*order, "symbol_id")).alias("_s"))
    same = first(s, ["filename", "symbol_name"], ["line_start"]).select(F.col("filename").alias("file"), F.col("symbol_name").alias("name"), F.col("_s.symbol_id").alias("s1"))
    member = first(s.filter("parent_symbol is not null"), ["symbol_name", "parent_symbol"], ["filename", "line_start"]).select(F.col("symbol_name").alias("name"), F.col("parent_symbol").alias("object"), F.col("_s.symbol_id").alias("s2"))
    named = F.when(F.lower("filename").contains(F.lower("symbol_name")), 0).otherwise(1)
    public = first(s.filter("visibility = 'public'").withColumn("_named", named), ["symbol_name"], ["_named", "filename", "line_start"]).select(F.col("symbol_name").alias("name"), F.col("_s.symbol_id").alias("s3"))
    found = calls.join(same, ["file", "name"], "left").join(member, ["name", "object"], "left").join(public, "name", "left")
    sure = F.coalesce("s1", "s2")
    return found.select("call_id", F.coalesce(sure, "s3").alias("symbol_id"), F.when(sure.isNotNull(), 1.0).when(F.col("s3").isNotNull(), 0.7).otherwise(0.5).alias("confidence"))


_ORDER = [F.desc, F.asc_nulls_last, F.asc_nulls_last]


def _ordered(edges: DataFrame, limit: int | None) -> DataFrame:
    out = edges.orderBy(F.desc("confidence"), F.asc_nulls_last("source_file"), F.asc_nulls_last("source_line"))
    return out.limit(limit) if limit is not None else out


def callers(edges: DataFrame, target: str, level: float = LEVEL, limit: int | None = None) -> DataFrame:
    return _ordered(edges.filter((F.col("target") == target) & (F.col("confidence") >= level)), limit)


def callees(edges: DataFrame, source: str, level: float = LEVEL, limit: int | None = None) -> DataFrame:
    return _ordered(edges.filter((F.col("source") == source) & F.col("target").isNotNull() & (F.col("confidence") >= level)), limit)


def trace(edges: DataFrame, root: str, depth: int = 5, level: float = LEVEL) -> DataFrame:
    """``(symbol, depth)`` called from ``root``."""
    return chain(edges, root, depth, level).select("symbol", "depth")


def chain(edges: DataFrame, root: str, depth: int = 5, level: float = LEVEL, callees: bool = True) -> DataFrame:
    """``(symbol, depth, edge_type)`` called from ``root`` (or calling it),
    nearest first; nodes at the full depth are not given.  A node's type is
    that of its first edge onward by type, ``calls`` if it has none."""
    near, far = ("source", "target") if callees else ("target", "source")
    sure = edges.filter((F.col("confidence") >= level) & F.col("target").isNotNull()).select(F.col(near).alias("source"), F.col(far).alias("target"), F.col("edge_type") if "edge_type" in edges.columns else F.lit(None).cast("string").alias("edge_type"))
    links = stored(sure.groupBy("source", "target").agg(F.min("edge_type").alias("edge_type")), "calls")
    seen = edges.sparkSession.createDataFrame([(root, 0)], "symbol string, depth int")
    front = seen
    for d in range(1, depth):
        front = links.drop("edge_type").join(front.select(F.col("symbol").alias("source")), "source").select(F.col("target").alias("symbol")).distinct().join(seen.select("symbol"), "symbol", "left_anti")
        front = stored(front.withColumn("depth", F.lit(d)), "front")
        if not front.limit(1).count():
            break
        seen = stored(seen.unionByName(front), "trace")
    kinds = links.groupBy(F.col("source").alias("symbol")).agg(F.min("edge_type").alias("edge_type"))
    return seen.filter("depth > 0").join(kinds, "symbol", "left").select("symbol", "depth", F.coalesce("edge_type", F.lit("calls")).alias("edge_type"))


def references(edges: DataFrame, symbols: DataFrame, name: str, level: float = 0.5) -> DataFrame:
    """Definitions and calls of a name, by file and line."""
    made = symbols.filter(F.col("symbol_name") == name).select("filename", F.col("line_start").alias("line"), F.lit("definition").alias("kind"), F.lit(1.0).alias("confidence"))
    used = edges.filter((F.col("target") == name) & (F.col("confidence") >= level)).select(F.col("source_file").alias("filename"), F.col("source_line").alias("line"), F.lit("call").alias("kind"), "confidence")
    return made.unionByName(used).orderBy("filename", "line")


def usage(found: DataFrame) -> DataFrame:
    """Numbers of definitions and calls, and the files."""
    return found.agg(F.count_if(F.col("kind") == "definition").alias("definitions"), F.count_if(F.col("kind") == "call").alias("calls"), F.array_sort(F.collect_set("filename")).alias("files"))


def without(edges: DataFrame, symbols: DataFrame | None = None, file: str | None = None) -> DataFrame:
    """Edges that are left when symbols, or a file's symbols, are deleted."""
    if symbols is not None:
        edges = edges.join(symbols.select(F.col("symbol_id").alias("source")), "source", "left_anti")
    return edges.filter(~F.col("source_file").eqNullSafe(F.lit(file))) if file is not None else edges
