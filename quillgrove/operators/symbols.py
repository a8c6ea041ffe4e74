"""Symbols' categories and what they weigh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.files import symbol_weight

_FOLDERS = "(test|tests|__tests__|spec)/"
_ENDINGS = r"_test\.(py|go|rs)$"


def categorise(symbols: DataFrame, exports: DataFrame | None = None) -> DataFrame:
    """Sets ``category``: what was set before, then test, api (offered to other
    files, or public and no member), internal, implementation.  ``exports`` has
    ``(filename, symbol_name)`` rows."""
    name, file = F.col("symbol_name"), F.col("filename")
    rows = symbols
    offered = F.lit(False)
    if exports is not None:
        rows = rows.join(exports.select("filename", "symbol_name").distinct().withColumn("_offered", F.lit(True)), ["filename", "symbol_name"], "left")
        offered = F.col("_offered").isNotNull()
    told = F.col("category").isNotNull() & (F.col("category") != "implementation")
    test = name.rlike("^(test_|Test)") | ((F.col("symbol_type") == "class") & name.endswith("Test")) | file.rlike(_FOLDERS) | file.rlike(_ENDINGS)
    api = offered | ((F.col("visibility") == "public") & F.col("parent_symbol").isNull())
    hidden = F.col("visibility").isin("private", "internal") | name.rlike("^_[^_]") | (name.startswith("__") & ~name.endswith("__"))
    kind = F.when(told, F.col("category")).when(test, "test").when(api, "api").when(hidden, "internal").otherwise("implementation")
    return rows.withColumn("category", kind).select(*symbols.columns)


def symbol_boost(found: DataFrame, categories: DataFrame, key: str = "doc") -> DataFrame:
    """Scores times the weight of each symbol's category; those without one
    count as implementation."""
    kinds = categories.select(key, F.col("category").alias("_kind"))
    return found.join(kinds, key, "left").withColumn("score", F.col("score") * symbol_weight(F.coalesce("_kind", F.lit("implementation")))).drop("_kind")
