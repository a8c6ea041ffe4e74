"""Table maintenance: change detection, upserts, deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """``(key, status)``: added, changed, deleted or same, by a null-safe
    comparison of digests."""
    a, b = old.select(key, F.col(digest).alias("_a"), F.lit(1).alias("_x")), new.select(key, F.col(digest).alias("_b"), F.lit(1).alias("_y"))
    status = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "deleted").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same keys; of
    several in ``new``, that with the least hash, so a rerun agrees."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_v"), F.xxhash64(*old.columns)))
    return both.withColumn("_n", last).filter("_n = 1").drop("_v", "_n")


def replace_batch(table: DataFrame, batch: DataFrame, files: DataFrame, column: str = "filename") -> DataFrame:
    """New rows of files first, then the files' old rows go."""
    return table.join(files.select(column).distinct(), column, "left_anti").unionByName(batch)


def drop_old_batches(table: DataFrame, batch: str, files: DataFrame, column: str = "filename", batch_id: str = "batch_id") -> DataFrame:
    """A table without the rows that other batches, or none, left for files
    which this batch has written."""
    own = F.col(batch_id).eqNullSafe(F.lit(batch))
    mine = files.select(column).distinct().withColumn("_mine", F.lit(True))
    return table.join(mine, column, "left").filter(F.col("_mine").isNull() | own).drop("_mine")


def cascade(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges whose source symbol is still there."""
    return edges.join(symbols.select(F.col("symbol_id").alias("source")), "source", "left_semi")
