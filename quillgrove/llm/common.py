"""Session plumbing of the training-data operators: tables, shared scratch
storage that survives lost executors, and shipping this package to workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}
_SHIPPED: set[str] = set()
_ROOTS: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once for each application.  The zip
    is served by the driver, so executors need no shared code folder.  Rows
    hold whole texts, so where the session keeps Spark's default of 10,000 rows
    an Arrow batch, it is lowered: both sides hold a few batches at a time."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "2000")
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of
    the session.  Only where that is unset (a local test) one is made."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillgrove-")
        atexit.register(shutil.rmtree, folder, True)
        path = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Written tables in the shared folder.  A stored table is the recovery
    point of what follows: a lost executor costs the current stage only."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        _ROOTS.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that nothing lazy reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def clean(spark: SparkSession) -> int:
    """Deletes all scratch tables of this application; to be called when no
    result that is still lazy reads them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    roots = _ROOTS.pop(spark.sparkContext.applicationId, [])
    for root in roots:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(conf).delete(path, True)
    return len(roots)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished steps now: it does so
    when the driver collects the plans that wrote them, and a driver with
    memory to spare puts that off while executors' disks fill."""
    spark.sparkContext._jvm.System.gc()


def fold(key: str, of: int):
    """``crc32`` of a key's text, modulo ``of``."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(of))


def beside(carry: tuple[str, ...] | list[str], *results: str) -> list[str]:
    """The carried columns; one with the name of a result gives way to it."""
    return [c for c in carry if c not in results]


def extended(schema: T.StructType, **kinds: str) -> T.StructType:
    """A copy of a schema with more columns."""
    more = [T.StructField(name, _KINDS[kind]) for name, kind in kinds.items()]
    return T.StructType([*schema.fields, *more])


def by_group(df: DataFrame, keys: list[str], run: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Applies ``run`` to the rows of each group, streaming: one group is in
    memory at a time, so callers cut groups to a bounded size first.  Keys are
    integers without nulls."""
    dealt = df.repartition(*keys).sortWithinPartitions(*keys)
    at = [df.columns.index(k) for k in keys]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            new = np.zeros(max(len(batch) - 1, 0), bool)
            for k in at:
                x = batch.column(k).to_numpy()
                new |= x[1:] != x[:-1]
            edges = [0, *(np.flatnonzero(new) + 1).tolist()]
            for a, b in zip(edges, edges[1:]):
                yield batch.slice(a, b - a)
            rest = batch.slice(edges[-1]) if len(batch) else None
        if rest is not None:
            yield rest

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for group in groups(batches):
            out = run(group)
            if out is not None and len(out):
                held.append(out)
                size += len(out)
            if size >= 5000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return dealt.mapInArrow(each, schema)


def tiles(df: DataFrame, key: str, blocks: str, asks: str, member: str, ask_blocks: str) -> DataFrame:
    """Deals the rows of each bucket ``df[key]`` to tiles of bounded size: an
    asking row meets every member row of its bucket in exactly one tile.  The
    bucket has ``blocks`` blocks of members and ``ask_blocks`` of asking rows,
    so a large bucket with few questions is copied few times.  ``asks`` and
    ``member`` are boolean columns, set anew in each tile."""
    own = lambda n: F.pmod(F.xxhash64(F.lit(7), F.col("rep")), F.col(n)).cast("int")
    tile = lambda a, m, x, y: F.struct((a.cast("long") * F.col(blocks) + m).alias("tile"), x.alias("a"), y.alias("m"))
    asked = F.transform(F.sequence(F.lit(0), F.col(blocks) - 1), lambda m: tile(own(ask_blocks), m, F.col(asks), F.col(member) & (m == own(blocks))))
    others = F.filter(F.sequence(F.lit(0), F.col(ask_blocks) - 1), lambda a: (a != own(ask_blocks)) | ~F.col(asks))
    held = F.transform(others, lambda a: tile(a, own(blocks), F.lit(False), F.col(member)))
    both = F.concat(F.when(F.col(asks), asked).otherwise(F.expr("cast(array() as array<struct<tile:bigint,a:boolean,m:boolean>>)")), held)
    kept = [c for c in df.columns if c not in (blocks, ask_blocks, asks, member)]
    return df.select("*", F.explode(both).alias("_t")).filter("_t.a or _t.m").select(*kept, F.col("_t.tile").alias("tile"), F.col("_t.a").alias(asks), F.col("_t.m").alias(member))
