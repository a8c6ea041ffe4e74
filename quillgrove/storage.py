"""Shared scratch tables: the recovery points of iterative operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


_SHIPPED: set[str] = set()
_WRITTEN: dict[str, list[str]] = {}


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once for each application: the driver
    serves it as a zip, so executors need no shared code folder."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, f"{root.name}_core.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)


def few_rows(batches: Iterator[pa.RecordBatch], most: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches: a worker holds Python copies of few texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; made only where a local test has none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillgrove-")
        atexit.register(shutil.rmtree, folder, True)
        path = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Existence:
    """What the driver knows to be there or not: for ``hit`` and ``miss``
    seconds.  Safe to share between threads."""

    def __init__(self, hit: float = 300.0, miss: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.clock = {True: hit, False: miss}, clock
        self.held: dict[str, tuple[bool, float]] = {}
        self.lock = threading.Lock()

    def get(self, key: str) -> bool | None:
        with self.lock:
            there, since = self.held.get(key, (None, 0.0))
            return there if there is not None and self.clock() - since < self.ttl[there] else None

    def put(self, key: str, there: bool) -> bool:
        with self.lock:
            self.held[key] = (there, self.clock())
        return there

    def forget(self, key: str | None = None) -> None:
        with self.lock:
            if key is None:
                self.held.clear()
            else:
                self.held.pop(key, None)


def stored(df: DataFrame, what: str = "step") -> DataFrame:
    """Writes a table to the shared folder and reads it from there."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Deletes the tables that ``stored`` has written in this application; to
    be called when no result that is still lazy reads them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)
