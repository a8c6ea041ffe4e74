"""Indexing repositories into versioned tables, in batch or incrementally.

Every table of a repository lives in ``{root}/{repo}/{table}/v{n}``; the
registry row names the live version.  A run writes a new version first and
then the registry, so a run that fails leaves the old index as it was, and a
rerun after a lost driver starts from the live one.
"""

from __future__ import annotations

import hashlib
import re
import time
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import parsing
from ..config import IndexMissing, InvalidInput, QuillgroveError, Settings, check_query
from ..functions import files as N
from ..functions import text as T
from ..functions.embedding import Provider, QueryCache, hashing_provider, with_embedding
from ..operators import graph, lexical, tables
from ..plans.search import Index, choose_symbols, file_search, hybrid, searched, symbol_text, with_code, with_symbol_files
from ..sources.files import EXTENSIONS, IGNORED, ignore_lines, modified, scan
from ..storage import stored

REGISTRY = "name string, path string, status string, version int, created_at timestamp, last_indexed timestamp, file_count long, chunk_count long, error_message string"
TABLES = ("files", "chunks", "symbols", "edges", "adjacency", "calls", "centrality", "lexicon")
MEMO_SECONDS, MOST_LISTED, CLAIM_SECONDS = 5.0, 10_000, 600.0


def repo_name(path: str, taken: dict[str, str]) -> str:
    """The folder's name in lower case; a longer and longer digest of the path
    is appended while another path has the name."""
    # The characters that a name keeps, and the digest's lengths.
    base = re.sub(r"[^a-z0-9_]", "", re.sub(r"[-. ]+", "_", path.rstrip("/").rpartition("/")[2].lower())).strip("_") or "repo"
    digest = hashlib.sha1(path.encode()).hexdigest()
    for name in (base, *(f"{base}_{digest[:n]}" for n in (8, 12, 16, 40))):
        if taken.get(name, path) == path:
            return name
    raise InvalidInput("no free repository name")


def schema_name(name: str) -> str:
    """A strict identifier: lower case, ``-`` and ``.`` as underscores."""
    out = name.lower().replace("-", "_").replace(".", "_")
    if not re.fullmatch(r"[a-z0-9_]+", out) or len(out) > 63:
        raise InvalidInput(f"{name!r} can't be an identifier")
    return out


@dataclass(frozen=True)
class Result:
    status: str
    files: int
    chunks: int
    symbols: int = 0
    errors: int = 0


class Engine:
    """Index, search and clear repositories under ``root``, a folder that all
    executors share."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, provider: Provider | None = None):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings or Settings.from_env()
        self.provider = provider or hashing_provider()
        self.query_vector = QueryCache(self.provider)
        self._checked: dict[str, tuple[int, float]] = {}

    # registry

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _registry_version(self) -> int:
        fs, p = self._fs(f"{self.root}/registry")
        if not fs.exists(p):
            return -1
        done = [s.getPath().getName() for s in fs.listStatus(p) if fs.exists(self._fs(f"{s.getPath()}/_SUCCESS")[1])]
        return max((int(n[1:]) for n in done if re.fullmatch(r"v\d+", n)), default=-1)

    def repos(self) -> DataFrame:
        n = self._registry_version()
        return self.spark.createDataFrame([], REGISTRY) if n < 0 else self.spark.read.schema(REGISTRY).parquet(f"{self.root}/registry/v{n}")

    def _get(self, path: str) -> dict | None:
        row = self.repos().filter(F.col("path") == path).first()
        return row.asDict() if row else None

    def _publish(self, change) -> None:
        """Writes ``change(repos)`` as the next registry.  A version belongs to
        the engine that creates its claim file first; others take the next one,
        on top of it, so none loses another's row."""
        for _ in range(100):
            n = self._registry_version() + 1
            fs, claim = self._fs(f"{self.root}/claims/v{n}")
            if fs.createNewFile(claim):
                try:
                    if self._registry_version() + 1 == n:
                        return change(self.repos()).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/registry/v{n}")
                finally:
                    fs.delete(claim, False)
            elif fs.exists(claim) and time.time() - fs.getFileStatus(claim).getModificationTime() / 1000 > CLAIM_SECONDS:
                fs.delete(claim, False)  # left by an engine that was lost
            time.sleep(0.2)
        raise QuillgroveError("the registry is held by another engine")

    def _put(self, row: dict) -> None:
        new = self.spark.createDataFrame([tuple(row.get(c.split()[0]) for c in REGISTRY.split(", "))], REGISTRY)
        self._publish(lambda repos: tables.upsert(repos, new, ["path"]))

    def _table(self, name: str, table: str, version: int) -> str:
        return f"{self.root}/{schema_name(name)}/{table}/v{version}"

    def _read(self, row: dict, table: str) -> DataFrame:
        return self.spark.read.parquet(self._table(row["name"], table, row["version"]))

    # indexing

    def _build(self, files: DataFrame, old: Index | None, changed: DataFrame | None) -> dict[str, DataFrame]:
        """Chunks and symbols of ``changed`` files in place of their old ones;
        the graph tables anew."""
        todo = files if changed is None else files.join(changed, "filename", "left_semi")
        size, overlap = self.settings.chunk_size, self.settings.chunk_overlap
        chunks = parsing.file_chunks(todo, size, overlap).withColumn("location", F.concat(F.lit("["), "start", F.lit(", "), "end", F.lit(")")))
        shown = T.context_header(F.col("filename"), N.chunk_language(F.col("filename")), F.col("location"), F.col("content"))
        chunks = with_embedding(chunks.withColumn("_shown", shown), "_shown", self.provider).drop("_shown")
        symbols = parsing.file_symbols(todo).withColumn("symbol_id", F.sha2(F.concat_ws("\0", "filename", "symbol_name", "line_start"), 256))
        symbols = tables.upsert(symbols.limit(0), symbols, ["filename", "symbol_name", "line_start"])
        told = symbol_text(*(F.col(c) for c in ("filename", "symbol_name", "symbol_type", "parent_symbol", "signature", "docstring")))
        symbols = with_embedding(symbols.withColumn("_shown", told), "_shown", self.provider).drop("_shown")
        if old is not None and changed is not None:
            there = files.select("filename")
            keep = lambda t: t.join(changed, "filename", "left_anti").join(there, "filename", "left_semi").select
            chunks = keep(old.chunks)(*chunks.columns).unionByName(chunks)
            symbols = keep(old.symbols)(*symbols.columns).unionByName(symbols)
        return {"files": files, "chunks": chunks, "symbols": symbols}

    def _calls(self, files: DataFrame, symbols: DataFrame) -> DataFrame:
        from ..operators.calls import resolve

        made = parsing.symbol_calls(files).withColumn("call_id", F.sha2(F.concat_ws("\0", "filename", "symbol_name", "line_start", "function_name", "line_number", F.coalesce("object_name", F.lit(""))), 256))
        made = made.dropDuplicates(["call_id"])
        found = resolve(made.select("call_id", F.col("filename").alias("file"), F.col("function_name").alias("name"), F.col("object_name").alias("object")), symbols)
        own = symbols.select("filename", "symbol_name", "line_start", F.col("symbol_id").alias("source"))
        target = symbols.select(F.col("symbol_id").alias("target"), F.col("filename").alias("target_file"), F.col("line_start").alias("target_line"))
        context = F.concat_ws(", ", F.when(F.col("is_recursive"), "recursive"), "context", F.when(F.col("object_name") == "[chained]", "chained").when(F.col("object_name").isNotNull(), F.concat(F.lit("on "), "object_name")))
        edges = made.join(found.withColumnRenamed("symbol_id", "target"), "call_id").join(own, ["filename", "symbol_name", "line_start"]).join(target, "target", "left")
        return edges.select("source", "target", F.col("call_type").alias("edge_type"), F.col("filename").alias("source_file"), F.col("line_number").alias("source_line"), "target_file", F.col("function_name").alias("target_symbol_name"), "target_line", "confidence", context.alias("context"))

    def _write(self, row: dict, built: dict[str, DataFrame], version: int) -> tuple[int, int, int, int]:
        put = lambda df, t: df.write.mode("overwrite").parquet(self._table(row["name"], t, version))
        for t, df in built.items():
            put(df, t)
        at = row | {"version": version}
        files = self._read(at, "files")
        put(self._calls(files, self._read(at, "symbols")), "calls")
        put(parsing.import_graph(files), "edges")
        edges = self._read(at, "edges")
        put(graph.adjacency(edges), "adjacency")
        put(graph.centrality(graph.pagerank(edges)), "centrality")
        chunks, symbols = self._read(at, "chunks"), self._read(at, "symbols")
        lexical.write_lexicon(searched(chunks), self._table(row["name"], "lexicon", version))
        unread = files.join(symbols.select("filename").distinct(), "filename", "left_anti").filter(N.parse_language(F.col("filename")).isNotNull() & F.col("content").isNull()).count()
        return files.count(), chunks.count(), symbols.count(), unread

    def ensure_indexed(self, path: str, extensions: tuple[str, ...] = EXTENSIONS, ignored: tuple[str, ...] = IGNORED) -> Result:
        """First time: a full index.  Later: only added and changed files are
        read into it, and deleted ones leave it; nothing changed: no work.  What
        may have changed is told by names and times alone, once in
        ``MEMO_SECONDS``; content is read and hashed only for those files."""
        row, now = self._get(path), datetime.now(timezone.utc).replace(tzinfo=None)
        seen, at = self._checked.get(path, (None, 0.0))
        if row is not None and row["version"] is not None and seen == row["version"] and time.monotonic() - at < MEMO_SECONDS:
            return Result("unchanged", row["file_count"], row["chunk_count"])
        found = scan(self.spark, path, extensions, (*ignored, *ignore_lines(self.spark, path)))
        if row is not None and row["version"] is not None:
            known = self._read(row, "files")
            names = found.select("filename", "mtime")  # no content
            doubtful = modified(names, known.agg(F.max("mtime")).first()[0]).select("filename")
            doubtful = doubtful.unionByName(names.join(known.select("filename", F.col("mtime").alias("_m")), "filename", "left").filter(~F.col("mtime").eqNullSafe(F.col("_m"))).select("filename")).distinct()
            gone = known.join(names, "filename", "left_anti")
            if not doubtful.limit(1).count() and not gone.limit(1).count():
                self._checked[path] = (row["version"], time.monotonic())
                return Result("unchanged", row["file_count"], row["chunk_count"])
            same = known.join(names.select("filename"), "filename", "left_semi").join(doubtful, "filename", "left_anti")
            listed = [r["filename"] for r in doubtful.limit(MOST_LISTED + 1).collect()]
            if len(listed) <= MOST_LISTED:  # read by name; more are read in one scan
                found = scan(self.spark, path, extensions, (), listed) if listed else found.limit(0)
            else:
                found = found.join(doubtful, "filename", "left_semi")
            columns = ["filename", "content", "mtime", "hash"]
            files = same.select(columns).unionByName(found.withColumn("hash", T.file_hash(F.col("content"))).select(columns))
        else:
            files = found.withColumn("hash", T.file_hash(F.col("content")))
        fresh = row is None or row["version"] is None
        if row is None:
            names = {r["name"]: r["path"] for r in self.repos().select("name", "path").collect()}  # the registry is small
            row = {"name": repo_name(path, names), "path": path, "status": "pending", "created_at": now}
        version = (row.get("version") or 0) + 1
        try:
            if fresh:
                built = self._build(files, None, None)
            else:
                status = tables.changes(self._read(row, "files"), files, "filename", "hash").filter("status <> 'same'")
                if not status.limit(1).count():
                    self._checked[path] = (row["version"], time.monotonic())
                    return Result("unchanged", row["file_count"], row["chunk_count"])
                built = self._build(files, self.index(path), status.filter("status <> 'deleted'").select("filename"))
            n_files, n_chunks, n_symbols, n_errors = self._write(row, built, version)
        except Exception as e:
            self._put(row | {"status": "error" if fresh else row["status"], "error_message": str(e)[:500]})
            raise
        self._put(row | {"status": "ready", "version": version, "last_indexed": now, "file_count": n_files, "chunk_count": n_chunks, "error_message": None})
        return Result("created" if fresh else "updated", n_files, n_chunks, n_symbols, n_errors)

    def index(self, path: str) -> Index:
        row = self._get(path)
        if row is None or row["version"] is None:
            raise IndexMissing(path)
        lexicon = lexical.read_lexicon(self.spark, self._table(row["name"], "lexicon", row["version"]))
        return Index(self._read(row, "chunks"), self._read(row, "symbols"), self._read(row, "centrality"), graph.edges_of(self._read(row, "adjacency")).select("src", "dst"), self._read(row, "files"), lexicon)

    def clear(self, path: str) -> bool:
        """Drops a repository's tables and its registry row."""
        row = self._get(path)
        if row is None:
            return False
        self._publish(lambda repos: repos.filter(F.col("path") != path))
        self._checked.pop(path, None)
        fs, p = self._fs(f"{self.root}/{schema_name(row['name'])}")
        fs.delete(p, True)
        return True

    # search

    def search(self, path: str, query: str, top_k: int = 10) -> DataFrame:
        check_query(query, top_k)
        return hybrid(self.index(path), query, self.query_vector(query), top_k, self.settings)

    def retrieve(self, path: str, query: str, top_k: int = 10) -> dict[str, DataFrame]:
        """``files`` with categories, those of found symbols included,
        ``dependencies`` between them and ``symbols`` with their code."""
        check_query(query, top_k)
        self.ensure_indexed(path)
        index, vector = self.index(path), self.query_vector(query)
        found = stored(file_search(index, query, vector, top_k, self.settings), "files")
        chosen = stored(choose_symbols(index, found, query, vector).drop("embedding"), "symbols")
        files = with_symbol_files(found, chosen)
        return {"files": files, "dependencies": graph.dependencies(index.edges, files), "symbols": with_code(chosen, index.files)}

    def calls(self, path: str) -> DataFrame:
        """The call edges of a repository."""
        row = self._get(path)
        if row is None or row["version"] is None:
            raise IndexMissing(path)
        return self._read(row, "calls")


# streams


def event_counts(stream: DataFrame, checkpoint: str, to: str) -> None:
    """Counts by event type, day and window, kept up to date from a stream:
    each micro-batch is aggregated and written under its batch id, so a batch
    that is run again after a failure replaces its own output."""

    def put(batch: DataFrame, batch_id: int) -> None:
        day = F.date_trunc("day", "ts").cast("date").cast("string")
        batch.groupBy("event_type", day.alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{to}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def merged_counts(spark: SparkSession, to: str) -> DataFrame:
    return spark.read.parquet(to).groupBy("event_type", "day").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def latest(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last change of each key; of those of one time, the least hash's."""
    by = Window.partitionBy(key).orderBy(F.desc(order), F.xxhash64(*changes.columns))
    return changes.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")
