"""Smaller operators and the parts around the engine."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillgrove import config, storage
from quillgrove.functions import embedding
from quillgrove.functions import text as T
from quillgrove.operators import calls, evaluate, fusion, graph, lexical, tables, vectors
from quillgrove.sources import files
from quillgrove.streaming import ingest


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_batches_of_symbols(spark):
    table = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 3, "old"), ("a", 4, None)], "filename string, n int, batch_id string")
    written = spark.createDataFrame([("a",), ("a",)], "filename string")
    assert rows(tables.drop_old_batches(table, "new", written), "n") == [(2,), (3,)]
    batch = spark.createDataFrame([("a", 9, "x")], table.schema)
    assert rows(tables.replace_batch(table, batch, written), "n") == [(3,), (9,)]
    edges = spark.createDataFrame([("s1", "t"), ("s2", "t")], "source string, target string")
    assert rows(tables.cascade(edges, spark.createDataFrame([("s1",)], "symbol_id string")), "source") == [("s1",)]


def test_upserts_and_latest_changes_do_not_depend_on_the_order_of_rows(spark):
    old = spark.createDataFrame([("k", 0)], "k string, v int")
    new = [("k", i) for i in range(1, 9)]
    one, two = (tables.upsert(old, spark.createDataFrame(x, old.schema).repartition(3), ["k"]).first()["v"] for x in (new, new[::-1]))
    assert one == two > 0
    changes = [("k", 5, i) for i in range(6)]
    one, two = (ingest.latest(spark.createDataFrame(x, "k string, at int, v int").repartition(3), "k", "at").first()["v"] for x in (changes, changes[::-1]))
    assert one == two


def test_metrics_over_common_cuts_and_latencies(spark):
    found = spark.createDataFrame([("q", 1.0, 1, 1.0, 0.5, 1.0), ("q", 1.0, 5, 0.2, 0.5, 0.8), ("p", 0.5, 1, 0.0, 0.0, 0.0)], "query string, rr double, k int, precision double, recall double, ndcg double")
    assert rows(evaluate.aggregate_common(found)) == [(1, 0.75, 0.5, 0.25, 0.5)]
    assert evaluate.aggregate_common(found.limit(0)).collect() == []
    timed = spark.createDataFrame([(2.0, True), (4.0, False)], "ms double, ok boolean")
    assert rows(evaluate.latency(timed)) == [(2, 6.0, 2.0, 4.0, 3.0, 0.5)]


def test_ranks_after_changed_scores(spark):
    found = spark.createDataFrame([("a", 1.0, 0), ("b", 2.0, 1), ("c", 2.0, 2), ("d", float("nan"), 3)], "doc string, score double, rank int")
    assert [r["doc"] for r in fusion.resorted(found).orderBy("rank").collect()] == ["b", "c", "a", "d"]
    assert [r["doc"] for r in fusion.ranked(found.drop("rank")).orderBy("rank").collect()] == ["b", "c", "a", "d"]
    seen = spark.createDataFrame([("x", 2), ("y", 1), ("x", 0)], "file string, rank int")
    assert [tuple(r) for r in fusion.first_of(seen, "file").collect()] == [("x", 0), ("y", 1)]


def test_call_chain_has_the_type_of_the_first_edge(spark):
    edges = spark.createDataFrame([("a", "b", 1.0, "calls"), ("b", "c", 1.0, "uses"), ("b", "c", 1.0, "reads"), ("c", "d", 0.2, "calls")], "source string, target string, confidence double, edge_type string")
    assert rows(calls.chain(edges, "a")) == [("b", 1, "reads"), ("c", 2, "calls")]
    assert rows(calls.chain(edges, "c", callees=False)) == [("a", 2, "calls"), ("b", 1, "calls")]


def test_pagerank_on_the_driver_equals_the_written_rounds(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("d", "e")], "src string, dst string")
    here, there = (rows(graph.pagerank(edges, rounds=12, tolerance=1e-4, local_most=n)) for n in (1000, 0))
    assert [k for k, _ in here] == [k for k, _ in there]
    assert all(abs(a - b) < 1e-12 for (_, a), (_, b) in zip(here, there, strict=True))
    assert abs(sum(s for _, s in here) - 1) < 1e-9


def test_adjacency_within_files_and_back_to_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "a"), ("x", "b")], "src string, dst string")
    among = graph.adjacency_among(edges, spark.createDataFrame([("a",), ("b",), ("z",)], "filename string"))
    assert rows(among) == [("a", ["b"], []), ("b", [], ["a"]), ("z", [], [])]
    assert rows(graph.edges_of(graph.adjacency(edges)), "src", "dst") == [("a", "a"), ("a", "b"), ("b", "c"), ("x", "b")]


def test_stored_postings_score_like_a_scan(spark, tmp_path):
    texts = [(i, f"alpha {'beta ' * (i % 4)} gamma{i % 3} Über") for i in range(60)] + [(60, ""), (61, None)]
    docs = spark.createDataFrame(texts, "doc long, content string")
    lexical.write_lexicon(docs, f"file://{tmp_path}/lexicon")
    stored = lexical.read_lexicon(spark, f"file://{tmp_path}/lexicon")
    for query in (["beta"], ["alpha", "gamma1", "beta", "beta"], ["nothing"], [], ["über"]):
        a, b = lexical.bm25_plus(docs, query, top_k=None), lexical.bm25_plus_stored(stored, query, top_k=None)
        assert [(d, round(s, 9)) for d, s in rows(a)] == [(d, round(s, 9)) for d, s in rows(b)]
    plan = lexical.bm25_plus_stored(stored, ["beta"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [" in plan and "term" in plan


def test_providers_are_probed_and_batched():
    def broken():
        raise OSError("no network")

    offered = {"remote": broken, "empty": lambda: lambda ts: [], "good": lambda: lambda ts: [[1.0]] * len(ts), "local": embedding.hashing_provider}
    assert [embedding.choose_provider(w, offered, "local")[0] for w in ("remote", "empty", " Good ", "other", "local")] == ["local", "local", "good", "local", "local"]
    assert list(embedding.by_call(["aa", "bb", "cc"], 2)) == [["aa", "bb"], ["cc"]]
    assert list(embedding.by_call(["aaa", "bb", "cc"], 9, 4)) == [["aaa"], ["bb", "cc"]]
    with pytest.raises(ValueError, match="exceeds"):
        list(embedding.by_call(["aaaaa"], 9, 4))


def test_existence_is_remembered_for_a_while():
    now = [0.0]
    cache = storage.Existence(hit=10, miss=2, clock=lambda: now[0])
    assert cache.get("a") is None and cache.put("a", True) and not cache.put("b", False)
    now[0] = 3.0
    assert cache.get("a") is True and cache.get("b") is None
    now[0] = 11.0
    assert cache.get("a") is None
    cache.put("a", True)
    cache.forget("a")
    assert cache.get("a") is None


def test_messages_tell_clients_no_detail():
    assert config.public_message(config.InvalidInput("top_k is between 1 and 100")) == "top_k is between 1 and 100"
    assert config.public_message(config.QuillgroveError("/secret/path")) == "the search failed"
    assert "path" not in config.public_message(config.IndexMissing("/secret/path"))
    assert config.public_message(KeyError("secret")) == "an unexpected error occurred"


def test_markers_dimensions_and_times(spark):
    one = spark.createDataFrame([("#hash:abc#Doc",), ("plain",)], "d string")
    assert [r[0] for r in one.select(T.hash_marker(F.col("d"))).collect()] == ["abc", None]
    cut = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<float>").select(vectors.fit_dimensions(F.col("v"), 2).alias("v"))
    assert cut.first()["v"] == [1.0, 2.0]
    since = dt.datetime(2024, 1, 2)
    seen = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 1, 3)), ("c", None)], "filename string, mtime timestamp")
    assert rows(files.modified(seen, since), "filename") == [("b",), ("c",)]


def test_ignore_file_of_a_repository(spark, tmp_path):
    for name in ("keep.py", "drop.py", "gen/made.py", "lib/x.kt", "out/y.py", "n[1].py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text("# made\ngen/\n/drop.py\n\n")
    lines = files.ignore_lines(spark, str(tmp_path))
    assert rows(files.scan(spark, str(tmp_path), ignored=(*files.IGNORED, *lines)), "filename") == [("keep.py",), ("lib/x.kt",), ("n[1].py",)]
    assert rows(files.scan(spark, str(tmp_path), only=["n[1].py", "keep.py"]), "filename") == [("keep.py",), ("n[1].py",)]
    assert files.ignore_lines(spark, str(tmp_path / "lib")) == ()
    assert len(files.EXTENSIONS) == 19


def test_engines_keep_each_others_rows_and_symbol_files_join_the_answer(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "main.py").write_text("def open_session():\n    return close_session()\n")
        (tmp_path / name / "helper.py").write_text("def close_session():\n    return 1\n")
    a, b = (ingest.Engine(spark, f"file://{tmp_path}/index") for _ in range(2))
    first = a.ensure_indexed(str(tmp_path / "one"))
    assert first.symbols == 2 and first.errors == 0
    b.ensure_indexed(str(tmp_path / "two"))
    assert a.repos().count() == b.repos().count() == 2
    assert a.ensure_indexed(str(tmp_path / "one")).status == "unchanged"
    got = a.retrieve(str(tmp_path / "one"), "open session", 1)
    files_found = got["files"].collect()
    assert {r["category"] for r in files_found} == {"implementation"} and {r["source"] for r in files_found} <= {"search", "symbol", "graph"}
    assert {r["filename"] for r in got["symbols"].collect()} <= {r["filename"] for r in files_found}
    assert a.query_vector.misses == 1 and a.retrieve(str(tmp_path / "one"), "open session", 1) and a.query_vector.hits == 1
    assert storage.clean(spark) > 0
