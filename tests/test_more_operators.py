"""Stems, covers, reranking, symbol categories, cells, caches, monitoring."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrove.functions.embedding import QueryCache, hashing_provider, memoised
from quillgrove.functions.stemming import english_terms, stem
from quillgrove.monitoring import Monitor, observed, success_rate
from quillgrove.operators import graph, ivf, vectors
from quillgrove.operators.cover import cover_density, covers
from quillgrove.operators.rerank import reranker
from quillgrove.operators.symbols import categorise, symbol_boost

#: Words and stems printed with the published algorithm.
STEMS = "caresses caress, ponies poni, ties ti, caress caress, cats cat, feed feed, agreed agre, plastered plaster, bled bled, motoring motor, sing sing, conflated conflat, troubled troubl, sized size, hopping hop, tanned tan, falling fall, hissing hiss, fizzed fizz, failing fail, filing file, happy happi, sky sky, relational relat, conditional condit, rational ration, valenci valenc, digitizer digit, conformabli conform, radicalli radic, differentli differ, vileli vile, analogousli analog, vietnamization vietnam, predication predic, operator oper, feudalism feudal, decisiveness decis, hopefulness hope, callousness callous, formaliti formal, sensitiviti sensit, sensibiliti sensibl, triplicate triplic, formative form, formalize formal, electriciti electr, electrical electr, hopeful hope, goodness good, revival reviv, allowance allow, inference infer, airliner airlin, gyroscopic gyroscop, adjustable adjust, defensible defens, irritant irrit, replacement replac, adjustment adjust, dependent depend, adoption adopt, homologou homolog, communism commun, activate activ, angulariti angular, homologous homolog, effective effect, bowdlerize bowdler, probate probat, rate rate, cease ceas, controll control, roll roll"


@pytest.mark.parametrize("pair", STEMS.split(", "))
def test_published_stems(pair):
    word, want = pair.split()
    assert stem(word) == want


def test_english_terms(spark):
    df = spark.createDataFrame([("The runners were running",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(english_terms(F.col("t"))).collect()] == [["runner", "run"], [], []]


def plain_covers(words, wanted):
    spans = [(a, b) for a in range(len(words)) for b in range(a, len(words)) if wanted <= set(words[a : b + 1])]
    return [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]


def test_covers_equal_all_passages():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice("abcx") for _ in range(rng.randrange(1, 14))]
        wanted = set("abc") & set(words)
        if wanted:
            assert covers(words, wanted) == sorted(plain_covers(words, wanted))


def test_cover_density(spark):
    df = spark.createDataFrame([(1, "red fish blue fish"), (2, "red red red"), (3, "none here"), (4, "blue " + "x " * 40 + "red"), (5, None)], "doc int, content string")
    got = [tuple(r) for r in cover_density(df, ["red", "blue"]).collect()]
    assert [g[:2] for g in got] == [(1, 2), (4, 2), (2, 1)] and got[0][2] == 1.0 and abs(got[1][2] - 16 / 42) < 1e-9 and got[2][2] == 3.0
    assert cover_density(df, []).collect() == []


def test_reranker_and_its_fallback(spark):
    df = spark.createDataFrame([(0, 0.9, "nothing"), (1, 0.8, "alpha beta"), (2, 0.7, "alpha"), (3, 0.6, None)], "rank int, score double, content string")
    got = reranker()(df, "alpha beta", 3).orderBy("rank").collect()
    assert [(r["content"], r["score"]) for r in got] == [("alpha beta", 1.0), ("alpha", 0.5), ("nothing", 0.0)]

    def lost(query, texts):
        raise OSError("no service")

    got = reranker(lost)(df, "alpha", 2).orderBy("rank").collect()
    assert [r["score"] for r in got] == [0.9, 0.8]


def test_symbol_categories(spark):
    rows = [("a.py", "run", "function", "public", None, None), ("a.py", "_x", "function", "internal", None, "implementation"), ("a.py", "m", "method", "public", "C", "implementation"), ("a.py", "sent", "method", "public", "C", "implementation"), ("tests/a.py", "q", "function", "public", None, None), ("a.py", "test_q", "function", "public", None, None), ("a.py", "CarTest", "class", "public", None, None), ("a.py", "kept", "function", "private", None, "api"), ("a.py", "__in", "method", "public", "C", None), ("x_test.go", "F", "function", "public", None, None)]
    df = spark.createDataFrame(rows, "filename string, symbol_name string, symbol_type string, visibility string, parent_symbol string, category string")
    out = spark.createDataFrame([("a.py", "sent"), ("a.py", "sent")], "filename string, symbol_name string")
    got = {r["symbol_name"]: r["category"] for r in categorise(df, out).collect()}
    assert got == {"run": "api", "_x": "internal", "m": "implementation", "sent": "api", "q": "test", "test_q": "test", "CarTest": "test", "kept": "api", "__in": "internal", "F": "test"}
    found = spark.createDataFrame([("s", 1.0), ("t", 1.0)], "doc string, score double")
    assert {r["doc"]: r["score"] for r in symbol_boost(found, spark.createDataFrame([("s", "api")], "doc string, category string")).collect()} == {"s": 1.2, "t": 1.0}


def test_cells_find_most_of_the_nearest(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("vec_id", "doc")
    centres = ivf.fit(e, 16)
    ivf.write(e, centres, f"file://{tmp_path}/ivf")
    query = [float(x) for x in e.orderBy("doc").first()["embedding"]]
    want = {r["doc"] for r in vectors.nearest(e, query, top_k=10).collect()}
    got = {r["doc"] for r in ivf.search(spark, f"file://{tmp_path}/ivf", centres, query, top_k=10, probes=8).collect()}
    assert len(want & got) >= 7
    every = {r["doc"] for r in ivf.search(spark, f"file://{tmp_path}/ivf", centres, query, top_k=10, probes=16).collect()}
    assert every == want and np.isfinite(centres).all()
    plan = ivf.search(spark, f"file://{tmp_path}/ivf", centres, query)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan


def test_graph_cache(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c")], "src string, dst string")
    cache = graph.adjacency(e)
    left = graph.invalidate(cache, spark.createDataFrame([("b",)], "filename string"))
    assert {r["filename"] for r in left.collect()} == {"c", "d"}
    assert tuple(graph.cache_stats(cache).first()) == (4, 3, 1)


def test_texts_are_embedded_once(spark):
    p = hashing_provider(8)
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "k int, t string")
    first, known = memoised(rows, "t", p, None)
    assert first.count() == 4 and known.count() == 3

    def refuse(texts):
        raise AssertionError("a known text was embedded again")

    again, _ = memoised(rows, "t", refuse, known)
    assert again.count() == 4
    more, known = memoised(rows.unionByName(spark.createDataFrame([(5, "new")], "k int, t string")), "t", p, known)
    assert more.count() == 5 and known.count() == 4


def test_query_cache():
    now, asked = [0.0], []
    cache = QueryCache(lambda ts: asked.extend(ts) or [[1.0] for _ in ts], most=2, ttl=10, clock=lambda: now[0])
    for text in ("a", "a", "b", "c", "a"):
        cache(text)
    assert asked == ["a", "b", "c", "a"] and (cache.hits, cache.misses) == (1, 4)
    now[0] = 11
    cache("c")
    assert asked[-1] == "c"


def test_monitoring(spark):
    m = Monitor()
    m.record("search", 0.050)
    m.record("search", 0.075)
    for k in ("hit", "hit", "hit", "miss"):
        m.count(k)
    assert m.summary()["search"]["count"] == 2 and abs(m.summary()["search"]["avg"] - 0.0625) < 1e-9 and m.rate("hit", "miss") == 0.75

    @m.timed("work")
    def work(x):
        return 1 / x

    assert work(1) == 1
    with pytest.raises(ZeroDivisionError):
        work(0)
    assert m.summary()["work"]["count"] == 2 and m.counts["work_failed"] == 1
    df, seen = observed(spark.range(10), rows=F.count(F.lit(1)), top=F.max("id"))
    df.collect()
    assert seen.get == {"rows": 10, "top": 9}
    assert success_rate(spark.createDataFrame([("a", True), ("a", False)], "k string, ok boolean"), "k", "ok").first()["rate"] == 0.5
