"""Lexical scores, vectors, fusion, diversity, evaluation: known results."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrove.config import InvalidInput, Settings, check_query
from quillgrove.operators import evaluate, fusion, lexical, vectors
from quillgrove.operators.diversity import content_mmr, file_mmr, pick_contents, pick_files


def ranks(spark, docs, score=1.0):
    return spark.createDataFrame([(d, score, i) for i, d in enumerate(docs)], "doc string, score double, rank int")


def pairs(df, *cols):
    return [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()]


def corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc int, content string")


def test_rrf_values_and_ties(spark):
    found = fusion.rrf([ranks(spark, ["doc1", "doc2", "doc3"]), ranks(spark, ["doc2", "doc1", "doc4"])]).orderBy(F.desc("score"), "doc")
    assert pairs(found, "doc", "score") == [("doc1", 0.032522), ("doc2", 0.032522), ("doc3", 0.015873), ("doc4", 0.015873)]


def test_rrf_weights(spark):
    lists = [ranks(spark, ["doc1"]), ranks(spark, ["doc2"])]
    assert dict(pairs(fusion.rrf(lists, [0.7, 0.3]), "doc", "score")) == {"doc1": 0.011475, "doc2": 0.004918}
    with pytest.raises(InvalidInput):
        fusion.rrf(lists, [1.0])
    assert fusion.normalise([0.0, 0.0], 2) == [0.5, 0.5] and fusion.normalise(None, 2) == [1.0, 1.0]
    with pytest.raises(InvalidInput):
        fusion.normalise([1.0], 2)


def test_rrf_representative_is_the_best_raw_score(spark):
    found = fusion.rrf_results([ranks(spark, ["s"], 0.9), ranks(spark, ["s"], 0.1)]).collect()
    assert len(found) == 1 and found[0]["best"] == 0.9 and found[0]["score"] < 0.1


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), unique=True, min_size=1, max_size=5), min_size=1, max_size=3))
def test_rrf_equals_a_plain_sum(lists):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    want: dict[str, float] = {}
    for one in lists:
        for i, d in enumerate(one):
            want[str(d)] = want.get(str(d), 0) + 1 / (60 + i + 1)
    got = {r["doc"]: r["score"] for r in fusion.rrf([ranks(spark, map(str, one)) for one in lists]).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


QUICK = ["the quick brown fox", "the lazy dog", "quick brown dogs"]


def test_bm25_values(spark):
    assert pairs(lexical.bm25_plus(corpus(spark, QUICK), ["quick", "brown"]), "doc", "score") == [(2, 1.924308), (0, 1.802399)]
    assert pairs(lexical.bm25_plus(corpus(spark, QUICK), ["quick", "quick", "brown"]), "doc", "score") == [(2, 2.886462), (0, 2.703599)]
    other = corpus(spark, [*QUICK[:2], "completely unrelated content"])
    assert pairs(lexical.bm25_plus(other, ["quick", "brown"]), "doc", "score") == [(0, 3.761345)]
    assert lexical.bm25_plus(other, ["quick", "brown"], threshold=5.0).collect() == []
    many = corpus(spark, [f"document number {i}" for i in range(100)])
    assert [r["doc"] for r in lexical.bm25_plus(many, ["document"], top_k=5).collect()] == [0, 1, 2, 3, 4]
    assert lexical.bm25_plus(corpus(spark, []), ["x"]).collect() == []
    assert lexical.bm25_plus(many, []).collect() == []


def test_bm25_statistics(spark):
    got = lexical.index_stats(corpus(spark, ["one two three", "four five six"]), k1=1.2, b=0.75, delta=0.5).first()
    assert (got["num_docs"], got["avg_doc_length"], got["vocab_size"], got["k1"], got["b"], got["delta"]) == (2, 3.0, 6, 1.2, 0.75, 0.5)
    assert lexical.corpus_stats(corpus(spark, [])).first()["n_docs"] == 0


def test_keyword_fallback(spark):
    text = "alpha beta" + " " * 10
    assert pairs(lexical.keyword_fallback(corpus(spark, [text]), ["alpha", "beta", "gamma"]), "score") == [(0.166845,)]


def test_cosine(spark):
    rows = [([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
    with pytest.raises(Exception, match="different lengths"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(vectors.cosine(F.col("a"), F.col("b"))).collect()


def test_nearest_orders_ties_and_zero_vectors(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("z", [0.0, 0.0]), ("n", None)], "doc string, embedding array<double>")
    assert pairs(vectors.nearest(df, [1.0, 0.0]), "doc", "score") == [("a", 1.0), ("b", 1.0), ("z", 0.0)]
    assert {r["score"] for r in vectors.nearest(df, [0.0, 0.0]).collect()} == {0.0}


def test_category_boost_and_order(spark):
    df = spark.createDataFrame([("test_foo.py", 0.9), ("README.md", 0.85), ("manager.py", 0.8)], "filename string, score double")
    assert pairs(fusion.category_boost(df).orderBy(F.desc("score")), "filename", "score") == [("manager.py", 0.8), ("README.md", 0.595), ("test_foo.py", 0.27)]


def test_centrality_boost_defaults_to_one(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "filename string, score double")
    c = spark.createDataFrame([("a", 2.0)], "filename string, score double")
    assert sorted(pairs(fusion.centrality_boost(df, c), "filename", "score")) == [("a", 1.0), ("b", 0.5)]


def test_adaptive_cut(spark):
    df = spark.createDataFrame([("a.py", 0.9), ("b.py", 0.1), ("c.py", 0.1)], "filename string, score double")
    assert fusion.adaptive_cut(df, 3).count() == 3
    assert pairs(fusion.adaptive_cut(df, 1), "filename") == [("a.py",)]


def test_per_file_cap(spark):
    df = spark.createDataFrame([("one.py", float(i)) for i in range(10)], "filename string, score double")
    assert [r["score"] for r in fusion.cap_per_group(df, "filename", 3, [F.desc("score")], 5).collect()] == [9.0, 8.0, 7.0]


TEXTS = ["a b c", "a b c", "a b d", "x y z"]


def test_content_mmr(spark):
    assert pick_contents([0.9, 0.88, 0.5, 0.4], TEXTS, 3) == [0, 1, 3]
    assert pick_contents([0.03, 0.029, 0.02, 0.01], TEXTS, 4) == [0, 1, 2, 3]  # no more than asked for: as they are
    assert pick_contents([0.03, 0.029, 0.02, 0.01, 0.0], [*TEXTS, "a b c"], 4) == [0, 3, 2, 1]
    rows = [("q", i, s, t) for i, (s, t) in enumerate(zip([0.9, 0.88, 0.5, 0.4], TEXTS, strict=True))]
    df = spark.createDataFrame(rows, "query string, rank int, score double, content string")
    assert [r["content"] for r in content_mmr(df, 3).orderBy("rank").collect()] == ["a b c", "a b c", "x y z"]


def test_file_mmr(spark):
    names, kinds = ["a.py", "b.py", "README.md", "c.toml"], ["implementation", "implementation", "documentation", "config"]
    assert pick_files([0.9, 0.8, 0.5, 0.2], kinds, 4) == [0, 2, 1, 3]
    df = spark.createDataFrame([("q", i, s, n, k) for i, (s, n, k) in enumerate(zip([0.9, 0.8, 0.5, 0.2], names, kinds, strict=True))], "query string, rank int, score double, filename string, category string")
    assert [r["filename"] for r in file_mmr(df, 4).orderBy("rank").collect()] == ["a.py", "README.md", "b.py", "c.toml"]


def judged(spark, docs, gains):
    got = spark.createDataFrame([("q", i + 1, d) for i, d in enumerate(docs)], "query string, rank int, doc string")
    rel = spark.createDataFrame([("q", d, float(g)) for d, g in gains.items()], "query string, doc string, rel double")
    return evaluate.evaluate(got, rel, (1, 3, 4, 5)).first()


def test_ranking_metrics(spark):
    assert judged(spark, "abc", {"a": 1})["rr"] == 1.0 and judged(spark, "bac", {"a": 1})["rr"] == 0.5
    got = judged(spark, "abcde", dict.fromkeys("acef", 1))
    assert math.isclose(got["precision_3"], 2 / 3) and math.isclose(got["recall_5"], 0.75)
    gains = {"a": 3, "b": 2, "c": 1, "d": 0}
    assert math.isclose(judged(spark, "abcd", gains)["ndcg_4"], 1.0)
    assert abs(judged(spark, "dcba", gains)["ndcg_4"] - 0.613827) < 1e-6
    assert judged(spark, "x", {"a": 1})["rr"] == 0.0


def test_metrics_without_queries(spark):
    none = evaluate.evaluate(spark.createDataFrame([], "query string, rank int, doc string"), spark.createDataFrame([], "query string, doc string, rel double"))
    assert evaluate.aggregate(none).first()[0] == 0.0


@pytest.mark.parametrize(("query", "k"), [("", 5), ("  ", 5), ("x" * 50_001, 5), ("ok", 0), ("ok", 101)])
def test_queries_are_validated(query, k):
    with pytest.raises(InvalidInput):
        check_query(query, k)


def test_settings_come_from_the_environment():
    got = Settings.from_env({"QUILLGROVE_HOPS": "5", "QUILLGROVE_B": "bad", "QUILLGROVE_K1": "-1", "QUILLGROVE_FILE_LAMBDA": "0.9"})
    assert (got.hops, got.b, got.k1, got.file_lambda) == (5, 0.75, 1.2, 0.9)
