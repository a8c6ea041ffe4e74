"""What queries write, shuffle and read, so that they fit large tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillgrove import queries
from quillgrove.functions import text as T
from quillgrove.storage import shared_dir


def on_disk(folder: Path) -> int:
    return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())


def test_symbol_search_writes_little_beside_its_input(spark, sf, monkeypatch):
    monkeypatch.setattr(queries, "_INDEXES", {})
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = on_disk(shared)
    assert queries.symbol_search(spark, sf).count() == 5
    assert on_disk(shared) - before < 3 * (Path(sf) / "documents.parquet").stat().st_size


def test_code_tokens_by_one_split_equal_those_by_name(spark):
    """The form with a split for each name and a search of the stop words' list."""
    text = F.col("text")
    names = F.filter(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_\-]+)"), 1), lambda x: F.octet_length(x) >= 2)
    parts = F.flatten(F.transform(names, lambda x: F.split(x, r"[_\-]+")))
    pieces = F.transform(F.flatten(F.transform(parts, T.camel_split)), F.lower)
    plain = F.filter(pieces, lambda x: (F.octet_length(x) >= 2) & ~F.array_contains(T.stop_words(), x))
    odd = ["", None, "_", "--a_-B", "a_Bc-DEFg__HTTPServer2X x É ÉcoleÜber_ÜBERCamel İstanbul _X_ -Ab A_B aB Ab9Cd ABc_DEf", "getUserName XMLParser get_HTTPResponse the_File"]
    found = spark.createDataFrame([(t,) for t in odd], "text string").select(T.code_tokens(text).alias("a"), plain.alias("b")).collect()
    assert [r["a"] for r in found] == [r["b"] for r in found] and found[4]["a"]


def scans(df, what: str) -> int:
    """How often a plan reads files whose path holds a name."""
    plan = df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    return sum("Scan" in line and what in line for line in plan.splitlines())


def test_hybrid_search_shuffles_no_text_but_the_candidates(spark, sf):
    from quillgrove.plans import search

    index, provider = queries._index(spark, sf)
    found = search.hybrid(index, "thing orre hehely", provider(["thing orre hehely"])[0], 10)
    assert not scans(found, "/chunks") and found.count() == 10


def test_copies_of_a_chunk_are_one_candidate(spark):
    from quillgrove.plans import search

    rows = [("a.py", "[0, 10)", " alpha beta"), ("a.py", "[0, 10)", "alpha beta"), ("a.py", "[0, 10)", "alpha beta "), ("b.py", "[0, 10)", "gamma")]
    found = search.hybrid(search.Index(spark.createDataFrame(rows, "filename string, location string, content string").repartition(4)), "alpha", None, 5).collect()
    assert [(r["filename"], r["content"]) for r in found] == [("a.py", " alpha beta")]


def test_file_search_computes_its_hits_once(spark, sf):
    from quillgrove.plans import search

    index, provider = queries._index(spark, sf)
    found = search.file_search(index, "thing orre hehely", provider(["thing orre hehely"])[0], 5)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") + found._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInPandas") <= 2
    assert found.filter("rank < 1000").count() == 5


def test_curated_sections_search_once_and_read_files_once(spark, sf):
    from quillgrove.plans import search

    index, provider = queries._index(spark, sf)
    found = search.curated_sections(index, "thing orre hehely", provider(["thing orre hehely"])[0])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "/chunks" not in plan and "InPandas" not in plan
    assert found.count() == 4


@pytest.mark.parametrize("name", ["ir_aggregate", "rrf_plain", "adaptive_cut"])
def test_scores_are_not_read_from_all_words_postings(spark, sf, name):
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = on_disk(shared)
    assert queries.QUERIES[name](spark, sf).count() > 0
    assert on_disk(shared) - before < 0.2 * (Path(sf) / "documents.parquet").stat().st_size


def test_adaptive_cut_computes_its_hits_once(spark, sf):
    assert "documents.parquet" not in queries.adaptive_cut(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_cover_density_gives_python_places_only(spark):
    from quillgrove.operators.cover import cover_density, covers

    texts = [(i, " ".join(("beta", "gap", "Alpha")[(i * j * j + j) % 3] for j in range(i % 9))) for i in range(40)] + [(40, None), (41, "gap " * 500 + "alpha")]
    found = cover_density(spark.createDataFrame(texts, "doc long, content string"), ["alpha", "beta"], top_k=50)
    plain = {}
    for d, t in texts:
        words = (t or "").lower().split()
        own = {"alpha", "beta"}.intersection(words)
        if own:
            plain[d] = (len(own), round(sum(min(1.0, 16 / (b - a + 1)) for a, b in covers(words, own)), 9))
    assert {r["doc"]: (r["level"], round(r["score"], 9)) for r in found.collect()} == plain
    given = next(line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in line)
    assert "tokens#" not in given and "content#" not in given


def test_postings_are_counted_row_by_row(spark):
    from collections import Counter

    from quillgrove.operators import lexical

    texts = [(1, "b a B c a a"), (2, ""), (3, None), (4, "Über über 9 9x z"), (5, "x"), (6, " ".join(f"w{i * i % 37}" for i in range(500)))]
    docs = spark.createDataFrame(texts, "doc long, content string")
    want = sorted((t, d, n, len(x.lower().split())) for d, x in texts if x for t, n in Counter(x.lower().split()).items())
    found = lexical.postings(docs)
    assert sorted(tuple(r) for r in found.select("term", "doc", "tf", "dl").collect()) == want
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    again = lexical.postings(docs.unionByName(docs.filter("doc in (1, 3, 5)")))  # one key, two rows
    assert sorted(tuple(r) for r in again.select("term", "doc", "tf", "dl").collect()) == [(t, d, n * (2 if d in (1, 5) else 1), dl) for t, d, n, dl in want]
