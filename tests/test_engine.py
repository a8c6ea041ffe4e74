"""Indexing and searching a small repository, end to end."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrove.config import IndexMissing, InvalidInput, QuillgroveError, Settings
from quillgrove.functions.embedding import embed_one, hashing_provider
from quillgrove.plans import search
from quillgrove.sources import files as S
from quillgrove.streaming import ingest

FILES = {
    "src/auth/login.py": 'from src.store import database\n\ndef authenticate(user, password):\n    """Checks a password of a user."""\n    return database.find(user) == password\n\nclass Session:\n    def open(self):\n        return authenticate("a", "b")\n',
    "src/store/database.py": 'def find(user):\n    """Finds the password of a user."""\n    return table[user]\n\ndef connect():\n    return find("root")\n',
    "src/shapes.py": "def area(width, height):\n    return width * height\n",
    "tests/test_login.py": "from src.auth.login import authenticate\n\ndef test_authenticate():\n    assert authenticate('a', 'b')\n",
    "README.md": "# Demo\n\nHow users authenticate with a password.\n",
    "node_modules/skip.py": "def authenticate(): pass\n",
    "notes.xyz": "authenticate",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("repo") / "My-Repo.Name"
    for name, text in FILES.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)
    made = ingest.Engine(spark, f"file://{tmp_path_factory.mktemp('index')}")
    return made, str(top)


def test_scan_filters_by_name(spark, engine):
    names = {r["filename"] for r in S.scan(spark, engine[1]).select("filename").collect()}
    assert names == {"src/auth/login.py", "src/store/database.py", "src/shapes.py", "tests/test_login.py", "README.md"}


def test_index_search_refresh_clear(spark, engine):
    made, path = engine
    with pytest.raises(IndexMissing):
        made.index(path)
    first = made.ensure_indexed(path)
    assert (first.status, first.files) == ("created", 5) and first.chunks >= 5
    assert made.ensure_indexed(path).status == "unchanged"
    row = made.repos().first()
    assert (row["name"], row["status"], row["file_count"]) == ("my_repo_name", "ready", 5)

    found = made.search(path, "authenticate user password", 3).collect()
    assert found[0]["filename"] == "src/auth/login.py" and len(found) == 3
    assert [r["score"] for r in found] == sorted((r["score"] for r in found), reverse=True)

    got = made.retrieve(path, "authenticate user password", 3)
    files = [r["filename"] for r in got["files"].orderBy("rank").collect()]
    assert "src/auth/login.py" in files
    symbols = got["symbols"].collect()
    assert "authenticate" in {r["symbol_name"] for r in symbols}
    assert all(r["code"].strip() for r in symbols)
    assert all(r["src"] != r["dst"] for r in got["dependencies"].collect())

    index = made.index(path)
    assert {tuple(r) for r in index.edges.collect()} == {("tests/test_login.py", "src/auth/login.py")}
    made_calls = made.calls(path).filter("source_file = 'src/auth/login.py'").collect()
    assert ("authenticate", 1.0) in {(r["target_symbol_name"], r["confidence"]) for r in made_calls}

    os.remove(f"{path}/src/shapes.py")
    with open(f"{path}/src/store/database.py", "a") as f:
        f.write("\ndef vacuum():\n    return connect()\n")
    again = made.ensure_indexed(path)
    assert (again.status, again.files) == ("updated", 4)
    names = {(r["filename"], r["symbol_name"]) for r in made.index(path).symbols.collect()}
    assert ("src/store/database.py", "vacuum") in names and ("src/shapes.py", "area") not in names and ("src/auth/login.py", "authenticate") in names
    with pytest.raises(InvalidInput):
        made.search(path, "", 3)

    assert made.clear(path) and not made.clear(path)
    with pytest.raises(IndexMissing):
        made.index(path)


def test_failed_run_keeps_the_old_index(spark, tmp_path):
    top = tmp_path / "r"
    top.mkdir()
    (top / "a.py").write_text("def one(): pass\n")
    made = ingest.Engine(spark, f"file://{tmp_path}/index")
    made.ensure_indexed(str(top))

    def broken(texts):
        raise RuntimeError("no embedding")

    (top / "b.py").write_text("def two(): pass\n")
    good, made.provider = made.provider, broken
    with pytest.raises(Exception, match="no embedding"):
        made.ensure_indexed(str(top))
    assert {r["symbol_name"] for r in made.index(str(top)).symbols.collect()} == {"one"}
    assert made.repos().first()["error_message"]
    made.provider = good
    assert made.ensure_indexed(str(top)).status == "updated"
    assert made.repos().first()["error_message"] is None


def test_repository_names():
    assert ingest.repo_name("/x/My-Repo.Name", {}) == "my_repo_name"
    import hashlib

    digest = hashlib.sha1(b"/x/repo").hexdigest()
    assert ingest.repo_name("/x/repo", {"repo": "/y/repo"}) == f"repo_{digest[:8]}"
    assert ingest.repo_name("/x/repo", {"repo": "/y", f"repo_{digest[:8]}": "/z", f"repo_{digest[:12]}": "/w"}) == f"repo_{digest[:16]}"
    assert ingest.schema_name("My-Repo.Name") == "my_repo_name"
    for bad in ("with space", "", "x" * 64):
        with pytest.raises(InvalidInput):
            ingest.schema_name(bad)


def chunked(spark, rows):
    return search.Index(spark.createDataFrame([(f, "[0, 10)", t) for f, t in rows], "filename string, location string, content string"))


def test_backend_failures(spark):
    index = chunked(spark, [("a.py", "alpha beta"), ("b.py", "gamma")])
    # without an embedding column the vector backend fails; the lexical one answers
    assert [r["filename"] for r in search.hybrid(index, "alpha", [1.0, 0.0], 5).collect()] == ["a.py"]
    with pytest.raises(QuillgroveError):
        search.hybrid(search.Index(index.chunks.drop("content").withColumn("content", F.raise_error(F.lit("lost")).cast("string"))), "alpha", [1.0], 5).collect()


def test_rerank_then_boost(spark):
    index = chunked(spark, [("README.md", "alpha beta"), ("impl.py", "alpha beta gamma")])
    scores = {"README.md": 0.9, "impl.py": 0.8}
    ranker = lambda df, query, k: df.withColumn("score", F.when(F.col("filename") == "README.md", scores["README.md"]).otherwise(scores["impl.py"]))
    found = search.hybrid(index, "alpha", None, 2, reranker=ranker).collect()
    assert [(r["filename"], round(r["score"], 6)) for r in found] == [("impl.py", 0.8), ("README.md", 0.63)]


def test_curated_sections_keep_to_the_budget(spark):
    from quillgrove.functions.embedding import with_embedding

    body = {"src/core.py": "\n".join(f"def core_{i}(): return 'alpha {i}'" for i in range(200)), "README.md": "\n".join(f"alpha line {i}" for i in range(100)), "tests/test_core.py": "\n".join(f"assert alpha_{i}" for i in range(49))}
    files = spark.createDataFrame(sorted(body.items()), "filename string, content string")
    provider = hashing_provider()
    chunks = with_embedding(files.select("filename", F.lit("[0, 40)").alias("location"), "content"), "content", provider)
    index = search.Index(chunks, files=files)
    found = search.curated_sections(index, "alpha", provider(["alpha"])[0], Settings(budget_chars=180)).collect()
    assert found[0]["filename"] == "src/core.py"
    assert not any(r["filename"].startswith("tests/") for r in found)
    assert sum(len(r["content"]) for r in found) <= 180


def test_embedding_provider():
    p = hashing_provider(32)
    assert p(["parse file"]) == p(["parse file"]) and len(p(["x"])[0]) == 32
    with pytest.raises(ValueError):
        embed_one("  ", p)
    with pytest.raises(ValueError):
        embed_one("x" * 50_001, p)


def test_long_texts_are_embedded_whole(spark):
    from quillgrove.functions.embedding import MAX_CHARS, parts, with_embedding

    p = hashing_provider()
    long = "alpha " * 10_000 + "omega " * 20_000
    for text in (long, "x" * 120_000, "", "short"):
        assert "".join(parts(text)) == text and max(map(len, parts(text))) <= MAX_CHARS
    assert all(x.endswith(" ") for x in parts(long))
    df = spark.createDataFrame([(1, long), (2, "alpha beta"), (3, None)], "k long, content string")
    found = {r["k"]: np.array(r["embedding"]) for r in with_embedding(df, "content", p).collect()}
    assert abs(np.linalg.norm(found[1]) - 1) < 1e-5
    assert found[1] @ np.array(p(["omega"])[0]) > 0.8  # the first 50,000 characters hold no such word
    assert np.allclose(found[2], p(["alpha beta"])[0]) and not found[3].any()


def test_stream_counts_survive_a_replayed_batch(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = lambda: spark.readStream.schema(schema).option("pathGlobFilter", "events*").parquet(sf)
    ingest.event_counts(stream(), f"file://{tmp_path}/c", f"file://{tmp_path}/o")
    ingest.event_counts(stream(), f"file://{tmp_path}/c", f"file://{tmp_path}/o")  # nothing new
    ingest.event_counts(stream(), f"file://{tmp_path}/c2", f"file://{tmp_path}/o")  # batch 0 again
    got = ingest.merged_counts(spark, f"file://{tmp_path}/o").agg(F.sum("n")).first()[0]
    assert got == spark.read.parquet(f"{sf}/events.parquet").count()
