"""Text functions, file names, spans, lines."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillgrove.functions import files as N
from quillgrove.functions import text as T
from quillgrove.operators import spans, tables
from quillgrove.sources import files as S


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("text", "want"), [("getUserName", "get User Name"), ("XMLParser", "XML Parser"), ("getHTTPResponse", "get HTTP Response"), ("simple", "simple")])
def test_camel_split(spark, text, want):
    assert one(spark, T.camel_split(F.lit(text))) == want.split()
    assert one(spark, T.camel_split_simple(F.lit(text))) == want.split()


def test_code_and_query_tokens(spark):
    got = one(spark, T.code_tokens(F.lit("getUserById")))
    assert "user" in got and "by" not in got and "id" not in got
    got = one(spark, T.code_tokens(F.lit("user_name_validator")))
    assert got == ["user", "validator"]
    assert set(one(spark, T.query_tokens(F.lit("find user authentication")))) == {"find", "user", "authentication"}
    assert one(spark, T.word_tokens(F.lit("Hello, World! This is a test."))) == "hello world this is a test".split()


def test_intent(spark):
    for text, want in (("get_user_by_id", "exact"), ("How does authentication work?", "semantic"), ("user authentication flow", "hybrid")):
        assert one(spark, T.intent(F.lit(text)))["intent"] == want


def test_hash_and_jaccard(spark):
    assert one(spark, T.file_hash(F.lit("def foo(): pass"))) == "edd9f8855bc0387c"
    for a, b, want in (("a b c", "a b c", 1.0), ("a b", "b c", 1 / 3), ("a b", "c d", 0.0), ("", "", 1.0)):
        assert abs(one(spark, T.jaccard(F.lit(a), F.lit(b))) - want) < 1e-9


CATEGORIES = {
    "test": "test_foo.py foo_test.py src/test_module.py foo.test.ts bar.spec.tsx pkg/handler_test.go src/lib_test.rs test/integration.py __tests__/Button.test.tsx spec/models/user_spec.rb FooTest.java FooTests.cs test_utils.py src\\tests\\test_manager.py",
    "documentation": "README.md CHANGELOG.md docs/api.md doc/guide.mdx notes.rst LICENSE README docs\\api\\endpoints.md",
    "config": "config.yaml pyproject.toml package.json .eslintrc .env .env.local Makefile Dockerfile docker-compose.yml",
    "implementation": "main.py app.ts lib.rs src/core/manager.py attestation.py contest.go",
}


def test_file_categories(spark):
    rows = [(kind, name) for kind, names in CATEGORIES.items() for name in names.split()]
    df = spark.createDataFrame(rows, "kind string, name string")
    got = df.withColumn("got", N.category(F.col("name"))).filter("got <> kind").collect()
    assert got == []
    weights = {r["kind"]: r["w"] for r in df.select("kind", N.category_weight(F.col("name")).alias("w")).distinct().collect()}
    assert weights == {"implementation": 1.0, "test": 0.3, "documentation": 0.7, "config": 0.6}


def test_languages(spark):
    want = {".py": "python", ".go": "go", ".rs": "rust", ".cxx": "cpp", ".h": "c", ".mjs": "javascript", ".mts": "typescript", ".tsx": "tsx", ".md": None, ".json": None}
    df = spark.createDataFrame([(f"a{e}",) for e in want], "f string")
    assert {r["f"][1:]: r["x"] for r in df.select("f", N.parse_language(F.col("f")).alias("x")).collect()} == want


@pytest.mark.parametrize(("rows", "gap", "want"), [([(1, 5), (6, 9)], 0, [(1, 5), (6, 9)]), ([(1, 5), (6, 9)], 1, [(1, 9)]), ([(10, 12), (1, 3), (4, 8)], 1, [(1, 8), (10, 12)]), ([(10, 12), (1, 3), (4, 8)], 2, [(1, 12)])])
def test_span_merge(spark, rows, gap, want):
    df = spark.createDataFrame([("f", a, b) for a, b in rows], "filename string, line_start int, line_end int")
    assert sorted((r["line_start"], r["line_end"]) for r in spans.merge(df, gap).collect()) == want


@pytest.mark.parametrize(
    ("text", "first", "last", "limit", "want"),
    [
        ("l1\nl2\nl3\nl4\n", 2, 3, None, ("l2\nl3\n", 3, 4, False)),
        ("l1\nl2", 1, 999, None, ("l1\nl2", 2, 2, True)),
        ("".join(f"line{i}\n" for i in range(1, 11)), 1, 10, 12, ("line1\nline2\n", 2, 10, True)),
        ("abcdefgh\nx\n", 1, 2, 4, ("abcd", 1, 2, True)),
    ],
)
def test_line_extraction(spark, text, first, last, limit, want):
    df = spark.createDataFrame([(text,)], "content string")
    assert tuple(spans.extract_lines(df, first, last, limit).select("code", "end", "n_lines", "truncated").first()) == want


def test_line_beyond_the_file_is_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        spans.extract_lines(spark.createDataFrame([("a\n",)], "content string"), 5, 6).collect()


def test_safe_paths():
    assert S.safe_relative("src/a.py") and not any(map(S.safe_relative, ("../x", "/etc/passwd", "a/../../b", "", "C:\\x", "\\\\host")))


def test_ignore_patterns():
    assert S.glob_of("# c") is None and S.glob_of("") is None and S.glob_of("!x") is None
    assert S.glob_of("*.log") == "**/*.log" and S.glob_of("/root.txt") == "root.txt" and S.glob_of("build/") == "**/build/**" and S.glob_of("a/b") == "a/b"


def test_location_strings(spark):
    for text, want in (("3:9", "L3-9"), ("3:3", "L3"), ("[0, 120)", "~L1-3"), ("[0, 30)", "~L1"), ("x", "x")):
        assert one(spark, T.location(F.lit(text))) == want


def test_table_changes_and_upserts(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "4")], "k string, h string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", None), ("e", "5")], "k string, h string")
    assert {r["k"]: r["status"] for r in tables.changes(old, new, "k", "h").collect()} == {"a": "same", "b": "changed", "c": "same", "d": "deleted", "e": "added"}
    assert {tuple(r) for r in tables.upsert(old, new, ["k"]).collect()} == {("a", "1"), ("b", "9"), ("c", None), ("d", "4"), ("e", "5")}
