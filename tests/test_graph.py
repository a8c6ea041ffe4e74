"""Graphs: PageRank, traversals against a queue model, components, calls."""

from __future__ import annotations

import random

import pytest

from quillgrove.operators import calls, graph


def edges(spark, text, seq=False):
    rows = [tuple(e.split(">")) for e in text.split()]
    if seq:
        return spark.createDataFrame([(*e, i) for i, e in enumerate(rows)], "src string, dst string, seq int")
    return spark.createDataFrame(rows, "src string, dst string")


def starts(spark, text):
    return spark.createDataFrame([(x, i) for i, x in enumerate(text.split())], "node string, place int")


@pytest.mark.parametrize(
    ("text", "scores", "norm"),
    [
        ("A>B B>C C>A", {"A": 0.333333, "B": 0.333333, "C": 0.333333}, {"A": 1.25, "B": 1.25, "C": 1.25}),
        ("A>B C>B D>B", {"A": 0.152672, "B": 0.541985, "C": 0.152672, "D": 0.152672}, {"A": 0.5, "B": 2.0, "C": 0.5, "D": 0.5}),
        ("A>B A>B A>C B>C", {"A": 0.192988, "B": 0.302348, "C": 0.504664}, {"A": 0.5, "B": 1.026316, "C": 2.0}),
    ],
)
def test_pagerank(spark, text, scores, norm):
    found = graph.pagerank(edges(spark, text), rounds=100, tolerance=1e-6)
    got = {r["node"]: r["score"] for r in found.collect()}
    assert got.keys() == scores.keys() and all(abs(got[k] - scores[k]) < 2e-6 for k in got)
    assert abs(sum(got.values()) - 1) < 1e-9
    c = {r["filename"]: r["score"] for r in graph.centrality(found).collect()}
    if len(set(scores.values())) > 1:
        assert all(abs(c[k] - norm[k]) < 1e-4 for k in c)


def test_pagerank_of_no_edges(spark):
    assert graph.pagerank(spark.createDataFrame([], "src string, dst string")).collect() == []


TREES = [
    ("a>b a>c b>d c>e", "a", 1, 10, {("b", 1), ("c", 1)}),
    ("a>b b>c c>d", "a", 2, 10, {("b", 1), ("c", 2)}),
    ("a>b b>c c>d d>e", "a", 3, 10, {("b", 1), ("c", 2), ("d", 3)}),
    ("a>b b>c c>a", "a", 3, 10, {("b", 1), ("c", 1)}),
    ("a>a", "a", 3, 10, set()),
    ("a>b c>d", "a", 3, 10, {("b", 1)}),
    ("a>b", "a", 0, 10, set()),
    ("a>b", "", 3, 10, set()),
    ("a>b a>c b>d c>d", "a", 2, 10, {("b", 1), ("c", 1), ("d", 2)}),
    ("a>common b>common common>util", "a b", 2, 10, {("common", 1), ("util", 2)}),
    (" ".join(f"a>file{i}" for i in range(20)), "a", 2, 5, {(f"file{i}", 1) for i in (0, 1, 10, 11, 12)}),
    ("a>d a>b c>a", "a", 1, 2, {("b", 1), ("d", 1)}),
]


@pytest.mark.parametrize(("text", "start", "hops", "limit", "want"), TREES)
def test_tree_cases(spark, text, start, hops, limit, want):
    found = graph.bfs_tree(edges(spark, text), starts(spark, start), hops, limit).collect()
    assert {(r["target"], r["hop"]) for r in found} == want


def test_tree_relations(spark):
    found = graph.bfs_tree(edges(spark, "a>b c>a"), starts(spark, "a"), 1, 10).collect()
    assert {(r["target"], r["relation"]) for r in found} == {("b", "imports"), ("c", "imported_by")}
    assert graph.bfs_tree(edges(spark, "a>b").limit(0), starts(spark, "a"), 3, 10).collect() == []


def queue_model(rows, first, hops, limit):
    """Breadth-first discovery with a queue: forward, then backward, sorted."""
    ahead, behind = {}, {}
    for a, b in rows:
        if a != b:
            ahead.setdefault(a, set()).add(b)
            behind.setdefault(b, set()).add(a)
    seen, queue, out = set(first), [(x, 0) for x in first], []
    while queue:
        x, d = queue.pop(0)
        if d == hops:
            continue
        for way, told in ((ahead, "imports"), (behind, "imported_by")):
            for y in sorted(way.get(x, ())):
                if y not in seen and len(out) < limit:
                    seen.add(y)
                    out.append((x, y, told, d + 1))
                    queue.append((y, d + 1))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_tree_equals_a_queue(spark, seed):
    rng = random.Random(seed)
    rows = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(40)]
    first = [f"n{i}" for i in rng.sample(range(25), 2)]
    limit = rng.choice([3, 8, 100])
    found = graph.bfs_tree(spark.createDataFrame(rows, "src string, dst string"), starts(spark, " ".join(first)), 3, limit).collect()
    assert sorted(map(tuple, found)) == sorted(queue_model(rows, first, 3, limit))


def test_distances(spark):
    found = graph.bfs_distances(edges(spark, "A>B B>C C>D A>E"), starts(spark, "A"), 2, backward=False).collect()
    assert {tuple(r) for r in found} == {("A", 0), ("B", 1), ("E", 1), ("C", 2)}
    found = graph.bfs_distances(edges(spark, "A>B B>C"), starts(spark, "B"), 1).collect()
    assert {tuple(r) for r in found} == {("B", 0), ("A", 1), ("C", 1)}
    # the start counts toward the limit, and neighbours keep their order
    found = graph.bfs_distances(edges(spark, "a>d a>b c>a", seq=True), starts(spark, "a"), 1, 2).collect()
    assert {tuple(r) for r in found} == {("a", 0), ("d", 1)}


def test_strong_components(spark):
    got = {r["node"]: r["component"] for r in graph.strong_components(edges(spark, "A>B B>C C>A D>E")).collect()}
    assert got == {"A": "A", "B": "A", "C": "A", "D": "D", "E": "E"}


def test_strong_components_of_a_random_graph(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(30), rng.randrange(30)) for _ in range(38)]
    nodes = {x for e in rows for x in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in rows:
            reach[a] |= reach[b]
    want = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    assert {r["node"]: r["component"] for r in graph.strong_components(spark.createDataFrame(rows, "src long, dst long")).collect()} == want


def test_dependencies_adjacency_and_expansion(spark):
    e = edges(spark, "a.py>b.py b.py>c.py a.py>a.py a.py>b.py")
    chosen = spark.createDataFrame([("a.py",), ("b.py",)], "filename string")
    assert [tuple(r) for r in graph.dependencies(e, chosen).collect()] == [("a.py", "b.py")]
    got = {r["filename"]: (r["imports"], r["imported_by"]) for r in graph.adjacency(e).collect()}
    assert got["b.py"] == (["c.py"], ["a.py"])
    tree = spark.createDataFrame([("a.py", "c.py", "imported_by", 1), ("a.py", "test_c.py", "imports", 1), ("a.py", "b.py", "imports", 1)], "source string, target string, relation string, hop int")
    assert [r["target"] for r in graph.expand(chosen, tree).collect()] == ["c.py"]


CALLS = [("main", "load", 1.0, "a.py", 3), ("load", "parse", 0.9, "b.py", 5), ("parse", "load", 0.8, "b.py", 9), ("parse", "emit", 0.7, "c.py", 2), ("emit", "hidden", 0.4, "c.py", 4), ("emit", None, 0.9, "c.py", 8)]


@pytest.fixture
def made(spark):
    return spark.createDataFrame(CALLS, "source string, target string, confidence double, source_file string, source_line int")


def test_callers_and_callees(made):
    assert [r["source"] for r in calls.callers(made, "load").collect()] == ["main", "parse"]
    assert [r["target"] for r in calls.callees(made, "parse").collect()] == ["load", "emit"]
    assert calls.callees(made, "emit").collect() == []


def test_trace_ends(made):
    assert {tuple(r) for r in calls.trace(made, "main").collect()} == {("load", 1), ("parse", 2), ("emit", 3)}
    assert {tuple(r) for r in calls.trace(made, "main", depth=3).collect()} == {("load", 1), ("parse", 2)}
    assert calls.trace(made, "nothing").collect() == []


def test_references_and_usage(spark, made):
    symbols = spark.createDataFrame([("id1", "load", "b.py", 1), ("id2", "emit", "c.py", 1)], "symbol_id string, symbol_name string, filename string, line_start int")
    found = calls.references(made, symbols, "load")
    assert [(r["filename"], r["line"], r["kind"]) for r in found.collect()] == [("a.py", 3, "call"), ("b.py", 1, "definition"), ("b.py", 9, "call")]
    got = calls.usage(found).first()
    assert (got["definitions"], got["calls"], got["files"]) == (1, 2, ["a.py", "b.py"])
    gone = spark.createDataFrame([("main",)], "symbol_id string")
    assert calls.without(made, gone).count() == 5 and calls.without(made, file="b.py").count() == 4


def test_resolution_cascade(spark):
    symbols = spark.createDataFrame([("s1", "a.py", "run", 1, None, "public"), ("s2", "b.py", "go", 1, "Car", "private"), ("s3", "stop.py", "stop", 2, None, "public"), ("s4", "aa.py", "stop", 1, None, "public"), ("s5", "z.py", "hide", 1, None, "private")], "symbol_id string, filename string, symbol_name string, line_start int, parent_symbol string, visibility string")
    made = spark.createDataFrame([(1, "a.py", "run", None), (2, "x.py", "go", "Car"), (3, "x.py", "stop", None), (4, "x.py", "hide", None), (5, "x.py", "none", None)], "call_id int, file string, name string, object string")
    got = {r["call_id"]: (r["symbol_id"], r["confidence"]) for r in calls.resolve(made, symbols).collect()}
    assert got == {1: ("s1", 1.0), 2: ("s2", 1.0), 3: ("s3", 0.7), 4: (None, 0.5), 5: (None, 0.5)}
