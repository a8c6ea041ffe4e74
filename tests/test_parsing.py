"""Parsers: golden rows for small pieces of source text."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgrove import parsing as P

SHAPES = '''class Box:
    """A box."""
    def area(self):
        return 1
    def _hidden(self):
        return 2

def build():
    return Box()
'''


def test_python_symbols():
    got = [(s[0], s[1], s[2], s[3], s[6], s[7], s[8], s[5], s[4]) for s in P.symbols(SHAPES, "shapes.py", "python")]
    assert got == [
        ("Box", "class", 1, 6, None, "public", "implementation", "A box.", "class Box:"),
        ("area", "method", 3, 4, "Box", "public", "implementation", None, "def area(self):"),
        ("_hidden", "method", 5, 6, "Box", "internal", "implementation", None, "def _hidden(self):"),
        ("build", "function", 8, 9, None, "public", "implementation", None, "def build():"),
    ]
    assert {s[8] for s in P.symbols(SHAPES, "test_shapes.py", "python")} == {"test"}
    assert P.symbols("class A:\n    def __init__(self): pass\n    def __x(self): pass\n", "a.py", "python")[1][7] == "internal"


def kinds(text, name, language):
    return {(s[0], s[1], s[6], s[7]) for s in P.symbols(text, name, language)}


def test_go_symbols():
    text = "package p\n\n// Run runs.\nfunc Run() {}\nfunc helper() {}\nfunc (s *Server) Start() {}\ntype Server struct {\n\ta int\n}\ntype Doer interface {\n\tDo()\n}\n"
    assert kinds(text, "a.go", "go") == {("Run", "function", None, "public"), ("helper", "function", None, "internal"), ("Start", "method", "Server", "public"), ("Server", "struct", None, "public"), ("Doer", "interface", None, "public")}


def test_rust_symbols():
    text = "/// A point.\npub struct Point { x: i32 }\ntrait Shape { fn area(&self) -> f64; }\nimpl Point {\n    pub fn new() -> Self { Point { x: 0 } }\n    fn secret(&self) {}\n}\nenum Kind { A }\n"
    got = kinds(text, "a.rs", "rust")
    assert {("Point", "struct", None, "public"), ("Shape", "interface", None, "private"), ("new", "method", "Point", "public"), ("secret", "method", "Point", "private"), ("Kind", "enum", None, "private")} <= got
    assert P.symbols(text, "a.rs", "rust")[0][5] == "A point."


def test_typescript_symbols():
    text = "export const Panel = (p) => { const inner = () => 1; return inner }\nexport const useThing = () => { return 1 }\nconst plain = (a) => a\ninterface Shape { a: number }\ntype Id = string\nenum Color { Red }\nclass Car extends Base {\n  drive(x) {\n    if (x) { return 1 }\n  }\n}\n"
    got = {(n, k) for n, k, *_ in kinds(text, "a.tsx", "tsx")}
    assert {("Panel", "component"), ("useThing", "hook"), ("plain", "function"), ("Shape", "interface"), ("Id", "type"), ("Color", "enum"), ("Car", "class"), ("drive", "method")} <= got
    assert not any(n in ("inner", "if") for n, _ in got)


@pytest.mark.parametrize(
    ("text", "language", "want"),
    [
        ("import os, sys\nimport os\nfrom a.b import c\nfrom . import d\nfrom ..e import f\n", "python", ["os", "sys", "a.b", ".", "..e"]),
        ("# import no\nx = 'import no'\n'''\nimport no\n'''\nimport yes\n", "python", ["yes"]),
        ('import "fmt"\nimport (\n\tm "math"\n\t. "strings"\n\t_ "os"\n)\n// import "no"\n', "go", ["fmt", "math", "strings", "os"]),
        ("use std::fs;\nmod util;\nuse crate::x;\nextern crate serde;\n", "rust", ["std", "util", "serde"]),
        ('#include <stdio.h>\n#include "my.h"\n// #include "no.h"\n', "c", ["stdio.h", "my.h"]),
        ("import a from './a'\nimport './side'\nexport { b } from \"./b\"\nconst c = require('./c')\n// import x from './no'\n", "javascript", ["./a", "./side", "./b", "./c"]),
        ("whatever", "cobol", []),
        ("   ", "python", []),
    ],
)
def test_imports(text, language, want):
    assert P.imports(text, language) == want


RUN = "def run(items):\n    for it in items:\n        if it:\n            try:\n                it.send()\n            except ValueError:\n                run(items)\n"


def test_python_calls():
    assert [(c[0], c[1], c[2], c[4], c[5], c[3]) for c in P.calls(RUN, "python", "run")] == [("send", 5, "method_call", "it", False, "try_block, conditional, loop"), ("run", 7, "function_call", None, True, "try_block, try_block, conditional, loop")]
    assert {(c[0], c[4]) for c in P.calls("a.b().c()", "python")} == {("b", "a"), ("c", "[chained]")}
    assert [c[:5] for c in P.calls('package p\nfunc f() {\n\tfmt.Println("x")\n}\n', "go")] == [("Println", 3, "method_call", None, "fmt")]
    assert P.calls("x(", "python") == [] and P.calls("x()", "cobol") == []


def test_calls_within_keep_file_lines():
    text = SHAPES + "\nclass C:\n    def go(self):\n        build()\n        go()\n"
    got = P.calls_within(text, "python", "go", 12, 14)
    assert [(c[0], c[1], c[5]) for c in got] == [("build", 13, False), ("go", 14, True)]


def test_relationships_and_exports():
    assert [r[:3] for r in P.relationships("class A(B, C, object):\n    pass\n", "python")] == [("A", "B", "extends"), ("A", "C", "extends")]
    assert {r[:3] for r in P.relationships("class A extends B implements C, D<E> {}", "typescript")} == {("A", "B", "extends"), ("A", "C", "implements"), ("A", "D", "implements")}
    assert P.exported("__all__ = [\"a\", 'b']", "python") == ["a", "b"]
    assert P.exported("export function f() {}\nexport { g, h as k }", "javascript") == ["f", "g", "h"]
    assert P.exported("pub struct S;", "rust") == ["S"]


@pytest.mark.parametrize(
    ("language", "name", "source", "there", "strict", "fixed"),
    [
        ("python", "pkg.util", "app/main.py", "pkg/util.py", "pkg/util.py", "pkg/util.py"),
        ("python", "util", "app/main.py", "app/util.py", "app/util.py", "app/util.py"),
        ("python", "pkg", "main.py", "pkg/__init__.py", "pkg/__init__.py", "pkg/__init__.py"),
        ("typescript", "./b", "src/a.ts", "src/b.tsx", "src/b.tsx", "src/b.tsx"),
        ("typescript", "./lib", "src/a.ts", "src/lib/index.ts", "src/lib/index.ts", "src/lib/index.ts"),
        ("typescript", "react", "src/a.ts", "react.ts", None, None),
        ("typescript", "../x", "src/a/m.ts", "src/x.ts", None, "src/x.ts"),
        ("tsx", "./b", "src/a.tsx", "src/b.tsx", None, "src/b.tsx"),
        ("rust", "util", "src/main.rs", "src/util.rs", "src/util.rs", "src/util.rs"),
        ("go", "x", "a.go", "x.go", None, None),
    ],
)
def test_import_resolution(spark, language, name, source, there, strict, fixed):
    for mode, want in ((True, strict), (False, fixed)):
        assert next((c for c in P.resolve_candidates(name, source, language, mode) if c == there), None) == want


def test_import_graph(spark):
    files = [("app/main.py", "import util\nimport pkg.deep\nimport main"), ("app/util.py", "import os"), ("pkg/deep.py", "from app import util"), ("app/__init__.py", "")]
    got = {tuple(r) for r in P.import_graph(spark.createDataFrame(files, "filename string, content string")).collect()}
    assert got == {("app/main.py", "app/util.py"), ("app/main.py", "pkg/deep.py"), ("pkg/deep.py", "app/__init__.py")}


def test_chunks_cover_the_text():
    text = "\n\n".join(f"paragraph {i} " + "word " * (i % 40) for i in range(200))
    found = P.chunks(text, 500, 100)
    assert found[0][0] == 0 and found[-1][1] == len(text)
    assert all(b - a <= 500 for a, b in found) and all(c <= b and c > a for (a, b), (c, _) in zip(found, found[1:]))
    assert P.chunks("") == [] and P.chunks("short") == [(0, 5)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="defclassfnimport(){}\"'`/*#\n\t :;=<>.x", max_size=120), st.sampled_from(P.LANGUAGES))
def test_parsers_never_raise(text, language):
    P.imports(text, language)
    P.symbols(text, "a", language)
    P.calls(text, language)
    P.relationships(text, language)
    P.exported(text, language)
