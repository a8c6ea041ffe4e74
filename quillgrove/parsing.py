"""Symbols, imports, calls and relationships of source text.

Python is read by the standard library's own parser, other languages by a
scanner that blanks comments and strings and matches braces.  Neither raises on
broken or unknown input: it yields what can be read, or nothing.  The table
functions run a file at a time in Arrow batches; files are independent, so
nothing is shuffled.
"""

from __future__ import annotations

import ast
import re
import textwrap
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.files import parse_language
from .storage import few_rows, ship

LANGUAGES = ("python", "go", "rust", "c", "cpp", "javascript", "typescript", "tsx")
SYMBOLS = "symbol_name string, symbol_type string, line_start int, line_end int, signature string, docstring string, parent_symbol string, visibility string, category string"
CALLS = "function_name string, line_number int, call_type string, context string, object_name string, is_recursive boolean"
RELATIONS = "source_name string, target_name string, relationship_type string, source_line int, confidence double"


def supported(language: str | None) -> bool:
    return language in LANGUAGES


# reading


def blank(text: str, language: str) -> str:
    """The text with comments and string contents as spaces, lines in place."""
    quotes = "\"'`" if language in ("javascript", "typescript", "tsx") else "\"`" if language == "go" else '"'
    char = r"|'(?:\\.|[^'\\\n])'" if language in ("rust", "c", "cpp", "go") else ""
    strings = "|".join(rf"{q}(?:\\.|[^{q}\\{'' if q == '`' else chr(10)}])*{q}" for q in quotes)
    pattern = rf"//[^\n]*|/\*.*?(?:\*/|\Z)|{strings}{char}"
    wipe = lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1]
    return re.sub(pattern, wipe, text, flags=re.S)


def tree(text: str) -> ast.Module | None:
    """Python's syntax tree; of broken text, that of the longest start that parses."""
    text = textwrap.dedent(text)
    for _ in range(40):
        try:
            return ast.parse(text)
        except SyntaxError as e:
            lines = text.split("\n")
            cut = min(max((e.lineno or 1) - 1, 0), len(lines) - 1)
            if not cut:
                return None
            text = "\n".join(lines[:cut])
        except (ValueError, RecursionError, MemoryError):
            return None
    return None


def close(text: str, at: int) -> int:
    """Where the brace that opens at or after ``at`` closes."""
    depth = 0
    for m in re.compile(r"[{};]").finditer(text, at):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth <= 0:
                return m.start()
        elif not depth:
            return m.start()
    return len(text)


def line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


# imports


def imports(text: str, language: str | None) -> list[str]:
    """Imported names, in order, once each."""
    if not text.strip() or not supported(language):
        return []
    found: list[str] = []
    if language == "python":
        for node in ast.walk(tree(text) or ast.Module([], [])):
            if isinstance(node, ast.Import):
                found += [(node.lineno, a.name) for a in node.names]
            elif isinstance(node, ast.ImportFrom):
                found.append((node.lineno, "." * node.level + (node.module or "")))
        return list(dict.fromkeys(x for _, x in sorted(found, key=lambda p: p[0])))
    code = blank(text, language)
    if language in ("c", "cpp"):
        found = [text[m.start(1) : m.end(1)].strip() for m in re.finditer(r"^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]*)[>\"]", code, re.M)]
    elif language == "go":
        for m in re.finditer(r"^[ \t]*import\s*(\((?:[^)]*)\)|[^\n]*)", code, re.M):
            found += [text[m.start(1) + q.start() + 1 : m.start(1) + q.end() - 1] for q in re.finditer(r"\"[^\"]*\"|`[^`]*`", code[m.start(1) : m.end(1)])]
    elif language == "rust":
        for m in re.finditer(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:use\s+(?:::)?(\w+)|mod\s+(\w+)\s*;|extern\s+crate\s+(\w+))", code, re.M):
            found += [x for x in m.groups() if x and x != "crate"]
    else:
        pattern = r"\b(?:import|export)\b[^;\"'`]*?\bfrom\s*([\"'])|\bimport\s*([\"'])|\b(?:require|import)\s*\(\s*([\"'])"
        for m in re.finditer(pattern, code):
            end = code.find(m[m.lastindex], m.end())
            if end > 0:
                found.append(text[m.end() : end])
    return list(dict.fromkeys(x for x in found if x))


def resolve_candidates(name: str, source: str, language: str | None, strict: bool = True) -> list[str]:
    """Files that an import may mean, most likely first.  ``strict`` keeps two
    known gaps: ``..`` is not followed, and tsx imports mean nothing."""
    folder = source.rpartition("/")[0]
    within = lambda p: f"{folder}/{p}" if folder else p
    if language == "python":
        if not strict and name.startswith("."):
            up = len(name) - len(name.lstrip(".")) - 1
            parts = folder.split("/") if folder else []
            base = "/".join([*parts[: len(parts) - up], *filter(None, name.lstrip(".").split("."))])
            return [f"{base}.py", f"{base}/__init__.py"]
        path = name.replace(".", "/")
        path = path.strip("/") if path.strip("/") else ""
        ends = [f"{path}.py", f"{path}/__init__.py"] if path else ["__init__.py"]
        return [*ends, *map(within, ends)]
    if language in ("typescript", "javascript") or (language == "tsx" and not strict):
        if not name.startswith("."):
            return []
        parts = (folder.split("/") if folder else []) + name.split("/")
        out: list[str] = []
        for p in parts:
            if p == ".." and (strict or not out):
                return []
            out = out[:-1] if p == ".." else out if p == "." else [*out, p]
        base = "/".join(out)
        return [base + x for x in (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")]
    if language == "rust":
        return [f"src/{name}.rs", f"src/{name}/mod.rs"]
    return []


# symbols


def category(filename: str, name: str = "") -> str:
    stem = filename.replace("\\", "/").rpartition("/")[2].rpartition(".")[0].lower()
    told = any(x in stem for x in ("test_", "_test", "tests", "spec")) or "/test" in filename.lower()
    return "test" if told or re.match(r"(test_|Test[A-Z_]|Benchmark)", name) else "implementation"


def _shown(source: str, language: str) -> str:
    first = source.split("\n", 1)[0].strip()
    if language == "python":
        first = first[: first.rindex(":") + 1] if ":" in first else first
    else:
        first = first.split("{")[0].strip()
    return first.encode()[:200].decode(errors="ignore")


def _comment(lines: list[str], at: int) -> str | None:
    """What the documentation comments right above line ``at`` (from 1) say."""
    said: list[str] = []
    i = at - 2
    while i >= 0:
        s = lines[i].strip()
        if s.startswith(("///", "//!")):
            said.append(s[3:].strip())
        elif s.endswith("*/"):
            block = [s]
            while not block[-1].startswith("/*") and i:
                i -= 1
                block.append(lines[i].strip())
            said += [x.removeprefix("/**").removeprefix("/*").removesuffix("*/").strip().removeprefix("*").strip() for x in block]
        elif not s.startswith(("//", "#[", "@")):
            break
        i -= 1
    return "\n".join(x for x in reversed(said) if x) or None


_Symbol = tuple[str, str, int, int, str, str | None, str | None, str, str]


def _python_symbols(text: str, filename: str) -> list[_Symbol]:
    root, out, lines = tree(text), [], textwrap.dedent(text).split("\n")

    def visit(node: ast.AST, parent: str | None) -> None:
        for x in ast.iter_child_nodes(node):
            inside = parent
            if isinstance(x, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                made = isinstance(x, ast.ClassDef)
                kind = "class" if made else "method" if parent else "function"
                dunder = x.name.startswith("__") and x.name.endswith("__")
                seen = "internal" if dunder else "private" if x.name.startswith("__") else "internal" if x.name.startswith("_") else "public"
                said = ast.get_docstring(x)
                out.append((x.name, kind, x.lineno, x.end_lineno or x.lineno, _shown("\n".join(lines[x.lineno - 1 : x.end_lineno]), "python"), said or None, None if made else parent, seen, category(filename, x.name)))
                inside = x.name if made else parent
            visit(x, inside)

    if root is not None:
        visit(root, None)
    return out


_DECLARED = {
    "go": [(r"^func\s+(?:\(\s*\w*\s*\*?(\w+)[^)]*\)\s*)?(\w+)\s*[(\[]", "function"), (r"^type\s+()(\w+)\s+struct\b", "struct"), (r"^type\s+()(\w+)\s+interface\b", "interface"), (r"^type\s+()(\w+)\s+(?!struct|interface)\S", "type")],
    "rust": [(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+()(\w+)", "function"), (r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+()(\w+)", "struct"), (r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?enum\s+()(\w+)", "enum"), (r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?trait\s+()(\w+)", "interface")],
}
_SCRIPT = [
    (r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*()(\w+)", "function"),
    (r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+()(\w+)", "class"),
    (r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+()(\w+)[^=\n]*=\s*(?:async\s*)?(?:function\b|\([^)]*\)[^=\n]*=>|\w+\s*=>)", "value"),
]
_TYPED = [(r"^[ \t]*(?:export\s+)?(?:declare\s+)?interface\s+()(\w+)", "interface"), (r"^[ \t]*(?:export\s+)?type\s+()(\w+)[^=\n]*=", "type"), (r"^[ \t]*(?:export\s+)?(?:const\s+)?enum\s+()(\w+)", "enum")]
_METHOD = r"^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?(#?\w+)\s*(?:<[^>\n]*>)?\([^;{}]*\)[^;{}\n]*\{"
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "function", "return", "with", "do"}


def _named(kind: str, name: str) -> str:
    return kind if kind != "value" else "hook" if re.match(r"use[A-Z]", name) else "component" if name[:1].isupper() else "function"


def symbols(text: str, filename: str, language: str | None) -> list[_Symbol]:
    """``SYMBOLS`` rows; none for C and C++."""
    if not text.strip() or language not in ("python", "go", "rust", "javascript", "typescript", "tsx"):
        return []
    if language == "python":
        return _python_symbols(text, filename)
    code, lines = blank(text, language), text.split("\n")
    scopes: list[tuple[int, int, str]] = []
    if language == "rust":
        for m in re.finditer(r"^[ \t]*impl\b(?:<[^{]*?>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)[^{;]*\{", code, re.M):
            scopes.append((m.start(), close(code, m.start()), m[1]))
    patterns = _DECLARED.get(language) or _SCRIPT + (_TYPED if language != "javascript" else [])
    out: list[_Symbol] = []
    bodies: list[tuple[int, int]] = []  # of values: not looked into

    def last(m: re.Match, at: int) -> int:
        """Where a declaration ends: an arrow's plain expression at its line's end."""
        after = code[m.end() :].lstrip(" \t")
        if m[0].endswith("=>") and after[:1] not in ("{", "(", "\n"):
            return m.end() + (code[m.end() :] + "\n").index("\n")
        return close(code, max(at, m.end() if m[0].endswith("=>") else at))

    def add(m: re.Match, name: str, kind: str, parent: str | None) -> None:
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        end, head = last(m, at), text[at : text.find("\n", at) if "\n" in text[at:] else len(text)]
        seen = "public"
        if language == "go":
            seen = "public" if name[:1].isupper() else "internal"
        elif language == "rust":
            seen = "public" if head.lstrip().startswith("pub") else "private"
        first = line(code, at)
        end = at if kind == "type" and "{" not in head else end
        out.append((name, kind, first, line(code, min(end, len(code))), _shown(head, language), _comment(lines, first), parent, seen, category(filename, name)))

    for pattern, kind in patterns:
        for m in re.finditer(pattern, code, re.M):
            name, parent = m[2], m[1] or next((s for a, b, s in reversed(scopes) if a < m.start() < b), None)
            told = "method" if kind == "function" and parent else _named(kind, name)
            if kind == "value":
                bodies.append((m.start(), last(m, m.end())))
            if kind == "class":
                scopes.append((m.start(), close(code, m.start()), name))
            add(m, name, told, parent if kind == "function" else None)
    if language in ("javascript", "typescript", "tsx"):
        for a, b, owner in list(scopes):
            brace = code.find("{", a)
            for m in re.compile(_METHOD, re.M).finditer(code, brace + 1, b):
                if m[1] not in _NOT_METHODS and code.count("{", brace, m.start()) - code.count("}", brace, m.start()) == 1:
                    add(m, m[1], "method", owner)
    held = [(line(code, a), line(code, b)) for a, b in bodies]
    kept = [s for s in out if not any(a < s[2] <= b for a, b in held)]
    return sorted(kept, key=lambda s: (s[2], s[3], s[0]))


def exported(text: str, language: str | None) -> list[str]:
    """Names that a file offers to others."""
    if language == "python":
        m = re.search(r"__all__\s*=\s*[\[(]([^\])]*)[\])]", text)
        return re.findall(r"[\"'](\w+)[\"']", m[1]) if m else []
    if language == "rust":
        return re.findall(r"\bpub\s+(?:async\s+)?(?:fn|struct|enum|trait|const|type|mod)\s+(\w+)", text)
    if language in ("javascript", "typescript", "tsx"):
        out = re.findall(r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\*?|class|const|let|var|interface|type|enum)\s+(\w+)", text)
        for group in re.findall(r"\bexport\s*\{([^}]*)\}", text):
            out += [x.split()[0] for x in group.split(",") if x.strip()]
        return list(dict.fromkeys(out))
    return []


def relationships(text: str, language: str | None) -> list[tuple[str, str, str, int, float]]:
    out = []
    if language == "python" and text.strip():
        for x in ast.walk(tree(text) or ast.Module([], [])):
            if isinstance(x, ast.ClassDef):
                out += [(x.name, b.id, "extends", x.lineno, 1.0) for b in x.bases if isinstance(b, ast.Name) and b.id not in ("object", "ABC")]
    elif language in ("typescript", "tsx"):
        code = blank(text, language)
        for m in re.finditer(r"\b(?:class|interface)\s+(\w+)(?:<[^{]*?>)?([^{]*)\{", code):
            for word, kind in (("extends", "extends"), ("implements", "implements")):
                tail = re.search(rf"\b{word}\s+(.*?)(?=\bimplements\b|$)", m[2], re.S)
                names = re.sub(r"<[^>]*>", "", tail[1]).split(",") if tail else []
                out += [(m[1], n.strip(), kind, line(code, m.start()), 1.0) for n in names if n.strip()]
    return out


# calls

_CONTEXTS = [((ast.Try,), "try_block"), ((ast.ExceptHandler,), "try_block"), ((ast.If,), "conditional"), ((ast.For, ast.AsyncFor, ast.While), "loop"), ((ast.With, ast.AsyncWith), "with_block")]


def calls(text: str, language: str | None, current: str | None = None) -> list[tuple[str, int, str, str | None, str | None, bool]]:
    """``CALLS`` rows of Python and Go text."""
    out: list[tuple[str, int, str, str | None, str | None, bool]] = []
    if not text.strip():
        return out
    if language == "python":

        def visit(node: ast.AST, around: tuple[str, ...]) -> None:
            for kinds, told in _CONTEXTS:
                if isinstance(node, kinds):
                    around = (told, *around)
            if isinstance(node, ast.Call):
                f, shown = node.func, ", ".join(around) or None
                if isinstance(f, ast.Name):
                    out.append((f.id, node.lineno, "function_call", shown, None, f.id == current))
                elif isinstance(f, ast.Attribute):
                    out.append((f.attr, getattr(f, "end_lineno", node.lineno), "method_call", shown, f.value.id if isinstance(f.value, ast.Name) else "[chained]", f.attr == current))
            for x in ast.iter_child_nodes(node):
                visit(x, around)

        try:
            visit(tree(text) or ast.Module([], []), ())
        except RecursionError:
            return []
    elif language == "go":
        code = blank(text, language)
        for m in re.finditer(r"(?:(\w+|\))\s*\.\s*)?\b(\w+)\s*\(", code):
            if m[2] in ("if", "for", "switch", "select", "func", "return", "go", "defer", "range", "import", "var", "const", "type") or re.search(r"\bfunc\s*(\([^)]*\)\s*)?$", code[max(0, m.start() - 200) : m.start(2)]):
                continue
            owner = "[chained]" if m[1] == ")" else m[1]
            out.append((m[2], line(code, m.start(2)), "method_call" if owner else "function_call", None, owner, False))
    return out


def calls_within(text: str, language: str | None, name: str, first: int, last: int) -> list[tuple]:
    """Calls of the symbol on lines ``first`` to ``last``, at the file's lines."""
    part = "\n".join(text.split("\n")[first - 1 : last])
    return [(c[0], c[1] + first - 1, *c[2:]) for c in calls(part, language, name)]


def chunks(text: str, size: int = 2000, overlap: int = 400) -> list[tuple[int, int]]:
    """``[start, end)`` offsets: cut at the last blank line, line end or space
    of each window's second half; each chunk but the first starts ``overlap``
    characters back, at a line where there is one."""
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            half = at + size // 2
            end = next((k + len(s) for s in ("\n\n", "\n", " ") if (k := text.rfind(s, half, end)) >= 0), end)
        out.append((at, end))
        if end == len(text):
            break
        back = max(end - overlap, at + 1)
        nl = text.find("\n", back, end)
        at = nl + 1 if 0 <= nl < end - 1 else back
    return out


# table functions


def _table(files: DataFrame, schema: str, rows: Callable[[str, str, str | None], list[tuple]]) -> DataFrame:
    """Applies ``rows(text, filename, language)`` to ``(filename, content)``."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            out: list[list] = [[] for _ in range(len(names) + 1)]
            for name, text, language in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for row in rows(text or "", name or "", language):
                    for column, value in zip(out, (name, *row), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.string(), *types], strict=True)], names=["filename", *names])

    ship(files.sparkSession)
    told = files.select("filename", "content", parse_language(F.col("filename")).alias("language"))
    return told.mapInArrow(run, f"filename string, {schema}")


def file_symbols(files: DataFrame) -> DataFrame:
    return _table(files, SYMBOLS, lambda text, name, lang: symbols(text, name, lang))


def file_imports(files: DataFrame) -> DataFrame:
    return _table(files, "import_name string, language string", lambda text, name, lang: [(x, lang) for x in imports(text, lang)])


def file_calls(files: DataFrame) -> DataFrame:
    return _table(files, CALLS, lambda text, name, lang: calls(text, lang))


def symbol_calls(files: DataFrame) -> DataFrame:
    """Calls by the function or method that makes them."""

    def rows(text: str, name: str, lang: str | None) -> list[tuple]:
        own = [s for s in symbols(text, name, lang) if s[1] in ("function", "method")]
        return [(s[0], s[2], *c) for s in own for c in calls_within(text, lang, s[0], s[2], s[3])]

    return _table(files, f"symbol_name string, line_start int, {CALLS}", rows)


def file_relationships(files: DataFrame) -> DataFrame:
    return _table(files, RELATIONS, lambda text, name, lang: relationships(text, lang))


def file_exports(files: DataFrame) -> DataFrame:
    return _table(files, "symbol_name string", lambda text, name, lang: [(x,) for x in exported(text, lang)])


def file_chunks(files: DataFrame, size: int = 2000, overlap: int = 400) -> DataFrame:
    """``(filename, start, end, content)``."""
    return _table(files, "start int, end int, content string", lambda text, name, lang: [(a, b, text[a:b]) for a, b in chunks(text, size, overlap)])


def import_graph(files: DataFrame, strict: bool = True) -> DataFrame:
    """Distinct ``(src, dst)``: each import's candidates against the files
    there are, the first that exists; a file never imports itself."""

    def rows(text: str, name: str, lang: str | None) -> list[tuple]:
        return [(x, i, c) for x in imports(text, lang) for i, c in enumerate(resolve_candidates(x, name, lang, strict))]

    wanted = _table(files, "import_name string, priority int, candidate string", rows)
    there = files.select(F.col("filename").alias("candidate")).distinct()
    found = wanted.join(there, "candidate").groupBy("filename", "import_name").agg(F.min_by("candidate", "priority").alias("dst"))
    return found.filter("filename <> dst").select(F.col("filename").alias("src"), "dst").distinct()
