"""What a file name tells: category, weight, language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Settings

# The name patterns of each category, tried in this order, and the
# languages by ending.
CATEGORIES = {
    "test": r"(?i)(^|/)(tests?|__tests__|spec)/|test_[^/]*\.py$|_test\.(py|go|rs)$|\.(test|spec)\.[jt]sx?$|_spec\.rb$|Test\.java$|Tests?\.cs$",
    "documentation": r"(?i)(^|/)(README|CHANGELOG|CONTRIBUTING|LICENSE|docs?/)|\.(mdx?|rst)$",
    "config": r"(?i)(^|/)(\.env|Dockerfile|docker-compose|\.[^/]*rc$|Makefile$)|\.(ya?ml|toml|json)$",
}

_CHUNKER = {"py": "python", "rs": "rust", "go": "go", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "md": "markdown", "mdx": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "sql": "sql"}
_PARSER = {"py": "python", "go": "go", "rs": "rust", "cpp": "cpp", "cxx": "cpp", "cc": "cpp", "hpp": "cpp", "hxx": "cpp", "c": "c", "h": "c", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx"}


def category(filename: Column) -> Column:
    name, out = F.replace(filename, F.lit("\\"), F.lit("/")), None
    for kind, pattern in CATEGORIES.items():
        out = F.when(name.rlike(pattern), kind) if out is None else out.when(name.rlike(pattern), kind)
    return out.otherwise("implementation")


def category_weight(filename: Column, settings: Settings = Settings()) -> Column:
    kind = category(filename)
    return F.when(kind == "test", settings.test_weight).when(kind == "documentation", settings.documentation_weight).when(kind == "config", settings.config_weight).otherwise(settings.implementation_weight)


def symbol_weight(kind: Column) -> Column:
    return F.when(kind == "api", 1.2).when(kind == "internal", 0.8).when(kind == "test", 0.3).otherwise(1.0)


def _language(filename: Column, known: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.try_element_at(pairs, F.lower(F.regexp_extract(filename, r"\.([^./]+)$", 1)))


def chunk_language(filename: Column) -> Column:
    return F.coalesce(_language(filename, _CHUNKER), F.lit("text"))


def parse_language(filename: Column) -> Column:
    return _language(filename, _PARSER)
