"""Settings, read from ``QUILLGROVE_*`` variables; a bad value means the default."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    dimensions: int = 1024
    chunk_size: int = 2000
    chunk_overlap: int = 400
    candidates: int = 30
    k1: float = 1.2
    b: float = 0.75
    vector_weight: float = 0.6
    lexical_weight: float = 0.4
    symbol_weight: float = 0.7
    rrf_k: int = 40
    implementation_weight: float = 1.0
    documentation_weight: float = 0.7
    test_weight: float = 0.3
    config_weight: float = 0.6
    file_lambda: float = 0.6
    content_lambda: float = 0.7
    centrality_weight: float = 1.0
    hops: int = 3
    graph_results: int = 30
    score_ratio: float = 0.4
    full_snippets: int = 3
    chunks_per_file: int = 3
    budget_chars: int = 20_000
    section_chars: int = 8_000
    section_files: int = 4
    sections: int = 8
    merge_gap: int = 4

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env, found = os.environ if env is None else env, {}
        for f in fields(cls):
            try:
                value = type(f.default)(env[f"QUILLGROVE_{f.name.upper()}"])
                found[f.name] = value if value >= 0 else f.default
            except (KeyError, ValueError):
                continue
        return cls(**found)


class QuillgroveError(Exception):
    """Base of the library's own errors."""


class InvalidInput(QuillgroveError, ValueError):
    """An argument outside its range."""


class IndexMissing(QuillgroveError):
    """A repository that was never indexed."""


def public_message(error: Exception) -> str:
    """What a client is told: the fault for a wrong argument, else no detail."""
    if isinstance(error, InvalidInput):
        return str(error)
    if isinstance(error, IndexMissing):
        return "the repository is not indexed"
    return "the search failed" if isinstance(error, QuillgroveError) else "an unexpected error occurred"


def check_query(query: str, top_k: int = 10) -> None:
    if not query or not query.strip() or len(query) > 50_000:
        raise InvalidInput("a query has 1 to 50,000 characters")
    if not 1 <= top_k <= 100:
        raise InvalidInput("top_k is between 1 and 100")
