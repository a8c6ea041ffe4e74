"""Plain versions of the operators' contracts, and a table of awkward rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = "keep string, kept string, rank string, component string, n string, key string, block string, votes string, rep string, ids string, ranges string"
N_CLASHES = len(CLASHES.split(", "))
PASSAGE = " ".join(f"shared{i}" for i in range(70))
PROSE = "The river ran past the old mill and the miller counted his sacks before the evening bell rang in town. "


def awkward_rows() -> list[tuple]:
    long = " ".join(f"w{i * i % 7919}" for i in range(60_000))
    texts = [
        (1, PROSE * 1), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "), (5, "one two three"), (6, "ONE two THREE"),
        (7, long), (8, long + " tail"), (9, "start " + PASSAGE + " end"), (10, "other " + PASSAGE + " words after it"),
        (10, "other " + PASSAGE + " words after it"), (11, PASSAGE), (12, PROSE.replace("mill ", "MILL ")), (13, "# $ % & | < > *" * 9),
        (14, "line one\nline one\n\nline two\nline one"), (15, "été 你好 мир 🙂 x " * 12), (16, "a\u0000b c"), (17, "word " * 500),
        (18, "\u0085  odd spaces"), (None, PROSE), (None, None), (20, PROSE), (20, PROSE + "more"), (21, "x" * 300_000), (22, "<|endoftext|> a <|im_start|>"),
    ]
    return [(i, t, None if k % 2 else "en", None if k % 3 else "src", None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


def awkward(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """``documents`` with nulls, repeats, ties and columns of clashing names."""
    rows = awkward_rows() if rows is None else rows
    return spark.createDataFrame([(*r, *["x"] * N_CLASHES) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}")


def empty(spark: SparkSession) -> DataFrame:
    return awkward(spark, [])


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(seen), set()
    for i, w in enumerate(seen):
        if times[w] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text: str | None) -> frozenset:
    words = WORD.findall(lower(text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def close(a: frozenset, b: frozenset, percent: int = 85) -> bool:
    both = len(a & b)
    return bool(a and b) and 100 * both >= percent * (len(a) + len(b) - both)


def reach(n: int, links: list[tuple[int, int]]) -> list[list[int]]:
    """Connected groups of row numbers."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(n):
        groups[find(i)].append(i)
    return list(groups.values())


def near(rows: list[tuple[int, str | None]], percent: int = 85) -> list[tuple]:
    """``(doc_id, n_shingles, component_id, kept)`` of each row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if close(sets[i], sets[j], percent)]
    out = []
    for group in reach(len(rows), links):
        least = min(rows[i][0] for i in group)
        out += [(rows[i][0], len(sets[i]), least, rows[i][0] == least) for i in group]
    return sorted(out)


def removed(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """``(doc_id, words, words removed, kept words)`` of each row."""
    first: dict[tuple, int] = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (key, _), own in zip(rows, words, strict=True):
        for i in range(len(own) - 49) if key is not None else ():
            w = tuple(own[i : i + 50])
            first[w] = min(first.get(w, key), key)
    out = []
    for (key, _), own in zip(rows, words, strict=True):
        gone: set[int] = set()
        for i in range(len(own) - 49) if key is not None else ():
            if first[tuple(own[i : i + 50])] < key:
                gone.update(range(i, i + 50))
        out.append((key, len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    return out
