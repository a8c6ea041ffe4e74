"""Retrieval plans: hybrid search, file search, curated sections.

Tables of an index: ``chunks(filename, location, start, end, content,
embedding)``, ``symbols``, ``centrality(filename, score)``, ``edges(src, dst)``
and ``files(filename, content)``.  Rankings are planned on keys and scores; the
text of a candidate is joined back only after the top-k cuts.  Every list
below is a top-k cut of at most a few dozen rows, so its windows are small.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import QuillgroveError, Settings, check_query
from ..functions import files as N
from ..functions import text as T
from ..operators import fusion, graph, lexical, spans, vectors
from ..operators.diversity import content_mmr, file_mmr
from ..storage import stored

log = logging.getLogger(__name__)


@dataclass
class Index:
    """The tables of one repository; those that are missing are None."""

    chunks: DataFrame
    symbols: DataFrame | None = None
    centrality: DataFrame | None = None
    edges: DataFrame | None = None
    files: DataFrame | None = None
    lexicon: lexical.Lexicon | None = None


Reranker = Callable[[DataFrame, str, int], DataFrame]


def tokens_of(spark, query: str) -> list[str]:
    found = spark.range(1).select(T.query_tokens(F.lit(query)).alias("t")).first()["t"]
    return found or [w for w in query.lower().split() if len(w) >= 2]


def _doc(chunks: DataFrame) -> DataFrame:
    key = F.sha2(F.concat_ws("\0", "filename", "location", F.sha2(F.trim("content"), 256)), 256)
    return chunks.withColumn("doc", key)


def vector_list(index: Index, vector: list[float], k: int = 30) -> DataFrame:
    return vectors.nearest(_doc(index.chunks), vector, top_k=k)


def searched(chunks: DataFrame) -> DataFrame:
    """``(doc, content)`` as the lexical backends read chunks."""
    return _doc(chunks).select("doc", T.search_content(F.col("content")).alias("content"))


def lexical_list(index: Index, tokens: list[str], k: int = 30) -> DataFrame:
    """BM25+, over stored postings where the index has them; where no word
    matches, the keyword fallback.  The list is computed here, once."""
    if index.lexicon is not None:
        found = stored(lexical.bm25_plus_stored(index.lexicon, tokens, top_k=k), "list")
    else:
        found = stored(lexical.bm25_plus(searched(index.chunks), tokens, top_k=k), "list")
    return found if found.limit(1).count() else lexical.keyword_fallback(searched(index.chunks), tokens, top_k=k)


def symbol_list(index: Index, tokens: list[str], vector: list[float] | None, k: int = 30, files: DataFrame | None = None, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """Symbols by vector and by full text, at 2k each, fused and cut.  A side
    that fails (vectors of another length, say) is an error: the other side's
    ranking alone would look like the result of both."""
    symbols = index.symbols.withColumn("doc", F.sha2(F.concat_ws("\0", "filename", "symbol_name", "symbol_type", "line_start", "line_end"), 256))
    if files is not None:
        symbols = symbols.join(files.select("filename").distinct(), "filename", "left_semi")
    content = F.concat_ws(" ", "symbol_name", "signature", F.coalesce("docstring", F.lit("")))
    docs = symbols.select("doc", T.search_content(content).alias("content"))
    matching = docs.filter(lexical.matches(F.col("content"), tokens, every=True))
    sides = [(weights[1], lambda: lexical.bm25_plus(matching, tokens, top_k=2 * k, threshold=-1.0))]
    if vector is not None and "embedding" in symbols.columns:
        sides.append((weights[0], lambda: vectors.nearest(symbols, vector, top_k=2 * k)))
    try:
        lists = [fusion.ranked(stored(make(), "list")) for _, make in sides]  # 2k rows, computed once
    except Exception as e:
        raise QuillgroveError("a side of the symbol search failed") from e
    fused = fusion.rrf_results(lists, [weight for weight, _ in sides]).orderBy(F.desc("score"), "doc").limit(k)
    return F.broadcast(fused.drop("best")).join(symbols, "doc")  # k rows


def _symbol_rows(found: DataFrame) -> DataFrame:
    head = F.when(F.col("parent_symbol").isNotNull(), F.concat(F.lit("class "), "parent_symbol", F.lit(":\n    "))).otherwise(F.lit(""))
    preview = F.when(F.length("docstring") > 200, F.concat(F.substring("docstring", 1, 200), F.lit("..."))).otherwise(F.col("docstring"))
    doc = F.when(F.col("docstring").isNotNull(), F.concat(F.lit('\n    """'), preview, F.lit('"""'))).otherwise(F.lit(""))
    return found.select("doc", "filename", F.concat_ws(":", "line_start", "line_end").alias("location"), F.concat(head, "signature", doc).alias("content"), "score")


def symbol_text(filename, name, kind, parent, signature, docstring):
    """What is embedded for a symbol, as a column expression."""
    told = F.regexp_replace(docstring, "^#hash:[^#]*#", "")
    parts = [F.concat(F.lit("# File: "), filename), F.concat(F.lit("# Symbol: "), name, F.lit(" ("), kind, F.lit(")")), F.when(parent.isNotNull(), F.concat(F.lit("# Parent: "), parent)), F.concat(F.lit("\n"), signature), F.when(told != "", F.concat(F.lit('\n"""'), told, F.lit('"""')))]
    return F.concat_ws("\n", *parts)


def hybrid(index: Index, query: str, vector: list[float] | None, top_k: int = 10, settings: Settings = Settings(), reranker: Reranker | None = None, strict: bool = False) -> DataFrame:
    """``(filename, location, content, score)``.  A backend that fails is left
    out; it is an error only if all of them do, or with ``strict``."""
    check_query(query, 100 if top_k > 100 else top_k)
    spark, k = index.chunks.sparkSession, settings.candidates
    tokens = tokens_of(spark, query)
    lists, weights, contents, failed = [], [], [], []

    def attempt(weight: float, make: Callable[[], tuple[DataFrame, DataFrame]]) -> None:
        try:
            found, content = make()
            found = stored(found, "list")  # at most k rows, computed once
            if found.limit(1).count():
                lists.append(fusion.ranked(found.select("doc", "score")))
                weights.append(weight)
                contents.append(content)
        except Exception as e:  # one backend's failure is not the search's
            if strict:
                raise QuillgroveError("a search backend failed") from e
            log.warning("a search backend failed", exc_info=True)
            failed.append(e)

    rows = _doc(index.chunks).select("doc", "filename", "location", "content")
    tried = 1 + (vector is not None) + (index.symbols is not None)
    if vector is not None:
        attempt(settings.vector_weight, lambda: (vector_list(index, vector, k), rows))
    attempt(settings.lexical_weight, lambda: (lexical_list(index, tokens, k), rows))
    if index.symbols is not None:

        def by_symbol() -> tuple[DataFrame, DataFrame]:
            found = stored(_symbol_rows(symbol_list(index, tokens, vector, k)), "list")
            return found, found.drop("score")

        attempt(settings.symbol_weight, by_symbol)
    if len(failed) == tried:
        raise QuillgroveError("every search backend failed") from failed[0]
    if not lists:
        return rows.select("filename", "location", "content", F.lit(0.0).alias("score")).limit(0)
    fused = fusion.rrf_results(lists, weights, settings.rrf_k).drop("best").orderBy(F.desc("score"), "doc").limit(k)
    # k rows; copies of a chunk are told apart here, so that no other text is shuffled
    named = F.broadcast(fused).join(reduce(DataFrame.unionByName, dict.fromkeys(contents)), "doc")
    one = F.row_number().over(Window.partitionBy("doc").orderBy("filename", "location", "content"))
    found = stored(fusion.ranked(named.withColumn("_n", one).filter("_n = 1").drop("_n")), "candidates")
    if 2 * top_k < k:
        found = content_mmr(found.withColumn("query", F.lit("q")), 2 * top_k, weight=settings.content_lambda).drop("query")

    def boosted(df: DataFrame) -> DataFrame:
        if index.centrality is not None:
            df = fusion.centrality_boost(df, index.centrality, settings.centrality_weight)
        return fusion.category_boost(df, settings=settings)

    found = fusion.resorted(boosted(found))
    if reranker is not None:
        found = boosted(reranker(found, query, top_k))
    return found.orderBy(F.desc("score"), "rank").limit(top_k).select("filename", "location", "content", "score")


def related(index: Index, found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(filename, relation, hop)`` of implementation files near the found ones."""
    names = found.select(F.col("filename").alias("node")).distinct()
    starts = names.withColumn("place", F.row_number().over(Window.orderBy("node")) - 1)  # of a top-k list
    tree = graph.bfs_tree(index.edges, starts, settings.hops, settings.graph_results)
    return graph.expand(found, tree).select(F.col("target").alias("filename"), "relation", "hop")


def file_search(index: Index, query: str, vector: list[float] | None, top_k: int = 10, settings: Settings = Settings(), reranker: Reranker | None = None, strict: bool = False) -> DataFrame:
    """``(rank, filename, score, content, locations, is_reference_only)``: the
    first files in full, the others by signature."""
    check_query(query, top_k)
    hits = stored(hybrid(index, query, vector, 3 * top_k, settings, reranker, strict), "hits")  # 3 top_k rows, computed once
    chunks = fusion.adaptive_cut(hits, top_k, settings.score_ratio)
    by = Window.partitionBy("filename").orderBy(F.desc("score"), "location")
    begin = F.regexp_extract("location", r"(\d+)", 1).try_cast("int")
    best = chunks.withColumn("n", F.row_number().over(by)).withColumn("begin", begin)
    per = best.groupBy("filename").agg(
        F.max("score").alias("score"),
        F.min_by("content", "n").alias("top"),
        F.array_sort(F.collect_list(F.when(F.col("n") <= settings.chunks_per_file, F.struct("begin", "content")))).alias("shown"),
        F.slice(F.array_sort(F.collect_set(T.location(F.col("location")))), 1, 3).alias("locations"),
    )
    per = fusion.ranked(per.withColumn("category", N.category(F.col("filename"))).withColumn("query", F.lit("q")), "filename")
    chosen = file_mmr(per, top_k, weight=settings.file_lambda)
    full = F.col("rank") < settings.full_snippets
    content = F.when(full, F.array_join(F.array_distinct("shown.content"), "\n\n")).otherwise(T.signature(F.col("top")))
    out = chosen.select("rank", "filename", F.round("score", 4).alias("score"), content.alias("content"), "locations", (~full).alias("is_reference_only"))
    if index.edges is None:
        return out
    out = stored(out, "files")  # top_k rows
    near = related(index, out, settings)
    place = F.row_number().over(Window.orderBy("hop", "filename")) + 1000
    return out.unionByName(near.select(place.cast("int").alias("rank"), "filename", F.lit(0.0).alias("score"), F.lit("").alias("content"), F.array().cast("array<string>").alias("locations"), F.lit(True).alias("is_reference_only")))


def choose_symbols(index: Index, files: DataFrame, query: str, vector: list[float] | None, most: int = 20, per_file: int = 3, most_lines: int = 220) -> DataFrame:
    """Symbols of implementation files among ``files``, of the whole repository
    if those have none; functions and short symbols first."""
    spark = index.chunks.sparkSession
    tokens = tokens_of(spark, query)
    scope = files.filter(N.category(F.col("filename")) == "implementation").select("filename")
    found = stored(symbol_list(index, tokens, vector, most, scope), "list")
    if not found.limit(1).count():
        found = stored(symbol_list(index, tokens, vector, most), "list")
    lines = F.col("line_end") - F.col("line_start") + 1
    every = Window.partitionBy()  # a top-k list
    kind = F.col("symbol_type").isin("function", "method")
    found = found.withColumn("_any", F.max(kind).over(every)).filter(kind | ~F.col("_any"))
    found = found.withColumn("_short", F.max(lines <= most_lines).over(every)).filter((lines <= most_lines) | ~F.col("_short")).drop("_any", "_short")
    return fusion.cap_per_group(found, "filename", per_file, [F.desc("score"), F.asc("doc")], most).withColumn("score", F.round("score", 6))


def with_code(symbols: DataFrame, files: DataFrame, limit: int = 8_000) -> DataFrame:
    """Adds each symbol's ``code``, the lines of its file under a budget of
    bytes, with ``end`` and ``truncated``.  ``symbols`` is a top-k list."""
    whole = files.select("filename", F.col("content").alias("_whole"))
    joined = F.broadcast(symbols).join(whole, "filename").filter(F.col("line_start") <= F.size(F.split("_whole", "\n", -1)))
    return spans.extract_lines(joined, F.col("line_start"), F.col("line_end"), limit, "_whole").drop("_whole", "n_lines")


def prioritise(files: DataFrame, docs: bool = True, tests: bool = False, most: int = 4) -> DataFrame:
    """``files(filename, rank)`` without tests unless asked, and with one
    documentation file at most."""
    kind = N.category(F.col("filename"))
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("rank"))
    ok = (F.col("kind") != "documentation") | (F.lit(docs) & (F.col("nth") == 1))
    kept = files.withColumn("kind", kind).withColumn("nth", nth).filter(ok & ((F.col("kind") != "test") | F.lit(tests)))
    return kept.orderBy("rank").limit(most).select("filename", "rank")


def curated_sections(index: Index, query: str, vector: list[float] | None, settings: Settings = Settings(), strict: bool = False) -> DataFrame:
    """Line-accurate sections of a few files under a budget of characters.  The
    budget is spent in rank order by an aggregate over at most ``sections``
    rows, as what is left depends on what each section took.  Each short list
    is stored, so chunks are searched once and files are read once."""
    plain = Index(index.chunks, None, index.centrality, index.edges, index.files)
    hits = stored(hybrid(plain, query, vector, 20, settings, strict=strict), "hits")
    order = hits.groupBy("filename").agg(F.max("score").alias("score"))
    files = fusion.ranked(order, "filename").select("filename", "rank", "score")
    tests = "test" in query.lower()
    chosen = stored(prioritise(files.select("filename", "rank"), tests=tests, most=settings.section_files), "files")
    marks = None
    if index.symbols is not None:
        found = choose_symbols(index, chosen, query, vector, per_file=2).join(chosen.select("filename"), "filename", "left_semi")
        marks = stored(found.select("filename", "line_start", "line_end", "score", F.lit("symbol").alias("source")), "marks")
    uncovered = chosen if marks is None else chosen.join(marks.select("filename").distinct(), "filename", "left_anti")
    top = hits.join(uncovered.select("filename"), "filename", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("filename").orderBy(F.desc("score"), "location"))).filter("n = 1")
    content = stored(F.broadcast(chosen.select("filename")).join(index.files.select("filename", F.col("content").alias("whole")), "filename"), "whole")
    number = lambda k: F.regexp_extract("location", r"\[(\d+),\s*(\d+)\)", k).try_cast("int")
    placed = F.broadcast(top).join(content, "filename").filter(number(1).isNotNull())
    first = F.greatest(T.line_at(F.col("whole"), number(1)) - 10, F.lit(1))
    rows = placed.select("filename", first.alias("line_start"), (T.line_at(F.col("whole"), number(2)) + 10).alias("line_end"), "score", F.lit("chunk").alias("source"))
    marks = stored(rows if marks is None else marks.unionByName(rows), "marks")
    best = marks.groupBy("filename").agg(F.max("score").alias("score"), F.min("source").alias("source"))
    merged = spans.merge(marks, settings.merge_gap).join(best, "filename").join(chosen, "filename").orderBy("rank", "line_start").limit(settings.sections)
    lines = F.split("whole", "(?<=\n)")
    cut = F.array_join(F.slice(lines, F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "")
    taken = F.broadcast(merged).join(content, "filename").withColumn("content", F.substring(cut, 1, settings.section_chars)).filter("content <> ''")
    used = F.coalesce(F.sum(F.length("content")).over(Window.orderBy("rank", "line_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a few rows
    left = taken.withColumn("left", settings.budget_chars - used).filter("left > 0")
    text = F.substring("content", F.lit(1), F.col("left").cast("int"))
    end = F.col("line_start") + F.length(F.regexp_replace(F.regexp_replace(text, "\n$", ""), "[^\n]", ""))
    return left.select("rank", "filename", "line_start", end.alias("line_end"), text.alias("content"), "source", F.round("score", 6).alias("score"))


def with_symbol_files(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """Found files with their category and source, and then, by name, the files
    that only symbols were found in, by reference."""
    kind = N.category(F.col("filename"))
    near = F.when(F.col("rank") >= 1000, "graph").otherwise("search")
    files = found.withColumn("category", kind).withColumn("source", near)
    more = symbols.select("filename").distinct().join(found.select("filename"), "filename", "left_anti")  # a top-k list
    rank = (F.row_number().over(Window.orderBy("filename")) + 2000).cast("int")
    none = F.array().cast("array<string>")
    return files.unionByName(more.select(rank.alias("rank"), "filename", F.lit(None).cast("double").alias("score"), F.lit("").alias("content"), none.alias("locations"), F.lit(True).alias("is_reference_only"), kind.alias("category"), F.lit("symbol").alias("source")))


def diagnostics(index: Index, query: str, vector: list[float] | None, settings: Settings = Settings()) -> dict:
    """Tokens, the lexical backend, corpus statistics, and the size and the
    seconds of each backend's list."""
    tokens = tokens_of(index.chunks.sparkSession, query)
    out = {"tokens": tokens, "backend": "postings" if index.lexicon is not None else "scan", "stats": lexical.corpus_stats(index.chunks).first().asDict(), "seconds": {}}
    lists = {"lexical": lambda: lexical_list(index, tokens, settings.candidates)}
    if vector is not None:
        lists["vector"] = lambda: vector_list(index, vector, settings.candidates)
    if index.symbols is not None:
        lists["symbols"] = lambda: symbol_list(index, tokens, vector, settings.candidates)
    for name, make in lists.items():
        began = time.perf_counter()
        out[name] = make().count()
        out["seconds"][name] = round(time.perf_counter() - began, 3)
    return out
