"""Graphs as edge tables ``(src, dst)``: PageRank, traversals, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6, local_most: int = 100_000) -> DataFrame:
    """``(node, score)``.  Repeated edges count; the mass of nodes without
    edges out is spread evenly.  Repeats are summed to weights once, before the
    loop, which ends when the L1 change falls below ``tolerance``.  A graph of
    up to ``local_most`` weighted edges (a few MB, counted first) is iterated
    on the driver.  Beyond that each round is one written table, so neither
    plan nor recovery grows with the rounds, and one aggregate over it gives
    the next round's stray mass and the change."""
    links = edges.groupBy("src", "dst").agg(F.count("*").alias("w"))
    out = links.groupBy("src").agg(F.sum("w").alias("out"))
    links = stored(links.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share")), "links")
    if links.count() <= local_most:
        return _pagerank_here(links, damping, rounds, tolerance)
    nodes = _nodes(links).join(links.select(F.col("src").alias("node")).distinct().withColumn("has", F.lit(True)), "node", "left")
    nodes = stored(nodes.select("node", F.col("has").isNull().alias("dangling")), "nodes")
    n = nodes.count()
    ranks = nodes.select("*", F.lit(1 / n).alias("score"))
    lost = nodes.filter("dangling").count() / n
    for _ in range(rounds):
        given = links.join(ranks.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        new = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + lost / n)
        ranks = stored(ranks.select("node", "dangling", F.col("score").alias("old")).join(given, "node", "left").select("node", "dangling", new.alias("score"), "old"), "ranks")
        lost, change = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("score"))), F.lit(0.0)), F.sum(F.abs(F.col("score") - F.col("old")))).first()
        if tolerance is not None and change < tolerance:
            break
    return ranks.select("node", "score")


def _pagerank_here(links: DataFrame, damping: float, rounds: int, tolerance: float | None) -> DataFrame:
    """The same sums over a bounded edge table."""
    held = links.toArrow().combine_chunks()
    names = pa.chunked_array([*held.column("src").chunks, *held.column("dst").chunks], held.schema.field("src").type).combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    place, n, share = names.indices.to_numpy(), len(names.dictionary), held.column("share").to_numpy()
    src, dst = place[: len(share)], place[len(share) :]
    dangling = np.ones(n, bool)
    dangling[src] = False
    score = np.full(n, 1 / max(n, 1))
    for _ in range(rounds if n else 0):
        old = score
        score = (1 - damping) / n + damping * (np.bincount(dst, old[src] * share, n) + old[dangling].sum() / n)
        if tolerance is not None and np.abs(score - old).sum() < tolerance:
            break
    schema = links.select(F.col("src").alias("node"), F.col("share").alias("score")).schema
    return links.sparkSession.createDataFrame(pa.table({"node": names.dictionary, "score": pa.array(score)}), schema)


def centrality(ranks: DataFrame, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Scores scaled to ``[low, high]``; the middle where all are equal."""
    ends = F.broadcast(ranks.agg(F.min("score").alias("a"), F.max("score").alias("b")))  # one row
    scaled = F.when(F.col("a") == F.col("b"), (low + high) / 2).otherwise(low + (F.col("score") - F.col("a")) / (F.col("b") - F.col("a")) * (high - low))
    return ranks.crossJoin(ends).select(F.col("node").alias("filename"), scaled.alias("score"))


def _both_ways(edges: DataFrame, forward: bool, backward: bool, seq: str | None) -> DataFrame:
    order = F.col(seq) if seq else F.lit(0)
    ways = []
    if forward:
        ways.append(edges.select("src", "dst", F.lit(0).alias("way"), order.alias("seq")))
    if backward:
        ways.append(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("way"), order.alias("seq")))
    out = ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1])
    return out.groupBy("src", "dst", "way").agg(F.min("seq").alias("seq"))


def _traverse(edges: DataFrame, starts: DataFrame, hops: int, limit: int | None, forward: bool, backward: bool, seq: str | None) -> DataFrame:
    """Breadth-first discovery order: by the parent's place, then direction,
    then the neighbour (by ``seq`` first, where given)."""
    ways = stored(_both_ways(edges, forward, backward, seq), "ways")
    first = starts.select(F.col("node"), F.col("place").cast("long").alias("place"))
    seen = stored(first.select("node", F.lit(None).cast(dict(first.dtypes)["node"]).alias("parent"), F.lit(None).cast("int").alias("way"), F.lit(0).alias("hop"), "place"), "seen")
    frontier, found, count = seen, [seen], 0
    for hop in range(1, hops + 1):
        steps = ways.join(frontier.select(F.col("node").alias("src"), F.col("place").alias("above")), "src").join(seen.select(F.col("node").alias("dst")), "dst", "left_anti")
        one = steps.groupBy("dst").agg(F.min(F.struct("above", "way", "seq", "src")).alias("by"))
        one = one.select(F.col("dst").alias("node"), F.col("by.src").alias("parent"), F.col("by.way").alias("way"), F.lit(hop).alias("hop"), F.col("by.above").alias("above"), F.col("by.seq").alias("seq"))
        if limit is not None:
            one = one.orderBy("above", "way", "seq", "node").limit(max(limit - count, 0))
        # a place orders the next hop; with a limit the window sees at most that many rows
        place = F.row_number().over(Window.orderBy("above", "way", "seq", "node")) if limit is not None else F.col("above")
        frontier = stored(one.select("node", "parent", "way", "hop", place.cast("long").alias("place")), "frontier")
        n = frontier.count()
        if not n:
            break
        count += n
        found.append(frontier)
        seen = stored(seen.unionByName(frontier), "seen")
        if limit is not None and count >= limit:
            break
    return seen


def bfs_distances(edges: DataFrame, starts: DataFrame, hops: int, limit: int | None = None, forward: bool = True, backward: bool = True) -> DataFrame:
    """``(node, distance)``; starts ``(node, place)`` count toward the limit,
    neighbours keep the order of ``edges.seq`` if there."""
    seq = "seq" if "seq" in edges.columns else None
    left = None if limit is None else max(limit - starts.count(), 0)
    seen = _traverse(edges, starts, hops, left, forward, backward, seq)
    return seen.select("node", F.col("hop").alias("distance"))


def bfs_tree(edges: DataFrame, starts: DataFrame, hops: int = 3, limit: int | None = 30, forward: bool = True, backward: bool = True) -> DataFrame:
    """``(source, target, relation, hop)`` of each node found, starts excluded."""
    seen = _traverse(edges.filter("src <> dst"), starts, hops, limit, forward, backward, None)
    relation = F.when(F.col("way") == 0, "imports").otherwise("imported_by")
    return seen.filter("hop > 0").select(F.col("parent").alias("source"), F.col("node").alias("target"), relation.alias("relation"), "hop")


def reach(edges: DataFrame, value: DataFrame) -> DataFrame:
    """Smallest ``value`` over everything that reaches a node, itself included."""
    state = value
    while True:
        moved = edges.join(state.select(F.col("node").alias("src"), "value"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("value").alias("new"))
        new = stored(state.join(moved, "node", "left").select("node", F.least("value", F.coalesce("new", "value")).alias("value"), (F.col("new") < F.col("value")).alias("changed")), "reach")
        state = new.select("node", "value")
        if not new.filter("changed").limit(1).count():
            return state


def strong_components(edges: DataFrame) -> DataFrame:
    """``(node, component)``: smallest node of each strongly connected
    component, by colouring.  Each round gives every node the smallest node
    that reaches it, settles the nodes that reach that node back, and goes on
    with the rest; each round settles at least the components of all colours."""
    links = stored(edges.filter("src <> dst").select("src", "dst").distinct(), "scc")
    rest, done = stored(_nodes(edges), "scc"), None
    while rest.limit(1).count():
        colour = reach(links, rest.select("node", F.col("node").alias("value")))
        a, b = (colour.select(F.col("node").alias(c), F.col("value").alias(f"c{c}")) for c in ("src", "dst"))
        back = stored(links.join(a, "src").join(b, "dst").filter("csrc = cdst").select("src", "dst"), "scc")
        found = colour.filter("node = value").select("node", "value")
        front = found
        while front.limit(1).count():
            front = back.join(front.select(F.col("node").alias("dst"), "value"), "dst").select(F.col("src").alias("node"), "value").distinct().join(found.select("node"), "node", "left_anti")
            front = stored(front, "scc")
            found = stored(found.unionByName(front), "scc")
        settled = found.select("node", F.col("value").alias("component"))
        done = settled if done is None else stored(done.unionByName(settled), "scc")
        rest = stored(rest.join(settled.select("node"), "node", "left_anti"), "scc")
        links = stored(back.sparkSession.createDataFrame([], links.schema) if not rest.limit(1).count() else links.join(rest.withColumnRenamed("node", "src"), "src", "left_semi").join(rest.withColumnRenamed("node", "dst"), "dst", "left_semi"), "scc")
    return done if done is not None else edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)


def dependencies(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct edges between two files of a set."""
    inside = edges.filter("src <> dst").join(files.select(F.col("filename").alias("src")), "src", "left_semi")
    return inside.join(files.select(F.col("filename").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """``(filename, imports, imported_by)`` as sorted arrays, one row a file."""
    ways = edges.select(F.col("src").alias("filename"), F.col("dst").alias("to"), F.lit(None).cast("string").alias("by")).unionByName(edges.select(F.col("dst").alias("filename"), F.lit(None).cast("string").alias("to"), F.col("src").alias("by")))
    return ways.groupBy("filename").agg(F.array_sort(F.collect_set("to")).alias("imports"), F.array_sort(F.collect_set("by")).alias("imported_by"))


def adjacency_among(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Adjacency within a set of files, one row for each of them."""
    lists = adjacency(dependencies(edges, files))
    none = F.array().cast("array<string>")
    every = files.select("filename").distinct().join(lists, "filename", "left")
    return every.select("filename", F.coalesce("imports", none).alias("imports"), F.coalesce("imported_by", none).alias("imported_by"))


def edges_of(cache: DataFrame) -> DataFrame:
    """The edges ``(src, dst, seq)`` of a stored adjacency table, with each
    neighbour's place in its list."""
    return cache.select(F.col("filename").alias("src"), F.posexplode("imports").alias("seq", "dst")).select("src", "dst", "seq")


def expand(found: DataFrame, tree: DataFrame, most: int = 10) -> DataFrame:
    """Related implementation files that were not found themselves.  The cut
    comes before the category filter."""
    from ..functions.files import category

    fresh = tree.join(found.select(F.col("filename").alias("target")).distinct(), "target", "left_anti")
    cut = fresh.orderBy("hop", "target").limit(most)
    return cut.filter(category(F.col("target")) == "implementation")


def invalidate(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """An adjacency table without the rows of changed files and of the files
    that import one of them."""
    gone = changed.select(F.col("filename").alias("_gone")).distinct()
    users = cache.select("filename", F.explode("imports").alias("_gone")).join(gone, "_gone", "left_semi").select("filename")
    return cache.join(gone, F.col("filename") == F.col("_gone"), "left_anti").join(users.distinct(), "filename", "left_anti")


def cache_stats(cache: DataFrame) -> DataFrame:
    """Files, edges, and files without imports of an adjacency table."""
    edges = F.coalesce(F.sum(F.size("imports")), F.lit(0)).cast("long")
    return cache.agg(F.count("*").alias("files"), edges.alias("edges"), F.count_if(F.size("imports") == 0).alias("leaves"))
