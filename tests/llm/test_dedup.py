"""Near-duplicates, shared passages, near vectors."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import awkward, awkward_rows, close, empty, near, removed, shingles

from quillgrove.llm import near_dedup, queries, substrings, vectors
from quillgrove.llm.components import components
from quillgrove.llm.common import Scratch


def texts_of(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def collected(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


def test_near_query_equals_all_pairs(spark, sf):
    assert collected(queries.op2_near_dedup(spark, sf)) == near(texts_of(spark, sf))


def family(seed: int, n: int) -> list[tuple[int, str]]:
    """Chains and stars of texts around the threshold, and exact copies."""
    rng, rows = random.Random(seed), []
    for base in range(6):
        words = [f"v{rng.randrange(5000)}" for _ in range(rng.choice([30, 60, 200]))]
        for _ in range(n):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                words = own  # drift
            rows.append((len(rows) + 1, " ".join(own)))
        rows.append((len(rows) + 1, f"filler {base} " + " ".join(f"z{rng.randrange(10**6)}" for _ in range(40))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_on_families_around_the_threshold(spark, seed):
    rows = family(seed, 40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(near_dedup.near_dedup(df)) == near(rows)


def test_near_settles_a_bucket_of_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rows = family(3, 40)
    assert collected(near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == near(rows)


def test_near_on_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in awkward_rows() if r[0] is not None]
    found = near_dedup.near_dedup(awkward(spark).filter("doc_id is not null"))
    assert collected(found) == near(rows)
    assert near_dedup.near_dedup(empty(spark)).collect() == []
    nulls = near_dedup.near_dedup(awkward(spark)).filter("doc_id is null").collect()
    assert len(nulls) == 2


def test_min_max_signature_estimates_similarity():
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(60):
        a, b, both = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (60, 60, 480))
        x, y = np.sort(np.concatenate([a, both])), np.sort(np.concatenate([b, both]))
        sig = near_dedup.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
        errors.append((sig[0] == sig[1]).mean() - 480 / 600)
    assert abs(np.mean(errors)) < 0.02  # without bias
    assert np.std(errors) < 1.2 * np.sqrt(0.8 * 0.2 / (2 * near_dedup.PERMS))


def test_linked_at_the_exact_threshold():
    x = np.arange(100, dtype=np.uint64)
    assert near_dedup.linked(x[:85], x, 85) and not near_dedup.linked(x[:84], x, 85)
    assert close(frozenset(range(85)), frozenset(range(100))) and not close(shingles(""), shingles(""))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (5, None)]
    random.Random(2).shuffle(edges)
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    got = {r["node"]: r["component"] for r in found}
    assert len(found) == len(got) == 500
    assert all(got[i] == 1 for i in range(1, 301)) and all(got[1000 + i] == 1000 for i in range(200))
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).collect() == []


def check_removed(found, rows, digest=False):
    last = (lambda t: hashlib.sha256(t.encode()).hexdigest()) if digest else (lambda t: t)
    order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256" if digest else "kept_text"]) for r in found), key=order)
    assert got == sorted(((a, b, c, last(d)) for a, b, c, d in removed(rows)), key=order)


def test_substring_query_equals_all_windows(spark, sf):
    check_removed(queries.op7_substring_dedup(spark, sf).collect(), texts_of(spark, sf), digest=True)


def test_substrings_on_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    check_removed(substrings.substring_dedup(awkward(spark)).collect(), rows)
    assert substrings.substring_dedup(empty(spark)).collect() == []


def test_substrings_of_every_alignment(spark):
    """A passage of exactly 50 words at every offset, 49 words nowhere."""
    exact, short = [f"p{i}" for i in range(50)], [f"s{i}" for i in range(49)]
    rows = [(0, " ".join(exact)), (1, " ".join(short))]
    for k in range(40):
        rows.append((2 + k, " ".join([f"a{k}_{i}" for i in range(k)] + exact + [f"b{k}"] + short)))
    check_removed(substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_copies_with_edits_settle_by_segments(spark):
    """Long copies in chains and stars, edited, cut, joined and repeated."""
    rng, rows = random.Random(8), []
    bases = [[f"w{b}_{rng.randrange(400)}" for _ in range(900)] for b in range(3)]
    for k in rng.sample(range(60), 60):
        own = list(bases[k % 3])
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(own))
            own[at : at + rng.randrange(3)] = [f"e{rng.randrange(9)}"] * rng.randrange(3)
        own = own[rng.randrange(300) : len(own) - rng.randrange(300)]
        rows.append((k, " ".join(own + (own[:200] if k % 7 == 0 else []))))
    rows += [(70, "same " * 400), (71, "same " * 300), (71, "same " * 500)]
    check_removed(substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_segments_have_the_hash_of_their_words():
    text = pa.array([" ".join(f"x{i * i % 97}" for i in range(600)).encode()], pa.binary())
    words = substrings.Words(*substrings.raw(text))
    hashes = words.hashes()
    moved = np.concatenate([hashes[:7], hashes])
    at = substrings._segments(hashes, words.whole(50))
    then = substrings._segments(moved, np.arange(7, len(moved) - 49))
    assert len(at[0]) > 20 and all((a == b).all() for a, b in zip(at[1:], then[1:], strict=True)) and (at[0] + 7 == then[0]).all()
    assert len(np.unique(at[2])) == len({tuple(hashes[a : a + n + 49].tolist()) for a, n in zip(at[0], at[1], strict=True)})


def test_texts_of_one_key_are_cut_by_their_own_windows(spark):
    passage = " ".join(f"q{i}" for i in range(60))
    rows = [(1, passage), (5, passage + " tail"), (5, "some other text " * 30 + passage), (5, " ".join(f"own{i}" for i in range(90))), (6, passage)]
    found = substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    check_removed(found.collect(), rows)


def test_difference_cover_has_every_shift():
    cover = set(substrings.COVER)
    assert {(a - b) % substrings.PERIOD for a in cover for b in cover} == set(range(substrings.PERIOD))


def plain_vectors(rows, cosine=0.9):
    ok = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in ok}
    return {(i, j) for i in ok for j in ok if j < i and len(rows[i][1]) == len(rows[j][1]) and unit[i] @ unit[j] >= cosine}


def test_vector_query_against_all_pairs(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    links = plain_vectors(rows)
    degree: dict[int, int] = {}
    for i, j in links:
        for k in (i, j):
            degree[rows[k][0]] = degree.get(rows[k][0], 0) + 1
    found = queries.op8_embedding_dedup(spark, sf).collect()
    assert len(found) == len(rows)
    got = {r["vec_id"]: r["n_links"] for r in found}
    assert all(got[k] <= degree.get(k, 0) for k in got)
    assert sum(got.values()) >= 0.9 * 2 * len(links)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


def test_vectors_recall_around_the_threshold(spark):
    rng = np.random.default_rng(8)
    rows, dim = [], 64
    for _ in range(120):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        for _ in range(rng.integers(1, 9)):
            v = centre + rng.normal(size=dim) * rng.uniform(0.01, 0.06)
            rows.append((len(rows), (v * rng.uniform(0.1, 9)).tolist()))
    links = plain_vectors(rows)
    found = vectors.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(links) > 300
    assert sum(r["n_links"] for r in found) / 2 >= 0.9 * len(links)


def test_awkward_vectors(spark):
    nan, inf, one = float("nan"), float("inf"), [1.0, 2.0, 3.0]
    rows = [(1, one), (2, one), (2, one), (3, [2.0, 4.0, 6.0]), (4, [-1.0, -2.0, -3.0]), (5, None), (6, []), (7, [0.0, 0.0, 0.0]), (8, [nan, 1.0, 1.0]), (9, [inf, 1.0, 1.0]), (10, [None, 1.0, 1.0]), (11, [1.0, 2.0]), (12, [1.0, 2.0]), (13, [1e300, 2e300, 3e300]), (None, one)]
    df = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], "vec_id long, embedding array<double>, key string, n string, keys string")
    found = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in vectors.embedding_dedup(df).collect()))
    got = {k: (n, c) for k, n, c in found if k}
    assert len(found) == len(rows)
    for k in (5, 6, 7, 8, 9, 10, 4):
        assert got[k] == (0, k)
    assert got[11] == (1, 11) and got[12] == (1, 11)
    for k in (1, 2, 3, 13):
        assert got[k][1] == 1 and got[k][0] == 5
    assert vectors.embedding_dedup(df.limit(0)).collect() == []


def test_vectors_in_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 4)
    rng = np.random.default_rng(1)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.01).tolist()) for i in range(50)]
    found = vectors.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r["n_links"] == 49 and r["component_id"] == 0 for r in found)


def turned(rng, x, cosine):
    """Copies of vectors ``x`` at a cosine, in random directions."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    v = rng.normal(size=x.shape)
    v -= (v * x).sum(1, keepdims=True) * x
    return cosine * x + np.sqrt(1 - cosine * cosine) * v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("bits", [14, 17, 21])
def test_vector_tables_find_links_that_the_sample_does_not_hold(bits):
    rng = np.random.default_rng(bits)
    sample, apart, fresh = (rng.normal(size=(n, 64)) for n in (4096, 4096, 3000))  # no two are alike
    model = vectors.Quantiser(sample, bits)
    model.calibrate(apart, 0.9)
    for cosine in (0.9, 0.92, 0.95):
        assert (model.keys(fresh) == model.keys(turned(rng, fresh, cosine))).any(1).mean() > 0.98


def test_vector_tables_are_held_against_links_of_all_vectors(spark):
    rng = np.random.default_rng(2)
    asked = rng.normal(size=(50, 16))
    near = np.concatenate([turned(rng, asked[:20], 0.91), turned(rng, asked[:20], 0.99)])
    rows = [(bytearray(v.tobytes()), 16) for v in np.concatenate([asked, near, rng.normal(size=(300, 16))])]
    a, b = vectors._sampled_links(spark.createDataFrame(rows, "vec binary, width int"), asked, 0.9)
    cosines = (a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)
    assert len(a) >= 40 and (cosines >= 0.9).all()
    assert {0, vectors.BANDS - 1} <= set(vectors.bands(cosines, 0.9).tolist())


def test_vector_tables_beyond_the_sample(spark):
    rng = np.random.default_rng(3)
    first = rng.normal(size=(700, 32))
    every = np.concatenate([first, turned(rng, first, 0.905)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r for r in vectors.embedding_dedup(df, sample=128).collect()}
    assert np.mean([found[i]["component_id"] == found[i + 700]["component_id"] for i in range(700)]) > 0.98


def test_recall_of_queries_by_id_against_all_vectors(spark):
    """Ids divisible by 20 against all rows, in blocks: the planted links lie
    from the threshold up, in groups of two, and far from each other."""
    rng = np.random.default_rng(5)
    first = rng.normal(size=(3000, 48))
    every = np.concatenate([first, turned(rng, first[:1500], 0.902), turned(rng, first[1500:2400], 0.93), turned(rng, first[2400:], 0.97)])
    order = rng.permutation(len(every))
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(order, every, strict=True)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["n_links"] for r in vectors.embedding_dedup(df, sample=1024).collect()}
    asked = np.flatnonzero(order % 20 == 0)
    true = (unit[asked] @ unit.T >= 0.9).sum(1) - 1
    got = np.array([found[int(order[i])] for i in asked])
    assert true.sum() > 200 and (got <= true).all()
    assert got.sum() >= 0.95 * true.sum()


def test_one_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [5.0, 0.1]), (4, [3.0, 0.0])]
    found = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert found == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1)]
