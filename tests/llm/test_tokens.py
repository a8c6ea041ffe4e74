"""Byte-pair encoding, packing and token files, against the public libraries."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute import awkward, awkward_rows, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillgrove.llm import bpe, chunks, packing, queries, token_files

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def oracle():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pairs():
    return bpe.BytePairs.load(RANKS, PATTERN)


def library(name: str) -> Tokenizer:
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


def raw(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


def test_bpe_query_equals_the_library(spark, sf, oracle):
    found = {r["doc_id"]: r for r in queries.op4_byte_bpe(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(found) == len(rows)
    for r in rows:
        text = r["text"] or ""
        ids, got = oracle.encode_ordinary(text), found[r["doc_id"]]
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == hashlib.sha256(raw(ids)).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_on_awkward_rows(spark, oracle):
    found = bpe.decode(bpe.encode(awkward(spark), RANKS, PATTERN), RANKS, PATTERN).collect()
    got = sorted((r["doc_id"] or 0, bytes(r["ids"]), bytes(r["bytes"])) for r in found)
    want = sorted((k or 0, raw(oracle.encode_ordinary(t or "")), (t or "").encode()) for k, t, *_ in awkward_rows() if k != 21)
    assert [x for x in got if x[0] != 21] == want  # one word of 300,000 letters: see below
    assert bpe.encode(empty(spark), RANKS, PATTERN).collect() == []


def test_bpe_of_very_long_pre_tokens(pairs, oracle):
    rng = random.Random(5)
    for word in ("ab" * 3000, "x" * 4001, "".join(rng.choice("etaoin") for _ in range(5000)), "é" * 900):
        want = oracle.encode_ordinary(word)
        assert pairs.encode_words([word.encode()]) == [raw(want)]
        assert pairs.encode_one(word.encode()) == want
    huge = ("".join(rng.choice("abcdefgh") for _ in range(200_000))).encode()
    ids = np.frombuffer(pairs.encode_words([huge])[0], "<u4").tolist()
    assert pairs.decode(ids) == huge


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab cé\n\t 12'.,#sS你🙂  \x00")), max_size=60))
def test_chunked_encoding_equals_whole_texts(text):
    global _PAIRS, _ORACLE
    if "_PAIRS" not in globals():
        _PAIRS = bpe.BytePairs.load(RANKS, PATTERN)
        _ORACLE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=_PAIRS.ranks, special_tokens={})
    encoder = chunks.ChunkEncoder(_PAIRS.encode_chunks)
    assert encoder([text]) == [raw(_ORACLE.encode_ordinary(text))]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB cé\n\t 12'.,#sS你🙂  \x00<|>")), max_size=60))
def test_chunked_library_encoding_equals_whole_texts(text):
    from quillgrove.llm.library_tokens import encoder

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        want = library(name).encode(text, add_special_tokens=False).ids
        assert encoder(public_tokenizers.path(name))([text]) == [raw(want)]


def test_bitmap_finds_the_lowest_rank():
    rng, held, b = random.Random(1), set(), bpe.Bitmap()
    for _ in range(4000):
        i = rng.choice([0, 63, 64, 4095, 4096, 262143, rng.randrange(1 << 18)])
        (b.clear if i in held else b.set)(i)
        held ^= {i}
        assert b.first() == (min(held) if held else -1)


# packing


def check_packing(found, rows, capacity=2048):
    t = library("byte_bpe_50k.json")
    want = Counter()
    for key, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or min(len(ids), capacity)
        starts = [0, *range(first, len(ids), capacity)]
        for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want[key, piece, a, b - a, zlib.crc32(raw(ids[a:b]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    bins: dict[int, list[tuple[int, int]]] = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for inside in bins.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_packing_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = queries.op6_best_fit_packing(spark, sf).collect()
    bins = check_packing(found, rows)
    lengths = sorted((r["length"] for r in found), reverse=True)
    assert len(bins) <= max(best_fit(lengths), -(-sum(lengths) // 2048) + 1)


def best_fit(lengths, capacity=2048):
    gaps: list[int] = []
    for n in lengths:
        at = min((g for g in range(len(gaps)) if gaps[g] >= n), key=lambda g: gaps[g], default=None)
        if at is None:
            gaps.append(capacity - n)
        else:
            gaps[at] -= n
    return len(gaps)


def test_packing_awkward_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = packing.pack(awkward(spark), path).collect()
    check_packing(found, [(r[0], r[1]) for r in awkward_rows()])
    assert packing.pack(empty(spark), path).collect() == []
    with_ids = packing.pack(awkward(spark), path, with_ids=True).collect()
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in with_ids)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 40), max_size=25))
def test_plan_holds_every_item(counts):
    planned = packing.plan(counts, 100)
    held = Counter()
    for contents, times in planned:
        assert sum(k * n for k, n in contents) <= 100 and times > 0
        assert sum(n for k, n in contents if 3 * k > 100) <= 2
        for k, n in contents:
            held[k] += n * times
    assert held == Counter(counts)
    lengths = sorted(Counter(counts).elements(), reverse=True)
    assert sum(t for _, t in planned) <= 1.25 * best_fit(lengths, 100) + 1


# token files


def check_files(found, rows):
    t = library("word_bpe_49k.json")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at, want = 0, []
    for key, text in order:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((key, at, len(ids), zlib.crc32(raw(ids))))
        at += len(ids)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in found), key=lambda r: r[1])
    assert got == want


def test_token_files_query(spark, sf):
    check_files(queries.op10_token_files(spark, sf).collect(), [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_token_files_awkward_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    check_files(token_files.token_files(awkward(spark), path).collect(), [(r[0], r[1]) for r in awkward_rows()])
    assert token_files.token_files(empty(spark), path).collect() == []


def test_keyed_access_to_files(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(k * 7, f"document number {k}") for k in range(300)]
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/f", path, shards=3)
    shards = [token_files.Shard(p.read_bytes()) for p in sorted((tmp_path / "f").glob("part-*"))]
    t = library("word_bpe_49k.json")
    for key, text in rows:
        hits = [x for s in shards for x in s.get(key)]
        assert len(hits) == 1 and hits[0].tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]
    assert not any(s.get(k) for s in shards for k in (1, 2, 3, 5, 2101, -7))


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal(n):
    keys = np.random.default_rng(n).choice(1 << 62, n, replace=False).astype(np.uint64)
    h = token_files.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(n))


def test_width_of_ids_follows_the_vocabulary(tmp_path):
    from tokenizers import models

    Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)}, unk_token="w0")).save(str(tmp_path / "large.json"))
    assert token_files.id_width(str(tmp_path / "large.json")) == 4
    assert token_files.id_width(public_tokenizers.path("word_bpe_49k.json")) == 2
    ids = np.array([1, 69_999], "<u4").tobytes()
    assert token_files.packed(ids, 4) == ids
    with pytest.raises(ValueError):
        token_files.packed(ids, 2)
