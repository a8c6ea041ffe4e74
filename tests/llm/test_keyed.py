"""Keyed access to token files: offsets, many shards, repeated and hot keys."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillgrove.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text: str) -> list[int]:
    return [*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 2]


def test_keys_are_found_through_many_shards_by_range(spark, tmp_path):
    rows = [(k * 3, f"text {k} of several") for k in range(400)] + [(30, "again"), (30, "and again"), (None, "no key")]
    folder = f"file://{tmp_path}/files"
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), folder, PATH, shards=5)
    files = token_files.TokenFiles(spark, folder)
    assert len(files.shards) > 1
    for key, text in [rows[0], rows[7], rows[399]]:
        assert [x.tolist() for x in files.get(key)] == [ids_of(text)]
    assert [x.tolist() for x in files.get(30)] == [ids_of(t) for t in ("again", "and again", "text 10 of several")]
    assert not any(files.get(k) for k in (-1, 1, 1198, 5000))


def test_a_hot_key_is_dealt_to_several_shards(spark, tmp_path):
    rows = [(7, f"{k:03d} is one of many texts") for k in range(300)] + [(None, f"{k:03d} has no key") for k in range(300)] + [(9, "last")]
    folder = f"file://{tmp_path}/files"
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), folder, PATH, shards=6)
    held = [token_files.Shard(p.read_bytes()) for p in sorted((tmp_path / "files").glob("part-*"))]
    assert sum(7 in (s.least, s.greatest) and s.least <= s.greatest for s in held) > 1
    assert max(s.n_null for s in held) < 300
    found = token_files.TokenFiles(spark, folder).get(7)
    assert [x.tolist() for x in found] == [ids_of(t) for k, t in rows[:300]]
    back = token_files.read(spark, folder).collect()
    assert len(back) == len(rows)


def test_shards_follow_the_bytes_of_text(spark, tmp_path):
    rows = [(k, "some words of a text " * 20) for k in range(200)]
    folder = f"file://{tmp_path}/files"
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), folder, PATH, shard_bytes=10_000)
    assert len(list((tmp_path / "files").glob("part-*"))) > 4


def test_a_large_shard_is_cut_into_files_of_bounded_size(spark, tmp_path):
    """A reader holds whole files, so their size is bounded even if all rows are in one range of keys."""
    body, end = "some words " * 60_000, [2]
    inside = ids_of(body)[:-1]  # no id crosses white space
    rows = [(None, "no key"), *((7, f"{k:03d} {body}") for k in range(100, 150)), (8, ""), (8, "after them"), (9, None)]
    want = [np.array(ids_of(t[:4])[:-1] + inside + end if t and len(t) > 99 else ids_of(t or ""), "<u4") for _, t in rows]
    folder = f"file://{tmp_path}/files"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    token_files.write(docs, folder, PATH, shards=1)
    sizes = [p.stat().st_size for p in (tmp_path / "files").glob("part-*")]
    assert sum(sizes) > 10_000_000 and max(sizes) < 9 << 20
    files = token_files.TokenFiles(spark, folder)
    for key, hits in ((7, want[1:51]), (8, want[51:53]), (9, want[53:]), (10, [])):
        assert [x.astype("<u4").tobytes() for x in files.get(key)] == [x.tobytes() for x in hits]
    back = token_files.read(spark, folder).orderBy("file", "start").collect()
    assert [(r["doc_id"], bytes(r["ids"])) for r in back] == [(k, x.tobytes()) for (k, _), x in zip(rows, want, strict=True)]
    found, at = token_files.token_files(docs, PATH).orderBy("start").collect(), 0
    for (key, _), x, r in zip(rows, want, found, strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (key, at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
