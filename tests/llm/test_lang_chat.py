"""Language identification and chat formatting."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
from brute import awkward, awkward_rows, empty

from quillgrove.llm import chat, langid, queries


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op5_language_id(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").toPandas()
    assert len(found) == len(docs) and found["score"].between(0, 1).all()
    assert (found["held_out"] == found["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    both = found[found["held_out"]].merge(docs[docs["lang"].notna() & docs["text"].fillna("").str.contains("[A-Za-z]")], on="doc_id")
    assert len(both) > 100
    assert (both["lang_pred"] == both["lang"]).mean() > 0.95


def test_language_of_awkward_rows(spark):
    net = langid.train([b"the house and the garden of the king " * 9, "das haus und der garten des königs über ".encode() * 9], ["en", "de"], steps=60)
    found = langid.language_id(awkward(spark), net).collect()
    assert len(found) == len(awkward_rows())
    got = {r["doc_id"]: r for r in found}
    for k in (2, 3, 4, 13):
        assert got[k]["lang_pred"] == "und" and got[k]["score"] == 0
    assert got[1]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in found)
    assert langid.language_id(empty(spark), net).collect() == []


def test_language_without_anything_to_learn(spark):
    net = langid.fit(empty(spark))
    assert {r["lang_pred"] for r in langid.language_id(awkward(spark), net).collect()} == {"und"}
    one = langid.train([b"only one language here"], ["xx"])
    assert {r["lang_pred"] for r in langid.language_id(awkward(spark), one).collect()} == {"xx", "und"}


def test_a_language_of_short_or_empty_texts_spoils_no_other(spark):
    en, de = b"the house and the garden of the king ", "das haus und der garten des königs über ".encode()
    net = langid.train([en * 9, de * 9, b"hi", b""], ["en", "de", "xx", "yy"], steps=150)
    assert net.langs == ["de", "en", "xx"]
    df = spark.createDataFrame([(1, en.decode() * 3), (2, de.decode() * 3)], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.language_id(df, net).orderBy("doc_id").collect()] == ["en", "de"]
    rows = [(i, (en if i % 2 else de).decode() * 4, "en" if i % 2 else "de") for i in range(40)] + [(i, "", "yy") for i in range(40, 60)]
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs == ["de", "en"]


def test_gradients_of_the_recurrent_network(monkeypatch):
    net = langid.Net(["a", "b", "c"], hidden=4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    data, labels = rng.integers(0, 256, (9, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grad = net.step(data, labels)
    for name, g in grad.items():
        flat = net.w[name].reshape(-1)
        used = np.argsort(-np.abs(g.reshape(-1)))[:4]
        for i in used:
            keep, eps = flat[i], 1e-3
            flat[i] = keep + eps
            up, _ = net.step(data, labels)
            flat[i] = keep - eps
            down, _ = net.step(data, labels)
            flat[i] = keep
            assert abs((up - down) / (2 * eps) - g.reshape(-1)[i]) < 2e-3


def test_long_texts_are_pooled_over_all_segments(spark):
    net = langid.train([b"the house and the garden of the king " * 9, b"aqui vive una familia que canta cada dia " * 9], ["en", "es"], steps=80)
    text = ("the house and the garden of the king " * 30) + ("aqui vive una familia que canta cada dia " * 300)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert langid.language_id(df, net).first()["lang_pred"] == "es"  # a prefix would say en


def by_sql(rows):
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    if rows:
        con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    return sorted(con.execute(f"select conv_id, n_turns, text from ({chat.ORACLE})").fetchall())


def check_chats(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "conv_id long, turn long, role string, text string, digest string, pos string, h1 string")
    assert sorted(map(tuple, chat.format_chats(df).collect())) == by_sql(rows)


def test_chats_query_equals_sql(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op9_chat_format(spark, sf).collect())) == by_sql(rows)


def test_chat_snapshots_collapse(spark):
    turns = [("user", "hi"), ("assistant", "hello"), ("user", "bye"), ("assistant", "goodbye")]
    rows = [(c, t, *turns[t]) for c, n in ((1, 1), (2, 2), (3, 4), (4, 4), (5, 3)) for t in range(n)]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "other")]
    check_chats(spark, rows)
    kept = {r[0] for r in by_sql(rows)}
    assert kept == {3, 6}


def test_awkward_chats(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (2, 0, "user", "a"), (2, 0, "user", "a"), (3, 0, "user", "a"), (None, 0, "user", "lost"), (4, 5, "user", "late"), (4, 1, "user", "early"), (5, 0, "b", "tie"), (5, 0, "a", "tie"), (6, 0, None, "x" * 100_000)]
    check_chats(spark, rows)
    check_chats(spark, [])
