"""Quality rules and the quality classifier."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from brute import awkward, awkward_rows, counts, empty

from quillgrove.llm import quality_classifier, quality_rules, queries

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def check(found, rows):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, *(r[c] for c in COUNTS), r["base_failed"]) for r in found)
    want = []
    for key, text in rows:
        c = counts(text)
        want.append((key is None, key or 0, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    assert got == sorted(want)
    assert not any(r["kept"] and r["base_failed"] for r in found)
    assert all(r["kept"] is not None for r in found)


def test_rules_query_equals_plain_counts(spark, sf):
    found = queries.op1_quality_rules(spark, sf).collect()
    check(found, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_rules_on_awkward_rows(spark):
    found = quality_rules.quality_rules(awkward(spark)).collect()
    check(found, [(r[0], r[1]) for r in awkward_rows()])
    twice = [r["kept"] for r in found if r["doc_id"] == 10]
    assert len(twice) == 2 and len(set(twice)) == 1


def test_rules_on_an_empty_table(spark):
    assert quality_rules.quality_rules(empty(spark)).collect() == []


def test_rules_keep_good_and_drop_junk(spark):
    good = "Rain fell on the hills while shepherd number {i} walked home. At dusk {i} lamps shone in the valley below, and the dogs slept near the stove. " "In the morning the market opened early, {i} carts came up the road, and bread was sold by the church until noon bells rang out."
    rows = [(i, good.format(i=i), "en", "s", 1) for i in range(60)] + [(100 + i, "BUY NOW!!! $$$ ### " * (12 + i), "en", "s", 1) for i in range(15)]
    found = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(awkward(spark, rows)).collect()}
    assert all(found[i] for i in range(60)) and not any(found[100 + i] for i in range(15))


def test_em_learns_which_rule_is_noise():
    rng, patterns = np.random.default_rng(0), {}
    for _ in range(20_000):
        good = rng.random() < 0.8
        votes = tuple(int(rng.choice([1, -1] if good != (k == 2 and rng.random() < 0.004) else [-1, 1], p=[0.999, 0.001])) if rng.random() < 0.7 else 0 for k in range(3))
        patterns[votes, good] = patterns.get((votes, good), 0) + 1
    every: dict[tuple, int] = {}
    for (votes, _), n in patterns.items():
        every[votes] = every.get(votes, 0) + n
    posterior, rates, share = quality_rules.fit(sorted(every.items()))
    assert posterior[1, 1, 1] > 0.99 and posterior[-1, -1, -1] < 0.01
    assert 0.7 < share < 0.9 and (rates[1] >= rates[0]).all()
    assert quality_rules.fit([]) [0] == {}


def plain_em(votes, rounds=60):
    """Posteriors of documents by expectation-maximisation, document by
    document and rule by rule."""
    good = [0.1 if -1 in v else 0.9 for v in votes]
    for _ in range(rounds):
        share = (sum(good) + 1) / (len(votes) + 2)
        rates = []
        for k in range(len(votes[0])):
            says = [(v[k], g) for v, g in zip(votes, good, strict=True) if v[k]]
            on_good = (sum(g for x, g in says if x > 0) + 1) / (sum(g for _, g in says) + 1.01)
            on_bad = (sum(1 - g for x, g in says if x > 0) + 1) / (sum(1 - g for _, g in says) + 2)
            on_good = max(on_good, 0.995)
            rates.append((on_good, min(on_bad, on_good)))
        good = []
        for v in votes:
            a, b = np.log(share), np.log(1 - share)
            for x, (on_good, on_bad) in zip(v, rates, strict=True):
                if x:
                    a += np.log(on_good if x > 0 else 1 - on_good)
                    b += np.log(on_bad if x > 0 else 1 - on_bad)
            good.append(1 / (1 + np.exp(np.clip(b - a, -500, 500))))
    return good


def test_verdicts_equal_a_plain_em_and_differ_from_all_must_pass(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counted = quality_rules.features(docs).select("doc_id", *(v.alias(k) for k, v in quality_rules.rules().items())).collect()
    votes = {r["doc_id"]: tuple(r)[1:] for r in counted}
    want = dict(zip(votes, plain_em(list(votes.values())), strict=True))
    found = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert all(abs(found[k]["p_good"] - p) < 1e-6 for k, p in want.items())
    assert all(found[k]["kept"] == (not found[k]["base_failed"] and p >= 0.5) for k, p in want.items())
    against = [k for k, v in votes.items() if -1 in v]
    assert any(found[k]["kept"] for k in against) and any(not found[k]["kept"] for k in against)


def auc(score, label):
    order = np.argsort(np.argsort(score)) + 1
    n = label.sum()
    return (order[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_classifier_on_held_out_documents(spark):
    found = queries.op3_quality_classifier(spark, "/root/testdata/sf0.01").toPandas()
    assert len(found) == 1000 and found["score"].between(0, 1).all()
    assert (found["held_out"] == found["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert (found["predicted"] == (found["score"] >= 0.5)).all()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = found[found["held_out"]].merge(labels[labels["quality"].isin([0, 1])], on="doc_id")
    assert len(both) > 50
    assert auc(both["score"].to_numpy(), both["quality"].to_numpy().astype(int)) > 0.9


def test_classifier_scores_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, "x"), (5, 0, "x"), (9, 1, "x"), (13, 0, "x"), (17, 0, "x"), (99, 1, "x"), (None, 1, "x"), (3, None, "x"), (7, 1, "x"), (7, 0, "x")], "doc_id long, quality int, text string")
    model = quality_classifier.fit(awkward(spark), labels)
    found = quality_classifier.quality_classifier(awkward(spark), model).collect()
    assert len(found) == len(awkward_rows()) and all(0 <= r["score"] <= 1 for r in found)
    bare = {round(r["score"], 12) for r in found if r["doc_id"] in (2, 3)}
    assert len(bare) == 1  # no text: the bias alone
    assert quality_classifier.quality_classifier(empty(spark), model).collect() == []


@pytest.mark.parametrize(("labels", "share"), [([], 0.5), ([(1, 1)], 1.0), ([(5, 0)], 0.0)])
def test_classifier_without_two_classes(spark, labels, share):
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality_classifier.fit(awkward(spark), known)
    kept = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 3 != 1]
    want = share if kept else 0.5
    for r in quality_classifier.quality_classifier(awkward(spark), model).collect():
        assert abs(r["score"] - want) < 1e-3


def test_classifier_never_reads_held_out_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1 then 1 - quality else quality end as quality")
    a, b = quality_classifier.fit(docs, labels), quality_classifier.fit(docs, flipped)
    assert (a.scores == b.scores).all() and a.bias == b.bias
