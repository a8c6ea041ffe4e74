"""The corpus pipeline, stage by stage against plain versions."""

from __future__ import annotations

import pytest
from brute import PROSE, awkward, awkward_rows, counts, empty, near, removed
from test_tokens import check_packing

import corpus_pipeline
from quillgrove.llm import quality_classifier

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect()), key=str)


def test_stages_follow_the_plan():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "near-duplicates", "shared passages", "packing"]


def test_each_stage_against_a_plain_version(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = rows_of(docs)

    kept = corpus_pipeline.rules_stage(spark, docs, sf)
    assert kept.columns == COLUMNS
    after = rows_of(kept)
    assert set(after) < set(rows)
    failed = {r[0] for r in rows if (c := counts(r[1]))[0] < 20 or 100 * c[4] > 30 * c[0]}
    assert not failed & {r[0] for r in after}
    assert len(after) > 0.5 * len(rows)

    docs = spark.createDataFrame(after, docs.schema)
    kept = corpus_pipeline.classifier_stage(spark, docs, sf)
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r["doc_id"] for r in quality_classifier.quality_classifier(docs, model).collect() if r["predicted"] == 1}
    before, after = after, rows_of(kept)
    assert kept.columns == COLUMNS and after == sorted((r for r in before if r[0] in good), key=str)

    docs = spark.createDataFrame(after, docs.schema)
    kept = corpus_pipeline.near_stage(spark, docs, sf)
    stay = {r[0] for r in near([(r[0], r[1]) for r in after], 80) if r[3]}  # five words, 0.8 or more
    before, after = after, rows_of(kept)
    assert kept.columns == COLUMNS and after == sorted((r for r in before if r[0] in stay), key=str)

    docs = spark.createDataFrame(after, docs.schema)
    kept = corpus_pipeline.substring_stage(spark, docs, sf)
    gone = {k: (n, t) for k, _, n, t in removed([(r[0], r[1]) for r in after])}
    want = [(k, gone[k][1], lang, src, len(gone[k][1])) if gone[k][0] else (k, t, lang, src, n) for k, t, lang, src, n in after]
    after = rows_of(kept)
    assert kept.columns == COLUMNS and after == sorted(want, key=str)

    docs = spark.createDataFrame(after, docs.schema)
    check_packing(corpus_pipeline.packing_stage(spark, docs, sf).collect(), [(r[0], r[1]) for r in after])


def test_run_chains_the_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns[:2] == ["doc_id", "piece"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
    want = corpus_pipeline.packing_stage(spark, docs, sf)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, out.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_and_empty_tables(spark, sf, name):
    for docs in (awkward(spark), empty(spark)):
        out = STAGES[name](spark, docs, sf)
        if name != "packing":
            assert out.columns == COLUMNS
        n = out.count()
        assert n <= len(awkward_rows()) or name == "packing"


def test_documents_without_an_id_are_judged_like_others(spark, sf):
    rows = [(None, PROSE), (None, None), (1, PROSE), (2, PROSE)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r["doc_id"] for r in STAGES["quality rules"](spark, docs, sf).collect()]
    assert sorted(kept, key=str) == [1, 2, None]
    assert sorted((r["doc_id"] for r in STAGES["near-duplicates"](spark, docs.filter("text is not null"), sf).collect()), key=str) == [1, None]
