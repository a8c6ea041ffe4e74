"""A corpus pipeline: five stages over ``documents``, each a written table.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its
predecessor kept; all but the last return the columns of ``documents``.  Rules
and classifier judge a row by itself and filter it on the spot, so only the
dedup stages shuffle.

Near-duplicates share at least 0.8 of their five-word shingles.

Edge cases: null, empty and too short texts are rejected by the rules.  A
document without a doc_id is judged like any other, but as dedup names
documents by their ids, both dedup stages leave it as it is.  Rows that repeat
a doc_id are one document's: they stay or go together in the near-duplicate
stage.  Null ``lang``, ``source`` and ``n_chars`` stay
null, and columns beyond those of ``documents`` are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.llm import near_dedup, packing, quality_classifier, quality_rules, substrings
from quillgrove.llm.common import Scratch, table

REST = ("lang", "source", "n_chars")
NEAR_PERCENT = 80
COLUMNS = ["doc_id", "text", *REST]


def _kept(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The documents of a decision table ``(doc_id, keep)``."""
    keep = decided.filter("keep and doc_id is not null").select("doc_id").distinct()
    named = docs.filter("doc_id is not null").join(keep, "doc_id", "left_semi").select(COLUMNS)
    return named.unionByName(docs.filter("doc_id is null").select(COLUMNS))


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filtered(docs, REST)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.quality_classifier(docs, model, carry=REST).filter("predicted = 1").select(COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, near_dedup.near_dedup(docs.filter("doc_id is not null"), percent=NEAR_PERCENT).withColumnRenamed("kept", "keep"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that lose words go on with the kept ones, joined by a space;
    the others keep their text as it is."""
    found = substrings.substring_dedup(docs, carry=REST)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", rules_stage),
    ("quality classifier", classifier_stage),
    ("near-duplicates", near_stage),
    ("shared passages", substring_stage),
    ("packing", packing_stage),
]

#: Training a classifier and library tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.store(stage(spark, docs, sf_dir), f"stage{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
