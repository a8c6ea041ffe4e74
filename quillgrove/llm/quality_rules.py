"""Quality rules: weak supervision in place of an all-must-pass filter.

Rules look at per-document counts and vote good (1), bad (-1) or abstain (0).
Expectation-maximisation (Dawid and Skene, 1979) over the vote patterns of the
whole corpus estimates how each rule votes on good and on bad documents; a
document is kept if its posterior probability of being good reaches one half.

Scale: one Python pass computes the counts, which are stored (six numbers a
document).  EM needs only the histogram of vote patterns, at most
``3 ** len(rules())`` rows whatever the corpus size, so it runs on the driver and
its posteriors go back by a broadcast of that bounded table.

Edge cases: a null or empty text has no words, zero counts, fails the base
rule and is not kept.  Very long texts are counted whole.  A posterior of
exactly one half is kept.  Repeated rows are judged separately and alike.  An
empty table gives an empty result.  Other columns are not read; a carried
column with the name of a result gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, beside, extended, ship
from .hashing import Words, column, mix, raw, slices, windows

SYMBOLS = b"#*$%&|<>"
REPEAT = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_letters", "n_shouts"]
JUDGED = ["votes", "p_good", "base_failed", "kept"]


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


_IS_SYMBOL, _IS_SHOUT = _lut(SYMBOLS), _lut(b"!")
_IS_UPPER = _lut(bytes(range(65, 91)))
_IS_LETTER = _lut(bytes(range(65, 91)) + bytes(range(97, 123)))
_STARTS_POINT = np.ones(256, np.uint8)
_STARTS_POINT[0x80:0xC0] = 0


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def repeated_words(words: Words) -> np.ndarray:
    """Of each text: words inside an 8-word window that the text has twice."""
    n_texts = len(words.count)
    at = words.whole(REPEAT)
    if not len(at):
        return np.zeros(n_texts, np.int64)
    text, _ = words.places()
    salt = mix(np.arange(1, n_texts + 1, dtype=np.uint64))
    key = mix(windows(words.hashes(), REPEAT)[at]) ^ salt[text[at]]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return np.zeros(n_texts, np.int64)
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(words) + REPEAT + 1, np.int32)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + REPEAT, -1)
    covered = np.cumsum(change)[: len(words)] > 0
    return np.bincount(text[covered], minlength=n_texts)


def _counts(part: pa.Array) -> list[np.ndarray]:
    data, offsets = raw(part)
    words = Words(data, offsets)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in part.to_pylist()]
    return [
        words.count, _sums(words.inside & _STARTS_POINT[data].astype(bool), offsets), _sums(_IS_SYMBOL[data], offsets),
        np.array([len(x) - len(set(x)) for x in lines], np.int64), repeated_words(words),
        np.array([len(x) for x in lines], np.int64), _sums(_IS_UPPER[data], offsets), _sums(_IS_LETTER[data], offsets), _sums(_IS_SHOUT[data], offsets),
    ]


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] | None = None) -> DataFrame:
    """The counts that the rules look at, of whole texts.  With ``carry``, the
    text and those columns come along, so that a filter needs no join."""
    ship(docs.sparkSession)
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *beside(carry or (), "doc_id", "text", *COUNTS, *MORE, *JUDGED))
    along = ["doc_id"] if carry is None else source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text")
            for i, j in slices(texts):
                found = [pa.array(x.astype(np.int64)) for x in _counts(texts.slice(i, j - i))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(len(along))), *found], names=[*along, *COUNTS, *MORE])

    return source.mapInArrow(run, extended(source.select(*along).schema, **dict.fromkeys(COUNTS + MORE, "long")))


def _share(top: str, bottom: str) -> Column:
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Every rule votes 1 (good), -1 (bad) or 0 (abstains)."""
    length = _share("word_chars", "n_words")
    return {
        "length": _vote(F.col("n_words") < 20, F.col("n_words") >= 60),
        "symbols": _vote(_share("n_symbols", "n_words") > 0.1, _share("n_symbols", "n_words") < 0.02),
        "repeats": _vote(_share("n_repeat_words", "n_words") > 0.3, _share("n_repeat_words", "n_words") < 0.05),
        "lines": _vote(_share("n_dup_lines", "n_lines") > 0.3, (F.col("n_dup_lines") == 0) & (F.col("n_lines") > 1)),
        "capitals": _vote(_share("n_upper", "n_letters") > 0.5, _share("n_upper", "n_letters") < 0.15),
        "shouts": _vote(_share("n_shouts", "n_words") > 0.3, _share("n_shouts", "n_words") < 0.03),
        "word_length": _vote((length < 2) | (length > 15), (length >= 3) & (length <= 11)),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60, false_alarms: float = 0.005) -> tuple[dict[tuple[int, ...], float], np.ndarray, float]:
    """EM over ``(votes, count)``.  Returns the posterior of good by pattern,
    ``P(good vote | class, a vote)`` as ``[class, rule]`` and the share of good.

    An abstention says nothing of the class.  EM starts from the belief that
    any bad vote makes a document bad, as each rule finds one kind of fault.
    What is known of rules bounds the estimates: a rule is wrong on at most
    ``false_alarms`` of the good documents, and votes good no more often on bad
    documents than on good ones.  Without that bound, a fault that only one
    rule sees counts as a habit of good documents."""
    if not patterns:
        return {}, np.empty((2, 0)), 0.5
    votes = np.array([p for p, _ in patterns], int)
    weight = np.array([n for _, n in patterns], float)
    up, down = (votes == 1).astype(float), (votes == -1).astype(float)
    good = np.where(down.any(1), 0.1, 0.9)
    for _ in range(rounds):
        share = (weight @ good + 1) / (weight.sum() + 2)
        of_bad = ((weight * (1 - good)) @ up + 1) / ((weight * (1 - good)) @ (up + down) + 2)
        of_good = ((weight * good) @ up + 1) / ((weight * good) @ (up + down) + 1.01)
        of_good = np.maximum(of_good, 1 - false_alarms)
        of_bad = np.minimum(of_bad, of_good)
        odds = np.log(share / (1 - share)) + up @ np.log(of_good / of_bad) + down @ np.log((1 - of_good) / (1 - of_bad))
        good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    return dict(zip([p for p, _ in patterns], good.tolist(), strict=True)), np.stack([of_bad, of_good]), float(share)


def judged(found: DataFrame) -> DataFrame:
    """Adds ``base_failed``, ``p_good`` and ``kept`` to stored ``features``."""
    votes = rules()
    code = sum((v + 1) * 3**i for i, v in enumerate(votes.values()))
    coded = found.withColumn("votes", code.cast("int"))
    seen = coded.groupBy("votes").count().collect()  # at most 3 ** rules rows
    digits = lambda n: tuple(n // 3**i % 3 - 1 for i in range(len(votes)))
    posterior, _, _ = fit([(digits(r["votes"]), r["count"]) for r in sorted(seen)])
    rows = [(sum((v + 1) * 3**i for i, v in enumerate(p)), g) for p, g in posterior.items()]
    table = found.sparkSession.createDataFrame(rows, "votes int, p_good double")
    words = F.col("n_words")
    failed = (words < 20) | (100 * F.col("n_repeat_words") > 30 * words)
    return coded.join(F.broadcast(table), "votes", "left").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, ``base_failed``, the posterior ``p_good`` and ``kept`` of every document."""
    counts = Scratch(docs.sparkSession, "quality").store(features(docs, key, text), "counts")
    return judged(counts).select("doc_id", *COUNTS, "base_failed", "kept", "p_good")


def filtered(docs: DataFrame, carry: tuple[str, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are kept: ``doc_id``, ``text`` and ``carry``.  Texts
    are written once beside their counts; nothing is shuffled."""
    counts = Scratch(docs.sparkSession, "quality").store(features(docs, key, text, carry), "counts")
    return judged(counts).filter("kept").select([c for c in counts.columns if c not in COUNTS + MORE])
