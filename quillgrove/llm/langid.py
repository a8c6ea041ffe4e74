"""Language identification: a bidirectional gated recurrent network over bytes
(Cho et al., 2014; Schuster and Paliwal, 1997), written and trained in numpy.

Each text is cut into segments of ``SEGMENT`` bytes, all of which are read
both ways; the network labels every position, and a document's probabilities
are the mean over its positions that hold letters.  Training is truncated
backpropagation through time with Adam on a bounded sample (``per_lang``
documents of each language, drawn by hash).

Edge cases: null texts and texts without a letter give ``und`` with score 0.
A null lang is never learned from, nor is an empty text; a language that has
only such texts is not learned, and any other is, however short its texts.
With no language to learn every text is ``und``; with one, that one wins.  Of
languages that tie the first by name wins.  Very long texts are read whole, in
bounded batches of segments.  Repeated rows are labelled alike; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, ship
from .hashing import column, raw, slices

HIDDEN = 8
SEGMENT = 64
UNKNOWN = "und"
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_ASCII_LETTER[0xC3:] = True  # lead bytes of the scripts' letters: they decide the pooling weights only


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    np.multiply(x, 0.5, out=x)
    x += 0.5
    return x


class Net:
    """Weights by name; for each direction ``d``: ``x{d}`` (256, 3H) input by
    byte, ``u{d}`` (2H, H) for the gates and ``c{d}`` (H, H) for the candidate."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 3):
        rng, self.langs, self.h = np.random.default_rng(seed), langs, hidden
        draw = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        self.w = {f"{k}{d}": draw(*s) for d in "fb" for k, s in (("x", (256, 3 * hidden)), ("u", (2 * hidden, hidden)), ("c", (hidden, hidden)))}
        self.w |= {"o": draw(len(langs), 2 * hidden), "ob": np.zeros(len(langs), np.float32)}

    def _run(self, d: str, data: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states ``(steps, H, batch)`` of bytes ``(steps, batch)``."""
        steps, batch = data.shape
        h, n = np.zeros((self.h, batch), np.float32), self.h
        x, u, c = self.w["x" + d].T.copy(), self.w["u" + d], self.w["c" + d]
        out, tape = np.empty((steps, n, batch), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            given = x.take(data[t], axis=1)
            gates = u @ h
            gates += given[: 2 * n]
            _sigmoid(gates)
            z, r = gates[:n], gates[n:]
            rh = r * h
            new = c @ rh
            new += given[2 * n :]
            np.tanh(new, out=new)
            if keep:
                tape.append((t, h, z, r, rh, new))
            h = h + z * (new - h)
            out[t] = h
        return out, tape

    def logits(self, data: np.ndarray) -> np.ndarray:
        """``(steps, langs, batch)``."""
        n = self.h
        out = np.matmul(self.w["o"][:, :n], self._run("f", data, False)[0])
        out += np.matmul(self.w["o"][:, n:], self._run("b", data, False)[0])
        out += self.w["ob"][:, None]
        return out

    def step(self, data: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients by
        backpropagation through the segment."""
        n, (steps, batch) = self.h, data.shape
        runs = {d: self._run(d, data, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], 1)
        z = np.matmul(self.w["o"], both) + self.w["ob"][:, None]
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        at = np.arange(batch)
        loss = -float(np.log(p[:, labels, at] + 1e-9).mean())
        p[:, labels, at] -= 1
        p /= steps * batch
        grad = {"o": np.einsum("tlb,thb->lh", p, both), "ob": p.sum((0, 2))}
        above = np.matmul(self.w["o"].T, p)
        for d, own in (("f", above[:, :n]), ("b", above[:, n:])):
            u, c = self.w["u" + d], self.w["c" + d]
            gx, gu, gc = np.zeros((256, 3 * n), np.float32), np.zeros_like(u), np.zeros_like(c)
            carry = np.zeros((n, batch), np.float32)
            for t, h, zg, r, rh, new in reversed(runs[d][1]):
                dh = own[t] + carry
                dnew = dh * zg * (1 - new * new)
                dz = dh * (new - h) * zg * (1 - zg)
                drh = c.T @ dnew
                dr = drh * h * r * (1 - r)
                gates = np.concatenate([dz, dr])
                gc += dnew @ rh.T
                gu += gates @ h.T
                np.add.at(gx, data[t], np.concatenate([gates, dnew]).T)
                carry = dh * (1 - zg) + drh * r + u.T @ gates
            grad |= {"x" + d: gx, "u" + d: gu, "c" + d: gc}
        return loss, grad


def train(texts: list[bytes], labels: list[str], steps: int = 300, batch: int = 96, seed: int = 5) -> Net:
    """Adam over random segments, every language drawn equally often.  Texts
    under 8 bytes serve only a language that has no longer ones."""
    langs = sorted({x for t, x in zip(texts, labels, strict=True) if t})
    net, rng = Net(langs), np.random.default_rng(seed)
    own = [[t for t, x in zip(texts, labels, strict=True) if x == lang and t] for lang in langs]
    pools = [[t for t in pool if len(t) >= 8] or pool for pool in own]
    if len(langs) < 2:
        return net
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    for i in range(1, steps + 1):
        y = rng.integers(0, len(langs), batch)
        data = np.full((SEGMENT, batch), 32, np.uint8)
        for b, k in enumerate(y):
            t = pools[k][rng.integers(len(pools[k]))]
            at = rng.integers(0, max(1, len(t) - SEGMENT + 1))
            part = np.frombuffer(t[at : at + SEGMENT], np.uint8)
            data[: len(part), b] = part
        _, grad = net.step(data, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.02 * (1 - 0.9 * i / steps)
        for k, g in grad.items():
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.98 * second[k] + 0.02 * g * g
            net.w[k] -= (rate * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.98**i)) + 1e-6)).astype(np.float32)
    return net


def _pooled(data: np.ndarray, offsets: np.ndarray, net: Net, batch: int = 2048) -> np.ndarray:
    """Mean probabilities over the letter positions of each text."""
    sizes = np.diff(offsets)
    pieces = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = offsets[:-1][owner] + nth * SEGMENT
    length = np.minimum(SEGMENT, offsets[1:][owner] - begin)
    total = np.zeros((len(net.langs), len(sizes)))
    place = np.arange(SEGMENT)[:, None]
    for i in range(0, len(begin), batch):
        b, n = begin[i : i + batch], length[i : i + batch]
        there = place < n
        part = np.where(there, data[np.minimum(b + place, len(data) - 1)], 32).astype(np.uint8)
        z = net.logits(part)
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        weight = (_ASCII_LETTER[part] & there).astype(np.float32)
        weight /= z.sum(1)
        mass = np.einsum("tlb,tb->lb", z, weight)
        for k in range(len(net.langs)):
            total[k] += np.bincount(owner[i : i + batch], mass[k], len(sizes))
    sums = total.sum(0)
    return np.where(sums > 0, total / np.where(sums > 0, sums, 1), 1 / max(len(net.langs), 1))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 400, most: int = 256, excerpt: int = 16384) -> Net:
    """Trains on about ``per_lang`` documents of each of the ``most`` frequent
    languages, chosen by hash among the rows whose ``crc32(key) mod 4`` is not
    2.  Of a longer text the sample has ``excerpt`` bytes from a place set by
    hash, as training reads random segments only."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t"), F.col(lang).alias("l"))
    rows = rows.filter(F.col("l").isNotNull() & (F.length("t") > 0) & (fold("k", 4) != 2))
    counts = rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(most).collect()
    draw = F.pmod(F.xxhash64("k"), F.lit(1 << 40)) / float(1 << 40)
    part = F.expr(f"substring(t, cast(1 + pmod(xxhash64(k), greatest(octet_length(t) - {excerpt}, 0) + 1) as int), {excerpt})")
    wanted = F.lit(False)
    for r in counts:
        wanted |= (F.col("l") == r["l"]) & (draw < per_lang / r["count"])
    found = sorted((r["k"], r["l"], bytes(r["t"])) for r in rows.filter(wanted).select("k", "l", part.alias("t")).collect()) if counts else []
    return train([t for _, _, t in found], [x for _, x, _ in found])


def language_id(docs: DataFrame, net: Net, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``lang_pred`` and ``score`` of every document."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(net)  # a few thousand floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts = column(batch, "text")
            has = pc.match_substring_regex(batch.column(1), r"\pL").fill_null(False)
            for i, j in slices(texts, 1_000_000):
                letters = has.slice(i, j - i).to_numpy(zero_copy_only=False)
                if net.langs:
                    p = _pooled(*raw(texts.slice(i, j - i)), net)
                    best, top = p.argmax(0), np.clip(p.max(0), 0, 1)
                    names = np.where(letters, np.array(net.langs, object)[best], UNKNOWN)
                    top = np.where(letters, top, 0.0)
                else:
                    names, top = [UNKNOWN] * (j - i), np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(top)], names=["doc_id", "lang_pred", "score"])

    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, lang_pred string, score double")
