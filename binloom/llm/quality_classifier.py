"""Quality classifier from weak labels.

Heuristic labellers each vote good, bad or nothing on a document. Expectation-maximisation estimates
how often each is right, without any true label: the chance of each vote given the unknown class, and
the classes' shares. Its input is the number of documents per pattern of votes, counted over all
documents; 3 to the number of labellers bounds the patterns, however large the corpus.

The posterior of a document's pattern is its soft label. A linear scorer over hashed features, words
and the shapes of words, is trained on the soft labels of a bounded sample (SAMPLE documents, give or take chance,
drawn by a hash of id and text), and then scores every document. It generalises beyond what the labellers
look at.

Defined results: null, empty and wordless texts get votes like any other and the score of the bias
alone; ties and repeated rows have equal posteriors and scores, and count each in the patterns; very long texts are
read whole, by the labellers and by the scorer; without any documents the result is empty; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, SAMPLE_BITS = 8_000, 62
WORD_BITS, SHAPE_BITS = 15, 12
EPOCHS, RATE, PRIOR = 60, 0.5, 10
# Frequent words of several languages.
COMMON = frozenset(b"the of and to in a is that for it as with be by on are was der die und den von zu das mit sich des auf ist im dem nicht ein eine de la le et les en un une du que pour dans est qui el y los se del las por con una su para al".split())
_CLASSES = np.zeros(256, np.uint8)  # of a byte: 0 white space, 1 small letter, 2 capital, 3 digit, 4 end of sentence, 5 other punctuation, 6 symbol, 7 beyond ASCII
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b] = 7 if _b > 127 else 0 if _c in " \t\n\x0b\x0c\r" else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c in ".!?" else 5 if _c in ",;:'\"()-" else 6
_END = re.compile(rb"[.!?\"'):]\s*$")


def votes(raw: bytes, found: list[bytes]) -> list[int]:
    """Votes of the labellers on a text as bytes and its words: 1 good, 0 bad, 2 nothing."""

    def say(value: float, bad, good) -> int:
        return 0 if bad(value) else 1 if good(value) else 2

    n = len(found)
    if not n:
        return [0] + [2] * 7
    counts = np.bincount(_CLASSES[np.frombuffer(raw, np.uint8)], minlength=8)
    letters = counts[1] + counts[2] + counts[7]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    common = sum(map(COMMON.__contains__, found)) / n
    same = sum(a == b for a, b in zip(found, found[1:])) / n
    return [
        say(n, lambda v: v < 3, lambda v: v >= 40),
        say(common, lambda v: v < 0.08, lambda v: v >= 0.2) if n >= 20 else 2,
        say(counts[6] / n, lambda v: v > 0.15, lambda v: v < 0.02),
        say(same, lambda v: v > 0.2, lambda v: v < 0.05) if n >= 10 else 2,
        say(sum(bool(_END.search(x)) for x in lines) / len(lines), lambda v: v < 0.2, lambda v: v >= 0.6),
        say(counts[2] / max(letters, 1), lambda v: v > 0.3, lambda v: v < 0.12),
        say(len(set(found)) / n, lambda v: v < 0.3, lambda v: v > 0.45) if 50 <= n <= 2000 else 2,
        say(1 - len(set(lines)) / len(lines), lambda v: v > 0.3, lambda v: v < 0.05) if len(lines) > 3 else 2,
    ]


LABELLERS = 8


def features(raw: bytes, found: list[bytes]) -> np.ndarray:
    """Hashed feature of each word, then of the shape of each word: a run of one class of characters counts once."""
    from zlib import crc32

    if not found:
        return np.empty(0, np.int32)
    hashed = np.fromiter(map(crc32, found), np.uint32, len(found)) >> np.uint32(32 - WORD_BITS)
    kinds = _CLASSES[np.frombuffer(raw, np.uint8)].astype(np.uint64)
    kinds = kinds[np.concatenate([[True], kinds[1:] != kinds[:-1]])]
    gaps = np.flatnonzero(kinds == 0)
    first = np.concatenate([[0], gaps + 1])
    last = np.concatenate([gaps, [len(kinds)]])
    first, last = first[last > first], last[last > first]
    # a word's shape: its first four runs and how many there are, and whether the word repeats the one before
    shape = np.minimum(last - first, 7).astype(np.uint64)
    for k in range(4):
        at = first + k
        shape = shape * np.uint64(8) + np.where(at < last, kinds[np.minimum(at, len(kinds) - 1)], 0).astype(np.uint64)
    shape = shape * np.uint64(2) + np.concatenate([[False], hashed[1:] == hashed[:-1]]).astype(np.uint64)
    shaped = (shape * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SHAPE_BITS)
    return np.concatenate([hashed.astype(np.int32), shaped.astype(np.int32) + (1 << WORD_BITS)])


def _words(text: str | None) -> tuple[bytes, list[bytes]]:
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    return raw, raw.lower().split()


def _pattern(text: str | None) -> int:
    return sum(v * 3**k for k, v in enumerate(votes(*_words(text))))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, n = np.unique([_pattern(t) for t in batch.column(0).to_pylist()], return_counts=True)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(n, pa.int64())], ["pattern", "n"])


def vote_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """EM over vote patterns: the posterior of good of each pattern, the share of good, and the chances [labeller, class, vote].

    A labeller that says nothing is no evidence, so chances are of bad and good votes alone.
    """
    v = (patterns[:, None] // 3 ** np.arange(LABELLERS)[None, :]) % 3
    good, bad = (v == 1).sum(axis=1), (v == 0).sum(axis=1)
    # a start by majority, a bad vote weighing more since each labeller knows one kind of fault
    p = (good + 1) / (good + 4 * bad + 2)
    share, chance = 0.5, np.ones((LABELLERS, 2, 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - p), counts * p])
        said = np.stack([(weight @ (v == k)).T + 1 for k in range(2)], axis=2)
        chance[:, :, :2] = said / said.sum(axis=2, keepdims=True)
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        logs = np.log(chance[np.arange(LABELLERS)[None, :], :, v]).sum(axis=1)
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] + np.log(1 - share) - logs[:, 1] - np.log(share), -500, 500)))
        done = np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
    return p, float(share), chance


def _values(weights: np.ndarray, index: np.ndarray) -> float:
    """Linear score but for the bias: the weights' sum over the number of words plus PRIOR, so that few words say little."""
    return float(weights[index].sum() / (len(index) / 2 + PRIOR))


def train_scorer(rows: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Weights and bias by AdaGrad on the logistic loss of (features, soft label)."""
    weights, bias = np.zeros((1 << WORD_BITS) + (1 << SHAPE_BITS)), 0.0
    rows = [r for r in rows if len(r[0])]
    if not rows:
        return weights, bias
    index = np.concatenate([r[0] for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    share = 1 / (np.bincount(doc, minlength=len(rows)) / 2 + PRIOR)[doc]
    y = np.array([r[1] for r in rows])
    past, past_bias = np.full_like(weights, 1e-8), 1e-8
    for _ in range(EPOCHS):
        z = np.bincount(doc, weights[index] * share, len(rows)) + bias
        slope = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.bincount(index, slope[doc] * share, len(weights)) / len(rows) + 1e-6 * weights
        past += grad**2
        weights -= RATE * grad / np.sqrt(past)
        past_bias += slope.mean() ** 2
        bias -= RATE * slope.mean() / np.sqrt(past_bias)
    return weights, float(bias)


def _scored(posterior: dict[int, float], weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weak, score = [], [], []
            for text in batch.column(1).to_pylist():
                raw, found = _words(text)
                v = votes(raw, found)
                n.append(sum(x < 2 for x in v))
                weak.append(posterior.get(sum(x * 3**k for k, x in enumerate(v)), 0.5))
                score.append(1 / (1 + np.exp(-np.clip(_values(weights, features(raw, found)) + bias, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(weak, pa.float64()), pa.array(score, pa.float64())], ["id", "n_votes", "weak_posterior", "score"])

    return run


def classify_quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: id, n_votes, weak_posterior, score (0 to 1, higher is better) and kept (score of 0.5 or more)."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    counted = source.select("text").mapInArrow(_patterns, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    if not counted:
        return source.select(F.col("id").alias(id_col), F.lit(0).alias("n_votes"), F.lit(0.0).alias("weak_posterior"), F.lit(0.0).alias("score"), F.lit(True).alias("kept"))
    patterns, counts = np.array([r.pattern for r in counted]), np.array([r.n for r in counted], float)
    good, _, _ = vote_model(patterns, counts)
    posterior = dict(zip(patterns.tolist(), good.tolist(), strict=True))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_words(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([features(*r).tobytes() for r in rows], pa.binary()), pa.array([posterior.get(sum(x * 3**k for k, x in enumerate(votes(*r))), 0.5) for r in rows])], ["f", "y"])

    # of 62 bits, so that a share is left however many documents there are
    hashed = F.xxhash64("id", "text").bitwiseAND(F.lit(2**SAMPLE_BITS - 1))
    share = 2**SAMPLE_BITS - 1 if sample >= counts.sum() else int(2**SAMPLE_BITS * (sample / counts.sum()))
    rows = source.where(hashed <= F.lit(share)).select("text").mapInArrow(drawn, "f binary, y double").collect()
    weights, bias = train_scorer([(np.frombuffer(r.f, np.int32), r.y) for r in rows])
    kind = docs.schema[id_col].dataType.simpleString()
    out = source.mapInArrow(_scored(posterior, weights.astype(np.float32), bias), f"id {kind}, n_votes int, weak_posterior double, score double")
    return out.select(F.col("id").alias(id_col), "n_votes", "weak_posterior", "score", (F.col("score") >= 0.5).alias("kept"))
