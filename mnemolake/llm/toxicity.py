"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct character n-grams of its lower-cased text, white space and punctuation as one
blank, hashed. Each has the log ratio of its smoothed document frequencies in the two classes; only ratios that speak
for label 1, and that enough documents support, are kept: what is absent from toxic texts proves nothing. Logistic regression over the scaled features gives the weights. To
score, one table look-up per n-gram leaves only those with a weight, each counted once, so that a long clean text
gathers nothing.

Defined results: a null or empty text scores as the intercept says; one class alone or no labels give a constant score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import arrow_map, id_remainder, whole_text
from mnemolake.llm.training import labelled_sample

#: Labelled rows that training reads at most.
SAMPLE_ROWS = 6000
ORDERS = (4, 6, 8)
BITS = 20
_CHUNK = 1 << 20
_ASCII = np.full(128, 32, dtype=np.uint32)
_ASCII[48:58] = np.arange(48, 58)
_ASCII[97:123] = np.arange(97, 123)
_PRIME, _MIX, _FOLD, _DROP = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(15), np.uint32(32 - BITS)


def _codes(text: str) -> np.ndarray:
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.where(c < 128, _ASCII[np.minimum(c, 127)], c)
    blank = c == 32
    # one blank for a run of them
    blank[1:] &= blank[:-1]
    blank[0] = False
    return c[~blank]


def buckets(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of each order, in pieces of bounded size; repeats are kept."""
    codes = _codes(text)
    for first in range(0, len(codes), _CHUNK):
        c = codes[first : first + _CHUNK + max(ORDERS) - 1]
        h, n = c, 1
        for order in ORDERS:
            if len(c) < order:
                break
            for i in range(n, order):
                h = h[: len(c) - i] * _PRIME + c[i:]
            n = order
            # a piece's tail belongs to the next one
            v = h[:_CHUNK] if first + _CHUNK < len(codes) else h
            yield ((v ^ (v >> _FOLD)) * _MIX) >> _DROP


@dataclass(frozen=True)
class Model:
    weight: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        parts = [b[self.weight[b] != 0] for b in buckets(text)]
        found = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        return float(1 / (1 + np.exp(-np.clip(self.bias + float(self.weight[found].sum(dtype=np.float64)), -30, 30))))


def fit(examples: list[tuple[str, int]], alpha: float = 0.5, least_docs: int = 5, least_ratio: float = 1.5, rounds: int = 200, l2: float = 0.01) -> Model:
    """Gradient descent on the mean log loss; its steps and order are fixed."""
    size = 1 << BITS
    y = np.array([label for _, label in examples], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(size, np.float32), -3.0 if not len(y) or y[0] == 0 else 3.0)
    distinct = lambda t: np.unique(np.concatenate(list(buckets(t)) or [np.zeros(0, np.uint32)]))
    with_1, with_0 = np.zeros(size), np.zeros(size)
    for (text, _), label in zip(examples, y, strict=True):
        (with_1 if label else with_0)[distinct(text)] += 1
    n1, n0 = y.sum(), len(y) - y.sum()
    ratio = np.log((with_1 + alpha) / (n1 + 2 * alpha)) - np.log((with_0 + alpha) / (n0 + 2 * alpha))
    ratio[(with_1 < least_docs) | (ratio < least_ratio)] = 0
    # a second reading keeps what has a ratio; all n-grams of all examples at once would take the driver's memory
    kept = [d[ratio[d] != 0] for d in (distinct(text) for text, _ in examples)]
    rows = np.repeat(np.arange(len(kept)), [len(k) for k in kept])
    cols = np.concatenate(kept)
    used, at = np.unique(cols, return_inverse=True)
    scaled = ratio[cols]
    w, bias = np.zeros(len(used)), float(np.log(n1 / n0))
    # Adam: the scaled columns differ by orders of magnitude in how often they occur
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = bias + np.bincount(rows, scaled * w[at], minlength=len(y))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(at, error[rows] * scaled, minlength=len(used)) / len(y) + l2 * w / len(y)
        gb = error.mean()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
        w -= 0.05 * (m / fix1) / (np.sqrt(v / fix2) + 1e-8)
        bias -= 0.05 * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-8)
    weight = np.zeros(size, np.float32)
    weight[used] = w * ratio[used]
    return Model(weight, float(bias))


def train(documents: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on labelled rows whose id isn't in the held-out fold."""
    return fit(labelled_sample(documents, labels, "toxic", id_remainder("doc_id", folds) != held_out, sample_rows))


def toxicity(text: Column, model: Model) -> Column:
    """A score from 0 to 1 for each whole text."""

    @arrow_map(pa.float64())
    def score(whole: str | None) -> float:
        return model.score(whole or "")

    return score(text.cast("string"))


def score_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of documents: doc_id, held_out, score, predicted."""
    model = train(documents, labels)
    rows = documents.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), toxicity(whole_text(), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents without the rows that score 0.5 or more, columns unchanged."""
    return documents.where(toxicity(F.col("text"), train(documents, labels)) < 0.5)
