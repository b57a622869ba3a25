"""Quality: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Tokens are words and runs of punctuation. Features are n-grams (1 to 3) of token shapes (case, digits, the punctuation
itself, whether the token repeats the one before) and of words (1 and 2), hashed into one space; a value is the
feature's count for each token of the text. Training is one pass after another over a bounded
sample in a fixed order, by FTRL-proximal; its L1 term leaves few weights, and a score is a sparse dot product.

Defined results: a null or empty text scores as the intercept says; one class alone or no labels give a constant score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.llm import words
from mnemolake.llm.common import arrow_map, id_remainder, whole_text
from mnemolake.llm.training import labelled_sample

#: Labelled rows that training reads at most.
SAMPLE_ROWS = 3000
BITS = 18
# classes of bytes: 0 space, 1 lower, 2 upper, 3 digit, 4 non-ASCII, 5 punctuation
_CLASS = np.full(256, 5, dtype=np.int8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_GROUP = np.array([0, 1, 1, 1, 1, 2], dtype=np.int8)
_FIELDS = np.array([0, 1 << 21, 1, 1 << 42, 0, 0], dtype=np.int64)
_FIELD = (1 << 21) - 1
_STEP = np.uint64(0x9E3779B97F4A7C15)
# no multiples of the step, as a shape in front of a run of punctuation would then be the same as that run alone
_KINDS = words.mix(np.arange(1, 7, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return (words.mix(h + _KINDS[kind]) >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str) -> tuple[np.ndarray, int]:
    """(the bucket of each n-gram, repeats kept; number of tokens)"""
    raw = words.raw_bytes(text)
    if not len(raw):
        return np.zeros(0, np.int64), 1
    kind = _CLASS[raw]
    group = _GROUP[kind]
    starts = np.flatnonzero((group > 0) & (group != np.concatenate([[0], group[:-1]])))
    if not len(starts):
        return np.zeros(0, np.int64), 1
    ends = np.flatnonzero((group > 0) & (group != np.concatenate([group[1:], [0]]))) + 1
    h = words.hashes(raw, starts, ends)
    # upper, lower and digits of each token, counted in three fields of one number
    inside = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_FIELDS[kind], out=inside[1:])
    within = inside[ends] - inside[starts]
    upper, lower, digit = within & _FIELD, (within >> 21) & _FIELD, within >> 42
    punct = group[starts] == 2
    title = kind[starts] == 2
    shape = np.where(digit > 0, 4, np.where((upper > 1) & (lower == 0), 3, np.where(title, 2, 1))).astype(np.uint64)
    # a run of punctuation is its own shape
    shape[punct] = h[punct]
    again = np.concatenate([[False], h[1:] == h[:-1]])
    shape[again] += np.uint64(1 << 40)
    s2 = shape[:-1] * _STEP + shape[1:]
    s3 = s2[:-1] * _STEP + shape[2:]
    w2 = h[:-1] * _STEP + h[1:]
    return np.concatenate([_bucket(shape, 1), _bucket(s2, 2), _bucket(s3, 3), _bucket(h, 4), _bucket(w2, 5)]), len(h)


@dataclass(frozen=True)
class Model:
    weight: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        at, tokens = features(text)
        return float(1 / (1 + np.exp(-np.clip(self.bias + float(self.weight[at].sum(dtype=np.float64)) / tokens, -30, 30))))


def fit(examples: list[tuple[str, int]], rounds: int = 6, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> Model:
    """FTRL-proximal, one example at a time, in the order given but shuffled by a fixed seed each round."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rows = []
    for text, _ in examples:
        at, tokens = features(text)
        at, count = np.unique(at, return_counts=True)
        rows.append((np.append(at, size).astype(np.int32), np.append(count / tokens, 1.0).astype(np.float32)))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            at, value = rows[i]
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - examples[i][1]) * value
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(slice(None))
    return Model(w[:size].astype(np.float32), float(w[size]))


def train(documents: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on labelled rows whose id isn't in the held-out fold."""
    return fit(labelled_sample(documents, labels, "quality", id_remainder("doc_id", folds) != held_out, sample_rows))


def quality(text: Column, model: Model) -> Column:
    """A score from 0 to 1 for each whole text."""

    @arrow_map(pa.float64())
    def score(whole: str | None) -> float:
        return model.score(whole or "")

    return score(text.cast("string"))


def score_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of documents: doc_id, held_out, score, predicted."""
    model = train(documents, labels)
    rows = documents.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), quality(whole_text(), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
