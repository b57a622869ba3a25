"""The hash embedding: signed trigram counts in 64 buckets, scaled to unit length."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from mnemolake.functions.slices import KNOWN, slices
from mnemolake.schema import DIM


def _place(gram: str) -> tuple[int, int]:
    """Bucket and sign: the low six bits of the digest, and its bit 64."""
    digest = hashlib.md5(gram.encode("utf-8", "surrogatepass")).digest()
    return digest[15] % DIM, 1 - 2 * (digest[7] & 1)


def bucket_sums(text: str, known: dict[str, tuple[int, int]] | None = None) -> list[int]:
    low, out = text.lower(), [0] * DIM
    known = {} if known is None else known
    for i in range(max(1, len(low) - 2)):
        gram = low[i : i + 3]
        if gram not in known:
            known[gram] = _place(gram)
        bucket, sign = known[gram]
        out[bucket] += sign
    return out


def embed(text: str) -> list[float]:
    sums = bucket_sums(text)
    norm = math.sqrt(sum(v * v for v in sums))
    return [v / norm for v in sums] if norm else [0.0] * DIM


def _embed_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    known: dict[str, tuple[int, int]] = {}
    for batch in slices(batches):
        if len(known) > KNOWN:
            known.clear()
        rows = np.array([bucket_sums(t.as_py() or "", known) for t in batch], dtype=np.float64).reshape(-1, DIM)
        norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        flat = np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0).astype(np.float32).ravel()
        yield pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, DIM, dtype=np.int32)), pa.array(flat))


def embedding(text: Column) -> Column:
    """array<float> of each text, as Arrow batches; no shuffle."""
    return F.arrow_udf(_embed_batches, from_arrow_type(pa.list_(pa.float32())))(text)


def embedding_buckets(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bucket, signed) where not 0. A key is one row, so its sums are made where it lies: nothing is exploded or shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int]] = {}
        for batch in slices(batches):
            if len(known) > KNOWN:
                known.clear()
            sums = np.array([bucket_sums(t.as_py() or "", known) for t in batch.column(1)], dtype=np.int64).reshape(-1, DIM)
            row, bucket = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(bucket.astype(np.int32)), pa.array(sums[row, bucket])], names=["key", "bucket", "signed"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, bucket int, signed long").withColumnRenamed("key", key)


def pack(vector: list[float]) -> bytes:
    return np.asarray(vector, dtype=np.float32).tobytes()


def unpack(blob: bytes) -> list[float]:
    return np.frombuffer(blob, dtype=np.float32).tolist()


def _decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in slices(batches):
        yield pa.array([unpack(b.as_py()) if b.as_py() else [] for b in batch], type=pa.list_(pa.float32()))


def _encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in slices(batches):
        yield pa.array([pack(v.as_py() or []) for v in batch], type=pa.binary())


def decode_vector(blob: Column) -> Column:
    return F.arrow_udf(_decode, from_arrow_type(pa.list_(pa.float32())))(blob)


def encode_vector(vector: Column) -> Column:
    return F.arrow_udf(_encode, from_arrow_type(pa.binary()))(vector)
