"""Clustering of integer vectors around centroids, with partial-distance search.

The dimensions are ordered by their variance over all vectors. Squared differences are added up over the first STEP of
them for all centroids; the centroid that is nearest there gives the first bound, by its whole distance. Every other
centroid goes on in steps and is abandoned for a vector as soon as its sum is strictly above the best distance; what
survives all dimensions is compared. So the result is that of the whole distances.

A round is one pass: each task adds up its own vectors by cluster, tasks send a row for each cluster and dimension, and
the driver gets their sums, k times the dimensions. No vector is shuffled, and none leaves its task but as a sum.

Defined results: a vector of another length, or one that is null or holds a null or a value that isn't finite, is left
out; a null id counts as the empty text where ids are hashed; repeated rows are vectors of their own, and centroids too;
fewer vectors than k make as many centroids; components beyond a long are cut to its range and distances too; an empty
table gives no rows.
"""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import materialise
from mnemolake.llm.topk import scaled, usable

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, "2"
#: Dimensions of a step, and vectors that are compared at once.
STEP, ROWS = 8, 2048
#: Components up to this can be subtracted, squared and added up as longs; beyond it as Python's integers.
_SAFE = 1 << 27
_LONG = (1 << 63) - 1


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) for each row of x; the smaller number where distances are equal. order: of the dimensions."""
    x, c = x[:, order], centroids[:, order]
    head = ((x[:, None, :STEP] - c[None, :, :STEP]) ** 2).sum(axis=2)
    best = head.argmin(axis=1)
    least = ((x - c[best]) ** 2).sum(axis=1)
    for j in range(len(c)):
        live = np.flatnonzero((head[:, j] <= least) & (best != j))
        far = head[live, j]
        for d in range(STEP, x.shape[1], STEP):
            if not len(live):
                break
            far = far + ((x[live, d : d + STEP] - c[j, d : d + STEP]) ** 2).sum(axis=1)
            there = np.flatnonzero(far <= least[live])
            live, far = live[there], far[there]
        won = np.flatnonzero((far < least[live]) | (far == least[live]) & (j < best[live]))
        best[live[won]], least[live[won]] = j, far[won]
    return best, least


def _matrices(batch: pa.RecordBatch, dims: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a batch as matrices: of longs where squares of differences fit, else of Python's integers."""
    flat = batch.column("terms").flatten().to_numpy().reshape(-1, dims)
    for at in range(0, len(flat), ROWS):
        x = flat[at : at + ROWS]
        wide = most > _SAFE or int(x.max()) > _SAFE or int(x.min()) < -_SAFE
        yield at, x.astype(object) if wide else x


def _widest(centroids: list[list[int]]) -> int:
    return max((abs(v) for c in centroids for v in c), default=0)


def _sums(vectors: DataFrame, dims: int, add: Callable) -> dict[tuple[int, int], int]:
    """Sums by (group, place) of what add(matrix) gives as pairs of groups and a matrix of values; a bounded table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], int] = {}
        for batch in batches:
            for group, values in add(batch):
                for place, v in enumerate(values):
                    held[group, place] = held.get((group, place), 0) + int(v)
        keys = list(held)
        total = pa.array([decimal.Decimal(held[x]) for x in keys], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in keys], pa.int32()), pa.array([p for _, p in keys], pa.int32()), total], names=["g", "place", "total"])

    rows = vectors.select("terms").mapInArrow(run, "g int, place int, total decimal(38, 0)").groupBy("g", "place").agg(F.sum("total").alias("total"))
    return {(r.g, r.place): int(r.total) for r in rows.collect()}


def variance_order(vectors: DataFrame, dims: int) -> np.ndarray:
    """The dimensions, that of the greatest variance first. It decides about speed alone."""

    def add(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for _, x in _matrices(batch, dims, _SAFE):
            low = np.clip(x.astype(np.float64), -_SAFE, _SAFE)
            yield 0, low.sum(axis=0)
            yield 1, (low * low).sum(axis=0)
            yield 2, [len(x)]

    found = _sums(vectors, dims, add)
    n = max(1, found.get((2, 0), 0))
    return np.argsort([-(found.get((1, d), 0) / n - (found.get((0, d), 0) / n) ** 2) for d in range(dims)], kind="stable")


def _first(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    return [r.terms for r in vectors.select(digest.alias("digest"), "terms").orderBy("digest", "terms").limit(k).collect()]


def _moved(vectors: DataFrame, centroids: list[list[int]], order: np.ndarray, dims: int) -> list[list[int]]:
    """The centroids after one round."""
    most = _widest(centroids)

    def add(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for _, x in _matrices(batch, dims, most):
            best, _ = nearest(x, np.array(centroids, dtype=x.dtype), order)
            for j in np.unique(best).tolist():
                own = x[best == j]
                yield j, [len(own), *own.sum(axis=0)]

    found = _sums(vectors, dims, add)
    return [[found[j, d + 1] // found[j, 0] for d in range(dims)] if found.get((j, 0)) else c for j, c in enumerate(centroids)]


def _assigned(vectors: DataFrame, centroids: list[list[int]], order: np.ndarray, dims: int) -> DataFrame:
    most = _widest(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _matrices(batch, dims, most):
                best, least = nearest(x, np.array(centroids, dtype=x.dtype), order)
                told = pa.array([min(_LONG, d) for d in least.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(at, len(x)), pa.array(best.astype(np.int32)), told], names=["key", "cluster", "distance"])

    return vectors.select("key", "terms").mapInArrow(run, f"key {vectors.schema['key'].dataType.simpleString()}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that is kept.

    vectors (key, column, ...) may have further columns of any name.
    """
    whole = (F.size(column) == dims) & usable(F.col(column))
    kept = materialise(vectors.where(whole).select(F.col(key).alias("key"), scaled(F.col(column), scale).alias("terms")), "vectors")
    order, centroids = variance_order(kept, dims), _first(kept, k, seed)
    for _ in range(rounds):
        centroids = _moved(kept, centroids, order, dims)
    found = materialise(_assigned(kept, centroids, order, dims), "assigned")
    inertia = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38, 0)")).alias("d")).collect()}
    rows = [(j, min(_LONG, inertia.get(j, 0)), min(_LONG, sum(inertia.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    # k rows
    told = F.broadcast(vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return found.join(told, "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
