"""Exact nearest vectors by cosine over lists of vectors around centroids, most of which a bound rules out.

Each vector is in the list of the centroid that it makes the smallest angle with; a list knows its widest angle. With the
angle t between a query and a centroid and the widest angle r of its list, no vector of the list makes a smaller angle
with the query than t - r. Lists are read in the order of that bound, in rounds, each one top-k in tasks; the search ends
when no list that is left can enter the k best. The result is that of the scan over all vectors, whatever the lists are.

Centroids come from a bounded sample of vectors, which decides about speed alone. Vectors without an angle (null, zero, of
another length) are a list of their own with cosine 0. A list of a third of all vectors is many files' row groups, not a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.operators.search import cosine_topk
from mnemolake.work import discard, materialise

#: Vectors that centroids are made from, centroids at most, rows that the first round reads at least, rows of a file.
SAMPLE, MOST_LISTS, ROUND_ROWS, FILE_ROWS = 1 << 14, 1 << 12, 1 << 12, 500_000
#: What angles and cosines may be off by.
SLACK = 1e-6
NOWHERE = -1


def _units(vectors: list, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, whether each has an angle) of lists of numbers."""
    fits = np.array([v is not None and len(v) == dims and None not in v for v in vectors], dtype=bool)
    x = np.array([v if ok else [0.0] * dims for v, ok in zip(vectors, fits, strict=True)], dtype=np.float64).reshape(-1, dims)
    norms = np.sqrt((x * x).sum(axis=1))
    fits &= np.isfinite(norms) & (norms > 0)
    return np.divide(x, norms[:, None], out=np.zeros_like(x), where=fits[:, None]), fits


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _centroids(units: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """n centroids of unit vectors, by rounds of mean directions."""
    chosen = units[:: max(1, len(units) // n)][:n].copy()
    for _ in range(rounds):
        of = (units @ chosen.T).argmax(axis=1)
        sums = np.zeros_like(chosen)
        np.add.at(sums, of, units)
        norms = np.sqrt((sums * sums).sum(axis=1))
        chosen[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return chosen


class VectorLists:
    """Vectors (key, column) written as lists below root; read() finds lists that are there."""

    def __init__(self, spark: SparkSession, root: str, key: str, column: str, dims: int, centroids: np.ndarray, told: dict[int, tuple[int, float]]):
        self.spark, self.root, self.key, self.column, self.dims, self.centroids, self.told = spark, root, key, column, dims, centroids, told
        #: Lists and rows that the last search read.
        self.lists_read = self.rows_read = 0

    @classmethod
    def write(cls, vectors: DataFrame, root: str, key: str = "id", column: str = "embedding", dims: int = 64, lists: int | None = None) -> VectorLists:
        """lists: how many; else the square root of how many vectors there are, up to MOST_LISTS."""
        spark, root = vectors.sparkSession, f"{root.rstrip('/')}/{uuid.uuid4().hex}"
        rows = materialise(vectors.select(F.col(key).alias("key"), F.col(column).alias("vector")), "vectors")
        n = rows.count()
        taken = rows.orderBy(F.xxhash64("vector", "key")).limit(SAMPLE).select("vector").collect()
        units, fits = _units([r.vector for r in taken], dims)
        wanted = min(MOST_LISTS, lists or max(1, int(n**0.5)), max(1, int(fits.sum())))
        centroids = _centroids(units[fits], wanted) if fits.any() else np.zeros((0, dims))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u, fit = _units(batch.column("vector").to_pylist(), dims)
                near = u @ centroids.T if len(centroids) else np.zeros((len(u), 1))
                of = near.argmax(axis=1) if len(u) else np.zeros(0, np.int64)
                angle = _angles(near[np.arange(len(u)), of])
                of, angle = np.where(fit, of, NOWHERE), np.where(fit, angle, 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), pa.array(angle), batch.column("key"), batch.column("vector")], names=["list", "angle", "key", "vector"])

        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        placed = rows.mapInArrow(place, f"list int, angle double, key {kinds['key']}, vector {kinds['vector']}")
        files = max(1, -(-n // FILE_ROWS))
        placed.repartitionByRange(files, "list", "key").sortWithinPartitions("list", "key").write.option("parquet.block.size", 4 << 20).parquet(f"{root}/lists")
        discard(rows)
        found = spark.read.parquet(f"{root}/lists").groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("widest"))
        told = {r.list: (r.n, r.widest) for r in found.collect()}
        return cls(spark, root, key, column, dims, centroids, told)

    def _bounds(self, query: list[float]) -> list[tuple[float, int]]:
        """(no cosine in the list is greater, list), the greatest first."""
        units, fits = _units([query], self.dims)
        if not fits[0]:
            return [(0.0, one) for one in sorted(self.told)]
        angles = _angles(self.centroids @ units[0]) if len(self.centroids) else np.zeros(0)
        bound = lambda one, widest: SLACK + (0.0 if one == NOWHERE else float(np.cos(max(0.0, angles[one] - widest))))
        return sorted(((bound(one, widest), one) for one, (_, widest) in self.told.items()), reverse=True)

    def search(self, query: list[float], k: int = 10) -> DataFrame:
        """(key, cosine): what cosine_topk() gives over all vectors."""
        stored = self.spark.read.parquet(f"{self.root}/lists")
        left, best, size = self._bounds(query), [], max(ROUND_ROWS, k)
        self.lists_read = self.rows_read = 0
        while left and (len(best) < k or left[0][0] >= best[-1][0]):
            taken, rows = [], 0
            while left and rows < size and (len(best) < k or left[0][0] >= best[-1][0]):
                taken.append(left.pop(0)[1])
                rows += self.told[taken[-1]][0]
            self.lists_read, self.rows_read, size = self.lists_read + len(taken), self.rows_read + rows, 2 * size
            found = cosine_topk(stored.where(F.col("list").isin(taken)), query, k, "key", "vector").collect()
            # ties go to the smaller key, a null one first, as a sort has it
            best = sorted([*best, *((r.cosine, r.key) for r in found)], key=lambda x: (-x[0], x[1] is not None, x[1]))[:k]
        kind = stored.schema["key"].dataType.simpleString()
        return self.spark.createDataFrame([(key, value) for value, key in best], f"`{self.key}` {kind}, cosine double")
