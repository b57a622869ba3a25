"""Exact top-k search by inner product over sparse integer vectors, term at a time.

Vectors are dealt into cells of bounded size by row, so neither a repeated id nor a repeated vector makes a cell larger.
A task turns the vectors of a cell into postings: for each term (a component's place) the rows that hold it and their
weights. Queries pass by in blocks; each of their terms scatters its weighted postings into dense arrays of scores, an
array for each query of the block, then a partition selects each query's best. What cells select is merged by query.
Every query meets every row; a task holds one cell and one block of queries, whatever there is of either.

Defined results: a vector that is null or holds a null or a value that isn't finite takes no part; an empty vector has
score 0 with all; vectors of unequal length are sparse beyond their end; scaled components beyond a long are cut to its
range, and scores too; each row that is a query has results of its own, and other rows of its id are candidates; ties go
to the smaller id, a null id last; no queries or no vectors give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mnemolake.llm.common import materialise

SCALE = 256
#: Rows of a cell at most, and about as many at least where there are fewer cells than cores; queries that are scored at once.
CELL_ROWS, LEAST_ROWS, QUERY_ROWS = 1 << 15, 1 << 10, 64
_LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Whether no component is null, NaN or infinite; false for null."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


class _Terms:
    """The rows of some list<long> arrays by term: for each term the rows that hold it, in order, and their weights."""

    def __init__(self, lists: list[pa.Array]):
        sizes = np.concatenate([x.value_lengths().to_numpy() for x in lists])
        values = np.concatenate([x.flatten().to_numpy() for x in lists])
        self.rows = len(sizes)
        row = np.repeat(np.arange(self.rows), sizes)
        term = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        held = values != 0
        order = np.argsort(term[held], kind="stable")
        self._row, self._weight, term = row[held][order], values[held][order], term[held][order]
        self.terms, self._first = np.unique(term, return_index=True)
        self._first = np.append(self._first, len(term))
        self.most = max((abs(int(x)) for x in (values.min(), values.max())), default=0) if len(values) else 0
        self.longest = int(sizes.max()) if len(sizes) else 0

    def cast(self, kind) -> None:
        """kind holds any score; lists that most rows are in are kept with their zeros."""
        self._lists = {}
        for i, t in enumerate(self.terms.tolist()):
            rows, weight = self._row[self._first[i] : self._first[i + 1]], self._weight[self._first[i] : self._first[i + 1]].astype(kind)
            if 2 * len(rows) > self.rows:
                full = np.zeros(self.rows, dtype=kind)
                full[rows] = weight
                rows, weight = slice(None), full
            self._lists[t] = rows, weight

    def __getitem__(self, term: int):
        return self._lists.get(term)


def _kind(candidates: _Terms, queries: _Terms):
    """A type that holds the sum of all terms."""
    most = candidates.most * queries.most * min(candidates.longest, queries.longest)
    return np.int32 if most < 1 << 31 else np.int64 if most < 1 << 63 else object


def _scores(candidates: _Terms, queries: _Terms, kind) -> np.ndarray:
    """Dense scores, a row for each query."""
    out = np.zeros((queries.rows, candidates.rows), dtype=kind)
    for term in queries.terms.tolist():
        found = candidates[term]
        if found is None:
            continue
        (asked, factor), (rows, weight) = queries[term], found
        if isinstance(asked, slice) and isinstance(rows, slice):
            out += np.multiply.outer(factor, weight)
        elif isinstance(asked, slice):
            out[:, rows] += np.multiply.outer(factor, weight)
        else:
            for q, f in zip(asked.tolist(), factor.tolist(), strict=True):
                out[q, rows] += f * weight
    return out


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, the smaller place first where they are equal."""
    if len(scores) <= k:
        found = np.arange(len(scores))
    elif scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], i))[:k])
    else:
        bound = scores[np.argpartition(scores, len(scores) - k)[len(scores) - k]]
        above = np.flatnonzero(scores > bound)
        found = np.concatenate([above, np.flatnonzero(scores == bound)[: k - len(above)]])
    return np.array(sorted(found.tolist(), key=lambda i: (-int(scores[i]), i)), dtype=np.int64)


def _search(k: int, key: pa.DataType):
    def answers(cell: tuple, queries: pa.RecordBatch, terms: _Terms) -> pa.RecordBatch:
        rows, keys, postings = cell
        kind = _kind(postings, terms)
        if getattr(postings, "kind", None) != kind:
            postings.cast(kind)
            postings.kind = kind
        terms.cast(kind)
        scores, own = _scores(postings, terms, kind), queries.column("row").to_numpy()
        asked, found, told = [], [], []
        for q in range(len(own)):
            best = _best(scores[q], k + 1)
            best = best[rows[best] != own[q]][:k]
            asked += [q] * len(best)
            found += best.tolist()
            told += [max(-_LONG - 1, min(_LONG, int(s))) for s in scores[q][best]]
        asked, found = pa.array(asked, pa.int64()), pa.array(found, pa.int64())
        return pa.RecordBatch.from_arrays([queries.column("row").take(asked), queries.column("key").take(asked).cast(key), keys.take(found), pa.array(told, pa.int64())], names=["row", "query_id", "key", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, cell = None, [], None
        for batch in batches:
            numbers, asks = batch.column("cell").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False).astype(np.int8)
            edges = [0, *(np.flatnonzero((np.diff(numbers) != 0) | (np.diff(asks) != 0)) + 1).tolist(), len(batch)]
            for first, last in zip(edges, edges[1:], strict=False):
                if first == last:
                    continue
                part = batch.slice(first, last - first)
                if numbers[first] != number:
                    number, held, cell = numbers[first], [], None
                if not asks[first]:
                    held.append(part)
                    continue
                if held:
                    keys = pa.chunked_array([x.column("key") for x in held], type=held[0].column("key").type).combine_chunks()
                    cell = np.concatenate([x.column("row").to_numpy() for x in held]), keys.cast(key), _Terms([x.column("terms") for x in held])
                    held = []
                for at in range(0, len(part) if cell else 0, QUERY_ROWS):
                    block = part.slice(at, QUERY_ROWS)
                    yield answers(cell, block, _Terms([block.column("terms")]))

    return run


def top_k(vectors: DataFrame, asks: Column, k: int = 5, key: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, key, score): the k best of all other rows for each row that asks is true of.

    vectors (key, column, ...) may have further columns of any name.
    """
    kind = vectors.schema[key].dataType
    rows = vectors.where(usable(F.col(column))).select(F.col(key).alias("key"), scaled(F.col(column), scale).alias("terms"), F.coalesce(asks, F.lit(False)).alias("query"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = rows.count()
    cells = max(1, -(-n // CELL_ROWS), min(vectors.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS))
    cell = F.pmod(F.xxhash64("row"), F.lit(cells)).cast("int")
    candidates = rows.select(cell.alias("cell"), F.lit(False).alias("asks"), "row", "key", "terms")
    # each query passes every cell
    queries = rows.where("query").select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.lit(True).alias("asks"), "row", "key", "terms")
    dealt = candidates.unionByName(queries).repartitionByRange(cells, "cell").sortWithinPartitions("cell", "asks", F.asc_nulls_last("key"), "row")
    told = kind.simpleString()
    found = dealt.mapInArrow(_search(k, to_arrow_type(kind)), f"row long, query_id {told}, key {told}, score long")
    place = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("key")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.col("key").alias(key), "score")
