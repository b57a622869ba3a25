"""Nearest vectors over lists against the scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolake.operators import search, vectors


def grouped(n, dims=16, groups=20, seed=3, width=0.15):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dims))
    return [(i, (middles[i % groups] + width * rng.normal(size=dims)).astype(np.float32).tolist()) for i in range(n)]


def same(lists, df, query, k):
    got = [tuple(r) for r in lists.search(query, k).collect()]
    want = [tuple(r) for r in search.cosine_topk(df, query, k, "vec_id", "v").collect()]
    assert got == want
    return lists.lists_read


@pytest.fixture(scope="module")
def table(spark):
    odd = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [1.0] * 3), (None, [1.0] + [0.0] * 15), (5004, [1.0] + [0.0] * 15)]
    rows = grouped(4000)
    rows += [(6000 + i, rows[7][1]) for i in range(500)] + odd
    return spark.createDataFrame(rows, "vec_id long, v array<float>"), rows


def test_lists_give_what_the_scan_gives(table, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "ROUND_ROWS", 200)
    df, rows = table
    lists = vectors.VectorLists.write(df, str(tmp_path), "vec_id", "v", dims=16)
    total = len(lists.told)
    assert total > 40 and sum(n for n, _ in lists.told.values()) == len(rows)
    rng = np.random.default_rng(9)
    read = [same(lists, df, [float(x) for x in rows[i][1]], 10) for i in (3, 7, 100)]
    assert max(read) <= total // 2 and min(read) <= total // 4
    for query in ([float(x) for x in rng.normal(size=16)], [0.0] * 16, [1.0] + [0.0] * 15):
        same(lists, df, query, 10)
    assert same(lists, df, [-float(x) for x in rows[3][1]], len(rows) + 5) == total


def test_few_vectors_and_none(spark, tmp_path):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "vec_id long, v array<double>")
    for df in (few, few.limit(0), few.where("v IS NULL")):
        same(vectors.VectorLists.write(df, str(tmp_path), "vec_id", "v", dims=2), df, [0.5, 0.5], 3)


def test_a_search_reads_the_lists_that_it_names(table, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "ROUND_ROWS", 1)
    df, rows = table
    lists = vectors.VectorLists.write(df.where(F.col("vec_id") < 4000), str(tmp_path), "vec_id", "v", dims=16, lists=64)
    lists.search([float(x) for x in rows[3][1]], 5)
    assert lists.rows_read < 4000 // 4
