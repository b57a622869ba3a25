"""Resampling, top-k search and clustering against versions in plain Python."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("mnemolake.llm")

from mnemolake.llm import centroids, resampling, topk  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{i % 97}x{i % 8111}" for i in range(30_000)) + " " + "é" * 3000 + "z" * 2000


def plain_features(text, n=1):
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return low, [" ".join(low[i : i + k]) for k in range(1, n + 1) for i in range(len(low) - k + 1)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % buckets


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(), max_size=6), st.integers(1, 3))
def test_features_are_runs_of_words(texts, n):
    of, _, found = resampling.features([t.encode("utf-8", "surrogatepass") for t in texts], 1000, n)
    want = sorted((i, bucket(f, 1000)) for i, t in enumerate(texts) for f in plain_features(t, n)[1])
    assert sorted(zip(of.tolist(), found.tolist(), strict=True)) == want


def plain_resample(docs, target, buckets, n, least, percent):
    source = [(i, *plain_features(t, n)) for i, t in docs]
    s, t = {}, {}
    for corpus, sums in (([f for _, _, f in source], s), ([plain_features(x, n)[1] for x in target], t)):
        for features in corpus:
            for f in features:
                sums[bucket(f, buckets)] = sums.get(bucket(f, buckets), 0) + 1
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t.get(b, 0) + 1) * float(big_s + buckets) / ((s[b] + 1) * float(big_t + buckets)))) for b in s}
    rows = []
    for i, low, features in source:
        weight = sum(gain[bucket(f, buckets)] for f in features)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(low), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    drawn = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    most = len(drawn) * percent // 100
    rank = {id(r): k for k, r in enumerate(drawn[:most], 1)}
    return sorted(((r[0], r[2], r[3], r[4], rank.get(id(r))) for r in rows), key=str)


@pytest.mark.parametrize("n", [1, 2])
def test_resampling_equals_plain_sums(docs, spark, n):
    rows = [(i, f"a common start {'x' * (i % 5)} of words number {i % 7} " * (1 + i % 9)) for i in range(60)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (100, LONG), (101, None), (102, ""), (None, "null id " * 20), (None, "null id " * 20), (103, "short text")]
    target = ["a common start of another kind", None, "", "words number 3 words number 3", "not in any document"]
    aim = spark.createDataFrame([(t, "x") for t in target], "text string, bucket string")
    got = resampling.resample(docs(rows).withColumn("bucket", F.lit(1)).withColumn("weight", F.lit("w")), aim, buckets=97, most_words=n, percent=25)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_resample(rows, target, 97, n, 20, 25)


def test_postings_of_a_hot_bucket_are_spread(spark, docs, monkeypatch):
    monkeypatch.setattr(resampling, "_HELD", 64)
    rows = [(i, "the " * 30 + f"w{i}") for i in range(3000)]
    held = resampling.inverted(docs(rows).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary").alias("text")))
    blocks = held.where("bucket IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64(F.element_at("rows", 1)), F.lit(resampling.SALTS)))
    hot = blocks.where(F.col("bucket") == bucket("the", 10_000)).groupBy("salt").agg(F.sum(F.size("rows")).alias("n")).collect()
    assert sum(r.n for r in hot) >= 3000 and max(r.n for r in hot) < 600


def test_empty_tables_give_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(docs, docs).collect() == []
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(vectors, F.col("vec_id") % 50 == 0).collect() == [] and centroids.cluster(vectors).collect() == []


# vectors


def odd_vectors(n, dims, seed=5):
    """Vectors with repeats, zeros, ties, repeated and null ids, and some that take no part."""
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 0.2, dims).astype(np.float32).tolist()) for i in range(n)]
    rows += [(i, rows[3][1]) for i in range(n, n + 40)] + [(50, rows[3][1]), (50, rows[4][1]), (None, rows[3][1]), (n + 41, [0.0] * dims)]
    rows += [(n + 42, None), (n + 43, [None] * dims), (n + 44, [float("nan")] * dims), (n + 45, [float("inf")] + [0.0] * (dims - 1))]
    return rows


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, embedding array<{kind}>, row string").withColumns({"cell": F.lit("x"), "score": F.lit("x"), "key": F.lit(1), "terms": F.lit(2), "cluster": F.lit("c")})


def integers(v):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v]


def plain_top_k(rows, k):
    held = [(i, q) for i, v in rows if (q := integers(v)) is not None]
    out = []
    for a, (i, q) in enumerate(held):
        if i is not None and i % 50 == 0:
            scored = [(sum(x * y for x, y in zip(q, p, strict=False)), j) for b, (j, p) in enumerate(held) if b != a]
            scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
            out += [(i, n, j, s) for n, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("cell", [1 << 15, 60])
def test_top_k_equals_all_products(spark, monkeypatch, cell):
    monkeypatch.setattr(topk, "CELL_ROWS", cell)
    rows = odd_vectors(220, 16)
    rows += [(300, []), (301, [0.5]), (350, [0.25, -0.5])]  # sparse beyond their end
    got = topk.top_k(table(spark, rows), F.col("vec_id") % 50 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_top_k(rows, 5)


def test_top_k_of_few_rows_and_wide_values(spark):
    rows = [(0, [1e6, -3.0]), (50, [2e9, 1e9]), (3, [1e-9, 5e9])]
    assert sorted(map(tuple, topk.top_k(table(spark, rows, "double"), F.col("vec_id") % 50 == 0, k=5).collect())) == plain_top_k(rows, 5)
    huge = [(0, [1e30, 0.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0])]
    got = topk.top_k(table(spark, huge, "double"), F.col("vec_id") == 0).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, (1 << 63) - 1), (2, -(1 << 63))]
    assert topk.top_k(table(spark, [(50, [1.0])]), F.col("vec_id") % 50 == 0).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), max_size=6), min_size=1, max_size=30), st.lists(st.lists(st.integers(-3, 3), max_size=6), min_size=1, max_size=8))
def test_scores_term_at_a_time(candidates, queries):
    made = [topk._Terms([pa.array(x, pa.list_(pa.int64()))]) for x in (candidates, queries)]
    for kind in (np.int32, np.int64, object):
        for m in made:
            m.cast(kind)
        want = [[sum(a * b for a, b in zip(q, c, strict=False)) for c in candidates] for q in queries]
        scores = topk._scores(*made, kind)
        assert scores.tolist() == want
        for row, plain in zip(scores, want, strict=True):
            assert topk._best(row, 4).tolist() == sorted(range(len(plain)), key=lambda i: (-plain[i], i))[:4]


def plain_clusters(rows, k, rounds, dims):
    held = [(i, q) for i, v in rows if v is not None and len(v) == dims and (q := integers(v)) is not None]
    digest = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    middle = [q for i, q in sorted(held, key=lambda r: (digest(r[0]), r[1]))[:k]]
    for n in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(middle)) for _, q in held]
        if n < rounds:
            own = [[q for (_, q), (_, at) in zip(held, near, strict=True) if at == j] for j in range(len(middle))]
            middle = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else c for o, c in zip(own, middle, strict=True)]
    of = lambda j: sum(d for d, at in near if at == j)
    return sorted(((i, j, d, of(j), sum(x for x, _ in near), hashlib.sha256(",".join(map(str, middle[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(held, near, strict=True)), key=str)


@pytest.mark.parametrize("dims,k", [(64, 40), (10, 7), (8, 500)])
def test_clusters_equal_whole_distances(spark, monkeypatch, dims, k):
    monkeypatch.setattr(centroids, "ROWS", 50)
    rows = odd_vectors(200, dims) + [(900, [1.0] * (dims + 1)), (901, [])]
    got = centroids.cluster(table(spark, rows), k=k, dims=dims)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(rows, k, 5, dims)


def test_clusters_of_wide_values(spark):
    rows = [(i, [float((i * 37 % 11) * 10**6), float(i)]) for i in range(30)]
    assert sorted(map(tuple, centroids.cluster(table(spark, rows, "double"), k=4, dims=2).collect()), key=str) == plain_clusters(rows, 4, 5, 2)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.booleans())
def test_partial_distances_find_the_nearest(seed, wide):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-3, 4, (40, 20)), rng.integers(-3, 4, (12, 20))
    if wide:
        x, c = x.astype(object) * 10**12, c.astype(object) * 10**12
    best, least = centroids.nearest(x, c, rng.permutation(20))
    want = [min((int(sum((a - b) ** 2 for a, b in zip(v, m, strict=True))), j) for j, m in enumerate(c.tolist())) for v in x.tolist()]
    assert [(int(d), int(j)) for d, j in zip(least, best, strict=True)] == want
