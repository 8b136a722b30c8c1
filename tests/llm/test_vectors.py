"""Centroid clustering and exact top-k search against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.llm import centroids, pivots, vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def whole(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def clusters(rows, plan):
    kept = [(i, whole(v)) for i, v, _ in rows if usable(v) and len(v) == plan.dims]
    at = lambda i: hashlib.sha256(f"{plan.seed}:{i}".encode()).hexdigest()
    first = sorted(kept, key=lambda r: (r[0] is None, at(r[0]), r[1]))
    c = [v for _, v in first[: plan.k]]
    near = lambda v: min(((sum((a - b) ** 2 for a, b in zip(v, m)), k) for k, m in enumerate(c)))
    for _ in range(plan.rounds):
        held = {}
        for _, v in kept:
            held.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(x) for x in zip(*held[k])] if k in held else m for k, m in enumerate(c)]
    return [(i, near(v)[1], min(near(v)[0], 2**63 - 1)) for i, v in kept], c


def best(rows, every, k):
    kept = [(n, i, whole(v)) for n, (i, v, _) in enumerate(rows) if usable(v)]
    out = []
    for n, i, q in kept:
        if i is not None and i % every == 0:
            found = [(-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for m, j, v in kept if m != n and len(v) == len(q)]
            out += [(i, r + 1, None if gone else j, -s) for r, (s, gone, j) in enumerate(sorted(found)[:k])]
    return out


def sort(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def table(n, dims, seed, spread=1.0):
    rnd = random.Random(seed)
    return [(i, [rnd.gauss(0, spread) for _ in range(dims)], 0) for i in range(n)]


ODD = [
    (None, [0.5] * 6, 1), (3, None, 1), (4, [], 1), (5, [1.0] * 5, 1), (6, [float("nan")] * 6, 1), (7, [None] * 6, 1), (8, [float("inf")] * 6, 1),
    (10, [0.25] * 6, 1), (10, [0.25] * 6, 1), (10, [-0.25] * 6, 1), (20, [0.25] * 6, 1), (-10, [0.0] * 6, 1), (30, [1.0] * 5, 1), (40, [2.0] * 5, 1),
]


@pytest.mark.parametrize("plan", [centroids.Plan(dims=6, k=5, rounds=3), centroids.Plan(dims=6, k=5, rounds=3, width=4, rows=7), centroids.Plan(dims=6, k=500, width=1)])
def test_clusters(spark, plan):
    rows = table(150, 6, 1) + ODD + [(i, [0.125] * 6, 2) for i in range(1000, 1060)]
    found, final = centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(5), plan=plan)
    want, c = clusters(rows, plan)
    assert sort(map(tuple, found.collect())) == sort(want)
    assert final == c
    sums = {r.cluster: (r.cluster_inertia, r.inertia) for r in centroids.inertia(found).collect()}
    total = sum(d for _, _, d in want)
    assert sums == {k: (sum(d for _, x, d in want if x == k), total) for k in {x for _, x, _ in want}}


@pytest.mark.parametrize("spread", [1e5, 1e12, 1e36])
def test_clusters_of_large_numbers_are_exact(spark, spread):
    plan = centroids.Plan(dims=3, k=4, rounds=2)
    rows = table(60, 3, 2, spread) + [(100, [0.0, 1.0, -1.0], 0)]
    found, final = centroids.cluster(spark.createDataFrame(rows, SCHEMA), plan=plan)
    want, c = clusters(rows, plan)
    assert sort(map(tuple, found.collect())) == sort(want)
    assert final == c


def test_dictionaries_lose_nothing():
    plan = centroids.Plan(dims=5, width=2)
    q = np.floor(np.random.default_rng(1).normal(0, 3, (200, 5)))
    subs, codes = zip(*(centroids.dictionary(q[:, b]) for b in plan.blocks()))
    assert (np.concatenate([s[c] for s, c in zip(subs, codes)], 1) == q).all()
    assert all(len(np.unique(s, axis=0)) == len(s) for s in subs)


@pytest.mark.parametrize("search", [pivots.Search(), pivots.Search(k=3, pivots=4, cell=8, block=4), pivots.Search(k=2, pivots=3, sample=5, cell=3, block=1, steps=(0.1, 0.4, 1.0))])
def test_top_k(spark, search):
    rows = table(200, 6, 3, 0.4) + ODD + [(i, [0.125] * 6, 2) for i in range(1000, 1100)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = pivots.top_k(df, F.col("vec_id") % 10 == 0, search=search)
    assert sort(map(tuple, found.collect())) == sort(best(rows, 10, search.k))


def test_top_k_of_large_numbers_is_exact(spark):
    rows = table(40, 3, 4, 1e5) + table(5, 3, 5, 1e-3) + [(100, [1e7, 1.0, -1e7], 0)]
    found = pivots.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0)
    assert sort(map(tuple, found.collect())) == sort(best(rows, 5, 5))


def test_far_annuli_are_left_out(spark):
    """Tight groups far apart: a query visits few of the cells."""
    rnd = random.Random(6)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    norm = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    rows = [(i, norm([x + rnd.gauss(0, 0.02) for x in centres[i % 12]]), 0) for i in range(1200)]
    df = spark.createDataFrame(rows, SCHEMA)
    search = pivots.Search(cell=16, block=4, pivots=16)
    asked = []
    real = pivots.visit
    try:
        pivots.visit = lambda pairs, *rest: (asked.append(pairs.count()), real(pairs, *rest))[1]
        found = pivots.top_k(df, F.col("vec_id") % 50 == 0, search=search)
    finally:
        pivots.visit = real
    assert sort(map(tuple, found.collect())) == sort(best(rows, 50, 5))
    assert sum(asked) < 0.5 * (1200 / 16) * (24 / 4)


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert centroids.cluster(empty)[0].count() == 0 and pivots.top_k(empty, F.col("vec_id") % 50 == 0).count() == 0
    rows = table(60, 6, 7)
    clash = ["row", "dims", "q", "pivot", "d", "cell", "block", "score", "rank", "cluster", "distance", "vector", "norm2", "query_id"]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'x' AS {c}" for c in clash])
    plan = centroids.Plan(dims=6, k=5)
    assert sort(map(tuple, centroids.cluster(df, plan=plan)[0].collect())) == sort(clusters(rows, plan)[0])
    assert sort(map(tuple, pivots.top_k(df, F.col("vec_id") % 10 == 0).collect())) == sort(best(rows, 10, 5))


def test_packing_keeps_values():
    for values in ([], [1, -2, 300], [2**15, 1], [2.0**60, -(2.0**80)]):
        q = np.array(values, float)
        assert (vectors.unpacked(vectors.packed(q), 1, len(values))[0] == q).all()
