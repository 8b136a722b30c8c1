import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.operators import forest as T


def data(n=240, p=5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, p)).astype(float)
    y = 3.0 * (x[:, 1] > 5) + x[:, 3] + rng.normal(0, 0.1, n)
    return x, y, rng.integers(0, 2, n)


def frame(spark, x, y, fold, parts=3):
    rows = [(i, a.tolist(), float(b), int(f)) for i, (a, b, f) in enumerate(zip(x, y, fold))]
    return spark.createDataFrame(rows, "id bigint, x array<double>, y double, fold_0 int").repartition(parts)


def tree(x, y, depth):
    """Greedy splits at the observed values, as nested tuples."""
    best = (0.0, None)
    for f in range(x.shape[1]):
        for c in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= c
            gain = y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum() - y.sum() ** 2 / len(y)
            if gain > best[0] * (1 + 1e-9) + 1e-9:
                best = (gain, f, c)
    if depth == 0 or len(y) < 2 or best[1] is None:
        return (len(y), y.mean())
    left = x[:, best[1]] <= best[2]
    return (len(y), y.mean(), best[1], best[2], tree(x[left], y[left], depth - 1), tree(x[~left], y[~left], depth - 1))


def predict(t, row, least):
    while len(t) > 2 and t[0] >= least:
        t = t[4] if row[t[2]] <= t[3] else t[5]
    return t[1]


@pytest.mark.parametrize("parts", [1, 6])
def test_one_tree_equals_greedy_splits(spark, parts):
    x, y, fold = data()
    plan = T.Forest(width=5, shares=(1.0,), min_split=(2, 30), trees=1, depth=3, bins=32, n_splits=2, n_repeats=1, bootstrap=False)
    got = {(r.cand, r.fold): r for r in T.forest_sweep(frame(spark, x, y, fold, parts), plan, "id").collect()}
    assert len(got) == 4
    for f in (0, 1):
        t = tree(x[fold != f], y[fold != f], 3)
        for cand, least in enumerate((2, 30)):
            err = np.array([predict(t, row, least) for row in x[fold == f]]) - y[fold == f]
            r = got[cand, f]
            assert r.n == (fold == f).sum() and np.isclose(r.mae, np.abs(err).mean()) and np.isclose(r.rmse, np.sqrt((err**2).mean()))


def test_forests_learn_and_do_not_depend_on_partitions(spark):
    x, y, fold = data(400, 8, 3)
    plan = T.Forest(width=8, shares=(0.4, 0.9), min_split=(2, 10), trees=12, depth=6, n_splits=2, n_repeats=1)
    one = {(r.cand, r.fold): (r.mae, r.r2) for r in T.forest_sweep(frame(spark, x, y, fold, 1), plan, "id").collect()}
    many = {(r.cand, r.fold): (r.mae, r.r2) for r in T.forest_sweep(frame(spark, x, y, fold, 9), plan, "id").collect()}
    assert one.keys() == many.keys() and all(np.allclose(one[k], many[k]) for k in one)
    assert min(r2 for _, r2 in one.values()) > 0.85


def test_rows_are_drawn_once_on_average():
    plan = T.Forest(width=3)
    w = plan.weights(np.arange(20_000, dtype=np.int64) * 7919, 5)
    assert abs(w.mean() - 1) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.02
    assert (w != plan.weights(np.arange(20_000, dtype=np.int64) * 7919, 6)).mean() > 0.4


def test_missing_responses_and_one_valued_features(spark):
    x, y, fold = data(80, 4, 2)
    x[:, 0] = 1.0
    df = frame(spark, x, y, fold).withColumn("y", F.when(F.col("id") % 9 != 0, F.col("y")))
    plan = T.Forest(width=4, shares=(0.5,), min_split=(2,), trees=3, depth=3, n_splits=2, n_repeats=1)
    got = T.forest_sweep(df, plan, "id").collect()
    assert sum(r.n for r in got) == 80 - len(range(0, 80, 9))


def test_trees_are_dealt_evenly_and_send_a_histogram_per_node(spark, monkeypatch):
    x, y, fold = data(300, 4, 1)
    plan = T.Forest(width=4, shares=(0.5,), min_split=(2,), trees=20, depth=2, n_splits=2, n_repeats=1)
    dealt, sent, histograms = [], [], T._histograms

    def watched(rows, *rest):
        dealt.append(rows.groupBy(F.spark_partition_id().alias("p"), "group").count().collect())
        sent.append(histograms(rows, *rest).groupBy("tree", "node").count().collect())
        return histograms(rows, *rest)

    monkeypatch.setattr(T, "_histograms", watched)
    T.grow(T.binned(frame(spark, x, y, fold, 1), plan, "id"), plan)
    groups = {r.group for r in dealt[0]}
    # Every group of trees is a task of its own with all rows, and sends one histogram per node.
    assert len(groups) > 1 and len({r.p for r in dealt[0]}) == len(dealt[0]) == len(groups) and all(r["count"] == 300 for r in dealt[0])
    assert len(sent[0]) == plan.size and all(r["count"] == 1 for level in sent for r in level)
