"""Operators on many keys, large groups, long traces and many blocks: same results as the plain definition."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bandloom.functions import bands as B
from bandloom.functions import solvers as S
from bandloom.operators import chains, gram, impute, order, pixels, scores
from bandloom.operators.grid import GRID


def test_gram_of_many_interleaved_keys_needs_little_memory(spark):
    """240 bands, 14 splits, 1,000 keys in every batch: one key's sums at a time."""
    width, splits, keys = 240, 14, 1_000
    band = F.sequence(F.lit(1), F.lit(width))
    df = spark.range(3 * keys, numPartitions=4).select(
        (F.col("id") % keys).alias("k"), F.transform(band, lambda i: F.cos(F.col("id") * i)).alias("x"),
        F.transform(F.sequence(F.lit(1), F.lit(splits)), lambda s: (F.floor(F.col("id") / keys) % 3 != s % 4).cast("int")).alias("member"),
        F.array_repeat(F.sin("id"), splits).alias("target"),
    )
    stats = gram.gram_stats(df, ["k"], width)
    two = stats.filter("k IN (3, 999)").collect()
    stats.write.format("noop").mode("overwrite").save()

    def used(batches):
        import resource

        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"mb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024]})

    most = spark.range(64, numPartitions=16).mapInArrow(used, "mb bigint").agg(F.max("mb")).first()[0]
    assert most < 1_000
    assert len(two) == 2 * splits
    for r in two:
        ids = np.array([r.k + i * keys for i in range(3) if i != (r.split + 1) % 4])
        x, z = np.cos(ids[:, None] * np.arange(1, width + 1)), np.sin(ids)
        st = gram.Stats.unpack(np.array(r.stats), width)
        assert st.n == len(ids) and np.allclose(st.xx, x.T @ x) and np.allclose(st.xz, x.T @ z) and np.allclose(st.sx, x.sum(0))


@pytest.mark.parametrize("flush", [10**9, 0])
def test_gram_of_large_and_null_keys(spark, flush, monkeypatch):
    monkeypatch.setattr(gram, "FLUSH_VALUES", flush)
    rng = np.random.default_rng(5)
    n = 30_000
    k = np.where(rng.random(n) < 0.8, "hot", rng.choice(["a", "b", ""], n))
    x, y = rng.normal(size=(n, 3)), rng.normal(size=n)
    rows = pd.DataFrame({"k": [v or None for v in k], "x": x.tolist(), "target": [[v] for v in y], "member": [[1]] * n})
    df = spark.createDataFrame(rows, "k string, x array<double>, target array<double>, member array<int>").repartition(4)
    got = {r.k: gram.Stats.unpack(np.array(r.stats), 3) for r in gram.gram_stats(df, ["k"], 3).collect()}
    assert set(got) == {"hot", "a", "b", None}
    for key, st in got.items():
        at = k == (key or "")
        assert st.n == at.sum() and np.allclose(st.xx, x[at].T @ x[at]) and np.allclose(st.xz, x[at].T @ y[at])


@pytest.mark.parametrize("p,n,noise", [(20, 200, 0.0), (40, 25, 0.0), (30, 300, 1.0)])
def test_every_penalty_is_optimal(p, n, noise):
    rng = np.random.default_rng(p)
    x = rng.normal(size=(n, p))
    if noise:
        x = np.cumsum(x, axis=1)  # neighbours nearly alike, as bands are
    x[:, 3], x[:, 5] = x[:, 4], 0.0  # a copy and a constant
    y = x[:, 1] - x[:, 6] + rng.normal(size=n)
    x, y = x - x.mean(0), y - y.mean()
    cov, cross = x.T @ x, x.T @ y
    alphas = np.array([0.01, 1e-4, 1.0, 0.1, 1e3])
    w, gaps = S.lasso_all(cov, cross, n, alphas)
    assert (gaps < 1e-5).all() and not w[4].any()
    for a, v in zip(alphas, w):
        goal = lambda u: 0.5 * ((y - x @ u) ** 2).mean() + a * np.abs(u).sum()
        assert goal(v) <= goal(S.descent(cov, cross, n, a, np.zeros(p))) + 1e-9
    path = S.lasso_path(cov, cross, n, 8, 50)
    assert max(g for _, _, g in path) < 1e-8 and (np.abs(path[-1][1]) > 1e-5).sum() >= 8 and len(path) == 50


def test_latent_variables_of_many_sets_equal_one_by_one():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(100, 12))
    y = x @ rng.normal(size=12)
    cov, cross = x.T @ x, x.T @ y
    sets = [np.array([0, 3, 5]), np.arange(12), np.array([2, 4])]
    many = S.pls1_batch(*S.subsets(cov, cross, sets), 5)
    for i, f in enumerate(sets):
        assert np.allclose(many[:, i, : len(f)], S.pls1(cov[np.ix_(f, f)], cross[f], 5))
        assert not many[:, i, len(f) :].any()


@pytest.mark.parametrize("small", [10**9, 0])
def test_following_equals_shift(spark, small):
    rng = np.random.default_rng(6)
    n = 2_000
    pdf = pd.DataFrame({"g": np.where(rng.random(n) < 0.6, 0, rng.integers(1, 4, n)), "t": np.round(rng.normal(0, 3, n)), "id": rng.permutation(n)})
    pdf["v"] = rng.random(n)
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.col("id") % 7 != 0, F.col("v"))).repartition(5)
    got = order.following(df, ["g"], ["t", "id"], "v", "next", cells=16, small_group_rows=small).toPandas().sort_values(["g", "t", "id"])
    pdf.loc[pdf.id % 7 == 0, "v"] = np.nan
    want = pdf.sort_values(["g", "t", "id"]).groupby("g")["v"].shift(-1)
    assert np.allclose(got["next"].values.astype(float), want.values, equal_nan=True)


@pytest.mark.parametrize("block", [1, 8, 1 << 16])
def test_autocorrelation_with_gaps_in_any_block(spark, block):
    rng = np.random.default_rng(7)
    rows = [(c, i, float(v)) for c in ("a", "b") for i, v in enumerate(rng.normal(size=80)) if rng.random() < 0.9]
    rows += [("one", 0, 1.0), ("flat", 0, 2.0), ("flat", 3, 2.0)]
    df = spark.createDataFrame([*rows, ("a", 500, None)], "c string, idx bigint, v double").repartition(4)
    got = {(r.c, r.lag): r.r for r in chains.autocorrelation(df, ["c"], "v", [1, 3, 10], block=block).collect()}
    for c in ("a", "b", "one", "flat"):
        x = {i: v for k, i, v in rows if k == c}
        m, s = np.mean(list(x.values())), np.var(list(x.values())) * len(x)
        for h in (1, 3, 10):
            pairs = [(x[i] - m) * (x[i + h] - m) for i in x if i + h in x]
            if not pairs:
                assert (c, h) not in got
            elif s:
                assert np.isclose(got[c, h], sum(pairs) / s)
            else:
                assert got[c, h] is None


def test_density_equals_the_plain_sum(spark):
    rng = np.random.default_rng(8)
    v, points = np.round(rng.normal(0, 2, 500), 1), [-2.0, 0.0, 1.5]
    df = spark.createDataFrame([(int(i % 3), float(x)) for i, x in enumerate(v)] + [(0, None), (9, 1.0)], "g int, v double").repartition(6)
    got = {(r.g, r.point): r.density for r in scores.density(df, ["g"], "v", points).collect()}
    for g in range(3):
        x = v[np.arange(500) % 3 == g]
        h = x.std(ddof=1) * len(x) ** -0.2
        for p in points:
            assert np.isclose(got[g, p], np.exp(-0.5 * ((p - x) / h) ** 2).sum() / (len(x) * h * np.sqrt(2 * np.pi)))
    assert got[9, 0.0] is None
    assert scores.density(df, [], "v", points).count() == 3


@pytest.mark.parametrize("limit,tile_rows", [(order.BROADCAST_ROWS, 10**6), (0, 3)])
def test_crop_meets_only_the_plots_of_the_image(spark, limit, tile_rows, monkeypatch):
    monkeypatch.setattr(order.broadcast_if_small, "__defaults__", (limit,))
    monkeypatch.setattr(pixels, "TILE_ROWS", tile_rows)
    px = spark.createDataFrame([(m, float(x), float(y)) for m in ("p", "q") for x in range(20) for y in range(20)], "image string, x double, y double")
    ring = {"p": ([0.0, 12.0, 12.0, 6.0, 0.0], [0.0, 0.0, 12.0, 4.0, 12.0]), "q": ([5.5, 18.5, 10.0], [1.5, 3.5, 17.5])}
    plots = spark.createDataFrame([(m, 1, *r) for m, r in ring.items()], "image string, plot int, xs array<double>, ys array<double>")
    for buffer in (0.0, 1.2):
        got = {(r.image, r.x, r.y) for r in pixels.crop_to_plots(px, plots, ["image"], buffer=buffer).collect()}
        want = set()
        for m, (xs, ys) in ring.items():
            edges = [((xs[i], ys[i]), (xs[(i + 1) % len(xs)], ys[(i + 1) % len(xs)])) for i in range(len(xs))]
            for x in range(20):
                for y in range(20):
                    odd = sum((b[1] > y) != (a[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in edges) % 2
                    near = []
                    for a, b in edges:
                        d = np.subtract(b, a)
                        t = np.clip(np.dot(np.subtract((x, y), a), d) / np.dot(d, d), 0, 1)
                        near.append(np.hypot(*(np.subtract((x, y), a) - t * d)))
                    if odd and (not buffer or min(near) >= buffer):
                        want.add((m, float(x), float(y)))
        assert got == want and want


def test_neighbours_are_found_through_levels_of_boxes(spark, monkeypatch):
    monkeypatch.setattr(impute, "TOP_BOXES", 2)
    monkeypatch.setattr(impute, "FAN", 3)
    rng = np.random.default_rng(2)
    n, p = 300, 4
    x = rng.normal(0, 3, (n, 1)) + rng.normal(0, 0.5, (n, p))
    x[rng.random((n, p)) < 0.1] = np.nan
    x[:, 0] = np.where(np.isnan(x[:, 0]), 1.0, x[:, 0])
    df = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id bigint, x array<double>").repartition(4)
    deep = {r.id: r.x for r in impute.impute_knn(df, p, "id", block_rows=12, visit_rows=50).collect()}
    monkeypatch.undo()
    flat = {r.id: r.x for r in impute.impute_knn(df, p, "id").collect()}
    assert deep.keys() == flat.keys() and all(np.allclose(deep[i], flat[i]) for i in deep)


def test_a_row_is_sent_once_to_neighbouring_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    n, p = 320, 6
    x = rng.normal(size=(n, p))
    x[:, 5] += 3 * np.arange(n) / n
    x[rng.random((n, p)) < 0.06] = np.nan
    x[np.nansum(x, axis=1) < 1, 4] = np.nan  # many blocks without a single donor
    x[:, 0] = np.where(np.isnan(x[:, 0]), 1.0, x[:, 0])
    df = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id bigint, x array<double>").repartition(4)
    sent, dealt = [], impute._dealt
    monkeypatch.setattr(impute, "_dealt", lambda guests, *rest: sent.append(guests.count()) or dealt(guests, *rest))
    many = {r.id: r.x for r in impute.impute_knn(df, p, "id", block_rows=10, visit_rows=50).collect()}
    # 32 blocks lie in two tiles, so that a row travels twice at most.
    assert 0 < sum(sent) <= 2 * n
    one = {r.id: r.x for r in impute.impute_knn(df, p, "id").collect()}
    assert many.keys() == one.keys() and all(np.allclose(many[i], one[i]) for i in one)


@pytest.mark.parametrize("small", [10**9, 0])
def test_percentiles_and_moments_in_one_pass(spark, small):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=400), 2)
    df = spark.createDataFrame([(int(i % 2), float(x)) for i, x in enumerate(v)], "g int, v double")
    for r in order.exact_percentiles(df, ["g"], ["v"], [0.25, 0.9], small_group_rows=small, extra=order.summary("v")).collect():
        x = v[np.arange(400) % 2 == r.g]
        assert r.n == len(x) and np.isclose(r["std"], x.std(ddof=1)) and np.allclose(r.v_pctl, np.quantile(x, [0.25, 0.9])) and r["max"] == x.max()


def test_all_scenarios_go_on_from_what_is_stored(spark):
    wl = tuple(400.0 + 8.0 * k for k in range(64))
    rng = np.random.default_rng(4)
    rows = [(i, p, (0.5 + 0.1 * rng.normal(size=64)).tolist()) for i in range(3) for p in range(30)]
    px = spark.createDataFrame(rows, "image int, p int, refl array<double>")
    how = dict(panels=[F.col("image") != 2, F.lit(True)], crops=[F.lit(True), F.col("p") < 20], derivatives=(1,), within=[0, 1, 8, 60, 161])
    every = pixels.all_scenarios(px, ["image"], GRID, wl, **how)
    key = lambda df: {(r.grid_idx, r.image, r.feat): (r.n_pixels, tuple(np.round(r.refl, 9))) for r in df.collect()}
    want = key(every)
    assert {g // 162 for g, _, _ in want} == {0, 1, 2, 3} and not any(i == 2 and g < 324 for g, i, _ in want)
    some = every.filter("image = 0 OR grid_idx % 162 = 8")
    rest = key(pixels.all_scenarios(px, ["image"], GRID, wl, **how, done=some))
    assert rest == {k: v for k, v in want.items() if k not in key(some)}
    assert not key(pixels.all_scenarios(px, ["image"], GRID, wl, **how, done=every))


def test_null_spectra_become_unknown():
    column = pa.array([[1.0, 2.0], None, [3.0, None]])
    assert np.allclose(B.list_matrix(column, 2), [[1, 2], [np.nan, np.nan], [3, np.nan]], equal_nan=True)
