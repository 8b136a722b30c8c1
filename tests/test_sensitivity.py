import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bandloom.operators import chains as C
from bandloom.operators import sensitivity as Z
from bandloom.operators.grid import Grid

GRID = Grid({"a": [0, 1], "b": [0, 1], "c": [0, 1, 2]})


@pytest.fixture(scope="module")
def cells(spark):
    """y = 3 a + b * c: indices follow by hand."""
    pdf = pd.DataFrame({"grid_idx": range(12)})
    pdf["value"] = [3.0 * (i // 6) + (i // 3 % 2) * (i % 3) for i in range(12)]
    pdf["m"] = "x"
    return spark.createDataFrame(pdf)


def test_factorial_indices(cells):
    got = {r.step: (r.s1, r.st) for r in Z.variance_indices(cells, GRID, ["m"]).collect()}
    a, inter = 9 / 4, 0.25 * (2 / 3)  # Var(3a); Var of the b x c interaction
    b, c = 0.25, 0.25 * (2 / 3)
    total = a + b + c + inter
    want = {"a": (a, a), "b": (b, b + inter), "c": (c, c + inter)}
    for k, (s1, st) in want.items():
        assert np.allclose(got[k], (s1 / total, st / total))
    assert sum(v[0] for v in got.values()) <= 1 <= sum(v[1] for v in got.values())


def test_sampled_indices_approach_the_exact_ones(cells):
    grid = Grid({"a": [0, 1], "b": [0, 1], "c": [0, 1]})
    df = cells.filter("grid_idx < 8").withColumn("value", 3.0 * F.floor(F.col("grid_idx") / 4) + F.col("grid_idx") % 2)
    got = {r.step: r.st for r in Z.sampled_indices(df, grid, ["m"], n=4000).collect()}
    assert abs(got["a"] - 0.9) < 0.05 and abs(got["b"]) < 1e-9 and abs(got["c"] - 0.1) < 0.03


def _fast(y, d, m):
    n = len(y) // d
    out = []
    for i in range(d):
        f = np.fft.fft(y[i * n : (i + 1) * n])
        sp = (np.abs(f[1 : (n + 1) // 2]) / n) ** 2
        w = (n - 1) // (2 * m)
        out.append((sp[[w * h - 1 for h in range(1, m + 1)]].sum() / sp.sum(), 1 - sp[: w // 2].sum() / sp.sum()))
    return out


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_fast_equals_one_transform(spark, block, monkeypatch):
    """Series of very different lengths, in one or many groups."""
    monkeypatch.setattr(Z.spectrum_sums, "__defaults__", (block,))
    rng = np.random.default_rng(1)
    data = {"long": rng.normal(size=1013), "short": rng.normal(size=151) + 5}
    rows = [(c, i + 1, float(v)) for c, y in data.items() for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "chain string, idx bigint, like1 double").repartition(4)
    got = {(r.chain, r.param): (r.s1, r.st) for r in Z.fast_indices(df, ["chain"], ["p", "q"], "like1").collect()}
    for c, y in data.items():
        for name, want in zip("pq", _fast(y, 2, 4)):
            assert np.allclose(got[c, name], want)


def test_morris_effects_of_a_linear_surface(spark, cells):
    df = cells.withColumn("value", 3.0 * F.floor(F.col("grid_idx") / 6) + 2.0 * (F.floor(F.col("grid_idx") / 3) % 2) - (F.col("grid_idx") % 3))
    starts = spark.range(50).select(F.col("id").alias("traj"), (F.col("id") * 5 % 12).alias("grid_idx"))
    effects = Z.elementary_effects(starts, df, GRID, ["m"])
    got = {r.step: r for r in Z.morris(effects, ["m"]).collect()}
    for step, mu in (("a", 3.0), ("b", 2.0), ("c", -1.0)):
        assert np.isclose(got[step].mu, mu) and np.isclose(got[step].mu_star, abs(mu)) and got[step].sigma < 1e-6


def test_bootstrap_interval_covers_the_mean(spark):
    units = spark.range(3000).select(F.col("id").alias("u"), (F.col("id") % 30).alias("g"))
    values = spark.range(30).select(F.col("id").alias("g"), F.lit("s").alias("k"), F.col("id").cast("double").alias("v"))
    r = Z.bootstrap(units, "u", "g", values, ["k"], "v").first()
    half = 1.96 * np.std(np.arange(30)) / np.sqrt(3000)
    assert abs(r["mean"] - 14.5) < half and abs((r.high - r.low) / 2 - half) < 0.35 * half


def test_welch_and_first_below_mean(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 1, 40), rng.normal(0.8, 2, 40)
    df = spark.createDataFrame([("c", i + 1, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "chain string, idx bigint, like1 double, like2 double")
    r = C.welch_t(df, ["chain"], "like1", "like2").first()
    e = a.var(ddof=1) / 40, b.var(ddof=1) / 40
    assert np.isclose(r.t, (a.mean() - b.mean()) / np.sqrt(sum(e)))
    assert 0 < r.p < 0.2
    f = C.first_below_mean(df, ["chain"], "like1", level=0.95).first()
    assert np.isclose(f.upper - f["mean"], 2.022691 * a.std(ddof=1) / np.sqrt(40), rtol=1e-5)
    assert f.first_run == np.flatnonzero(a < f.upper)[0] + 1


def test_autocorrelation_of_an_ar1_chain(spark):
    rng = np.random.default_rng(3)
    x = [0.0]
    for e in rng.normal(size=4000):
        x.append(0.7 * x[-1] + e)
    df = spark.createDataFrame([(0, i + 1, float(v)) for i, v in enumerate(x)], "chain int, idx bigint, x double").repartition(4)
    r = {q.lag: q.r for q in C.autocorrelation(df, ["chain"], "x", [1, 2, 3]).collect()}
    assert all(abs(r[h] - 0.7**h) < 0.06 for h in (1, 2, 3))
