import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.functions import bands as B
from bandloom.functions import indices as I
from bandloom.operators import order
from bandloom.operators import pixels as P
from bandloom.operators.grid import GRID

WL = tuple(400.0 + 8.0 * k for k in range(64))
RAW = B.identity(WL)
CLIP = B.clip([[0, 420], [760, 776], [813, 827], [880, 1000]])


@pytest.mark.parametrize("make", [B.savgol(11, 2), B.savgol(5, 2), B.resample(20), B.mimic("sentinel-2a")])
def test_constant_spectrum_stays_constant(make):
    for start in (RAW, RAW.then(CLIP)):
        assert np.allclose(start.then(make).weights @ np.ones(64), 1.0)


def test_savgol_keeps_polynomials_of_its_order():
    k = np.arange(64.0)
    for y in (k, k * k):
        assert np.allclose(B.savgol(11, 2)(WL).weights @ y, y)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_derivatives_of_polynomials_are_exact(order):
    wl = np.array(RAW.then(CLIP).wavelengths)
    w = B.derivative(order)(wl).weights
    powers = [wl**p for p in range(order + 2)]
    for p, y in enumerate(powers[: order + 1]):
        want = 0.0 if p < order else float(np.prod(np.arange(1, order + 1)))
        assert np.allclose(w @ y, want, atol=1e-6)
    if order == 2:
        assert np.allclose(B.derivative(1)(wl).weights @ (wl**2), 2 * wl)


def test_clip_drops_closed_ranges():
    kept = RAW.then(CLIP).wavelengths
    assert 408.0 not in kept and 424.0 in kept and 776.0 not in kept and 784.0 in kept and 880.0 not in kept


def test_unrolled_and_matrix_forms_agree(spark):
    rng = np.random.default_rng(1)
    x = rng.random((40, 64))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id int, refl array<double>").repartition(3)
    table = RAW.then(CLIP).then(B.savgol(11, 2)).then(B.resample(20))
    for limit in (0, 10**6):
        got = {r.id: r.refl for r in B.apply_table(df, table, max_terms=limit).collect()}
        assert np.allclose([got[i] for i in range(40)], x @ table.weights.T)


def test_target_wavelength_forms():
    assert [B.target_wavelength(w) for w in (800, 670.9, [550], [545, 565])] == [800, 670, 550, 555]
    assert B.target_wavelength([[800], [700]], 1) == 700
    assert B.nearest(WL, 670) == 34 and B.nearest(WL, 404) == 0


def _pixels(spark, n=300, images=4, seed=0):
    rng = np.random.default_rng(seed)
    base = 0.3 + 0.2 * np.sin(np.linspace(0, 3, 64))
    x = np.clip(base + rng.normal(0, 0.05, (n, 64)), 0.01, 0.99)
    image = np.where(rng.random(n) < 0.5, 0, rng.integers(0, images, n))
    return x, image, spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(image, x)], "image_id bigint, refl array<double>").repartition(5)


def _mcari2(r800, r670, r550):
    return 1.5 * (2.5 * (r800 - r670) - 1.3 * (r800 - r550)) / np.sqrt((2 * r800 + 1) ** 2 - (6 * r800 - 5 * np.sqrt(r670)) - 0.5)


@pytest.mark.parametrize("idx", [0, 27 + 9 + 3, 54 + 27 + 18 + 1, 108 + 7, 108 + 27 + 8, 54 + 9 + 6])
def test_scenario_spectra_equals_step_by_step(spark, idx):
    """The shared pass gives what clip, smooth, bin, mask and mean give pixel by pixel."""
    x, image, df = _pixels(spark)
    level = GRID.level(idx)
    table = P.prefix_table(level, WL)
    t, wl = x @ table.weights.T, np.array(table.wavelengths)
    near = lambda w: t[:, B.nearest(wl, w)]

    def band_mean(lo, hi):
        inside = (wl >= lo) & (wl <= hi)
        return t[:, inside].mean(axis=1) if inside.any() else near((lo + hi) / 2)

    ndi = (band_mean(770, 800) - band_mean(650, 680)) / (band_mean(770, 800) + band_mean(650, 680))
    value = {"ndi": ndi, "mcari2": _mcari2(near(800), near(670), near(550)), (545, 565): band_mean(545, 565)}
    got = P.scenario_spectra(df, ["image_id"], GRID, [idx], WL).collect()
    for im in np.unique(image):
        at = image == im
        keep = np.ones(at.sum(), bool)
        for method, pctl, side in P._steps(level["segment"]) if level["segment"] else []:
            v = value[method][at]
            lim = np.percentile(v, pctl)
            keep &= v > lim[0] if side == "lower" else v <= lim[0] if side == "upper" else (v > lim[0]) & (v <= lim[1])
        mean = t[at][keep].mean(axis=0)
        rows = {r.feat: r for r in got if r.image_id == im}
        assert rows["reflectance"].n_pixels == keep.sum()
        assert np.allclose(rows["reflectance"].refl, mean)
        for o in (1, 2, 3):
            assert np.allclose(rows[f"derivative_{o}"].refl, B.derivative(o)(wl).weights @ mean)


def test_many_scenarios_do_not_depend_on_partitioning(spark):
    _, _, df = _pixels(spark)
    run = lambda d: {
        (r.grid_idx, r.image_id, r.feat): (r.n_pixels, r.refl) for r in P.scenario_spectra(d, ["image_id"], GRID, list(range(0, 162, 5)), WL, (1,)).collect()
    }
    a, b = run(df.coalesce(1)), run(df.repartition(8))
    assert a.keys() == b.keys()
    assert all(a[k][0] == b[k][0] and np.allclose(a[k][1], b[k][1]) for k in a)


def test_large_images_give_the_same_spectra(spark, monkeypatch):
    """Thresholds located by counting equal the built-in ones, also for an image without index values."""
    _, _, df = _pixels(spark)
    dark = spark.createDataFrame([(9, [0.0] * 64)], "image_id bigint, refl array<double>")
    df = df.unionByName(dark)
    scenarios = [0, 1, 2, 54 + 1, 54 + 8]
    run = lambda: {(r.grid_idx, r.image_id): (r.n_pixels, r.refl) for r in P.scenario_spectra(df, ["image_id"], GRID, scenarios, WL, ()).collect()}
    a = run()
    monkeypatch.setattr(order, "SMALL_GROUP_ROWS", 0)
    b = run()
    assert a.keys() == b.keys() and (0, 9) in a and (1, 9) not in a
    assert all(a[k][0] == b[k][0] and np.allclose(a[k][1], b[k][1]) for k in a)


def test_mask_sides_are_complements(spark):
    _, _, df = _pixels(spark)
    df = df.withColumn("mcari2", I.mcari2(RAW)).withColumn("id", F.monotonically_increasing_id())
    ids = lambda side: {r.id for r in P.mask(df, ["image_id"], [P.Mask("mcari2", (50,), side)]).select("id").collect()}
    low, up = ids("lower"), ids("upper")
    assert not low & up and len(low | up) == df.count()
