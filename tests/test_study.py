"""A study that is run in parts stores what one run stores."""

import numpy as np
from pyspark.sql import functions as F

from bandloom.operators import study as U
from bandloom.operators import sweep as W
from bandloom.operators.grid import GRID

WL = tuple(400.0 + 8.0 * k for k in range(64))


def test_a_second_run_adds_what_is_missing(spark, tmp_path):
    rng = np.random.default_rng(1)
    level = rng.normal(size=40)
    rows = [(i, p, (0.5 + 0.05 * level[i] * np.sin(np.arange(64) / 9) + 0.01 * rng.normal(size=64)).tolist()) for i in range(40) for p in range(6)]
    px = spark.createDataFrame(rows, "image bigint, p int, refl array<double>").repartition(4).cache()
    truth = [(i, i % 2, "y", float(20 + 3 * level[i] + 0.1 * rng.normal())) for i in range(40)] + [(0, 0, "none", None)]
    ground = spark.createDataFrame(truth, "image bigint, dataset_id bigint, response string, y double")
    plan = W.Plan(keys=U.KEYS, width=64, row_id="image", n_splits=2, n_repeats=1, n_feats=3, path_steps=8, lasso_alphas=(0.001, 0.1), components=(2,))

    def run(folder, within, pixels=px):
        spectra = U.add_spectra(spark, pixels, "image", GRID, WL, [F.lit(True), F.lit(True)], [F.lit(True), F.col("p") < 4], f"{folder}/spectra", (1,), within)
        return U.add_scores(spark, spectra, ground, "image", "dataset_id", f"{folder}/scores", plan)

    key = lambda df: sorted((r.grid_idx, r.response, r.feat, r.model, r.feat_n, tuple(r.feats), round(r.score_test_mae, 9)) for r in df.collect())
    parts, once = str(tmp_path / "parts"), str(tmp_path / "once")
    run(parts, [0])
    second = key(run(parts, [0, 3]))
    assert second == key(run(once, [0, 3]))
    assert {g % 162 for g, *_ in second} == {0, 3} and {g // 162 for g, *_ in second} == {0, 1, 2, 3}
    # Nothing is missing: nothing is added, and nothing comes twice.
    assert key(run(parts, [0, 3])) == second
    spectra = spark.read.parquet(f"{parts}/spectra")
    assert spectra.count() == spectra.select("image", "grid_idx", "feat").distinct().count()
    assert min(r[-1] for r in second) < 1.0
