import dataclasses

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from bandloom.functions import solvers as S
from bandloom.functions import target as Y
from bandloom.operators import gram as M
from bandloom.operators import scores as R
from bandloom.operators import sweep as W

PLAN = W.Plan(keys=("k",), width=8, row_id="id", n_splits=3, n_repeats=2, n_feats=6, path_steps=12, lasso_alphas=(0.001, 0.1, 1.0), components=(2, 3))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 240
    x = rng.normal(size=(n, 8)) @ (np.eye(8) + 0.3 * rng.normal(size=(8, 8)))
    y = 30 + 3 * x[:, 1] - 2 * x[:, 4] + rng.normal(0, 1, n)
    folds = rng.integers(0, 3, (n, 2))
    rows = [("a" if i % 3 else "b", i, x[i].tolist(), float(y[i]), int(folds[i, 0]), int(folds[i, 1])) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, id bigint, x array<double>, y double, fold_0 bigint, fold_1 bigint").repartition(5).cache()
    return x, y, folds, np.array([r[0] for r in rows]), df


def _stats(df, width=8):
    rows = df.withColumns({"member": F.array(F.lit(1)), "target": F.array("y")})
    return {r.k: M.Stats.unpack(np.array(r.stats), width) for r in M.gram_stats(rows, ["k"], width).collect()}


def test_gram_equals_numpy_for_every_split(data):
    x, y, folds, k, df = data
    rows = W.members(df, PLAN).withColumn("target", F.array_repeat("y", 7))
    for r in M.gram_stats(rows, ["k"], 8).collect():
        st = M.Stats.unpack(np.array(r.stats), 8)
        at = k == r.k
        if r.split:
            rep, f = divmod(r.split - 1, 3)
            at &= folds[:, rep] != f
        assert st.n == at.sum()
        assert np.allclose(st.xx, x[at].T @ x[at]) and np.allclose(st.xz, x[at].T @ y[at]) and np.isclose(st.szz, (y[at] ** 2).sum())


def test_lasso_from_sums_equals_mllib(data, spark):
    x, y, _, k, df = data
    st = _stats(df)["a"]
    cov, cross, mx, mz = st.centred()
    w = S.lasso(cov, cross, st.n, 0.2)
    lib = LinearRegression(elasticNetParam=1.0, regParam=0.2, standardization=False, tol=1e-12, maxIter=2000, labelCol="y", featuresCol="f")
    model = lib.fit(df.filter("k = 'a'").withColumn("f", array_to_vector("x")))
    assert np.allclose(w, model.coefficients.toArray(), atol=1e-5)
    grad = (cross - cov @ w) / st.n
    assert np.all(np.abs(grad) <= 0.2 + 1e-8)
    assert np.allclose(grad[w != 0], 0.2 * np.sign(w[w != 0]), atol=1e-8)


def test_pls_with_all_components_is_least_squares(data):
    x, y, _, k, df = data
    cov, cross, _, _ = _stats(df)["b"].centred()
    assert np.allclose(S.pls1(cov, cross, 8)[-1], np.linalg.solve(cov, cross))


@pytest.mark.parametrize("lam", [-1.0, 0.0, 0.5, 2.0, 3.0])
def test_transform_and_inverse(spark, lam):
    v = np.linspace(-3, 5, 33)
    df = spark.createDataFrame([(float(a),) for a in v], "v double").select("v", Y.forward(F.col("v"), F.lit(lam)).alias("z"))
    rows = df.withColumn("back", Y.inverse(F.col("z"), F.lit(lam))).collect()
    assert np.allclose([r.z for r in rows], Y.forward_np(v, lam))
    assert np.allclose([r.back for r in rows], v) and np.allclose(Y.inverse_np(Y.forward_np(v, lam), lam), v)


def test_transform_has_no_inverse_outside_its_range():
    assert np.isnan(Y.inverse_np(np.array([2.5]), -0.5)[0])


def _loglik(y, lam):
    z = Y.forward_np(y, lam)
    return -len(y) / 2 * np.log(z.var()) + (lam - 1) * (np.sign(y) * np.log1p(np.abs(y))).sum()


@pytest.mark.parametrize("scale", [1.0, 300.0])
def test_lambda_maximises_the_likelihood(data, scale):
    x, y, folds, k, df = data
    rows = W.members(df.withColumn("y", F.exp(F.col("y") / 10) * scale), PLAN)
    for r in M.ml_lambda(rows, ["k"]).collect():
        for s in (0, 2):
            at = k == r.k
            if s:
                at &= folds[:, 0] != s - 1
            v = np.exp(y[at] / 10) * scale
            # Wider grids lose the spread to rounding in this direct formula.
            grid = np.linspace(-2, 3, 2001)
            best = grid[np.argmax([_loglik(v, g) for g in grid])]
            assert abs(r.lambdas[s] - best) < 3e-3


def test_candidate_scores_equal_direct_fits(data):
    x, y, folds, k, df = data
    lambdas, stats = W.prepare(df, PLAN)
    sets = W.distinct_sets(W.alpha_path(stats, PLAN), PLAN).filter("feat_n >= 3")
    models = W.fit_candidates(stats, lambdas, sets, PLAN)
    small = dataclasses.replace(PLAN, chunk_rows=17)
    one = {(r.k, r.split, r.alpha, r.model, r.cand): r for r in W.cv_scores(df, models, PLAN).collect()}
    many = {(r.k, r.split, r.alpha, r.model, r.cand): r for r in W.cv_scores(df, models, small).collect()}
    assert one.keys() == many.keys() and all(np.isclose(one[q].mae, many[q].mae) for q in one)
    lam = {r.k: r.lambdas for r in lambdas.collect()}
    feats = {(r.k, r.alpha): r.feats for r in sets.collect()}
    checked = 0
    for (key, split, alpha, model, cand), r in one.items():
        if split != 4 or model != "pls" or cand != 1:
            continue
        f = feats[key, alpha]
        tr = (k == key) & (folds[:, 1] != 0)
        va = (k == key) & (folds[:, 1] == 0)
        z = Y.forward_np(y[tr], lam[key][split])
        xc = x[tr][:, f] - x[tr][:, f].mean(0)
        coef = S.pls1(xc.T @ xc, xc.T @ (z - z.mean()), 2)[-1]
        pred = Y.inverse_np((x[va][:, f] - x[tr][:, f].mean(0)) @ coef + z.mean(), lam[key][split])
        assert np.isclose(r.mae, np.abs(pred - y[va]).mean())
        assert np.isclose(r.r2, 1 - ((pred - y[va]) ** 2).sum() / ((y[va] - y[va].mean()) ** 2).sum())
        checked += 1
    assert checked


def test_sweep_end_to_end(data):
    x, y, _, k, df = data
    run = W.tune(df, PLAN)
    tuning = run["tuning"].toPandas()
    assert set(tuning.model) == {"lasso", "pls"}
    # Sets too small for latent variables stay as empty rows.
    assert tuning[(tuning.model == "pls") & (tuning.feat_n < 2)].cand.isna().all()
    pls = tuning[tuning.n_components.notna()]
    assert (pls.n_components <= pls.feat_n).all()
    best = W.best_by_count(run["tuning"], PLAN)
    assert best.groupBy("k", "model", "feat_n").count().filter("count > 1").isEmpty()
    models = W.final_models(run["stats"], run["lambdas"], best, PLAN)
    preds = W.predict(df, models, PLAN, [])
    n_models = models.groupBy("k").count().collect()
    sizes = {r.k: r["count"] for r in df.groupBy("k").count().collect()}
    assert preds.count() == sum(sizes[r.k] * r["count"] for r in n_models)
    top = R.error_metrics(preds, ["k", "model"]).toPandas()
    assert (top.r2 > 0.7).all()
    used = models.filter("model = 'lasso'").toPandas()
    assert all(set(u) <= set(f) for u, f in zip(used.feats_used, used.feats))


def test_scoring_holds_a_bounded_number_of_predictions(spark, monkeypatch):
    back, most = W.inverse_np, 1 << 19

    def checked(z, lam):
        assert np.size(z) <= most
        return back(z, lam)

    monkeypatch.setattr(W, "inverse_np", checked)
    plan = W.Plan(keys=("k",), width=2, row_id="id", n_splits=2, n_repeats=1)
    rows = spark.range(5000).selectExpr("'a' AS k", "id", "array(id % 7D, id % 5D) AS x", "id % 11D AS y", "id % 2 AS fold_0")
    models = spark.range(256).selectExpr(
        "'a' AS k", "1L AS split", "1D AS alpha", "'lasso' AS model", "id AS cand", "1D AS lam", "id / 8D AS intercept", "array(0) AS feats", "array(0.5D) AS coef"
    )
    got = {(r.cand, r.role): r for r in W.score_candidates(rows, models, plan).collect()}
    i = np.arange(5000)
    for cand in (0, 200):
        for role, at in (("val", i % 2 == 0), ("train", i % 2 == 1)):
            e = (cand / 8 + 0.5 * (i % 7) - i % 11)[at]
            assert got[cand, role].n == 2500 and np.isclose(got[cand, role].mae, np.abs(e).mean()) and np.isclose(got[cand, role].mse, (e * e).mean())
