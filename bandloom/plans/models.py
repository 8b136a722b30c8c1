"""Queries over the model sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions import target as Y
from ..operators import design as D
from ..operators import forest as T
from ..operators import gram as M
from ..operators import grid as G
from ..operators import scores as R
from ..operators import selection as L
from ..operators import study as U
from ..operators import sweep as W
from ..session import checkpointed
from ..sources import sinks
from . import views as V
from .design import SEED, _FOLDS, _OBS, observations
from .registry import query
from .results import rounded
from .spectral import crops, panels

r6 = V.r6
#: The whole study: 30 features, 300 penalties, every response with every feature set as keys of the same jobs.
KEYS = ("response", "feat")
PLAN = W.Plan(keys=KEYS, width=64, row_id="plot_id")
FEATS = ("reflectance", "derivative_1", "derivative_2")


def responses(obs):
    """One row per observation and response: biomass, tissue share and uptake."""
    tissue = 3 + 2 * (F.col("refl")[10] - F.col("refl")[30])
    each = F.array(
        *[F.struct(F.lit(n).alias("response"), v.alias("y")) for n, v in (("biomass", F.col("y")), ("tissue", tissue), ("uptake", F.col("y") * tissue / 100))]
    )
    return obs.withColumn("r", F.explode(each)).drop("y").select("*", "r.response", "r.y").drop("r")


def study(s, d):
    """Observations with split, for three responses and three feature sets."""
    base = D.stratified_split(observations(s, d).select("plot_id", "dataset_id", "y", "refl"), "dataset_id", "plot_id", seed=SEED)
    wl = B.identity(V.WL)
    tables = {0: wl, 1: wl.then(B.derivative(1)), 2: wl.then(B.derivative(2))}
    # The tissue share is worked out on plain spectra, before they are replaced by derivatives.
    every = B.apply_tables(responses(base), tables, "ord").withColumnRenamed("refl", "x")
    return every.withColumn("feat", F.element_at(F.array(*[F.lit(f) for f in FEATS]), (F.col("ord") + 1).cast("int"))).drop("ord")


def training(s, d):
    """Training rows with folds, stored once: the sweep reads them several times."""
    train = study(s, d).filter(~F.col("is_test"))
    ids = train.filter("feat = 'reflectance' AND response = 'biomass'").select("plot_id", "dataset_id")
    folds = D.repeated_kfold(ids, "dataset_id", "plot_id", seed=SEED).drop("dataset_id")
    return checkpointed(train.join(folds, "plot_id"))


@query(
    "gram_stats",
    V.sql(
        """SELECT CAST(repeat * 4 + fold AS BIGINT) AS split, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(value, 4) + 0.0 AS value FROM (
          SELECT repeat, fold, -1 AS i, -1 AS j, CAST(count(DISTINCT plot_id) AS DOUBLE) AS value FROM t GROUP BY repeat, fold
          UNION ALL SELECT repeat, fold, -2, band, sum(r) FROM t GROUP BY repeat, fold, band
          UNION ALL SELECT repeat, fold, band, -1, sum(r * y) FROM t GROUP BY repeat, fold, band
          UNION ALL SELECT a.repeat, a.fold, a.band, b.band, sum(a.r * b.r) FROM t a JOIN t b
            ON a.repeat = b.repeat AND a.fold = b.fold AND a.plot_id = b.plot_id AND a.band <= b.band GROUP BY a.repeat, a.fold, a.band, b.band)""",
        "ground", "spectra", obs=_OBS, f=_FOLDS,
        t="""SELECT s.repeat, s.fold, o.plot_id, o.y, unnest(o.refl) AS r, unnest(range(64)) AS band FROM (SELECT DISTINCT repeat, fold FROM f) s
          JOIN f ON f.repeat = s.repeat AND f.fold <> s.fold JOIN obs o USING (plot_id)""",
    ),
)
def gram_stats(s, d):
    """Training sums of every fold, all 64 bands."""
    obs = observations(s, d).select("plot_id", "dataset_id", "y", F.col("refl").alias("x"))
    rows = D.repeated_kfold(obs, "dataset_id", "plot_id", seed=SEED).withColumn("all", F.lit(0))
    flags = F.array(*[(F.col(f"fold_{r}") != f).cast("int") for r in range(3) for f in range(4)])
    rows = rows.withColumns({"member": flags, "target": F.array_repeat("y", 12)})
    out = M.unpack_rows(M.gram_stats(rows, ["all"], 64), ["all"], 64).drop("all")
    return out.withColumn("value", F.round("value", 4) + F.lit(0.0))


def wide_features(s, d):
    """Line items as a regression table."""
    flags = [(F.col("l_returnflag") == f).cast("double") for f in ("A", "N", "R")] + [(F.col("l_linestatus") == f).cast("double") for f in ("F", "O")]
    x = F.array("l_quantity", "l_discount", "l_tax", F.col("l_linenumber").cast("double"), *flags)
    return V.table(s, d, "lineitem").select(
        F.lit("price").alias("response"), x.alias("x"), F.array(F.lit(1)).alias("member"), F.array("l_extendedprice").alias("target")
    )


_WIDE = "[l_quantity, l_discount, l_tax, l_linenumber, (l_returnflag = 'A')::INT, (l_returnflag = 'N')::INT, (l_returnflag = 'R')::INT, (l_linestatus = 'F')::INT, (l_linestatus = 'O')::INT]"


@query(
    "gram_stats_wide",
    V.sql(
        "SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(value / 1e6, 4) AS value FROM ("
        + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, sum(x[{i + 1}] * x[{j + 1}]) AS value FROM w" for i in range(9) for j in range(i, 9))
        + "".join(f" UNION ALL SELECT {i}, -1, sum(x[{i + 1}] * y) FROM w UNION ALL SELECT -2, {i}, sum(x[{i + 1}]) FROM w" for i in range(9))
        + " UNION ALL SELECT -1, -1, CAST(count(*) AS DOUBLE) FROM w)",
        w=f"SELECT {_WIDE}::DOUBLE[] AS x, l_extendedprice AS y FROM lineitem",
    ),
)
def gram_stats_wide(s, d):
    out = M.unpack_rows(M.gram_stats(wide_features(s, d), ["response"], 9), ["response"], 9)
    return out.select("i", "j", F.round(F.col("value") / 1e6, 4).alias("value"))


@query("lasso_fit")
def lasso_fit(s, d):
    """Penalty path of the line-item price on its attributes."""
    plan = W.Plan(keys=("response",), width=9, row_id="response", n_splits=0, n_repeats=0, n_feats=9)
    stats = M.gram_stats(wide_features(s, d), ["response"], 9).withColumn("split", F.lit(plan.raw_split).cast("bigint"))
    path = W.alpha_path(stats, plan)
    return path.select("alpha", F.posexplode("coef").alias("feature", "weight"))


@query(
    "yeo_johnson",
    V.sql(
        """SELECT plot_id, lam, round(CASE WHEN v >= 0 THEN CASE WHEN lam = 0 THEN ln(1 + v) ELSE (pow(v + 1, lam) - 1) / lam END
        ELSE CASE WHEN lam = 2 THEN -ln(1 - v) ELSE -(pow(1 - v, 2 - lam) - 1) / (2 - lam) END END, 6) + 0.0 AS z, round(v, 6) + 0.0 AS back
        FROM (SELECT plot_id, y - 50 AS v FROM ground WHERE y IS NOT NULL)
        CROSS JOIN (VALUES (CAST(0 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(1.3 AS DOUBLE)), (CAST(2 AS DOUBLE))) l(lam)""",
        "ground",
    ),
)
def yeo_johnson(s, d):
    v = V.ground(s, d).dropna(subset=["y"]).select("plot_id", (F.col("y") - 50).alias("v"), F.explode(F.array(*[F.lit(x) for x in (0.0, 0.5, 1.3, 2.0)])).alias("lam"))
    z = v.withColumn("z", Y.forward(F.col("v"), F.col("lam")))
    return z.select("plot_id", "lam", r6("z").alias("z"), r6(Y.inverse(F.col("z"), F.col("lam"))).alias("back"))


@query("yeo_johnson_lambda")
def yeo_johnson_lambda(s, d):
    """Maximum-likelihood parameter of every response for every fold's training part."""
    rows = W.members(training(s, d), PLAN)
    lam = M.ml_lambda(rows, list(KEYS))
    return lam.select(*KEYS, F.posexplode("lambdas").alias("split", "lam")).withColumn("lam", F.round("lam", 4))


def _text(c):
    return F.array_join(F.col(c).cast("array<string>"), " ").alias(c)


@query("alpha_path")
def alpha_path(s, d):
    """Every penalty with its feature set, the rank of each feature and whether the fit is optimal."""
    _, stats = W.prepare(training(s, d), PLAN)
    sets = L.feature_sets(W.alpha_path(stats, PLAN))
    return sets.select(*KEYS, r6("alpha").alias("alpha"), "feat_n", _text("feats"), _text("feat_ranking"), (F.col("gap") < 1e-8).alias("optimal"))


@query("pls_fit")
def pls_fit(s, d):
    """Validation errors of the latent-variable candidates by component count."""
    return _cv(s, d).filter("model = 'pls'").groupBy(*KEYS, "cand").agg(r6(F.avg("mae")).alias("mae"), r6(F.avg("r2")).alias("r2"))


def _cv(s, d):
    train = training(s, d)
    lambdas, stats = W.prepare(train, PLAN)
    stats = checkpointed(stats)
    sets = W.distinct_sets(W.alpha_path(stats, PLAN), PLAN)
    return W.cv_scores(train, W.fit_candidates(stats, lambdas, sets, PLAN), PLAN)


@query("cv_grid_search")
def cv_grid_search(s, d):
    return _cv(s, d).groupBy(*KEYS, "model", "alpha", "cand").agg(
        F.count(F.lit(1)).alias("n_splits"), *[r6(F.avg(c)).alias(c) for c in ("mae", "mse", "r2", "train_mae", "train_r2")], F.sum("n_bad").alias("n_bad")
    )


@query("tuning_sweep")
def tuning_sweep(s, d):
    t = W.tune(training(s, d), PLAN)["tuning"]
    return t.select(
        *KEYS, "model", r6("alpha").alias("alpha"), "feat_n", _text("feats"), _text("feat_ranking"), "cand", "las_alpha", "n_components", "scale",
        *[r6(f"{f}_{c}").alias(f"{f}_{c}") for c in ("train_mae", "mae", "train_mse", "mse", "train_r2", "r2") for f in ("mean", "std")],
    )


def _fitted(s, d):
    run = W.tune(training(s, d), PLAN)
    best = W.best_by_count(run["tuning"], PLAN)
    return checkpointed(W.final_models(run["stats"], run["lambdas"], best, PLAN))


@query("lasso_used_features")
def lasso_used_features(s, d):
    m = _fitted(s, d).filter("model = 'lasso'")
    return m.select(*KEYS, "feat_n", "las_alpha", F.size("feats_used").alias("feat_n_used"), F.array_join(F.col("feats_used").cast("array<string>"), " ").alias("features_used"))


@query("fit_predict")
def fit_predict(s, d):
    """Training and test scores, side by side, of the best model per feature count."""
    models = _fitted(s, d)
    out = U.score_table(models, W.predict(study(s, d), models, PLAN, ["is_test"]), list(KEYS))
    return rounded(out, *[c for c in out.columns if c.startswith("score_")]).withColumns({c: _text(c) for c in ("feats", "feat_ranking")})


#: Scenarios of a branch: clipped ends and bins of 20 nm with three of the segments (all nine take eight minutes on 500 pixels and 8 cores).
STUDIED = [72, 75, 80]


@query("study_run")
def study_run(s, d):
    """Pixels to stored scores in two runs: the second goes on from what the first has stored."""
    folder = sinks.scratch(s, "study")
    ground = D.dataset_id(V.ground_image(s, d)).select(F.col("plot_id").alias("image_id"), "dataset_id", F.lit("biomass").alias("response"), "y")
    plan = W.Plan(keys=U.KEYS, width=len(V.WL), row_id="image_id")
    for within in (STUDIED[:1], STUDIED):
        spectra = U.add_spectra(s, V.pixels(s, d), "image_id", G.GRID, V.WL, panels(), crops(), f"{folder}/spectra", (1,), within)
        scores = U.add_scores(s, spectra, ground, "image_id", "dataset_id", f"{folder}/scores", plan)
    return rounded(scores, *[c for c in scores.columns if c.startswith("score_")]).withColumns({c: _text(c) for c in ("feats", "feat_ranking")})


@query("random_forest_sweep")
def random_forest_sweep(s, d):
    """The whole grid of feature shares and smallest nodes on all twelve folds."""
    obs = observations(s, d).select("plot_id", "dataset_id", "y", F.col("refl").alias("x"))
    rows = D.repeated_kfold(obs, "dataset_id", "plot_id", seed=SEED)
    return rounded(T.forest_sweep(rows, T.Forest(width=64, trees=30, depth=6), "plot_id"), "mae", "rmse", "r2")
