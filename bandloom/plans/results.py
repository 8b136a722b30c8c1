"""Queries over score tables: selection, tuning results and result analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scores as R
from ..operators import selection as L
from ..operators.grid import settings_of
from . import views as V
from .registry import query

r6 = V.r6
KEYS = ["grid_idx", "response", "model", "metric"]


def rounded(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


#: What results are compared within.
BY = ["metric", "model", "response"]


# --- feature selection (given coefficients) ---------------------------------

ALPHAS = [0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3]


def coefs(s, d):
    """Soft-thresholded weights per penalty."""
    e = V.table(s, d, "embeddings").select("vec_id", F.explode(F.array(*[F.lit(a) for a in ALPHAS])).alias("alpha"), "embedding")
    soft = F.transform(
        "embedding",
        lambda x: F.signum(x.cast("double")) * F.greatest(F.abs(x.cast("double")) - F.col("alpha"), F.lit(0.0)),
    )
    return e.select("vec_id", "alpha", soft.alias("coef"))


_COEFS = f"""SELECT vec_id, alpha, k AS band, sign(e) * greatest(abs(e) - alpha, 0) AS weight FROM
  (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS e, unnest(range(64)) AS k FROM embeddings)
  CROSS JOIN (VALUES {', '.join(f'(CAST({a} AS DOUBLE))' for a in ALPHAS)}) v(alpha)"""


@query(
    "lasso_select",
    V.sql(
        """SELECT vec_id, alpha, band, round(weight, 6) AS weight, rank() OVER (PARTITION BY vec_id, alpha ORDER BY weight DESC) AS ranking
        FROM c WHERE abs(weight) > 1e-5""",
        c=_COEFS,
    ),
)
def lasso_select(s, d):
    return rounded(L.lasso_select(coefs(s, d), ["vec_id", "alpha"]), "weight")


@query(
    "feature_count_curve",
    V.sql("SELECT vec_id, alpha, count(*) FILTER (abs(weight) > 1e-5) AS feat_n FROM c GROUP BY vec_id, alpha", c=_COEFS),
)
def feature_count_curve(s, d):
    return L.feature_sets(coefs(s, d)).select("vec_id", "alpha", "feat_n")


@query(
    "path_dedupe",
    V.sql(
        """SELECT vec_id, feats, max(alpha) AS alpha, any_value(feat_n) AS feat_n FROM
        (SELECT vec_id, alpha, coalesce(string_agg(band, ',' ORDER BY band) FILTER (abs(weight) > 1e-5), '') AS feats,
          count(*) FILTER (abs(weight) > 1e-5) AS feat_n FROM c GROUP BY vec_id, alpha) GROUP BY vec_id, feats""",
        c=_COEFS,
    ),
)
def path_dedupe(s, d):
    sets = L.feature_sets(coefs(s, d)).select("vec_id", "alpha", F.array_join(F.col("feats").cast("array<string>"), ",").alias("feats"), "feat_n")
    return L.path_dedupe(sets, ["vec_id"])


# --- tuning tables ----------------------------------------------------------


def cv(s, d):
    """Validation errors per scenario, candidate and split."""
    v = F.avg("value")
    g = V.runs(s, d).groupBy("grid_idx", F.col("feat_n").alias("cand"), F.col("line").alias("split")).agg(v.alias("mae"))
    return g.withColumns({"mse": F.col("mae") * F.col("mae"), "r2": 1 - F.col("mae") / 400})


_CV = """SELECT grid_idx, feat_n AS cand, line AS split, avg(value) AS mae, avg(value) * avg(value) AS mse, 1 - avg(value) / 400 AS r2
  FROM runs GROUP BY grid_idx, feat_n, line"""
_CV_STATS = ", ".join(f"avg({c}) AS mean_{c}, stddev_pop({c}) AS std_{c}" for c in ("mae", "mse", "r2"))
_CV_OUT = [f"{n}_{c}" for c in ("mae", "mse", "r2") for n in ("mean", "std")]


@query(
    "cv_best_candidate",
    V.sql(
        f"""SELECT grid_idx, cand, {', '.join(f'round({c}, 6) AS {c}' for c in _CV_OUT)} FROM
        (SELECT *, row_number() OVER (PARTITION BY grid_idx ORDER BY mean_mae, cand) AS rn FROM
          (SELECT grid_idx, cand, {_CV_STATS} FROM cv GROUP BY grid_idx, cand)) WHERE rn = 1""",
        "runs",
        cv=_CV,
    ),
)
def cv_best_candidate(s, d):
    return rounded(R.best_candidate(cv(s, d), ["grid_idx"]), *_CV_OUT)


@query(
    "trim_components",
    V.sql(
        """SELECT vec_id, alpha, feat_n, c AS n_components FROM n LEFT JOIN (SELECT CAST(range AS BIGINT) AS c FROM range(2, 11)) ON c <= feat_n AND feat_n >= 2""",
        c=_COEFS,
        n="SELECT vec_id, alpha, count(*) FILTER (abs(weight) > 1e-5) AS feat_n FROM c GROUP BY vec_id, alpha",
    ),
)
def trim_components(s, d):
    return R.trim_components(L.feature_sets(coefs(s, d)).select("vec_id", "alpha", "feat_n"), list(range(2, 11)))


def tuning(s, d):
    score = F.when((F.col("feat_n") % 7 != 0) & (F.col("feat_n") > 1), -F.avg("value"))
    return V.runs(s, d).groupBy("grid_idx", "feat_n", F.col("line").alias("cand")).agg(score.alias("score"))


@query(
    "best_per_feature_count",
    V.sql(
        """SELECT grid_idx, feat_n, round(score, 6) AS score, cand FROM (SELECT *, min(feat_n) OVER (PARTITION BY grid_idx) AS least,
          row_number() OVER (PARTITION BY grid_idx, feat_n ORDER BY score DESC NULLS LAST, cand DESC) AS rn FROM
          (SELECT grid_idx, feat_n, line AS cand, CASE WHEN feat_n % 7 <> 0 AND feat_n > 1 THEN -avg(value) END AS score
           FROM runs GROUP BY grid_idx, feat_n, line)) WHERE rn = 1 AND (score IS NOT NULL OR feat_n = least)""",
        "runs",
    ),
)
def best_per_feature_count(s, d):
    return rounded(R.best_per_feature_count(tuning(s, d), ["grid_idx"], "score", ["cand"]), "score")


@query(
    "param_summary",
    V.sql(
        """SELECT g.grid_idx, f.feat_n, las_alpha, pls_n_components, pls_scale FROM (SELECT DISTINCT grid_idx FROM runs) g
        CROSS JOIN (SELECT CAST(range AS BIGINT) AS feat_n FROM range(1, 31)) f LEFT JOIN
        (SELECT grid_idx, feat_n, max(line) FILTER (model = 'A') AS las_alpha, max(line) FILTER (model = 'N') AS pls_n_components,
          max(line) FILTER (model = 'R') AS pls_scale FROM runs GROUP BY grid_idx, feat_n) p
        ON p.grid_idx = g.grid_idx AND p.feat_n = f.feat_n""",
        "runs",
    ),
)
def param_summary(s, d):
    name = F.when(F.col("model") == "A", "las_alpha").when(F.col("model") == "N", "pls_n_components").otherwise("pls_scale")
    tuned = V.runs(s, d).groupBy("grid_idx", "feat_n", name.alias("param")).agg(F.max("line").alias("param_value"))
    return R.param_summary(tuned, ["grid_idx"], ["las_alpha", "pls_n_components", "pls_scale"], 30)


@query(
    "param_mode_share",
    V.sql(
        """SELECT response, model, mode, round(c / n, 6) AS share FROM (SELECT response, model, v AS mode, c,
          sum(c) OVER (PARTITION BY response, model) AS n, row_number() OVER (PARTITION BY response, model ORDER BY v IS NULL, c DESC, v) AS rn
          FROM (SELECT response, model, CASE WHEN feat_n > 3 THEN feat_n END AS v, count(*) AS c FROM runs GROUP BY ALL)) WHERE rn = 1""",
        "runs",
    ),
)
def param_mode_share(s, d):
    rows = V.runs(s, d).select("response", "model", F.when(F.col("feat_n") > 3, F.col("feat_n")).alias("v"))
    return rounded(R.mode_share(rows, ["response", "model"], "v"), "share")


@query(
    "scores_reindexed",
    V.sql(
        """SELECT grid_idx, response, model, metric, f.feat_n, round(value, 6) AS value FROM (SELECT DISTINCT grid_idx, response, model, metric FROM scores) k
        CROSS JOIN (SELECT CAST(range AS BIGINT) AS feat_n FROM range(1, 51)) f LEFT JOIN scores s USING (grid_idx, response, model, metric, feat_n)""",
        "scores",
    ),
)
def scores_reindexed(s, d):
    m = V.scores(s, d)
    return rounded(R.each_feature_count(m, m.select(*KEYS).distinct(), 50), "value")


@query(
    "predictions_wide",
    V.sql(
        "SELECT supplier, " + ", ".join(f"round(avg(y_pred) FILTER (feat_n = {k}), 6) AS n_{k}" for k in range(1, 8)) + " FROM p GROUP BY supplier",
        p="SELECT l_suppkey AS supplier, l_linenumber AS feat_n, sqrt(l_quantity) * 10 + l_discount AS y_pred FROM lineitem",
    ),
)
def predictions_wide(s, d):
    p = V.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_linenumber").alias("feat_n")).agg(
        F.avg(F.sqrt("l_quantity") * 10 + F.col("l_discount")).alias("y_pred")
    )
    wide = R.wide_by_feature_count(p, ["supplier"], "y_pred", 7)
    return wide.select("supplier", *[r6(str(k)).alias(f"n_{k}") for k in range(1, 8)])


@query(
    "scores_wide",
    V.sql(
        "SELECT grid_idx, response, model, metric, " + ", ".join(f'round(max(value) FILTER (feat_n = {k}), 6) AS "{k}"' for k in range(1, 51))
        + " FROM scores GROUP BY grid_idx, response, model, metric",
        "scores",
    ),
)
def scores_wide(s, d):
    wide = R.wide_by_feature_count(V.scores(s, d), KEYS, "value", 50)
    return wide.select(*KEYS, *[r6(f"`{k}`").alias(str(k)) for k in range(1, 51)])


@query(
    "parse_feature_list",
    """SELECT l_orderkey, l_linenumber, pos, value, alpha FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
      unnest([l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)]) AS value, unnest([0, 1, 2]::BIGINT[]) AS pos,
      CAST(round(l_discount, 2) AS DOUBLE) AS alpha FROM lineitem)""",
)
def parse_feature_list(s, d):
    li = V.table(s, d, "lineitem")
    text = F.concat(F.lit("[ "), "l_partkey", F.lit("  "), "l_suppkey", F.lit("\n "), F.col("l_quantity").cast("bigint"), F.lit("]"))
    params = F.concat(F.lit("{'regressor__alpha': "), F.round("l_discount", 2).cast("string"), F.lit(", 'regressor__scale': True}"))
    shown = li.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), text.alias("text"), params.alias("params"))
    return shown.select(
        "l_orderkey", "l_linenumber", R.parse_param("params", "alpha").cast("double").alias("alpha"),
        F.posexplode(R.parse_int_list("text")).alias("pos", "value"),
    ).withColumn("pos", F.col("pos").cast("bigint"))


# --- predictions ------------------------------------------------------------


def predictions(s, d):
    return V.table(s, d, "lineitem").select(
        F.col("l_returnflag").alias("model"), F.col("l_linenumber").cast("bigint").alias("feat_n"), F.col("l_suppkey").alias("supplier"),
        (F.sqrt("l_extendedprice") / 3).alias("y"), (F.sqrt("l_quantity") * 10 + F.col("l_discount")).alias("y_pred"),
    )


_PRED = """SELECT l_returnflag AS model, CAST(l_linenumber AS BIGINT) AS feat_n, l_suppkey AS supplier, sqrt(l_extendedprice) / 3 AS y,
  sqrt(l_quantity) * 10 + l_discount AS y_pred FROM lineitem"""


@query(
    "error_metrics",
    V.sql(
        """SELECT model, feat_n, count(*) AS n, count(*) FILTER (y_pred IS NULL) AS n_bad, round(avg(abs(y - y_pred)), 6) AS mae, round(sqrt(avg((y - y_pred) * (y - y_pred))), 6) AS rmse,
        round(1 - sum((y - y_pred) * (y - y_pred)) / (var_pop(y) * count(*)), 6) AS r2 FROM p GROUP BY model, feat_n""",
        p=_PRED,
    ),
)
def error_metrics(s, d):
    return rounded(R.error_metrics(predictions(s, d), ["model", "feat_n"]), "mae", "rmse", "r2")


@query(
    "best_fit_line",
    V.sql(
        """SELECT model, count(*) AS n, round(regr_slope(y, y_pred), 6) AS slope, round(regr_intercept(y, y_pred), 6) AS intercept,
        round(regr_r2(y, y_pred), 6) AS r2, round(sqrt((regr_syy(y, y_pred) - pow(regr_sxy(y, y_pred), 2) / regr_sxx(y, y_pred)) / count(*)), 6) AS rmse
        FROM p GROUP BY model""",
        p=_PRED,
    ),
)
def best_fit_line(s, d):
    return rounded(R.best_fit_line(predictions(s, d), ["model"]), "slope", "intercept", "r2", "rmse")


@query(
    "stratified_error",
    V.sql(
        """SELECT model, level, round(avg(abs(y - y_pred)) FILTER ((level = 0 AND y < 25) OR (level = 1 AND y >= 25 AND y < 50)
          OR (level = 2 AND y >= 50 AND y < 100) OR (level = 3 AND y >= 100)), 6) AS mae
        FROM p CROSS JOIN (SELECT range AS level FROM range(4)) GROUP BY model, level""",
        p=_PRED,
    ),
)
def stratified_error(s, d):
    return rounded(R.stratified_error(predictions(s, d), ["model"], [25, 50, 100]), "mae")


@query(
    "score_ranges",
    V.sql(
        """SELECT feat_n, round(lo - (hi - lo) * 0.05, 6) AS low, round(hi + (hi - lo) * 0.05, 6) AS high FROM
        (SELECT feat_n, least(min(y), min(y_pred)) AS lo, greatest(max(y), max(y_pred)) AS hi FROM p GROUP BY feat_n)""",
        p=_PRED,
    ),
)
def score_ranges(s, d):
    return rounded(R.score_ranges(predictions(s, d), ["feat_n"], ["y", "y_pred"]), "low", "high")


@query(
    "counts_by_study_month",
    """SELECT o_custkey, CASE WHEN k > 10 THEN strftime(dt, '%B') ELSE strftime(dt, '%Y-%m-%d') END AS label, CAST(sum(c) AS BIGINT) AS n FROM
    (SELECT o_custkey, CAST(o_orderdate AS DATE) AS dt, count(*) AS c, count(*) OVER (PARTITION BY o_custkey) AS k FROM orders GROUP BY 1, 2)
    GROUP BY 1, 2""",
)
def counts_by_study_month(s, d):
    return R.counts_by_month(V.table(s, d, "orders"), "o_custkey", "o_orderdate", many=10)


@query(
    "optimum_feature_wavelengths",
    V.sql(
        """SELECT label, band, 400.0::DOUBLE + 8 * band AS wavelength FROM (SELECT label, unnest(range(64)) AS band, unnest(embedding) AS e
        FROM (SELECT label, arg_min(embedding, embedding[1]) AS embedding FROM embeddings GROUP BY label)) WHERE e > 0.1::FLOAT"""
    ),
)
def optimum_feature_wavelengths(s, d):
    e = V.table(s, d, "embeddings")
    feats = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.element_at("embedding", i + 1) > F.lit(0.1).cast("float"))
    rows = e.select("label", F.col("embedding")[0].alias("rmse"), feats.alias("feats"))
    out = R.optimum_wavelengths(rows, ["label"], "rmse", "feats", V.WL)
    return out.withColumn("band", F.col("band").cast("bigint"))


@query(
    "normalize_score_sign",
    V.sql("SELECT grid_idx, response, model, metric, feat_n, round(value, 6) AS value FROM scores", "scores"),
)
def normalize_score_sign(s, d):
    signed = V.scores(s, d).withColumn("value", F.when(F.col("model") == "A", -F.col("value")).otherwise(F.col("value")))
    return rounded(R.positive_scores(signed, KEYS, "value", "feat_n"), "value").select(*KEYS, "feat_n", "value")


# --- optimum and distributions ----------------------------------------------

_OPT = """SELECT grid_idx, response, model, metric, feat_n AS n_feats_opt, value FROM (SELECT *, row_number() OVER
  (PARTITION BY grid_idx, response, model, metric ORDER BY CASE WHEN metric = 'R2' THEN -value ELSE value END, feat_n) AS rn FROM scores) WHERE rn = 1"""


def optima(s, d):
    return R.optimum_feature_count(V.scores(s, d), KEYS)


@query(
    "optimum_feature_count",
    V.sql("SELECT grid_idx, response, model, metric, n_feats_opt, round(value, 6) AS value FROM o", "scores", o=_OPT),
)
def optimum_feature_count(s, d):
    return rounded(optima(s, d), "value")


@query(
    "stack_metrics",
    V.sql("SELECT metric, response, count(*) AS n, min(n_feats_opt) AS least, max(n_feats_opt) AS most FROM o GROUP BY metric, response", "scores", o=_OPT),
)
def stack_metrics(s, d):
    scores = V.scores(s, d)
    parts = {m: R.optimum_feature_count(scores.filter(F.col("metric") == m), KEYS).drop("metric") for m in V.METRICS}
    out = R.stack_metrics(parts)
    return out.groupBy("metric", "response").agg(
        F.count(F.lit(1)).alias("n"), F.min("n_feats_opt").alias("least"), F.max("n_feats_opt").alias("most")
    )


_CODES = ", ".join(f"dense_rank() OVER (ORDER BY {c}) - 1 AS par{c}" for c in V.STEPS)


@query(
    "objective_table",
    V.sql(
        f"""SELECT grid_idx, response, model, round(max(value) FILTER (metric = 'RMSE'), 6) AS like1, round(max(value) FILTER (metric = 'MAE'), 6) AS like2,
        round(max(value) FILTER (metric = 'R2'), 6) AS like3, any_value(pardir_panels) AS pardir_panels, any_value(parcrop) AS parcrop, any_value(parclip) AS parclip,
        any_value(parsmooth) AS parsmooth, any_value(parbin) AS parbin, any_value(parsegment) AS parsegment, any_value(chain) AS chain
        FROM o JOIN c USING (grid_idx) JOIN (SELECT model, dense_rank() OVER (ORDER BY model) - 1 AS chain FROM (SELECT DISTINCT model FROM o)) USING (model)
        GROUP BY grid_idx, response, model""",
        "scores",
        o=_OPT,
        c=f"SELECT grid_idx, {_CODES} FROM (SELECT grid_idx, {V.NAMED_SQL} FROM (SELECT range AS grid_idx FROM range(648)))",
    ),
)
def objective_table(s, d):
    from ..operators.grid import SHORT_NAMES, decode

    named = decode(optima(s, d), names=SHORT_NAMES)
    out = R.objective_table(
        named, ["grid_idx", "response", "model", *V.STEPS], {"RMSE": "like1", "MAE": "like2", "R2": "like3"}, SHORT_NAMES, ("model", ["A", "N", "R"])
    )
    return rounded(out, "like1", "like2", "like3").drop(*V.STEPS)


@query(
    "factorize_levels",
    V.sql(
        f"""SELECT segment, dense_rank() OVER (ORDER BY f) - 1 AS code, n FROM
        (SELECT segment, min(run_id * 648 + grid_idx) AS f, count(*) AS n FROM (SELECT {V.NAMED_SQL}, run_id, grid_idx FROM runs) GROUP BY segment)""",
        "runs",
    ),
)
def factorize_levels(s, d):
    from ..operators.grid import SHORT_NAMES, decode

    rows = decode(V.runs(s, d), names=SHORT_NAMES).withColumn("pos", F.col("run_id") * 648 + F.col("grid_idx"))
    return R.factorize(rows, "segment", "pos", "code").groupBy("segment", "code").agg(F.count(F.lit(1)).alias("n"))


_LOWS, _WIDTH = [30.0, 80.0, 130.0, 180.0, 230.0, 280.0], 50.0
_CLASSES = ", ".join(f"(CAST({x} AS DOUBLE))" for x in _LOWS)
_BY = ", ".join(BY)
_ALL = "SELECT * FROM named_scores"
_BY_STEP = " UNION ALL ".join(f"SELECT {_BY}, '{s}' AS step, {s} AS scenario, value FROM r" for s in V.STEPS)


@query(
    "class_proportions",
    V.sql(
        f"""SELECT {_BY}, class_min_val, round(100.0 * count(*) FILTER (value BETWEEN class_min_val AND class_min_val + {_WIDTH}) / count(*), 6) AS proportion
        FROM r CROSS JOIN (VALUES {_CLASSES}) v(class_min_val) GROUP BY ALL""",
        "named_scores",
        r=_ALL,
    ),
)
def class_proportions(s, d):
    return rounded(R.class_proportions(V.named_scores(s, d), BY, "value", _LOWS, _WIDTH), "proportion")


@query(
    "class_proportions_by_level",
    V.sql(
        f"""SELECT {_BY}, step, scenario, class_min_val, round(100.0 * count(*) FILTER (value BETWEEN class_min_val AND class_min_val + {_WIDTH}) / count(*), 6) AS proportion
        FROM l CROSS JOIN (VALUES {_CLASSES}) v(class_min_val) GROUP BY ALL""",
        "named_scores",
        r=_ALL,
        l=_BY_STEP,
    ),
)
def class_proportions_by_level(s, d):
    rows = R.by_step(V.named_scores(s, d), V.STEPS, [*BY, "value"])
    return rounded(R.class_proportions(rows, [*BY, "step", "scenario"], "value", _LOWS, _WIDTH), "proportion")


@query(
    "class_proportions_pivot",
    V.sql(
        f"SELECT {_BY}, segment, " + ", ".join(f"round(100.0 * count(*) FILTER (value BETWEEN {x} AND {x + _WIDTH}) / count(*), 6) AS c_{int(x)}" for x in _LOWS)
        + f" FROM r GROUP BY {_BY}, segment",
        "named_scores",
        r=_ALL,
    ),
)
def class_proportions_pivot(s, d):
    p = R.class_proportions(V.named_scores(s, d), [*BY, "segment"], "value", _LOWS, _WIDTH).groupBy(*BY, "segment").pivot("class_min_val", _LOWS).agg(F.first("proportion"))
    return p.select(*BY, "segment", *[r6(f"`{x}`").alias(f"c_{int(x)}") for x in _LOWS])


_DESC = ["mean", "std", "min", "max", "q25", "q50", "q75"]


def _describe_sql(v):
    return f"""count({v}) AS count, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std, round(min({v}), 6) AS min, round(max({v}), 6) AS max,
      round(quantile_cont({v}, 0.25), 6) AS q25, round(quantile_cont({v}, 0.5), 6) AS q50, round(quantile_cont({v}, 0.75), 6) AS q75"""


@query("describe_by_segment", V.sql(f"SELECT {_BY}, segment, {_describe_sql('value')} FROM r GROUP BY {_BY}, segment", "named_scores", r=_ALL))
def describe_by_segment(s, d):
    return rounded(R.describe(V.named_scores(s, d), [*BY, "segment"], "value"), *_DESC)


@query("describe_overall", V.sql(f"SELECT {_BY}, {_describe_sql('value')} FROM r GROUP BY {_BY}", "named_scores", r=_ALL))
def describe_overall(s, d):
    return rounded(R.describe(V.named_scores(s, d), BY, "value"), *_DESC)


@query("describe_by_group", V.sql(f"SELECT study, date, {_describe_sql('y')} FROM ground GROUP BY study, date", "ground"))
def describe_by_group(s, d):
    return rounded(R.describe(V.ground(s, d), ["study", "date"], "y"), *_DESC)


@query(
    "obs_stats_by_level",
    V.sql(
        f"SELECT step, scenario, {_describe_sql('obs_n')} FROM l GROUP BY step, scenario",
        "runs",
        o=f"SELECT grid_idx, {V.NAMED_SQL}, obs_n FROM (SELECT grid_idx, model, response, CAST(count(*) AS DOUBLE) AS obs_n FROM runs GROUP BY ALL)",
        l=" UNION ALL ".join(f"SELECT '{c}' AS step, {c} AS scenario, obs_n FROM o" for c in V.STEPS),
    ),
)
def obs_stats_by_level(s, d):
    from ..operators.grid import SHORT_NAMES, decode

    n = V.runs(s, d).groupBy("grid_idx", "model", "response").agg(F.count(F.lit(1)).cast("double").alias("obs_n"))
    rows = R.by_step(decode(n, names=SHORT_NAMES), V.STEPS, ["obs_n"])
    return rounded(R.describe(rows, ["step", "scenario"], "obs_n"), *_DESC)


@query(
    "percentile_of_score",
    V.sql(
        f"""SELECT {_BY}, dir_panels, round(100 * (avg(CASE WHEN value < s THEN 1.0 ELSE 0 END) + avg(CASE WHEN value <= s THEN 1.0 ELSE 0 END)) / 2, 6) AS pct_rank
        FROM r JOIN (SELECT {_BY}, avg(value) AS s FROM r WHERE grid_idx = 140 GROUP BY {_BY}) USING ({_BY}) GROUP BY {_BY}, dir_panels""",
        "named_scores",
        r=_ALL,
    ),
)
def percentile_of_score(s, d):
    """Where the mean score of one scenario, the one asked for, lies among all."""
    rows = V.named_scores(s, d)
    score = rows.groupBy(*BY).agg(F.avg(F.when(F.col("grid_idx") == 140, F.col("value"))).alias("__s")).filter("__s IS NOT NULL")
    return rounded(R.percentile_of_score(rows.join(score, BY), [*BY, "dir_panels"], "value", F.col("__s")), "pct_rank")


@query(
    "extreme_scenarios",
    V.sql(
        """SELECT response, metric, idx_min, value_min, idx_max, value_max, a.t AS settings_min, b.t AS settings_max FROM
        (SELECT response, metric, arg_min(grid_idx, m) AS idx_min, round(min(m), 6) AS value_min, arg_max(grid_idx, m) AS idx_max, round(max(m), 6) AS value_max
         FROM (SELECT response, metric, grid_idx, avg(value) AS m FROM o GROUP BY ALL) GROUP BY response, metric)
        JOIN t a ON a.grid_idx = idx_min JOIN t b ON b.grid_idx = idx_max""",
        "scores",
        o=_OPT,
        t=f"SELECT grid_idx, concat_ws('/', {', '.join(V.STEPS)}) AS t FROM (SELECT grid_idx, {V.NAMED_SQL} FROM (SELECT range AS grid_idx FROM range(648)))",
    ),
)
def extreme_scenarios(s, d):
    return rounded(R.extreme_scenarios(optima(s, d), ["response", "metric"], names=settings_of), "value_min", "value_max")


@query(
    "relative_rmse",
    V.sql(
        "SELECT grid_idx, round(avg(value) / (SELECT avg(y) FROM ground) * 100, 6) AS rrmse FROM scores WHERE metric = 'RMSE' GROUP BY grid_idx",
        "scores",
        "ground",
    ),
)
def relative_rmse(s, d):
    rows = V.scores(s, d).filter("metric = 'RMSE'")
    return rounded(R.relative_rmse(rows, V.ground(s, d), ["grid_idx"]), "rrmse")


@query(
    "ecdf_by_level",
    V.sql(
        f"""SELECT DISTINCT {_BY}, clip, round(value, 6) AS value, round(cume_dist() OVER (PARTITION BY {_BY}, clip ORDER BY value), 6) AS ecdf FROM r""",
        "named_scores",
        r=_ALL,
    ),
)
def ecdf_by_level(s, d):
    return rounded(R.ecdf(V.named_scores(s, d), [*BY, "clip"], "value"), "value", "ecdf").distinct()


@query(
    "histogram_cumulative",
    V.sql(
        f"""SELECT {_BY}, clip, bin, n, round(sum(n) OVER (PARTITION BY {_BY}, clip ORDER BY bin) / sum(n) OVER (PARTITION BY {_BY}, clip), 6) AS cumulative FROM
        (SELECT {_BY}, clip, CAST(CASE WHEN value < 50 THEN 0 WHEN value >= 300 THEN 26 ELSE floor((value - 50) / 10) + 1 END AS BIGINT) AS bin, count(*) AS n FROM r GROUP BY ALL)""",
        "named_scores",
        r=_ALL,
    ),
)
def histogram_cumulative(s, d):
    return rounded(R.cumulative_histogram(V.named_scores(s, d), [*BY, "clip"], "value", 50, 300, 25), "cumulative")


@query(
    "box_stats_by_level",
    V.sql(
        f"""SELECT {_BY}, segment, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
        round(min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
        round(max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
        count(*) FILTER (value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
        FROM r JOIN (SELECT {_BY}, segment, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
          FROM r GROUP BY {_BY}, segment) USING ({_BY}, segment) GROUP BY {_BY}, segment, q1, median, q3""",
        "named_scores",
        r=f"SELECT {_BY}, segment, value * value / 100 AS value FROM named_scores",
    ),
)
def box_stats_by_level(s, d):
    rows = V.named_scores(s, d).select(*BY, "segment", (F.col("value") * F.col("value") / 100).alias("value"))
    return rounded(R.box_stats(rows, [*BY, "segment"], "value"), "q1", "median", "q3", "whisker_low", "whisker_high")


_POINTS = [float(p) for p in range(20, 340, 20)]


@query(
    "density_by_group",
    V.sql(
        f"""SELECT {_BY}, point, round(avg(exp(-0.5 * pow((point - value) / h, 2))) / (any_value(h) * sqrt(2 * pi())), 6) AS density FROM r
        JOIN (SELECT {_BY}, stddev_samp(value) * pow(count(*), -0.2) AS h FROM r GROUP BY {_BY}) USING ({_BY})
        CROSS JOIN (VALUES {', '.join(f'(CAST({p} AS DOUBLE))' for p in _POINTS)}) v(point) GROUP BY {_BY}, point""",
        "named_scores",
        r=_ALL,
    ),
)
def density_by_group(s, d):
    return rounded(R.density(V.named_scores(s, d), BY, "value", _POINTS), "density")
