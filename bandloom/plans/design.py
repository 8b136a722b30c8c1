"""Queries over joins, splits and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indices as I
from ..operators import design as D
from ..operators import grid as G
from ..operators import impute as N
from ..operators import pixels as P
from ..session import stored
from . import views as V
from .registry import query
from .spectral import RAW, long

SEED = 973717
_DATASET = "dense_rank() OVER (ORDER BY study, date) - 1"


@query("dataset_id", V.sql(f"SELECT study, date, plot_id, {_DATASET} AS dataset_id FROM ground", "ground"))
def dataset_id(s, d):
    return D.dataset_id(V.ground(s, d)).select("study", "date", "plot_id", "dataset_id")


@query(
    "join_ground_spectra",
    V.sql(
        """SELECT study, date, plot_id, trt, round(y, 6) AS y, round(refl[6], 6) AS band_5
        FROM ground JOIN spectra USING (study, date, plot_id)""",
        "ground", "spectra",
    ),
)
def join_ground_spectra(s, d):
    j = D.join_keys(V.ground(s, d), V.spectra(s, d))
    return j.select("study", "date", "plot_id", "trt", V.r6("y").alias("y"), V.r6(F.col("refl")[5]).alias("band_5"))


@query(
    "join_ground_stats_spectra",
    V.sql(
        """SELECT plot_id, round(y, 6) AS y, round(p10, 6) AS pctl_10th, round(b5, 6) AS band_5 FROM ground_image
        JOIN (SELECT study, date, plot_id, quantile_cont(mcari2, 0.1) AS p10 FROM px_idx GROUP BY ALL) USING (study, date, plot_id)
        JOIN (SELECT study, date, plot_id, avg(refl[6]) AS b5 FROM px GROUP BY ALL) USING (study, date, plot_id)""",
        "px_idx", "ground_image",
    ),
)
def join_ground_stats_spectra(s, d):
    px = V.pixels(s, d)
    stats = P.bandmath_stats(px.withColumn("mcari2", I.mcari2(RAW)), D.KEYS, "mcari2").select(*D.KEYS, "pctl_10th")
    j = D.join_keys(V.ground_image(s, d), stats, P.mean_spectrum(px, D.KEYS))
    return j.select("plot_id", V.r6("y").alias("y"), V.r6("pctl_10th").alias("pctl_10th"), V.r6(F.col("refl")[5]).alias("band_5"))


@query("drop_missing_response", V.sql("SELECT plot_id, round(y, 6) AS y FROM ground WHERE y IS NOT NULL", "ground"))
def drop_missing_response(s, d):
    return V.ground(s, d).dropna(subset=["y"]).select("plot_id", V.r6("y").alias("y"))


@query(
    "join_grid_scores",
    V.sql("SELECT grid_idx, segment, clip, count(*) AS n, round(avg(value), 6) AS mean FROM named_scores GROUP BY ALL", "named_scores"),
)
def join_grid_scores(s, d):
    """Scores joined with the grid table that a run has stored."""
    grid = stored(G.decode(G.GRID.all_indices(s), names=G.SHORT_NAMES), "grid")
    j = G.join_grid(V.scores(s, d), grid).groupBy("grid_idx", "segment", "clip")
    return j.agg(F.count(F.lit(1)).alias("n"), V.r6(F.avg("value")).alias("mean"))


def observations(s, d):
    """Rows with a response and their stratum."""
    return D.dataset_id(D.join_keys(V.ground(s, d).dropna(subset=["y"]), V.spectra(s, d)))


_OBS = f"SELECT plot_id, y, refl, {_DATASET} AS dataset_id FROM ground JOIN spectra USING (study, date, plot_id) WHERE y IS NOT NULL"
_RANK = "row_number() OVER (PARTITION BY dataset_id ORDER BY md5(plot_id || '|' || '{seed}'), plot_id)"
_SPLIT = f"""SELECT plot_id, dataset_id, {_RANK.format(seed=SEED)} <= round(0.4 * count(*) OVER (PARTITION BY dataset_id)) AS is_test FROM obs"""
_FOLDS = " UNION ALL ".join(
    f"SELECT plot_id, dataset_id, CAST({r} AS BIGINT) AS repeat, CAST(({_RANK.format(seed=SEED + r)} - 1 + dataset_id) % 4 AS BIGINT) AS fold FROM obs"
    for r in range(3)
)


@query("stratified_split", V.sql(_SPLIT, "ground", "spectra", obs=_OBS))
def stratified_split(s, d):
    return D.stratified_split(observations(s, d), "dataset_id", "plot_id", seed=SEED).select("plot_id", "dataset_id", "is_test")


def folds(s, d):
    rows = D.fold_rows(observations(s, d).select("plot_id", "dataset_id"), "dataset_id", "plot_id", seed=SEED)
    return rows.select("plot_id", "dataset_id", "repeat", "fold")


@query("repeated_stratified_kfold", V.sql(_FOLDS, "ground", "spectra", obs=_OBS))
def repeated_stratified_kfold(s, d):
    return folds(s, d)


@query(
    "fold_proportions",
    V.sql(
        """SELECT repeat, fold, dataset_id, n_val, CAST(sum(n_val) OVER (PARTITION BY repeat, dataset_id) - n_val AS BIGINT) AS n_train
        FROM (SELECT repeat, fold, dataset_id, count(*) AS n_val FROM f GROUP BY ALL)""",
        "ground", "spectra", obs=_OBS, f=_FOLDS,
    ),
)
def fold_proportions(s, d):
    return D.fold_proportions(folds(s, d), "dataset_id")


@query(
    "fold_proportions_wide",
    V.sql(
        "SELECT repeat, fold, " + ", ".join(f"count(*) FILTER (dataset_id = {k}) AS set_{k}" for k in range(10)) + " FROM f GROUP BY repeat, fold",
        "ground", "spectra", obs=_OBS, f=_FOLDS,
    ),
)
def fold_proportions_wide(s, d):
    p = D.fold_proportions(folds(s, d), "dataset_id").groupBy("repeat", "fold").pivot("dataset_id", list(range(10))).agg(F.sum("n_val"))
    return p.fillna(0).select("repeat", "fold", *[F.col(str(k)).alias(f"set_{k}") for k in range(10)])


@query(
    "assemble_features",
    V.sql(
        """SELECT plot_id, k AS pos, round(v, 6) AS value FROM
        (SELECT plot_id, unnest(list_append(refl, rate)) AS v, unnest(range(65)) AS k
         FROM ground JOIN spectra USING (study, date, plot_id) WHERE y IS NOT NULL)""",
        "ground", "spectra",
    ),
)
def assemble_features(s, d):
    x = D.assemble_features(observations(s, d), extra=["rate"])
    return long(x, "plot_id", column="x").withColumnRenamed("band", "pos")


def gappy(s, d):
    """Spectra with values missing in a fixed pattern."""
    hole = lambda v, k: F.when((F.col("plot_id") * 7 + k) % 41 != 0, v)
    return V.spectra(s, d).select("plot_id", F.transform("refl", hole).alias("x"))


@query("impute_iterative")
def impute_iterative(s, d):
    out = N.impute_iterative(gappy(s, d), 64)
    return long(out, "plot_id", column="x").filter((F.col("plot_id") * 7 + F.col("band")) % 41 == 0)


_GAPS = """SELECT plot_id, k, CASE WHEN (plot_id * 7 + k) % 41 <> 0 THEN r END AS v FROM
  (SELECT plot_id, unnest(refl) AS r, unnest(range(64)) AS k FROM spectra)"""


@query(
    "impute_knn",
    V.sql(
        """SELECT plot_id, k AS band, round(avg(v), 6) AS value FROM
        (SELECT q.plot_id, q.k, n.v, row_number() OVER (PARTITION BY q.plot_id, q.k ORDER BY p.dist, p.b) AS rn
         FROM g q JOIN p ON p.a = q.plot_id JOIN g n ON n.plot_id = p.b AND n.k = q.k AND n.v IS NOT NULL WHERE q.v IS NULL)
        WHERE rn <= 2 GROUP BY plot_id, k""",
        "spectra",
        g=_GAPS,
        p="SELECT a.plot_id AS a, b.plot_id AS b, 64.0 / count(*) * sum((a.v - b.v) * (a.v - b.v)) AS dist FROM g a JOIN g b ON a.k = b.k AND a.plot_id <> b.plot_id AND a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY 1, 2",
    ),
)
def impute_knn(s, d):
    out = N.impute_knn(gappy(s, d), 64, "plot_id")
    return long(out, "plot_id", column="x").filter((F.col("plot_id") * 7 + F.col("band")) % 41 == 0)
