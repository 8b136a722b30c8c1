"""A whole study: from pixels to stored scores, going on from what is stored.

Spectra and scores are two stores in one folder. A run adds the spectra of the images
and scenarios that are missing, then tunes, fits and scores the (scenario, response,
feature set) keys that have spectra but no scores. Both steps find what is missing by
an anti-join, append in one job each, and leave what is there alone, so a run that was
broken off, or one with more images or scenarios, goes on where the last one ended.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed
from ..sources.sinks import exists
from . import design, pixels as P, sweep as W
from .grid import Grid
from .order import broadcast_if_small
from .scores import error_metrics

#: What scores are kept by.
KEYS = ("grid_idx", "response", "feat")
METRICS = ("mae", "rmse", "r2")


def add_spectra(
    spark: SparkSession, px: DataFrame, image: str, grid: Grid, wl, panels: list[Column], crops: list[Column], path: str,
    derivatives: tuple[int, ...] = (1, 2), within: list[int] | None = None,
) -> DataFrame:
    """Store the mean spectra of every image under every scenario that the store lacks; all that is stored."""
    done = spark.read.parquet(path) if exists(spark, path) else None
    new = P.all_scenarios(px, [image], grid, wl, panels, crops, derivatives, done, within)
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def assign(ground: DataFrame, image: str, stratum: str, plan: W.Plan, share: float = 0.4, seed: int = 973717) -> DataFrame:
    """``is_test`` and a fold per repeat for every image with a response, the same under every scenario."""
    split = checkpointed(design.stratified_split(ground.select(image, stratum).distinct(), stratum, image, share, seed))
    folds = design.repeated_kfold(split.filter("NOT is_test"), stratum, image, plan.n_splits, plan.n_repeats, seed)
    return split.select(image, "is_test").join(folds.select(image, *[f"fold_{r}" for r in range(plan.n_repeats)]), image, "left")


def score_table(models: DataFrame, preds: DataFrame, keys: list[str]) -> DataFrame:
    """A row per key, model and feature count with its features and the errors on training and test rows side by side."""
    by = [*keys, "model", "feat_n"]
    long = error_metrics(preds, [*by, "is_test"])
    part = {"train": ~F.col("is_test"), "test": F.col("is_test")}
    pick = lambda p, c: F.max(F.when(part[p], F.col(c))).alias(f"score_{p}_{c}")
    wide = long.groupBy(*by).agg(*[pick(p, c) for c in METRICS for p in part])
    return models.select(*by, "feats", "feat_ranking").join(wide, by)


def add_scores(spark: SparkSession, spectra: DataFrame, ground: DataFrame, image: str, stratum: str, path: str, plan: W.Plan) -> DataFrame:
    """Tune, fit and score the keys that the store lacks; all that is stored.

    ``ground`` has a row per image and response (``response, y``). Scenarios with fewer
    bands than others are filled up with features of no variance, which no model uses.
    """
    plan = dataclasses.replace(plan, keys=KEYS, row_id=image)
    known = ground.filter("y IS NOT NULL")
    rows = spectra.select(image, "grid_idx", "feat", "refl").join(known, image)
    if exists(spark, path):
        rows = rows.join(broadcast_if_small(spark.read.parquet(path).select(*KEYS).distinct()), list(KEYS), "left_anti")
    fill = F.array_repeat(F.lit(0.0), F.lit(plan.width) - F.size("refl"))
    rows = rows.join(assign(known, image, stratum, plan), image).withColumn("x", F.concat("refl", fill)).drop("refl", stratum)
    rows = checkpointed(rows)
    if rows.isEmpty():
        return spark.read.parquet(path)
    run = W.tune(rows.filter("NOT is_test"), plan)
    models = checkpointed(W.final_models(run["stats"], run["lambdas"], W.best_by_count(run["tuning"], plan), plan))
    preds = W.predict(rows, models, plan, ["is_test"])
    score_table(models, preds, list(KEYS)).write.mode("append").parquet(path)
    return spark.read.parquet(path)
