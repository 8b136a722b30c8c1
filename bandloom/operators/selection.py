"""Feature sets from penalised coefficients."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Smallest absolute weight of a selected feature.
MIN_WEIGHT = 1e-5


def lasso_select(coefs: DataFrame, keys: list[str], coef: str = "coef", absolute: bool = False) -> DataFrame:
    """Selected features and their rank by descending weight (ties share the lowest rank).

    The rank uses signed weights; ``absolute`` ranks by size instead. One group
    is one model, so it holds at most as many rows as there are bands.
    """
    rows = coefs.select(*keys, F.posexplode(coef).alias("band", "weight")).filter(F.abs("weight") > MIN_WEIGHT)
    by = F.abs("weight") if absolute else F.col("weight")
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(by.desc()))
    return rows.select(*keys, F.col("band").cast("bigint").alias("band"), "weight", rank.cast("bigint").alias("ranking"))


def feature_sets(coefs: DataFrame, coef: str = "coef", out: str = "feats") -> DataFrame:
    """Add the array of selected bands, the rank of each by descending weight (ties share the lowest) and their number."""
    bands = F.sequence(F.lit(0), F.size(coef) - 1)
    picked = F.filter(bands, lambda i: F.abs(F.element_at(coef, i + 1)) > MIN_WEIGHT)
    weights = F.transform(out, lambda i: F.element_at(coef, i + 1))
    ranks = F.transform("__w", lambda w: F.size(F.filter("__w", lambda v: v > w)) + 1)
    return coefs.withColumn(out, picked).withColumn("__w", weights).withColumn("feat_ranking", ranks).withColumn("feat_n", F.size(out).cast("bigint")).drop("__w")


def path_dedupe(sets: DataFrame, keys: list[str], feats: str = "feats") -> DataFrame:
    """One penalty per distinct feature set: the largest."""
    rest = [c for c in sets.columns if c not in (*keys, feats, "alpha")]
    best = sets.groupBy(*keys, feats).agg(F.max("alpha").alias("alpha"), *[F.max_by(c, "alpha").alias(c) for c in rest])
    return best
