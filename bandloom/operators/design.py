"""Joins and experiment design."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import broadcast_if_small, hash_ranked, null_safe_join

KEYS = ["study", "date", "plot_id"]


def join_keys(ground: DataFrame, *others: DataFrame) -> DataFrame:
    """Inner join of ground truth with spectra (and statistics) on study, date and plot."""
    out = ground
    for o in others:
        out = out.join(o, KEYS)
    return out


def dataset_id(df: DataFrame, outer: str = "study", inner: str = "date", out: str = "dataset_id") -> DataFrame:
    """Dense id from 0 of each (study, date) in sorted order.

    Only the distinct keys are numbered: dates inside their study, then studies
    shifted by the number of sets before them.
    """
    sets = df.select(outer, inner).distinct()
    within = Window.partitionBy(outer).orderBy(inner)
    sizes = sets.groupBy(outer).agg(F.count(F.lit(1)).alias("__k"))
    # One row per study; a handful whatever the number of observations.
    before = Window.orderBy(outer).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(outer, F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__shift"))
    ids = (
        sets.withColumn("__r", F.row_number().over(within))
        .withColumnRenamed(outer, "__o")
        .join(shifts, F.col("__o").eqNullSafe(F.col(outer)))
        .select(outer, inner, (F.col("__shift") + F.col("__r") - 1).cast("bigint").alias(out))
    )
    return null_safe_join(df, broadcast_if_small(ids), [outer, inner])


def digest(key: Column, seed: int | Column) -> Column:
    """Reproducible random order: md5 of key and seed, equal on every engine."""
    seed = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.md5(F.concat_ws("|", key.cast("string"), seed))


def stratified_split(df: DataFrame, stratum: str, key: str, share: float = 0.4, seed: int = 973717) -> DataFrame:
    """Add ``is_test``: exactly round(share * n) rows of every stratum."""
    tagged = df.withColumn("__h", digest(F.col(key), seed))
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n"))
    numbered = null_safe_join(hash_ranked(tagged, [stratum], "__h", key, "__rn"), broadcast_if_small(sizes), [stratum])
    return numbered.withColumn("is_test", F.col("__rn") <= F.round(F.lit(share) * F.col("__n"))).drop("__h", "__n", "__rn")


def fold_rows(
    df: DataFrame, stratum: str, key: str, n_splits: int = 4, n_repeats: int = 3, seed: int = 973717
) -> DataFrame:
    """One row per observation and repeat (columns repeat, fold), balanced inside every stratum.

    All repeats are numbered in one pass. The first fold of a stratum is shifted
    by its id, so leftovers do not all fall into fold 0.
    """
    repeats = F.sequence(F.lit(0).cast("bigint"), F.lit(n_repeats - 1).cast("bigint"))
    rows = df.withColumn("repeat", F.explode(repeats)).withColumn("__h", digest(F.col(key), F.col("repeat") + seed))
    numbered = hash_ranked(rows, [stratum, "repeat"], "__h", key, "__rn")
    return numbered.withColumn("fold", ((F.col("__rn") - 1 + F.coalesce(F.col(stratum), F.lit(0))) % n_splits).cast("bigint")).drop("__h", "__rn")


def repeated_kfold(
    df: DataFrame, stratum: str, key: str, n_splits: int = 4, n_repeats: int = 3, seed: int = 973717
) -> DataFrame:
    """Add one fold column per repeat (``fold_0``, ...); ``key`` is unique."""
    rows = fold_rows(df.select(stratum, key), stratum, key, n_splits, n_repeats, seed)
    picks = [F.max(F.when(F.col("repeat") == r, F.col("fold"))).alias(f"fold_{r}") for r in range(n_repeats)]
    return df.join(rows.groupBy(key).agg(*picks), key)


def fold_proportions(folds: DataFrame, stratum: str) -> DataFrame:
    """Rows per stratum in the validation and training part of every split."""
    cells = folds.groupBy("repeat", stratum, "fold").agg(F.count(F.lit(1)).alias("n_val"))
    totals = cells.groupBy("repeat", stratum).agg(F.sum("n_val").alias("n_all"))
    return cells.join(totals, ["repeat", stratum]).withColumn("n_train", F.col("n_all") - F.col("n_val")).drop("n_all")


def assemble_features(df: DataFrame, column: str = "refl", extra: list[str] | None = None, out: str = "x") -> DataFrame:
    """Bands in order followed by extra columns as one array."""
    parts = [F.col(column)] + ([F.array(*[F.col(c).cast("double") for c in extra])] if extra else [])
    return df.withColumn(out, F.concat(*parts))
