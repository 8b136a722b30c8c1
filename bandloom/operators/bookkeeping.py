"""What has been processed, what is missing, and how long it took."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import append


def completeness(done: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Processed items per scenario against the expected number (column ``expected``)."""
    counts = done.groupBy(*keys).agg(F.count(F.lit(1)).alias("processed"))
    joined = expected.join(counts, keys, "left").withColumn("processed", F.coalesce("processed", F.lit(0)))
    return joined.withColumn("complete", F.col("processed") >= F.col("expected"))


def missed(requested: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Requested items without an output."""
    return requested.join(processed.select(key).distinct(), key, "left_anti")


def first_gap(done: DataFrame, idx: str, idx_min: int = 0) -> DataFrame:
    """Smallest index from ``idx_min`` on that has no output, as one row."""
    seen = done.select(F.col(idx).cast("bigint").alias("i")).filter(F.col("i") >= idx_min).distinct()
    # A gap starts after a finished index, or at the start itself.
    start = done.sparkSession.range(idx_min, idx_min + 1).withColumnRenamed("id", "i")
    candidates = seen.select((F.col("i") + 1).alias("i")).unionByName(start)
    return candidates.join(seen, "i", "left_anti").agg(F.min("i").alias("first_gap"))


def incomplete_scenarios(done: DataFrame, grid: DataFrame, key: str, parts: list[str], expected: int) -> DataFrame:
    """Scenarios whose number of distinct finished runs differs from the expected number."""
    finished = done.select(key, *parts).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_done"))
    joined = grid.join(finished, key, "left").withColumn("n_done", F.coalesce("n_done", F.lit(0)))
    return joined.filter(F.col("n_done") != expected)


def observation_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Observations per run."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("obs_n"))


def append_log(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Add rows to a stored log under their keys; keys that are logged again are replaced, the others stay."""
    append(rows, path, keys)


def step_durations(log: DataFrame, keys: list[str], duration: str = "duration") -> DataFrame:
    """Timings per step."""
    return log.groupBy(*keys).agg(
        F.count(duration).alias("n"), F.sum(duration).alias("total"), F.avg(duration).alias("mean"), F.max(duration).alias("longest")
    )


def scenario_filter(df: DataFrame, present: str | None = None, **equals) -> DataFrame:
    """Rows with the given values and, if asked, a non-null column."""
    cond: Column = F.lit(True) if present is None else F.col(present).isNotNull()
    for c, v in equals.items():
        cond = cond & (F.col(c) == v)
    return df.filter(cond)
