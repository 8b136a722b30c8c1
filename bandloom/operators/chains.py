"""Diagnostics of parameter traces and run results.

Traces have a chain column, a 1-based run number ``idx`` in the chain, and
columns by role (like*, par*, sim*).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import t_factor, t_p_value
from .order import broadcast_if_small, exact_percentiles, null_safe_join, ranked, running


def posterior(df: DataFrame, keys: list[str], like: str, percent: float = 10, maximize: bool = True) -> DataFrame:
    """Runs in the best ``percent`` of their group."""
    p = (100.0 - percent) / 100 if maximize else percent / 100
    limit = exact_percentiles(df, keys, [like], [p])
    limit = limit.select(*keys, F.col(f"{like}_pctl")[0].alias("__limit"))
    good = F.col(like) >= F.col("__limit") if maximize else F.col(like) <= F.col("__limit")
    return df.join(broadcast_if_small(limit), keys).filter(good).drop("__limit")


def best_runs(df: DataFrame, keys: list[str], like: str, maximize: bool = True) -> DataFrame:
    """All runs sharing the best value of their group."""
    best = df.groupBy(*keys).agg((F.max(like) if maximize else F.min(like)).alias("__best"))
    return df.join(broadcast_if_small(best), keys).filter(F.col(like) == F.col("__best")).drop("__best")


def simulation_percentiles(df: DataFrame, keys: list[str], columns: list[str], percents: list[float]) -> DataFrame:
    """Percentiles of every simulation column, one row per column."""
    wide = exact_percentiles(df, keys, columns, [p / 100 for p in percents])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"{c}_pctl").alias("__p")) for c in columns])
    out = wide.select(*keys, F.explode(rows).alias("__r"))
    return out.select(*keys, "__r.name", *[F.col("__r.__p")[i].alias(f"p{p:g}".replace(".", "_")) for i, p in enumerate(percents)])


def welch_t(df: DataFrame, keys: list[str], a: str, b: str, p_value: bool = True) -> DataFrame:
    """Unequal-variance t statistic of two columns, its degrees of freedom and p."""
    s = df.groupBy(*keys).agg(
        *[f(c).alias(f"__{n}{i}") for i, c in enumerate((a, b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))]
    )
    e0, e1 = F.try_divide(F.col("__v0"), F.col("__n0")), F.try_divide(F.col("__v1"), F.col("__n1"))
    df_ = F.try_divide(F.pow(e0 + e1, F.lit(2.0)), F.try_divide(e0 * e0, F.col("__n0") - 1) + F.try_divide(e1 * e1, F.col("__n1") - 1))
    out = s.select(*keys, F.try_divide(F.col("__m0") - F.col("__m1"), F.sqrt(e0 + e1)).alias("t"), df_.alias("df"))
    return out.withColumn("p", t_p_value("t", "df")) if p_value else out


def rmse(sim: Column, obs: Column) -> Column:
    return F.sqrt(F.avg((sim - obs) * (sim - obs)))


def nse(sim: Column, obs: Column) -> Column:
    """Nash-Sutcliffe efficiency."""
    return 1 - F.try_divide(F.sum((sim - obs) * (sim - obs)), F.var_pop(obs) * F.count(obs))


def log_nse(sim: Column, obs: Column) -> Column:
    """Efficiency of the logarithms; pairs with a value that has none are left out whole."""
    both = (sim > 0) & (obs > 0)
    return nse(F.when(both, F.log(sim)), F.when(both, F.log(obs)))


def objectives(sims: DataFrame, obs: DataFrame, step: str, run: list[str], functions: dict, sim: str = "sim", value: str = "obs") -> DataFrame:
    """Objective functions per run; each maps (simulated, observed) to an aggregate."""
    joined = sims.join(broadcast_if_small(obs), step)
    return joined.groupBy(*run).agg(*[f(F.col(sim), F.col(value)).alias(n) for n, f in functions.items()])


def running_best(df: DataFrame, keys: list[str], like: str, idx: str = "idx") -> DataFrame:
    """Lowest value so far at every run."""
    return running(df, keys, [idx], {"best": ("min", F.col(like))})


def first_below_mean(df: DataFrame, keys: list[str], like: str, level: float = 0.999, idx: str = "idx") -> DataFrame:
    """First run whose best-so-far is under the upper confidence limit of the mean."""
    s = df.groupBy(*keys).agg(F.avg(like).alias("mean"), F.stddev(like).alias("__sd"), F.count(like).alias("__n"))
    half = t_factor(level)((F.col("__n") - 1).cast("double")) * F.col("__sd") / F.sqrt("__n")
    s = s.select(*keys, "mean", (F.col("mean") + half).alias("upper"))
    # The best falls below a limit exactly when some run first does.
    hit = F.min(F.when(F.col(like) < F.col("upper"), F.col(idx)))
    return df.join(broadcast_if_small(s), keys).groupBy(*keys, "mean", "upper").agg(hit.alias("first_run"))


def long_params(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per run and column."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, columns, "name", "value")


def gelman_rubin(df: DataFrame, chain: str, columns: list[str], idx: str = "idx") -> DataFrame:
    """Potential scale reduction of each column over chains cut to the shortest length."""
    n = df.groupBy(chain).agg(F.count(F.lit(1)).alias("__n")).agg(F.min("__n")).scalar()
    rows = long_params(df.filter(F.col(idx) <= n), [chain], columns)
    per = rows.groupBy("name", chain).agg(F.avg("value").alias("__m"), F.var_samp("value").alias("__v"), F.count("value").alias("__n"))
    s = per.groupBy("name").agg(F.var_samp("__m").alias("__b"), F.avg("__v").alias("__w"), F.count(F.lit(1)).alias("__k"), F.min("__n").alias("__n"))
    s2 = F.col("__w") * (F.col("__n") - 1) / F.col("__n") + F.col("__b")
    return s.select("name", F.try_divide(s2 + F.col("__b") / F.col("__k"), F.col("__w")).alias("r_hat"))


def geweke(df: DataFrame, keys: list[str], value: str, idx: str = "idx", intervals: int = 20) -> DataFrame:
    """z-scores of early against late segments of a trace."""
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rows = df.join(broadcast_if_small(size), keys).withColumn("i", F.col(idx) - 1)
    length = F.floor(F.floor(F.col("n") / intervals) / 2)
    length = F.greatest(length, F.lit(1))
    early = F.floor((F.col("i") - F.floor(0.1 * F.col("n"))) / length)
    late = F.floor((F.col("i") - F.floor(F.col("n") / 2)) / length)
    parts = F.array(F.struct(early.alias("k"), F.lit(0).alias("late")), F.struct(late.alias("k"), F.lit(1).alias("late")))
    tagged = rows.select(*keys, F.col(value).alias("v"), F.explode(parts).alias("s")).select(*keys, "v", "s.*")
    tagged = tagged.filter((F.col("k") >= 0) & (F.col("k") < intervals))
    side = lambda f, s: f(F.when(F.col("late") == s, F.col("v")))
    z = F.try_divide(side(F.avg, 0) - side(F.avg, 1), F.sqrt(side(F.var_pop, 0) + side(F.var_pop, 1)))
    return tagged.groupBy(*keys, "k").agg(z.alias("z"))


def autocorrelation(df: DataFrame, keys: list[str], value: str, lags: list[int], idx: str = "idx", block: int = 1 << 16) -> DataFrame:
    """Correlation of a trace with itself at given lags.

    Run numbers are cut into blocks; a block also gets the first max(lag) runs after
    it. All lags of a block are added up in one task, so a row is sent at most twice
    (with blocks at least as long as the largest lag) however many lags there are.
    Runs that are missing or null take no part in a lag's sum; run numbers are unique
    in a trace. A lag without any pair has no row.
    """
    reach = max(lags, default=0)
    size = max(block, reach, 1)
    s = df.groupBy(*keys).agg(F.avg(value).alias("__m"), F.var_pop(value).alias("__c0"), F.count(value).alias("__n"))
    x = null_safe_join(df.select(*keys, F.col(idx).alias("__i"), F.col(value).cast("double").alias("__x")).dropna(subset=["__x"]), broadcast_if_small(s.select(*keys, "__m")), keys)
    own = F.floor(F.col("__i") / size)
    # The block before needs the rows at the start of this one.
    both = F.array_distinct(F.array(own, F.floor((F.col("__i") - reach) / size)))
    placed = x.select(*keys, "__i", (F.col("__x") - F.col("__m")).alias("__d"), F.explode(both).alias("__block"))
    schema = T.StructType([placed.schema[k] for k in keys] + [T.StructField("lag", T.LongType()), T.StructField("__s", T.DoubleType()), T.StructField("__p", T.LongType())])

    def sums(g: pa.Table) -> pa.Table:
        at, d = g.column("__i").to_numpy(), g.column("__d").to_numpy()
        order = np.argsort(at, kind="stable")
        at, d = at[order], d[order]
        mine = np.searchsorted(at, (g.column("__block")[0].as_py() + 1) * size)
        first, total, n = at[:mine], [], []
        for h in lags:
            to = np.searchsorted(at, first + h)
            hit = (to < len(at)) & (at[np.minimum(to, len(at) - 1)] == first + h)
            total.append(float(d[:mine][hit] @ d[to[hit]]))
            n.append(int(hit.sum()))
        lead = [g.column(k).take(pa.array([0] * len(lags), pa.int64())) for k in keys]
        return pa.table([*lead, pa.array(lags, pa.int64()), pa.array(total, pa.float64()), pa.array(n, pa.int64())], names=schema.names)

    parts = placed.groupBy(*keys, "__block").applyInArrow(sums, schema)
    total = parts.groupBy(*keys, "lag").agg(F.sum("__s").alias("__s"), F.sum("__p").alias("__p")).filter("__p > 0")
    out = null_safe_join(total, broadcast_if_small(s), keys)
    return out.select(*keys, F.col("lag").cast("int").alias("lag"), F.try_divide(F.col("__s"), F.col("__n") * F.col("__c0")).alias("r"))


def correlations(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Correlation of every pair of columns in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    keyed, gk = (df, keys) if keys else (df.withColumn("__all", F.lit(0)), ["__all"])
    wide = keyed.groupBy(*gk).agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])
    return wide.select(*keys, F.explode(rows).alias("__p")).select(*keys, "__p.*")


def bounds(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Smallest and largest value of every parameter."""
    return long_params(df, keys, columns).groupBy(*keys, "name").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def tail_histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int, last: int = 100, idx: str = "idx") -> DataFrame:
    """Histogram of the last runs of each chain."""
    size = df.groupBy(*keys).agg(F.max(idx).alias("__n"))
    tail = df.join(broadcast_if_small(size), keys).filter(F.col(idx) > F.col("__n") - last)
    v = F.col(value)
    b = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1))
    return tail.filter(v.between(low, high)).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def sorted_trace(df: DataFrame, keys: list[str], order: list[str], threshold: float = 0.1) -> DataFrame:
    """Runs sorted by ``order`` without the first share, numbered from 0 (``pos``)."""
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    rows = ranked(df, keys, order, "__rn").join(broadcast_if_small(size), keys)
    cut = F.floor(F.col("__n") * threshold)
    return rows.filter(F.col("__rn") > cut).withColumn("pos", F.col("__rn") - 1 - cut).drop("__rn", "__n")


def sentinel_to_null(df: DataFrame, columns: list[str], sentinel: float = -9999) -> DataFrame:
    """Missing-value marks to nulls."""
    return df.withColumns({c: F.when(F.col(c) != sentinel, F.col(c)) for c in columns})
