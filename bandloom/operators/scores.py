"""Operators on score tables in long form (one row per value)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bands import batch_groups, matrix_list
from .order import broadcast_if_small, exact_percentiles, null_safe_join, running, summary

#: Metrics where larger is better.
LARGER_IS_BETTER = ["R2"]


def error_metrics(df: DataFrame, keys: list[str], y: str = "y", pred: str = "y_pred") -> DataFrame:
    """MAE, RMSE and R2 per group in one aggregate.

    A group with a row that has no prediction gets no scores: ``n_bad`` counts such
    rows, so that failing on the hard rows is never an advantage.
    """
    err = F.col(y) - F.col(pred)
    known = df.filter(F.col(y).isNotNull())
    if dict(df.dtypes)[pred] in ("double", "float"):
        known = known.withColumn(pred, F.when(~F.isnan(pred), F.col(pred)))
    out = known.groupBy(*keys).agg(
        F.count(pred).alias("n"),
        F.count_if(F.col(pred).isNull()).alias("n_bad"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.sum(err * err).alias("__sse"),
        F.var_pop(y).alias("__var"),
    )
    out = out.withColumn("r2", F.when((F.col("__var") > 0) & (F.col("n") > 0), 1 - F.try_divide(F.col("__sse"), F.col("__var") * F.col("n"))))
    whole = F.col("n_bad") == 0
    return out.withColumns({c: F.when(whole, F.col(c)) for c in ("mae", "rmse", "r2")}).drop("__sse", "__var")


def best_fit_line(df: DataFrame, keys: list[str], measured: str = "y", predicted: str = "y_pred") -> DataFrame:
    """Least-squares line of measured on predicted values in one aggregate."""
    y, x = F.col(measured), F.col(predicted)
    sse = F.regr_syy(y, x) - F.try_divide(F.pow(F.regr_sxy(y, x), F.lit(2.0)), F.regr_sxx(y, x))
    return df.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.when(sse.isNotNull(), F.sqrt(F.try_divide(F.greatest(sse, F.lit(0.0)), F.regr_count(y, x)))).alias("rmse"),
    )


def _loss(metric: str, value: str) -> Column:
    return F.when(F.col(metric).isin(LARGER_IS_BETTER), -F.col(value)).otherwise(F.col(value))


def optimum_feature_count(scores: DataFrame, keys: list[str], metric: str = "metric") -> DataFrame:
    """Best value and its feature count; missing values are skipped, the smallest count wins ties.

    ``keys`` include the metric. A minimum of a small struct, so it is combined
    before the shuffle and no group is sorted.
    """
    best = F.min(F.struct(_loss(metric, "value").alias("loss"), F.col("feat_n"), F.col("value")))
    out = scores.filter(F.col("value").isNotNull()).groupBy(*keys).agg(best.alias("__b"))
    return out.select(*keys, F.col("__b.feat_n").alias("n_feats_opt"), F.col("__b.value").alias("value"))


def stack_metrics(frames: dict[str, DataFrame], label: str = "metric") -> DataFrame:
    """Tables of several metrics stacked with a label column."""
    out = None
    for name, df in frames.items():
        part = df.withColumn(label, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def level_code(column: str, levels: list[str]) -> Column:
    """Position of a level in alphabetical order, from 0."""
    return F.array_position(F.array(*[F.lit(x) for x in sorted(levels)]), F.col(column)) - 1


def objective_table(
    optima: DataFrame, keys: list[str], metrics: dict[str, str], steps: dict[str, list[str]] | None = None, chain: tuple[str, list[str]] | None = None
) -> DataFrame:
    """One row per key with the metrics side by side (``metrics``: metric -> column).

    ``steps`` (names of the levels per processing step) adds a code per step as
    ``par<step>``; ``chain`` is the column, with its levels, that numbers the chains.
    """
    picks = [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(c) for m, c in metrics.items()]
    codes = {f"par{s}": level_code(s, levels) for s, levels in (steps or {}).items()}
    if chain:
        codes["chain"] = level_code(*chain)
    return optima.groupBy(*keys).agg(*picks).withColumns(codes) if codes else optima.groupBy(*keys).agg(*picks)


def factorize(df: DataFrame, column: str, order: str, out: str) -> DataFrame:
    """Integer codes of levels in order of first appearance."""
    return df.join(broadcast_if_small(factor_levels(df, column, order, out)), column)


def factor_levels(df: DataFrame, column: str, order: str, out: str) -> DataFrame:
    """Level dictionary: level and code. The levels, not the rows, are ordered."""
    first = df.groupBy(column).agg(F.min(order).alias("__first"))
    return running(first.withColumn("__g", F.lit(0)), ["__g"], ["__first"], {out: ("sum", F.lit(1))}).select(
        column, (F.col(out) - 1).alias(out)
    )


def class_proportions(df: DataFrame, keys: list[str], value: str, lows: list[float], width: float) -> DataFrame:
    """Percent of rows with a value in [low, low + width], ends included, for each low.

    Overlapping classes are counted in one pass: each row is listed under the
    classes it falls in, which merge before the shuffle.
    """
    hits = [F.count_if(F.col(value).between(lo, lo + width)).alias(f"__c{i}") for i, lo in enumerate(lows)]
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *hits)
    rows = F.array(*[F.struct(F.lit(float(lo)).alias("class_min_val"), F.col(f"__c{i}").alias("c")) for i, lo in enumerate(lows)])
    return wide.select(*keys, F.explode(rows).alias("__r"), "__n").select(
        *keys, "__r.class_min_val", (100.0 * F.col("__r.c") / F.col("__n")).alias("proportion")
    )


def by_step(df: DataFrame, steps: list[str], keep: list[str]) -> DataFrame:
    """One row per processing step: its level in ``scenario``."""
    parts = [F.struct(F.lit(s).alias("step"), F.col(s).cast("string").alias("scenario")) for s in steps]
    return df.select(*keep, F.explode(F.array(*parts)).alias("__s")).select(*keep, "__s.*")


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, std, extremes and quartiles per group."""
    keyed, gk = (df, keys) if keys else (df.withColumn("__all", F.lit(0)), ["__all"])
    q = exact_percentiles(keyed, gk, [value], [0.25, 0.5, 0.75], extra=summary(value)).withColumnRenamed("n", "count")
    quart = [F.col(f"{value}_pctl")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))]
    return q.select(*keys, "count", "mean", "std", "min", "max", *quart)


def percentile_of_score(df: DataFrame, keys: list[str], value: str, score: float | Column) -> DataFrame:
    """Percent rank of a score: mean of the shares below and not above it."""
    s = score if isinstance(score, Column) else F.lit(float(score))
    v = F.col(value)
    below, upto = F.avg((v < s).cast("double")), F.avg((v <= s).cast("double"))
    return df.groupBy(*keys).agg((100 * (below + upto) / 2).alias("pct_rank"))


def extreme_scenarios(df: DataFrame, keys: list[str], value: str = "value", idx: str = "grid_idx", names: Callable[[Column], Column] | None = None) -> DataFrame:
    """Scenarios with the lowest and highest mean value over models.

    ``names`` turns a scenario's number into its settings (``settings_min``, ``settings_max``).
    """
    means = df.groupBy(*keys, idx).agg(F.avg(value).alias("__m"))
    low = F.min(F.struct("__m", idx))
    high = F.max(F.struct(F.col("__m"), (-F.col(idx)).alias("__i")))
    out = means.groupBy(*keys).agg(low.alias("__lo"), high.alias("__hi"))
    out = out.select(
        *keys, F.col(f"__lo.{idx}").alias("idx_min"), F.col("__lo.__m").alias("value_min"), (-F.col("__hi.__i")).alias("idx_max"), F.col("__hi.__m").alias("value_max")
    )
    return out if names is None else out.withColumns({f"settings_{e}": names(F.col(f"idx_{e}")) for e in ("min", "max")})


def relative_rmse(df: DataFrame, response: DataFrame, keys: list[str], value: str = "value", y: str = "y") -> DataFrame:
    """Mean value per scenario in percent of the mean response (a scalar subquery)."""
    scale = response.agg(F.avg(y)).scalar()
    means = df.groupBy(*keys).agg(F.avg(value).alias("__m"))
    return means.select(*keys, (F.try_divide(F.col("__m"), scale) * 100).alias("rrmse"))


def ecdf(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Cumulative distribution at every distinct value of each group."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__w"))
    totals = counts.groupBy(*keys).agg(F.sum("__w").alias("__n"))
    run = running(counts, keys, [value], {"__upto": ("sum", F.col("__w"))})
    return run.join(broadcast_if_small(totals), keys).select(*keys, value, (F.col("__upto") / F.col("__n")).alias("ecdf"))


def cumulative_histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Share of rows up to the end of each bin; bin 0 is below, ``bins + 1`` above the range."""
    counts = df.groupBy(*keys, F.expr(f"width_bucket({value}, {low}D, {high}D, {bins})").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # At most bins + 2 rows per group are left here.
    w = Window.partitionBy(*keys)
    upto = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("cumulative", upto / F.sum("n").over(w))


def box_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 IQR, and the number of outliers."""
    q = exact_percentiles(df, keys, [value], [0.25, 0.5, 0.75])
    p = F.col(f"{value}_pctl")
    q = q.select(*keys, p[0].alias("q1"), p[1].alias("median"), p[2].alias("q3"))
    v, iqr = F.col(value), F.col("q3") - F.col("q1")
    inside = (v >= F.col("q1") - 1.5 * iqr) & (v <= F.col("q3") + 1.5 * iqr)
    return df.join(broadcast_if_small(q), keys).groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"), F.count_if(~inside).alias("n_outliers")
    )


def stratified_error(df: DataFrame, keys: list[str], edges: list[float], y: str = "y", pred: str = "y_pred") -> DataFrame:
    """MAE by level of the measured value; a level without rows gives null."""
    err, yv = F.abs(F.col(y) - F.col(pred)), F.col(y)
    bounds = [None, *edges, None]
    cols = []
    for i in range(len(bounds) - 1):
        lo, hi = bounds[i], bounds[i + 1]
        cond = (F.lit(True) if lo is None else yv >= lo) & (F.lit(True) if hi is None else yv < hi)
        cols.append((i, F.avg(F.when(cond, err)).alias(f"__m{i}")))
    wide = df.groupBy(*keys).agg(*[c for _, c in cols])
    rows = F.array(*[F.struct(F.lit(i).cast("bigint").alias("level"), F.col(f"__m{i}").alias("mae")) for i, _ in cols])
    return wide.select(*keys, F.explode(rows).alias("__r")).select(*keys, "__r.*")


def score_ranges(df: DataFrame, keys: list[str], columns: list[str], pad: float = 0.05) -> DataFrame:
    """Common axis range of several score columns, padded on both sides."""
    lo = F.least(*[F.min(c) for c in columns]) if len(columns) > 1 else F.min(columns[0])
    hi = F.greatest(*[F.max(c) for c in columns]) if len(columns) > 1 else F.max(columns[0])
    out = df.groupBy(*keys).agg(lo.alias("__lo"), hi.alias("__hi"))
    span = (F.col("__hi") - F.col("__lo")) * pad
    return out.select(*keys, (F.col("__lo") - span).alias("low"), (F.col("__hi") + span).alias("high"))


def counts_by_month(df: DataFrame, study: str, ts: str, many: int = 15) -> DataFrame:
    """Rows per study and date label: the month name once a study has more than ``many`` dates."""
    dates = df.groupBy(study, F.to_date(ts).alias("__d")).agg(F.count(F.lit(1)).alias("__n"))
    n_dates = dates.groupBy(study).agg(F.count(F.lit(1)).alias("__k"))
    label = F.when(F.col("__k") > many, F.date_format("__d", "MMMM")).otherwise(F.date_format("__d", "yyyy-MM-dd"))
    return dates.join(broadcast_if_small(n_dates), study).groupBy(study, label.alias("label")).agg(F.sum("__n").alias("n"))


def optimum_wavelengths(df: DataFrame, keys: list[str], score: str, feats: str, wl: tuple[float, ...]) -> DataFrame:
    """Wavelengths of the features at the lowest score."""
    best = df.groupBy(*keys).agg(F.min(F.struct(F.col(score), F.col(feats))).alias("__b"))
    table = F.array(*[F.lit(float(w)) for w in wl])
    return best.select(*keys, F.explode(f"__b.{feats}").alias("band")).select(*keys, "band", F.element_at(table, F.col("band").cast("int") + 1).alias("wavelength"))


def positive_scores(df: DataFrame, keys: list[str], column: str, order: str) -> DataFrame:
    """Flip a series of negated scores: its sign is read off its first value."""
    first = df.groupBy(*keys).agg(F.min_by(column, order).alias("__first"))
    sign = F.when(F.col("__first") < 0, -1).otherwise(1)
    return df.join(broadcast_if_small(first), keys).withColumn(column, F.col(column) * sign).drop("__first")


def density(df: DataFrame, keys: list[str], value: str, points: list[float], width: float | None = None) -> DataFrame:
    """Gaussian kernel density on given points; bandwidth std * n^(-1/5) per group.

    Equal values (or bins of ``width``, when given) are counted first. A task turns the
    counts of a batch into one array with a sum per point, so neither a row per value
    and point is made nor more than an array per group and batch is sent.
    """
    if not keys:
        return density(df.withColumn("__all", F.lit(0)), ["__all"], value, points, width).drop("__all")
    v = F.col(value) if width is None else (F.floor(F.col(value) / width) + 0.5) * width
    merged = df.groupBy(*keys, v.cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__w")).filter("__v IS NOT NULL")
    spread = df.groupBy(*keys).agg(F.stddev(value).alias("__sd"), F.count(value).alias("__n"))
    spread = spread.select(*keys, "__n", (F.col("__sd") * F.pow(F.col("__n").cast("double"), F.lit(-0.2))).alias("__h"))
    rows = null_safe_join(merged, broadcast_if_small(spread), keys).select(*keys, "__v", "__w", "__h")
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("__part", T.ArrayType(T.DoubleType()))])
    at, nk = np.asarray(points, float), len(keys)

    def sums(batches):
        for b in batches:
            v, w, h = (b.column(nk + i).to_numpy(zero_copy_only=False).astype(float) for i in range(3))
            found, parts = list(batch_groups(b, keys)), []
            for _, own in found:
                total = np.zeros(len(at))
                for lo in range(0, len(own), 4_096):
                    some = own[lo : lo + 4_096]
                    with np.errstate(all="ignore"):
                        total += w[some] @ np.exp(-0.5 * ((at[None, :] - v[some, None]) / h[some, None]) ** 2)
                parts.append(total)
            if parts:
                first = pa.array([r for r, _ in found])
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(first) for i in range(nk)), matrix_list(np.array(parts))], names=schema.names)

    total = rows.mapInArrow(sums, schema).groupBy(*keys).agg(Summarizer.metrics("sum").summary(array_to_vector("__part")).alias("s"))
    total = null_safe_join(total, broadcast_if_small(spread), keys)
    scale = F.col("__n") * F.col("__h") * F.lit((2 * 3.141592653589793) ** 0.5)
    each = F.arrays_zip(F.array(*[F.lit(float(p)) for p in points]).alias("point"), vector_to_array("s.sum").alias("sum"))
    return total.select(*keys, scale.alias("__scale"), F.explode(each).alias("p")).select(
        *keys, "p.point", F.when(F.col("__scale") > 0, F.col("p.sum") / F.col("__scale")).alias("density")
    )


# --- tuning and score bookkeeping -------------------------------------------


def best_candidate(cv: DataFrame, keys: list[str], cand: str = "cand", metrics: tuple[str, ...] = ("mae", "mse", "r2")) -> DataFrame:
    """Candidate with the lowest mean validation MAE, its mean and spread over the splits.

    ``cv`` has one row per candidate and split with columns mae, mse, r2 (and any
    other ``metrics``); the smaller candidate number wins ties. A candidate without a
    score in any one split has no mean there and comes after all others.
    """
    whole = lambda c, v: F.when(F.count(c) == F.count(F.lit(1)), v)
    stats = cv.groupBy(*keys, cand).agg(*[whole(c, f(c)).alias(f"{n}_{c}") for c in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    rest = [c for c in stats.columns if c not in (*keys, "mean_mae", cand)]
    best = stats.groupBy(*keys).agg(F.min(F.struct(F.col("mean_mae").isNull().alias("__none"), "mean_mae", cand, *rest)).alias("__b"))
    return best.select(*keys, "__b.*").drop("__none")


def trim_components(sets: DataFrame, components: list[int], n_feats: str = "feat_n") -> DataFrame:
    """Component counts allowed for each feature set; sets with fewer than two features keep one empty row."""
    all_c = F.array(*[F.lit(c).cast("bigint") for c in components])
    fit = F.when(F.col(n_feats) >= 2, F.filter(all_c, lambda c: c <= F.col(n_feats)))
    return sets.withColumn("n_components", F.explode_outer(fit))


def best_per_feature_count(tuning: DataFrame, keys: list[str], score: str, rest: list[str]) -> DataFrame:
    """Row with the highest (negated) score for each feature count; the largest ``rest`` (penalty) wins ties.

    A feature count without any score is dropped, except the smallest one.
    """
    by = [*keys, "feat_n"]
    best = tuning.groupBy(*by).agg(F.max(F.struct(score, *rest)).alias("__b"))
    small = tuning.groupBy(*keys).agg(F.min("feat_n").alias("__least"))
    out = best.join(broadcast_if_small(small), keys).filter(F.col(f"__b.{score}").isNotNull() | (F.col("feat_n") == F.col("__least")))
    return out.select(*by, f"__b.{score}", *[f"__b.{c}" for c in rest])


def each_feature_count(df: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """A row for every feature count 1..n of each key, null where there is no score."""
    wanted = keys.withColumn("feat_n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint"))))
    return wanted.join(df, [*keys.columns, "feat_n"], "left")


def param_summary(df: DataFrame, keys: list[str], params: list[str], n: int) -> DataFrame:
    """Feature counts 1..n with one column per tuned parameter (rows: feat_n, param, param_value)."""
    wide = df.groupBy(*keys, "feat_n").agg(*[F.first(F.when(F.col("param") == p, F.col("param_value")), True).alias(p) for p in params])
    return each_feature_count(wide, df.select(*keys).distinct(), n)


def mode_share(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value and its share of all rows (missing values count in the total)."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    known = F.col(value).isNotNull()
    out = counts.groupBy(*keys).agg(
        F.max(F.when(known, F.struct(F.col("__c"), (-F.col(value)).alias("__v")))).alias("__b"), F.sum("__c").alias("__n")
    )
    return out.select(*keys, (-F.col("__b.__v")).alias("mode"), (F.col("__b.__c") / F.col("__n")).alias("share"))


def wide_by_feature_count(df: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """Columns 1..n of a value, one row per key."""
    return df.groupBy(*keys).pivot("feat_n", list(range(1, n + 1))).agg(F.first(value))


def parse_int_list(text: str | Column) -> Column:
    """Printed array such as ``[ 3 17\\n 20]`` to an array of integers."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+)"), 1), lambda x: x.cast("bigint"))


def parse_param(text: str | Column, name: str) -> Column:
    """Value of one parameter in a printed dictionary, as text."""
    return F.nullif(F.regexp_extract(text, rf"['\"](?:\w+__)?{name}['\"]\s*:\s*'?([^,'}}]+)", 1), F.lit(""))
