"""Sensitivity of a score to the processing steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import md5_uniform, poisson_weight
from .grid import Grid
from .order import broadcast_if_small


def missing_cells(cells: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """Scenarios without a value, per key."""
    full = cells.select(*keys).distinct().withColumn("grid_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(grid.size - 1).cast("bigint"))))
    return full.join(cells.select(*keys, "grid_idx"), [*keys, "grid_idx"], "left_anti")


def variance_indices(cells: DataFrame, grid: Grid, keys: list[str], value: str = "value") -> DataFrame:
    """First and total order index of every step on a (near) complete factorial.

    S1 = Var(E[Y|x]) / Var(Y) and ST = 1 - Var(E[Y|all but x]) / Var(Y). A cell's
    "all but x" group is its index with the step's digit set to zero, so all
    twelve groupings are one aggregate over plain numbers.
    """
    parts = []
    for step, stride in grid.strides().items():
        digit = grid.digit(step).cast("bigint")
        parts.append(F.struct(F.lit(step).alias("step"), F.lit("S1").alias("__kind"), digit.alias("__cell")))
        parts.append(F.struct(F.lit(step).alias("step"), F.lit("ST").alias("__kind"), (F.col("grid_idx") - digit * stride).alias("__cell")))
    rows = cells.select(*keys, F.col(value).alias("__v"), F.explode(F.array(*parts)).alias("__g")).select(*keys, "__v", "__g.*")
    means = rows.groupBy(*keys, "step", "__kind", "__cell").agg(F.avg("__v").alias("__m"), F.count("__v").alias("__n"))
    mean = F.sum(F.col("__m") * F.col("__n")) / F.sum("__n")
    spread = means.groupBy(*keys, "step", "__kind").agg(
        (F.sum(F.col("__m") * F.col("__m") * F.col("__n")) / F.sum("__n") - mean * mean).alias("__between")
    )
    total = cells.groupBy(*keys).agg(F.var_pop(value).alias("__total"))
    ratio = F.try_divide(F.col("__between"), F.col("__total"))  # null where nothing varies
    pick = lambda k: F.max(F.when(F.col("__kind") == k, ratio))
    return spread.join(broadcast_if_small(total), keys).groupBy(*keys, "step").agg(pick("S1").alias("s1"), (1 - pick("ST")).alias("st"))


def sampled_indices(cells: DataFrame, grid: Grid, keys: list[str], n: int = 400, seed: int = 7818, value: str = "value") -> DataFrame:
    """Sampled first and total order indices.

    Two independent samples A and B of the levels, plus A with one step taken
    from B, are rounded to cells and looked up by an equality join.
    """
    sample = cells.sparkSession.range(n)
    levels = {s: len(v) for s, v in grid.settings.items()}

    def point(step: str, which: str) -> Column:
        # Rounding a uniform over [0, levels - 1]: the end levels get half weight.
        return F.round(md5_uniform(F.lit(f"{which}-{step}"), F.col("id"), F.lit(seed)) * (levels[step] - 1)).cast("bigint")

    strides = grid.strides()
    drawn = sample.select("id", *[point(s, w).alias(f"{w}_{s}") for w in "AB" for s in grid.steps])
    index = lambda use: sum(F.col(f"{use(s)}_{s}") * k for s, k in strides.items())
    kinds = [("A", index(lambda s: "A")), ("B", index(lambda s: "B"))]
    kinds += [(x, index(lambda s, x=x: "B" if s == x else "A")) for x in grid.steps]
    points = drawn.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("__kind"), i.alias("grid_idx")) for k, i in kinds])).alias("__p")).select("id", "__p.*")
    looked = broadcast_if_small(points).join(cells.select(*keys, "grid_idx", F.col(value).alias("__y")), "grid_idx")
    pick = lambda k: F.max(F.when(F.col("__kind") == k, F.col("__y")))
    wide = looked.groupBy(*keys, "id").agg(pick("A").alias("__ya"), pick("B").alias("__yb"), *[pick(s).alias(f"y_{s}") for s in grid.steps])
    parts = F.array(*[F.struct(F.lit(s).alias("step"), F.col(f"y_{s}").alias("__yi")) for s in grid.steps])
    rows = wide.select(*keys, "__ya", "__yb", F.explode(parts).alias("__s")).select(*keys, "__ya", "__yb", "__s.*")
    # Variance over both base samples from their sums.
    n2 = 2.0 * F.count("__ya")
    mean = (F.sum("__ya") + F.sum("__yb")) / n2
    var = (F.sum(F.col("__ya") * F.col("__ya")) + F.sum(F.col("__yb") * F.col("__yb"))) / n2 - mean * mean
    diff = F.col("__ya") - F.col("__yi")
    return rows.groupBy(*keys, "step").agg(
        F.try_divide(F.avg(F.col("__yb") * (F.col("__yi") - F.col("__ya"))), var).alias("s1"), F.try_divide(0.5 * F.avg(diff * diff), var).alias("st")
    )


def fast_indices(df: DataFrame, keys: list[str], params: list[str], like: str, idx: str = "idx", harmonics: int = 4) -> DataFrame:
    """Fourier amplitude indices from the runs of a frequency-sampled design.

    The runs fall into one block of N per parameter (rows left over at the end
    are ignored). S1 uses the first multiples of the base frequency
    floor((N-1)/(2 M)), ST the frequencies up to half of it; the total power
    follows from the variance.
    """
    d = len(params)
    size = df.groupBy(*keys).agg((F.floor(F.count(F.lit(1)) / d)).alias("N"))
    rows = df.join(broadcast_if_small(size), keys).withColumn("block", F.floor((F.col(idx) - 1) / F.col("N")))
    rows = rows.filter(F.col("block") < d).withColumn("t", (F.col(idx) - 1) % F.col("N"))
    by = [*keys, "block"]
    power = rows.groupBy(*by).agg(
        F.first("N").alias("N"), F.var_pop(like).alias("var"),
        F.sum(F.col(like) * F.when(F.col("t") % 2 == 0, 1.0).otherwise(-1.0)).alias("alt"),
    )
    # Frequencies 1 .. ceil(N/2)-1 hold half the variance; for even N the top one is left out.
    total = F.col("var") - F.when(F.col("N") % 2 == 0, F.pow(F.col("alt") / F.col("N"), F.lit(2.0))).otherwise(0.0)
    series = rows.select(*by, "N", "t", F.col(like).cast("double").alias("y"))
    parts = spectrum_sums(series, by, harmonics)
    name = F.element_at(F.array(*[F.lit(p) for p in params]), (F.col("block") + 1).cast("int"))
    scale = 2.0 / (F.col("N") * F.col("N"))
    return parts.join(broadcast_if_small(power), by).select(
        *keys, name.alias("param"), F.try_divide(F.col("base") * scale, total).alias("s1"), (1 - F.try_divide(F.col("low") * scale, total)).alias("st")
    )


def transform_shape(n: int, block: int) -> tuple[int, int, int, int]:
    """For a series of ``n`` values: rows and columns of its matrix, columns and rows to a group."""
    bits = max(int(2 * n - 1).bit_length(), 4)
    p1, p2 = 1 << (bits // 2), 1 << (bits - bits // 2)
    return p1, p2, min(max(block // p1, 1), p2), min(max(block // p2, 1), p1)


def _shape_columns(n: Column, block: int) -> tuple[Column, Column]:
    """Columns of a series' matrix and columns to a group, as ``transform_shape`` has them."""
    bits = F.greatest(F.length(F.bin(F.greatest(2 * n - 1, F.lit(0)).cast("bigint"))), F.lit(4))
    half = F.floor(bits / 2)
    p1, p2 = F.pow(F.lit(2.0), half).cast("bigint"), F.pow(F.lit(2.0), bits - half).cast("bigint")
    return p2, F.least(F.greatest(F.floor(F.lit(block) / p1), F.lit(1)), p2)


def spectrum_sums(series: DataFrame, by: list[str], harmonics: int, block: int = 1 << 16) -> DataFrame:
    """Power at the base frequency's multiples and below half of it, for every series (columns N, t, y).

    The discrete transform of any length N is a convolution with a chirp, taken
    by transforms of a power-of-two length P = P1 x P2 >= 2N. Each of those is
    done in two steps, along the columns and along the rows of a P1 x P2 matrix,
    so a series of any length is spread over the cluster in groups of about
    ``block`` values (or sqrt(P), if that is more) with three shuffles. P is that of
    the series itself: a long series does not pad the short ones next to it.
    """
    lead = [series.schema[c] for c in by] + [series.schema["N"]]
    names = [f.name for f in lead]
    wave = [T.StructField(c, T.DoubleType()) for c in ("ar", "ai", "br", "bi")]

    def chirp(t, n, sign):
        return np.exp(sign * 1j * np.pi * ((t * t) % (2 * n)) / n)

    def table(g: pa.Table, schema, *cols) -> pa.Table:
        cols = [np.asarray(c).ravel() for c in cols]
        row = pa.array(np.zeros(len(cols[0]), dtype=np.int64))
        return pa.table([g.column(c).take(row) for c in names] + [pa.array(c) for c in cols], names=schema.names)

    def grid(a, b):
        return np.broadcast_arrays(np.asarray(a, np.int64)[:, None], np.asarray(b, np.int64)[None, :])

    mid = T.StructType([*lead, T.StructField("g", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("n2", T.LongType()), *wave])

    def columns(g: pa.Table) -> pa.Table:
        # Values t = P2 n1 + n2 of some n2; the chirp is symmetric around 0 and padded with zeros.
        n = g.column("N")[0].as_py()
        p1, p2, wide, tall = transform_shape(n, block)
        p, lo = p1 * p2, g.column("g")[0].as_py() * wide
        n1, n2 = grid(np.arange(p1), np.arange(lo, lo + wide))
        g_rows = g.filter(g.column("t").is_valid())
        t, a = g_rows.column("t").to_numpy(), np.zeros((p1, wide), complex)
        a[t // p2, t % p2 - lo] = g_rows.column("y").to_numpy() * chirp(t, n, -1)
        near = np.minimum(n2 + p2 * n1, p - n2 - p2 * n1)
        b = np.where(near < n, chirp(near, n, 1), 0)
        turn = np.exp(-2j * np.pi * ((n2 * n1) % p) / p)
        a, b = np.fft.fft(a, axis=0) * turn, np.fft.fft(b, axis=0) * turn
        return table(g, mid, n1 // tall, n1, n2, a.real, a.imag, b.real, b.imag)

    back = T.StructType([*lead, T.StructField("g", T.LongType()), T.StructField("m1", T.LongType()), T.StructField("k1", T.LongType()), *wave[:2]])

    def rows(g: pa.Table) -> pa.Table:
        # Finish both transforms at k = k1 + P1 k2, multiply, start the way back.
        p1, p2, wide, tall = transform_shape(g.column("N")[0].as_py(), block)
        p, lo = p1 * p2, g.column("g")[0].as_py() * tall
        at = (g.column("k1").to_numpy() - lo, g.column("n2").to_numpy())
        a, b = np.zeros((tall, p2), complex), np.zeros((tall, p2), complex)
        a[at] = g.column("ar").to_numpy() + 1j * g.column("ai").to_numpy()
        b[at] = g.column("br").to_numpy() + 1j * g.column("bi").to_numpy()
        k1, m1 = grid(np.arange(lo, lo + tall), np.arange(p2))
        c = np.fft.ifft(np.fft.fft(a) * np.fft.fft(b)) * np.exp(2j * np.pi * ((k1 * m1) % p) / p)
        return table(g, back, m1 // wide, m1, k1, c.real, c.imag)

    done = T.StructType([*lead, T.StructField("base", T.DoubleType()), T.StructField("low", T.DoubleType())])

    def finish(g: pa.Table) -> pa.Table:
        n = g.column("N")[0].as_py()
        p1, p2, wide, _ = transform_shape(n, block)
        lo = g.column("g")[0].as_py() * wide
        c = np.zeros((p1, wide), complex)
        c[g.column("k1").to_numpy(), g.column("m1").to_numpy() - lo] = g.column("ar").to_numpy() + 1j * g.column("ai").to_numpy()
        m2, m1 = grid(np.arange(p1), np.arange(lo, lo + wide))
        k, pw = m1 + p2 * m2, np.abs(np.fft.ifft(c, axis=0)) ** 2
        w = (n - 1) // (2 * harmonics)
        base = pw[np.isin(k, [w * h for h in range(1, harmonics + 1)])].sum() if w else np.nan
        return table(g, done, [base], [pw[(k >= 1) & (k <= w // 2)].sum()])

    # Every group of columns takes part, also those a short series has no values in.
    p2, wide = _shape_columns(F.col("N"), block)
    groups = F.sequence(F.lit(0).cast("bigint"), F.floor(p2 / wide).cast("bigint") - 1)
    frame = series.select(*by, "N").distinct().withColumn("g", F.explode(groups)).withColumns(
        {"t": F.lit(None).cast("bigint"), "y": F.lit(None).cast("double")}
    )
    start = series.withColumn("g", F.floor(F.col("t") % p2 / wide)).unionByName(frame)
    first = start.groupBy(*by, "g").applyInArrow(columns, mid)
    second = first.groupBy(*by, "g").applyInArrow(rows, back)
    third = second.groupBy(*by, "g").applyInArrow(finish, done)
    return third.groupBy(*by).agg(F.sum("base").alias("base"), F.sum("low").alias("low"))


def elementary_effects(starts: DataFrame, cells: DataFrame, grid: Grid, keys: list[str], value: str = "value") -> DataFrame:
    """Effects of moving one step at a time along trajectories over the grid.

    ``starts`` has one row per trajectory with its first scenario in grid_idx.
    Step by step each digit moves to its next level (the last one back to the
    first); the effect is the change of the value per level. Trajectories with
    the same start take the same way, so they are counted first: the result has
    one row per start and step, ``n`` trajectories each.
    """
    counted = starts.groupBy("grid_idx").agg(F.count(F.lit(1)).alias("n"))
    moved, at = [], F.col("grid_idx")
    for step, stride in grid.strides().items():
        levels = len(grid.settings[step])
        digit = grid.digit(step).cast("bigint")
        delta = (digit + 1) % levels - digit
        nxt = at + delta * stride
        moved.append(F.struct(F.lit(step).alias("step"), at.alias("__from"), nxt.alias("__to"), delta.cast("double").alias("__delta")))
        at = nxt
    hops = counted.select(F.col("grid_idx").alias("start"), "n", F.explode(F.array(*moved)).alias("__h")).select("start", "n", "__h.*")
    y = broadcast_if_small(cells.select(*keys, "grid_idx", F.col(value).alias("__y")))
    a = y.withColumnsRenamed({"grid_idx": "__from", "__y": "__y0"})
    b = y.withColumnsRenamed({"grid_idx": "__to", "__y": "__y1"})
    joined = hops.join(a, "__from").join(b, [*keys, "__to"])
    return joined.select(*keys, "start", "step", "n", ((F.col("__y1") - F.col("__y0")) / F.col("__delta")).alias("effect"))


def morris(effects: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, mean absolute value and spread of the effects of each step."""
    n, e, total = F.col("n"), F.col("effect"), F.sum("n")
    mean = F.sum(n * e) / total
    var = F.try_divide(F.sum(n * e * e) - total * mean * mean, total - 1)
    return effects.groupBy(*keys, "step").agg(
        mean.alias("mu"), (F.sum(n * F.abs(e)) / total).alias("mu_star"), F.when(var.isNotNull(), F.sqrt(F.greatest(var, F.lit(0.0)))).alias("sigma")
    )


def bootstrap(
    units: DataFrame, unit: str, group: str, values: DataFrame, keys: list[str], value: str,
    resamples: int = 100, level: float = 0.95, seed: int = 7818,
) -> DataFrame:
    """Confidence interval of a mean by resampling units (Poisson weights).

    Each unit belongs to a ``group`` that fixes its value. Weights follow from the md5
    of unit, replicate and seed, so a rerun, on any engine, gives the same interval. They
    are added up per group and replicate before anything is shuffled or joined.
    """
    digest = F.md5(F.concat_ws("|", F.col(unit).cast("string"), F.col("__rep").cast("string"), F.lit(str(seed))))
    u = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(2.0**52)
    spread = units.select(unit, group).withColumn("__rep", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    weights = spread.groupBy(group, "__rep").agg(F.sum(poisson_weight(u)).alias("__w"))
    rows = weights.join(values, group)
    reps = rows.groupBy(*keys, "__rep").agg((F.sum(F.col(value) * F.col("__w")) / F.sum("__w")).alias("__m"))
    q = F.percentile("__m", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return reps.groupBy(*keys).agg(q.alias("__q"), F.avg("__m").alias("mean")).select(*keys, "mean", F.col("__q")[0].alias("low"), F.col("__q")[1].alias("high"))


def delta_indices(df: DataFrame, grid: Grid, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Moment-independent index: mean shift of the binned density given a step's level.

    Rows are counted by scenario and bin first; everything after works on those
    counts.
    """
    binned = df.groupBy(*keys, "grid_idx", F.expr(f"width_bucket({value}, {low}D, {high}D, {bins})").alias("__bin")).agg(F.count(F.lit(1)).alias("__c"))
    parts = F.array(*[F.struct(F.lit(s).alias("step"), grid.digit(s).alias("__lvl")) for s in grid.steps])
    rows = binned.select(*keys, "__bin", "__c", F.explode(parts).alias("__s")).select(*keys, "__bin", "__c", "__s.*")
    given = rows.groupBy(*keys, "step", "__lvl", "__bin").agg(F.sum("__c").alias("__c"))
    levels = given.groupBy(*keys, "step", "__lvl").agg(F.sum("__c").alias("__n_level"))
    overall = binned.groupBy(*keys, "__bin").agg(F.sum("__c").alias("__c_all"))
    total = binned.groupBy(*keys).agg(F.sum("__c").alias("__n_all"))
    # Every level against every bin of the overall density, also where the level has none.
    frame = levels.join(broadcast_if_small(overall), keys).join(broadcast_if_small(total), keys)
    cells = frame.join(given, [*keys, "step", "__lvl", "__bin"], "left")
    gap = F.abs(F.col("__c_all") / F.col("__n_all") - F.coalesce("__c", F.lit(0)) / F.col("__n_level"))
    per_level = cells.groupBy(*keys, "step", "__lvl").agg((0.5 * F.sum(gap)).alias("__shift"), F.first(F.col("__n_level") / F.col("__n_all")).alias("__p"))
    return per_level.groupBy(*keys, "step").agg(F.sum(F.col("__shift") * F.col("__p")).alias("delta"))


def sensitivity_rank(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Steps by ascending sum of an index, ranked from 0."""
    sums = df.groupBy(*keys, "step").agg(F.sum(index).alias("total"))
    # Six rows per key.
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy("total", "step")) - 1
    return sums.withColumn("position", pos.cast("bigint"))
