"""Pixel tables: cropping, masking and reduction to mean spectra."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bands as B
from .grid import Grid
from .order import broadcast_if_small, exact_percentiles, largest_group, null_safe_join, summary


_INSIDE = """
    aggregate(sequence(0, size(xs) - 1), 0, (n, i) -> n + CASE
      WHEN (ys[i] > y) <> (ys[(i + 1) % size(ys)] > y)
       AND x < (xs[(i + 1) % size(xs)] - xs[i]) * (y - ys[i]) / (ys[(i + 1) % size(ys)] - ys[i]) + xs[i]
      THEN 1 ELSE 0 END) % 2 = 1"""
# Squared distance to the nearest point of each edge.
_EDGE = """
    array_min(transform(transform(sequence(0, size(xs) - 1), i -> named_struct(
        'ax', x - xs[i], 'ay', y - ys[i], 'bx', xs[(i + 1) % size(xs)] - xs[i], 'by', ys[(i + 1) % size(ys)] - ys[i])),
      e -> pow(e.ax - e.bx * least(greatest(coalesce(try_divide(e.ax * e.bx + e.ay * e.by, e.bx * e.bx + e.by * e.by), 0D), 0D), 1D), 2D)
         + pow(e.ay - e.by * least(greatest(coalesce(try_divide(e.ax * e.bx + e.ay * e.by, e.bx * e.bx + e.by * e.by), 0D), 0D), 1D), 2D)))"""
#: Pixels of one tile that one task matches with plots when plots are not sent to every task.
TILE_ROWS = 1_000_000


def crop_to_plots(pixels: DataFrame, plots: DataFrame, keys: list[str] | None = None, tile: float = 8.0, buffer: float = 0.0) -> DataFrame:
    """Pixels inside plot polygons (columns plot, xs, ys of the ring, and ``keys`` of the image).

    Each plot is listed under the square tiles its box touches, so the match is
    an equality join on image and tile: an image meets its own plots only. The even-odd
    ring test runs on the matches. With a ``buffer`` a pixel must also be that far from
    every edge of the ring. Where plots are too many to be sent to every task, tiles
    with more than ``TILE_ROWS`` pixels are dealt to several.
    """
    keys = keys or []
    lo, hi = (lambda c: F.array_min(c) + buffer), (lambda c: F.array_max(c) - buffer)
    span = lambda c: F.sequence(F.floor(lo(c) / tile), F.floor(hi(c) / tile))
    boxed = plots.filter((lo("xs") <= hi("xs")) & (lo("ys") <= hi("ys"))).withColumns(
        {"x0": lo("xs"), "x1": hi("xs"), "y0": lo("ys"), "y1": hi("ys")}
    )
    by = [*keys, "tx", "ty"]
    tiles = boxed.withColumn("tx", F.explode(span("xs"))).withColumn("ty", F.explode(span("ys")))
    tagged = pixels.withColumns({"tx": F.floor(F.col("x") / tile), "ty": F.floor(F.col("y") / tile)})
    small = broadcast_if_small(tiles)
    if small is tiles:
        hot = tagged.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TILE_ROWS)
        hot = broadcast_if_small(hot.select(*by, F.ceil(F.col("n") / TILE_ROWS).cast("int").alias("__parts")))
        part = F.coalesce(F.col("__parts"), F.lit(1))
        tagged = tagged.join(hot, by, "left").withColumn("__part", F.pmod(F.xxhash64("x", "y"), part).cast("int")).drop("__parts")
        small = tiles.join(hot, by, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), part - 1))).drop("__parts")
        by = [*by, "__part"]
    near = tagged.join(small, by).filter("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1").filter(F.expr(_INSIDE))
    if buffer > 0:
        near = near.filter(F.expr(_EDGE) >= buffer * buffer)
    return near.drop("tx", "ty", "__part", "x0", "x1", "y0", "y1", "xs", "ys")


def crop_subsets(df: DataFrame, dropped: list[tuple[str, str]]) -> DataFrame:
    """Remove the (study, date) sets that have no image of the chosen panel."""
    keep = F.lit(True)
    for study, date in dropped:
        keep = keep & ~((F.col("study") == study) & (F.col("date") == date))
    return df.filter(keep)


@dataclass(frozen=True)
class Route:
    """Which plots the images of a study, and of a year if one is named, are cut with."""

    study: str
    plots: str
    method: str
    year: int | None = None


def crop_routes(sheet: DataFrame, routes: list[Route], dropped: list[tuple[str, str]]) -> DataFrame:
    """Crop instructions with their plot set (``plots``) and cutting ``method``.

    The (study, date) sets in ``dropped`` have no image of the chosen panel; they go, as
    do rows that no route takes. The first route that fits counts.
    """
    plots, method = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(routes):
        fits = F.col("study") == r.study
        if r.year is not None:
            fits = fits & (F.year(F.to_date("date", "yyyyMMdd")) == r.year)
        plots, method = F.when(fits, r.plots).otherwise(plots), F.when(fits, r.method).otherwise(method)
    return crop_subsets(sheet, dropped).withColumns({"plots": plots, "method": method}).filter("plots IS NOT NULL")


@dataclass(frozen=True)
class Mask:
    """One masking rule on an index column; ``side`` names what is masked."""

    value: str
    pctl: tuple[float, ...]
    side: str

    def keeps(self, pctl: Column, probs: list[float]) -> Column:
        """Condition for a pixel to stay. Upper keeps ``>``, lower ``<=``: the sides are complements."""
        at = [pctl[probs.index(p / 100)] for p in self.pctl]
        v = F.col(self.value)
        if self.side == "lower":
            return v > at[0]
        if self.side == "upper":
            return v <= at[0]
        between = (v > at[0]) & (v <= at[1])
        return between if self.side == "outside" else ~between


def _thresholds(pixels: DataFrame, keys: list[str], masks: list[Mask]):
    probs = sorted({p / 100 for m in masks for p in m.pctl})
    values = sorted({m.value for m in masks})
    return probs, exact_percentiles(pixels, keys, values, probs)


def mask(pixels: DataFrame, keys: list[str], masks: list[Mask]) -> DataFrame:
    """Pixels kept by every rule; thresholds come from the unmasked image."""
    probs, limits = _thresholds(pixels, keys, masks)
    joined = pixels.join(broadcast_if_small(limits), keys)
    keep = F.lit(True)
    for m in masks:
        keep = keep & m.keeps(F.col(f"{m.value}_pctl"), probs)
    return joined.filter(keep).drop(*[f"{v}_pctl" for v in {m.value for m in masks}])


def mean_spectrum(pixels: DataFrame, keys: list[str], column: str = "refl") -> DataFrame:
    """Mean spectrum and pixel count per image; partial sums are built before the shuffle."""
    stats = Summarizer.metrics("mean", "count").summary(array_to_vector(F.col(column)))
    return (
        pixels.groupBy(*keys)
        .agg(stats.alias("s"))
        .select(*keys, F.col("s.count").alias("n_pixels"), vector_to_array("s.mean").alias(column))
    )


BM_PROBS = [0.1, 0.25, 0.5, 0.75, 0.9, 0.95]


def bandmath_stats(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distribution of an index per image before masking."""
    pct = exact_percentiles(pixels, keys, [value], BM_PROBS, extra=summary(value))
    cols = [F.col(f"{value}_pctl")[i].alias(f"pctl_{int(100 * p)}th") for i, p in enumerate(BM_PROBS)]
    return pct.select(*keys, "n", "mean", "std", "min", "max", *cols)


def prefix_table(level: dict, wl) -> B.BandTable:
    """Clip, smooth and bin settings of a scenario as one coefficient table."""
    t = B.identity(wl)
    if level["clip"]:
        t = t.then(B.clip(level["clip"]["wl_bands"]))
    if level["smooth"]:
        t = t.then(B.savgol(level["smooth"]["window_size"], level["smooth"]["order"]))
    if level["bin"]:
        b = level["bin"]
        t = t.then(B.mimic(b["sensor"]) if b["method"] == "spectral_mimic" else B.resample(b["bandwidth"]))
    return t


def _steps(segment: dict):
    """Masking steps of a segment setting as (index, percentiles, side)."""
    if not isinstance(segment["method"], list):
        pctl = segment["mask_percentile"]
        return [(segment["method"], tuple(pctl) if isinstance(pctl, list) else (pctl,), segment["mask_side"])]
    methods = [tuple(m) if isinstance(m, list) else m for m in segment["method"]]
    return [(m, (p,), s) for m, p, s in zip(methods, segment["mask_percentile"], segment["mask_side"])]


class _MaskPlan:
    """Distinct band rows, indices and masks needed by a set of scenarios.

    Different prefixes often give the same index or keep the same pixels (no
    segmentation always does); each is worked out once.
    """

    def __init__(self, grid: Grid, indices: list[int], wl):
        self.rows: list[np.ndarray] = []
        self.index_keys: list[tuple] = []
        self.masks: list[tuple] = []
        self.tables: list[B.BandTable] = []
        self.use: dict[int, tuple[int, int]] = {}  # scenario -> (mask, table)
        tags: list[tuple] = []
        for g in indices:
            level = grid.level(g)
            tag = tuple(str(level[s]) for s in ("clip", "smooth", "bin"))
            if tag not in tags:
                tags.append(tag)
                self.tables.append(prefix_table(level, wl))
            t = tags.index(tag)
            steps = _steps(level["segment"]) if level["segment"] else []
            mask = tuple((self._index(self.tables[t], m), p, s) for m, p, s in steps)
            self.use[g] = (self._place(self.masks, mask), t)
        self.probs = sorted({p / 100 for mask in self.masks for _, ps, _ in mask for p in ps})

    @staticmethod
    def _place(items: list, item) -> int:
        if item not in items:
            items.append(item)
        return items.index(item)

    def _row(self, row: np.ndarray) -> int:
        for i, r in enumerate(self.rows):
            if np.allclose(r, row, rtol=0, atol=1e-14):
                return i
        self.rows.append(row)
        return len(self.rows) - 1

    def _index(self, table: B.BandTable, method) -> int:
        if method == "ndi":
            rows = [B.mean_row(table, 770, 800), B.mean_row(table, 650, 680)]
        elif method == "mcari2":
            rows = [B.pick_row(table, w) for w in (800, 670, 550)]
        else:
            rows = [B.mean_row(table, *method)]
        kind = method if isinstance(method, str) else "mean"
        return self._place(self.index_keys, (kind, *[self._row(r) for r in rows]))

    def values(self, refl: np.ndarray) -> np.ndarray:
        """Index values, pixels x indices. Summed per row, so a pixel gets equal bits in any batch."""
        r = np.einsum("nk,mk->nm", refl, np.array(self.rows).reshape(-1, refl.shape[1]), optimize=False)
        out = np.empty((len(refl), len(self.index_keys)))
        with np.errstate(all="ignore"):
            for i, (kind, *at) in enumerate(self.index_keys):
                x = [r[:, a] for a in at]
                if kind == "ndi":
                    out[:, i] = (x[0] - x[1]) / (x[0] + x[1])
                elif kind == "mcari2":
                    root = (2 * x[0] + 1) ** 2 - (6 * x[0] - 5 * np.sqrt(x[1])) - 0.5
                    out[:, i] = 1.5 * (2.5 * (x[0] - x[1]) - 1.3 * (x[0] - x[2])) / np.sqrt(root)
                else:
                    out[:, i] = x[0]
        return np.where(np.isfinite(out), out, np.nan)

    def kept(self, values: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """Pixels x masks; ``limits`` is pixels x indices x probs."""
        keep = np.ones((len(values), len(self.masks)), bool)
        for j, mask in enumerate(self.masks):
            for i, pctl, side in mask:
                v, lim = values[:, i], [limits[:, i, self.probs.index(p / 100)] for p in pctl]
                if side == "lower":
                    keep[:, j] &= v > lim[0]
                elif side == "upper":
                    keep[:, j] &= v <= lim[0]
                else:
                    keep[:, j] &= ((v > lim[0]) & (v <= lim[1])) == (side == "outside")
        return keep


def scenario_spectra(
    pixels: DataFrame, keys: list[str], grid: Grid, indices: list[int], wl, derivatives: tuple[int, ...] = (1, 2, 3)
) -> DataFrame:
    """Mean and derivative spectra of many scenarios from two scans of the pixels.

    The linear steps commute with the mean, so pixels only need the index values
    of each distinct clip/smooth/bin prefix. Raw spectra are averaged under
    every distinct mask at once, as partial sums per batch, and each scenario's
    coefficient table is applied to one mean spectrum per image. ``indices``
    share the panel and crop levels of the pixels given.
    """
    plan, width = _MaskPlan(grid, indices, wl), len(wl)
    n_idx, n_probs = len(plan.index_keys), len(plan.probs)
    rows = pixels.select(*keys, "refl")
    key_fields = [rows.schema[k] for k in keys]
    joined = rows
    if n_idx:
        names = [f"i{k}" for k in range(n_idx)]
        schema = T.StructType(key_fields + [T.StructField(n, T.DoubleType()) for n in names])

        def measure(batches):
            for b in batches:
                v = plan.values(B.list_matrix(b.column(len(keys)), width))
                cols = [pa.array(v[:, i], from_pandas=True) for i in range(n_idx)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *cols], names=schema.names)

        limits = exact_percentiles(
            rows.mapInArrow(measure, schema), keys, names, plan.probs, largest=largest_group(pixels, keys)
        )
        nan = F.array_repeat(F.lit(float("nan")), n_probs)
        limits = limits.select(*keys, F.flatten(F.array(*[F.coalesce(f"{n}_pctl", nan) for n in names])).alias("limits"))
        # Images without any index value keep their place: unmasked scenarios still need them.
        joined = null_safe_join(rows, broadcast_if_small(limits), keys, "left")
        unknown = F.array_repeat(F.lit(float("nan")), n_idx * n_probs)
        joined = joined.withColumn("limits", F.coalesce("limits", unknown))
    schema = T.StructType(
        key_fields
        + [T.StructField("mask", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("total", T.ArrayType(T.DoubleType()))]
    )

    def partial(batches):
        for b in batches:
            if not b.num_rows:
                continue
            refl = B.list_matrix(b.column(len(keys)), width)
            if n_idx:
                limits = B.list_matrix(b.column(len(keys) + 1), n_idx * n_probs).reshape(-1, n_idx, n_probs)
                keep = plan.kept(plan.values(refl), limits)
            else:
                keep = np.ones((len(refl), len(plan.masks)), bool)
            for row, at in B.batch_groups(b, keys):
                k = keep[at].astype(float)
                counts = k.sum(axis=0).astype(np.int64)
                used = np.flatnonzero(counts)
                if not len(used):
                    continue
                repeat = pa.array(np.full(len(used), row))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[b.column(i).take(repeat) for i in range(len(keys))],
                        pa.array(used.astype(np.int32)), pa.array(counts[used]), B.matrix_list(k[:, used].T @ refl[at]),
                    ],
                    names=schema.names,
                )

    sums = joined.mapInArrow(partial, schema).groupBy(*keys, "mask").agg(
        F.sum("n").alias("n_pixels"), Summarizer.metrics("sum").summary(array_to_vector("total")).alias("s")
    )
    means = sums.select(
        *keys, "mask", "n_pixels", F.transform(vector_to_array("s.sum"), lambda v: v / F.col("n_pixels")).alias("refl")
    )
    orders = (0, *derivatives)
    maps = [
        {o: (t.weights if o == 0 else B.derivative(o)(t.wavelengths).weights @ t.weights) for o in orders} for t in plan.tables
    ]
    feat = {0: "reflectance", **{o: f"derivative_{o}" for o in derivatives}}
    users: dict[int, list[tuple[int, int]]] = {}
    for g, (m, t) in plan.use.items():
        users.setdefault(m, []).append((g, t))
    out = T.StructType(
        key_fields
        + [T.StructField("grid_idx", T.LongType()), T.StructField("n_pixels", T.LongType())]
        + [T.StructField("feat", T.StringType()), T.StructField("refl", T.ArrayType(T.DoubleType()))]
    )

    def finish(batches):
        for b in batches:
            mask, raw = b.column(len(keys)).to_numpy(), B.list_matrix(b.column(len(keys) + 2), width)
            for m in np.unique(mask):
                at = np.flatnonzero(mask == m)
                take = pa.array(at)
                lead = [b.column(i).take(take) for i in range(len(keys))]
                for g, t in users[int(m)]:
                    for o in orders:
                        yield pa.RecordBatch.from_arrays(
                            [
                                *lead, pa.array(np.full(len(at), g)), b.column(len(keys) + 1).take(take),
                                pa.array([feat[o]] * len(at), pa.string()), B.matrix_list(raw[at] @ maps[t][o].T),
                            ],
                            names=out.names,
                        )

    return means.mapInArrow(finish, out)


def all_scenarios(
    pixels: DataFrame, keys: list[str], grid: Grid, wl, panels: list[Column], crops: list[Column],
    derivatives: tuple[int, ...] = (1, 2, 3), done: DataFrame | None = None, within: list[int] | None = None,
) -> DataFrame:
    """Spectra of every scenario of the grid from the pixels of all panel and crop settings.

    ``panels`` and ``crops`` have a condition per level: which pixels the setting has.
    The first two steps are branches; a pixel goes once to each branch it belongs to,
    and within a branch all scenarios share their prefixes, indices and masks as in
    ``scenario_spectra``. ``done`` are results that are stored already: an image whose
    scenarios of a branch are all there is left out before its pixels are read further,
    and no scenario of an image comes out twice. ``within`` names the scenarios of a
    branch that are wanted, all by default.
    """
    per = grid.size // (len(panels) * len(crops))
    wanted = list(range(per)) if within is None else within
    branches = [F.when(p & c, F.lit(i * len(crops) + j).cast("bigint")) for i, p in enumerate(panels) for j, c in enumerate(crops)]
    rows = pixels.select(*keys, "refl", F.explode(F.array_compact(F.array(*branches))).alias("branch"))
    if done is not None:
        have = done.select(*keys, "grid_idx").filter((F.col("grid_idx") % per).isin(wanted)).distinct()
        whole = have.groupBy(*keys, F.floor(F.col("grid_idx") / per).alias("branch")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= len(wanted))
        rows = rows.join(broadcast_if_small(whole.select(*keys, "branch")), [*keys, "branch"], "left_anti")
    found = scenario_spectra(rows, [*keys, "branch"], grid, wanted, wl, derivatives)
    found = found.withColumn("grid_idx", F.col("branch") * per + F.col("grid_idx")).drop("branch")
    return found if done is None else found.join(have, [*keys, "grid_idx"], "left_anti")
