"""The scenario grid: a full factorial addressed by mixed-radix index."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .order import broadcast_if_small

# The processing settings in grid order (first step varies slowest).
_NDI = {"method": "ndi", "wl1": [770, 800], "wl2": [650, 680]}
_MCARI2 = {"method": "mcari2", "wl1": [800], "wl2": [670], "wl3": [550]}
SETTINGS: dict[str, list[Any]] = {
    "dir_panels": ["ref_closest_panel", "ref_all_panels"],
    "crop": ["crop_plot", "crop_buf"],
    "clip": [
        None,
        {"wl_bands": [[0, 420], [880, 1000]]},
        {"wl_bands": [[0, 420], [760, 776], [813, 827], [880, 1000]]},
    ],
    "smooth": [None, {"window_size": 11, "order": 2}],
    "bin": [
        None,
        {"method": "spectral_mimic", "sensor": "sentinel-2a"},
        {"method": "spectral_resample", "bandwidth": 20},
    ],
    "segment": [
        None,
        {**_NDI, "mask_percentile": 50, "mask_side": "lower"},
        {**_NDI, "mask_percentile": 50, "mask_side": "upper"},
        {**_MCARI2, "mask_percentile": 50, "mask_side": "lower"},
        {**_MCARI2, "mask_percentile": 50, "mask_side": "upper"},
        {**_MCARI2, "mask_percentile": 90, "mask_side": "lower"},
        {**_MCARI2, "mask_percentile": [50, 75], "mask_side": "outside"},
        {**_MCARI2, "mask_percentile": [75, 95], "mask_side": "outside"},
        {
            "method": ["mcari2", [545, 565]], "wl1": [[800], [None]], "wl2": [[670], [None]],
            "wl3": [[550], [None]], "mask_percentile": [90, 75], "mask_side": ["lower", "lower"],
        },
    ],
}
# Short level names used in result tables, in the same order.
SHORT_NAMES = {
    "dir_panels": ["closest", "all"],
    "crop": ["plot_bounds", "buffer"],
    "clip": ["none", "ends", "all"],
    "smooth": ["none", "sg-11"],
    "bin": ["none", "sentinel-2a_mimic", "bin_20nm"],
    "segment": [
        "none", "ndi_upper_50", "ndi_lower_50", "mcari2_upper_50", "mcari2_lower_50",
        "mcari2_upper_90", "mcari2_in_50-75", "mcari2_in_75-95", "mcari2_upper_90_green_upper_75",
    ],
}
# The side kept when the named side is masked.
KEPT_SIDE = {"lower": "upper", "upper": "lower", "outside": "between", "between": "outside"}


@dataclass(frozen=True)
class Grid:
    """Factor levels in order; ``grid_idx`` is the position in their product."""

    settings: dict[str, list[Any]]

    @property
    def steps(self) -> list[str]:
        return list(self.settings)

    @property
    def size(self) -> int:
        return self.strides()[self.steps[0]] * len(self.settings[self.steps[0]])

    def strides(self) -> dict[str, int]:
        out, stride = {}, 1
        for step in reversed(self.steps):
            out[step] = stride
            stride *= len(self.settings[step])
        return {step: out[step] for step in self.steps}

    def digit(self, step: str, idx: Column | str = "grid_idx") -> Column:
        """Level number of one step, by arithmetic on the index."""
        idx = F.col(idx) if isinstance(idx, str) else idx
        return (F.floor(idx / self.strides()[step]) % len(self.settings[step])).cast("int")

    def level(self, idx: int) -> dict[str, Any]:
        """Settings of one scenario on the driver."""
        return {s: self.settings[s][idx // k % len(self.settings[s])] for s, k in self.strides().items()}

    def all_indices(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.size).withColumnRenamed("id", "grid_idx")


GRID = Grid(SETTINGS)


def decode(df: DataFrame, grid: Grid = GRID, names: dict[str, list[str]] | None = None) -> DataFrame:
    """Add one column per step from ``grid_idx``: level number, or its name when given.

    Names are looked up in a constant array, so no join and no product is run.
    """
    cols = {}
    for step in grid.steps:
        digit = grid.digit(step)
        cols[step] = digit if names is None else F.element_at(F.array(*[F.lit(n) for n in names[step]]), digit + 1)
    return df.withColumns(cols)


def settings_of(idx: Column, grid: Grid = GRID, names: dict[str, list[str]] | None = None) -> Column:
    """Level names of a scenario's steps, in grid order, as one text."""
    names = SHORT_NAMES if names is None else names
    digits = [F.floor(idx / k).cast("int") % len(grid.settings[s]) for s, k in grid.strides().items()]
    return F.concat_ws("/", *[F.element_at(F.array(*[F.lit(n) for n in names[s]]), d + 1) for s, d in zip(grid.steps, digits)])


def join_grid(df: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with the settings of a stored grid of any run (one row per ``grid_idx``); scenarios that the grid lacks are left out."""
    return df.join(broadcast_if_small(table), "grid_idx")


def literal_text(setting: Any) -> str | None:
    """A setting in the text form kept in exported grids."""
    return setting if setting is None or isinstance(setting, str) else str(setting)


def settings_text(grid: Grid = GRID) -> dict[str, list[str | None]]:
    return {s: [literal_text(v) for v in levels] for s, levels in grid.settings.items()}


def level_counts(df: DataFrame, steps: list[str]) -> DataFrame:
    """Distinct levels per step; a missing setting counts as a level."""
    return df.agg(*[F.count_distinct(F.coalesce(F.col(s).cast("string"), F.lit("none"))).alias(f"n_{s}") for s in steps])


# One number or a list is read as text and split later; the rest maps directly.
SETTING_SCHEMA = (
    "method string, wl1 string, wl2 string, wl3 string, mask_percentile string, mask_side string, "
    "wl_bands array<array<double>>, window_size int, order int, sensor string, bandwidth double"
)


def parse_setting(text: Column) -> Column:
    """Exported setting text to a struct; null stays null (step off)."""
    json = F.regexp_replace(F.regexp_replace(text, "'", '"'), r"\bNone\b", "null")
    return F.from_json(json, SETTING_SCHEMA)


def _kept(side: Column) -> Column:
    out = F.lit(None).cast("string")
    for masked, kept in KEPT_SIDE.items():
        out = F.when(side == masked, F.lit(kept)).otherwise(out)
    return out


def _items(text: Column) -> Column:
    """Text of a number, name or flat list as an array of its items."""
    return F.split(F.regexp_replace(text, r'[\[\]"\s]', ""), ",")


def scenario_labels(df: DataFrame) -> DataFrame:
    """Add ``<step>_type`` labels from parsed setting structs (columns clip, smooth, bin, segment)."""
    ranges = F.size("clip.wl_bands")
    clip = (
        F.when(F.col("clip").isNull(), "clip_none").when(ranges == 2, "clip_ends").when(ranges == 4, "clip_all")
    )
    smooth = F.coalesce(F.concat(F.lit("smooth_window_"), F.col("smooth.window_size")), F.lit("smooth_none"))
    bins = (
        F.when(F.col("bin.method") == "spectral_mimic", F.concat(F.lit("bin_mimic_"), F.translate("bin.sensor", "-", "_")))
        .when(
            F.col("bin.method") == "spectral_resample",
            F.concat(F.lit("bin_resample_"), F.col("bin.bandwidth").cast("int"), F.lit("nm")),
        )
        .otherwise("bin_none")
    )
    method, pctl, side = (_items(F.col(f"segment.{f}")) for f in ("method", "mask_percentile", "mask_side"))
    second = F.when(F.element_at(method, 2) == "545", "green").when(F.element_at(method, 2) == "800", "nir")
    two_step = F.concat_ws(
        "_", F.lit("seg_mcari2"), pctl[0], _kept(side[0]), second, F.try_element_at(pctl, F.lit(2)),
        _kept(F.try_element_at(side, F.lit(2))),
    )
    between = F.concat_ws("_", F.lit("seg"), method[0], F.lit("between"), pctl[0], F.try_element_at(pctl, F.lit(2)), F.lit("pctl"))
    one_step = F.concat_ws("_", F.lit("seg"), method[0], F.array_join(pctl, "_"), _kept(side[0]))
    segment = (
        F.when(F.col("segment").isNull(), "seg_none")
        .when(F.size(method) == 1, one_step)
        .when(F.try_element_at(method, F.lit(2)) == "mcari2", between)
        .otherwise(two_step)
    )
    return df.withColumns({"clip_type": clip, "smooth_type": smooth, "bin_type": bins, "segment_type": segment})


def scenario_slice(df: DataFrame, idx_min: int, idx_max: int) -> DataFrame:
    """Rows of one job's index range, upper end excluded (pushed to the scan)."""
    return df.filter((F.col("grid_idx") >= idx_min) & (F.col("grid_idx") < idx_max))


def prefix_rollup(df: DataFrame, steps: list[str], measure: Column | None = None) -> DataFrame:
    """Rows and runs under every shared upstream product (prefix of the step order).

    Values are pre-aggregated to scenarios first, so the rollup expands at most
    one row per scenario instead of every input row.
    """
    cells = df.groupBy(*steps).agg((measure if measure is not None else F.count(F.lit(1))).alias("n"))
    depth = sum(1 - F.grouping(s) for s in steps)
    return cells.rollup(*steps).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_scenarios"), depth.cast("int").alias("depth")
    )


def rename_levels(df: DataFrame, grid: Grid = GRID, names: dict[str, list[str]] = SHORT_NAMES) -> DataFrame:
    """Exported setting text to short names; missing settings become the name of the off level."""
    texts = settings_text(grid)
    out = {}
    for step in grid.steps:
        pairs = [(F.lit(t), F.lit(n)) for t, n in zip(texts[step], names[step]) if t is not None]
        off = [n for t, n in zip(texts[step], names[step]) if t is None]
        lookup = F.create_map(*[x for p in pairs for x in p])
        value = F.coalesce(F.try_element_at(lookup, F.col(step)), F.col(step))
        out[step] = F.coalesce(value, F.lit(off[0] if off else "none"))
    return df.withColumns(out)
