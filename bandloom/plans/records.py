"""Queries over scans, run bookkeeping and the scenario grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bookkeeping as K
from ..operators import grid as G
from ..operators import pixels as P
from ..operators.order import broadcast_if_small
from ..sources import sinks, tables as S
from ..streaming import ingest as I
from . import views as V
from .registry import query
from .spectral import indexed, rounded_stats

_SHEETS = ["s0", "s1", "s2"]


@query(
    "scan_ground",
    V.sql("SELECT study, date, plot_id, trt, rate, growth_stage, round(y, 6) AS y FROM ground WHERE y IS NOT NULL", "ground"),
)
def scan_ground(s, d):
    """One CSV sheet per study, read back by the scan."""
    dashed = F.concat_ws("-", F.substring("date", 1, 4), F.substring("date", 5, 2), F.substring("date", 7, 2))
    rates = [F.col("rate").alias(f"rate_n_{k}_kgha") for k in ("pp", "sd_plan", "total")]
    g = V.ground(s, d).select("study", dashed.alias("date_image"), "plot_id", "trt", *rates, "growth_stage", F.col("y").alias("biomass_kgha"))
    folder = sinks.scratch(s, "sheets")
    for n in _SHEETS:
        g.filter(F.col("study") == n).write.option("header", True).csv(f"{folder}/{n}")
    out = S.scan_ground(s, [f"{folder}/{n}" for n in _SHEETS])
    return out.select("study", "date", "plot_id", "trt", F.col("rate_n_total_kgha").alias("rate"), "growth_stage", V.r6("biomass_kgha").alias("y"))


@query(
    "scan_spectra",
    V.sql(
        """SELECT study, date, plot_id, CAST(len(refl) AS BIGINT) AS n_bands, round(refl[1], 6) AS first_band, round(refl[64], 6) AS last_band,
        round(list_sum(refl), 6) AS total FROM spectra""",
        "spectra",
    ),
)
def scan_spectra(s, d):
    """Spectra of all studies, stored by scenario and feature set and scanned partition by partition."""
    number = F.substring("study", 2, 1).cast("int")
    folder = sinks.scratch(s, "spectra")
    sinks.append(V.spectra(s, d).withColumns({"grid_idx": number, "feat": F.lit("reflectance")}), folder, ["grid_idx", "feat"])
    parts = [S.scan_spectra(s, folder, grid_idx=k, feat="reflectance") for k in range(3)]
    total = F.aggregate("refl", F.lit(0.0), lambda a, x: a + x)
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(
        "study", "date", "plot_id", F.size("refl").cast("bigint").alias("n_bands"), V.r6(F.col("refl")[0]).alias("first_band"),
        V.r6(F.col("refl")[63]).alias("last_band"), V.r6(total).alias("total"),
    )


@query(
    "scan_bandmath_stats",
    V.sql(
        """SELECT study, date, plot_id, count(*) AS n, round(quantile_cont(mcari2, 0.1), 6) AS pctl_10th
        FROM px_idx GROUP BY study, date, plot_id""",
        "px_idx",
    ),
)
def scan_bandmath_stats(s, d):
    st = P.bandmath_stats(indexed(s, d), ["study", "date", "plot_id"], "mcari2")
    return st.select("study", "date", "plot_id", "n", V.r6("pctl_10th").alias("pctl_10th"))


@query(
    "scan_crop_sheet",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, CAST(year(o_orderdate) AS BIGINT) AS year,
    o_orderstatus || '/' || o_orderpriority AS directory FROM orders""",
)
def scan_crop_sheet(s, d):
    o = V.table(s, d, "orders").withColumn("date_text", F.date_format("o_orderdate", "yyyy-MM-dd"))
    sheet = S.crop_sheet(o, "date_text", ["o_orderstatus", "o_orderpriority"])
    return sheet.select("o_orderkey", F.col("date").cast("string").alias("date"), F.year("date").cast("bigint").alias("year"), "directory")


def image_names(s, d):
    name = F.concat(
        F.lit("study_"), "o_orderstatus", F.lit("_date_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_plot_"), F.col("o_orderkey").cast("string")
    )
    return V.table(s, d, "orders").select("o_orderkey", name.alias("fname"))


@query(
    "parse_image_key",
    """SELECT o_orderkey, o_orderstatus AS study, strftime(o_orderdate, '%Y%m%d') AS date, o_orderkey AS plot_id FROM orders""",
)
def parse_image_key(s, d):
    return S.image_key(image_names(s, d)).select("o_orderkey", "study", "date", "plot_id")


@query(
    "wide_bands_to_long",
    V.sql("SELECT plot_id, k AS band, round(r, 6) AS value FROM (SELECT plot_id, unnest(refl) AS r, unnest(range(64)) AS k FROM spectra)", "spectra"),
)
def wide_bands_to_long(s, d):
    wide = V.spectra(s, d).select("plot_id", *[F.col("refl")[k].alias(str(k)) for k in range(64)])
    return S.wide_to_long(wide).withColumn("value", V.r6("value"))


@query("file_inventory")
def file_inventory(s, d):
    files = S.file_inventory(s, d, "*.parquet")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", S.readable_size(F.col("length")).alias("size"))


_EXPECT = "CASE WHEN grid_idx < 324 THEN 90 ELSE 95 END"


@query(
    "completeness_check",
    V.sql(
        f"""SELECT g AS grid_idx, expected, coalesce(n, 0) AS processed, coalesce(n, 0) >= expected AS complete FROM
        (SELECT g, CAST(CASE WHEN g < 324 THEN 90 ELSE 95 END AS BIGINT) AS expected FROM range(648) r(g))
        LEFT JOIN (SELECT grid_idx, count(*) AS n FROM runs GROUP BY grid_idx) ON g = grid_idx""",
        "runs",
    ),
)
def completeness_check(s, d):
    expected = G.GRID.all_indices(s).withColumn("expected", F.expr(_EXPECT).cast("bigint"))
    return K.completeness(V.runs(s, d), expected, ["grid_idx"])


@query(
    "missed_items",
    "SELECT 'plot_' || o_orderkey AS stem FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def missed_items(s, d):
    plot = lambda c, tail: F.concat(F.lit("plot_"), F.col(c).cast("string"), F.lit(tail))
    asked = V.table(s, d, "orders").select(S.key_stem(plot("o_orderkey", "")).alias("stem"))
    made = V.table(s, d, "lineitem").select(S.key_stem(plot("l_orderkey", "-clip-mean.spec")).alias("stem"))
    return K.missed(asked, made, "stem")


@query(
    "first_gap_index",
    """SELECT min(i) AS first_gap FROM (SELECT l_orderkey + 1 AS i FROM lineitem WHERE l_orderkey >= 5 UNION SELECT 5)
    WHERE i NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def first_gap_index(s, d):
    return K.first_gap(V.table(s, d, "lineitem"), "l_orderkey", 5)


@query(
    "scenario_completion",
    V.sql(
        """SELECT g AS grid_idx, coalesce(n, 0) AS n_done FROM range(648) r(g) LEFT JOIN
        (SELECT grid_idx, count(*) AS n FROM (SELECT DISTINCT grid_idx, response, model, line FROM runs) GROUP BY grid_idx) ON g = grid_idx
        WHERE coalesce(n, 0) <> 28""",
        "runs",
    ),
)
def scenario_completion(s, d):
    return K.incomplete_scenarios(V.runs(s, d), G.GRID.all_indices(s), "grid_idx", ["response", "model", "line"], 28)


@query(
    "n_observations_log",
    V.sql("SELECT grid_idx, response, model, count(*) AS obs_n FROM runs GROUP BY grid_idx, response, model", "runs"),
)
def n_observations_log(s, d):
    """Counts of every run appended to a log, scenario by scenario group; a group run again replaces its rows."""
    folder = sinks.scratch(s, "observations")
    counts = K.observation_counts(V.runs(s, d), ["grid_idx", "response", "model"])
    for part in (F.col("grid_idx") < 400, F.col("grid_idx") >= 300):
        K.append_log(counts.filter(part).withColumn("batch", F.floor(F.col("grid_idx") / 100).cast("int")), folder, ["batch"])
    return sinks.load(s, folder).drop("batch")


@query(
    "step_timing_summary",
    V.sql(
        """SELECT step, count(duration) AS n, round(sum(duration), 3) AS total, round(avg(duration), 3) AS mean,
        round(max(duration), 3) AS longest FROM run_log GROUP BY step""",
        "run_log",
    ),
)
def step_timing_summary(s, d):
    out = K.step_durations(V.run_log(s, d), ["step"])
    return out.select("step", "n", *[F.round(c, 3).alias(c) for c in ("total", "mean", "longest")])


@query("append_sink", V.sql("SELECT response, metric, count(*) AS n FROM scores GROUP BY response, metric", "scores"))
def append_sink(s, d):
    """Scores appended twice under the same keys: the second run replaces the first."""
    path = sinks.scratch(s, "scores")
    rows = V.scores(s, d).select("response", "model", "metric", "grid_idx", "feat_n", "value")
    sinks.append(rows, path, ["response", "metric"])
    sinks.append(rows.filter("response = 'O'"), path, ["response", "metric"])
    return sinks.load(s, path).groupBy("response", "metric").agg(F.count(F.lit(1)).alias("n"))


@query("result_store", V.sql("SELECT CAST(date AS INTEGER) AS date, count(*) AS n, round(avg(y), 6) AS mean_y FROM ground WHERE study = 's1' AND y IS NOT NULL GROUP BY date", "ground"))
def result_store(s, d):
    """Joined observations stored per study and date, one study read back."""
    path = sinks.scratch(s, "joined")
    sinks.append(V.ground(s, d).dropna(subset=["y"]), path, ["study", "date"])
    return sinks.load(s, path, study="s1").groupBy("date").agg(F.count(F.lit(1)).alias("n"), V.r6(F.avg("y")).alias("mean_y"))


@query(
    "incremental_ingest",
    "SELECT event_type, count(DISTINCT event_id) AS n, count(DISTINCT event_id) AS n_distinct FROM events GROUP BY event_type",
)
def incremental_ingest(s, d):
    """Events streamed in twice with repeated records; each is stored once."""
    base, schema = sinks.scratch(s, "ingest"), V.table(s, d, "events").schema
    stream = I.stream_records(s, d, schema, "events.parquet")
    doubled = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    I.ingest(doubled, ["event_id"], "ts", f"{base}/out", f"{base}/state")
    I.ingest(doubled, ["event_id"], "ts", f"{base}/out", f"{base}/state")
    return s.read.parquet(f"{base}/out").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_distinct")
    )


_ROLES = [("like", "like1"), ("like", "like2"), ("par", "par_user"), ("par", "par_hour"), ("par", "par_k")]


@query(
    "scan_run_results",
    V.sql(
        " UNION ALL ".join(f"SELECT chain, idx, '{r}' AS role, '{c}' AS name, round({c}, 6) AS value FROM chains" for r, c in _ROLES), "chains"
    ),
)
def scan_run_results(s, d):
    out = S.scan_run_results(V.chains(s, d), ["chain", "idx"])
    return out.withColumn("value", V.r6("value"))


# --- scenario grid ----------------------------------------------------------

_COUNTED = "SELECT grid_idx, count(*) AS n_runs FROM runs GROUP BY grid_idx"


def counted(s, d):
    return V.runs(s, d).groupBy("grid_idx").agg(F.count(F.lit(1)).alias("n_runs"))


@query(
    "scenario_grid",
    V.sql(
        f"SELECT grid_idx, {V.NAMED_SQL}, n_runs FROM (SELECT g AS grid_idx, coalesce(n_runs, 0) AS n_runs FROM range(648) r(g) LEFT JOIN c ON g = c.grid_idx)",
        "runs",
        c=_COUNTED,
    ),
)
def scenario_grid(s, d):
    full = G.GRID.all_indices(s).join(broadcast_if_small(counted(s, d)), "grid_idx", "left")
    return G.decode(full.fillna(0, ["n_runs"]), names=G.SHORT_NAMES)


def texts(s, d):
    """Run counts per scenario with the settings as exported text."""
    return G.decode(counted(s, d), names=G.settings_text())


_TEXTS = f"SELECT grid_idx, n_runs, {V.TEXTS_SQL} FROM c"


@query(
    "grid_level_counts",
    V.sql(
        "SELECT " + ", ".join(f"count(DISTINCT coalesce({c}, 'none')) AS n_{c}" for c in V.STEPS) + " FROM t",
        "runs", c=_COUNTED, t=_TEXTS,
    ),
)
def grid_level_counts(s, d):
    return G.level_counts(texts(s, d), V.STEPS)


def parsed(s, d):
    return texts(s, d).withColumns({c: G.parse_setting(F.col(c)) for c in ("clip", "smooth", "bin", "segment")})


_J = lambda c: f"CAST(replace(replace({c}, '''', '\"'), 'None', 'null') AS JSON)"


@query(
    "parse_settings",
    V.sql(
        f"""SELECT grid_idx, n_runs, CAST(json_array_length({_J('clip')}, '$.wl_bands') AS BIGINT) AS n_ranges,
        CAST(json_extract_string({_J('clip')}, '$.wl_bands[1][0]') AS DOUBLE) AS second_low,
        CAST(json_extract_string({_J('smooth')}, '$.window_size') AS BIGINT) AS window_size,
        json_extract_string({_J('bin')}, '$.sensor') AS sensor,
        CAST(json_extract_string({_J('bin')}, '$.bandwidth') AS DOUBLE) AS bandwidth,
        replace(json_extract_string({_J('segment')}, '$.method'), ' ', '') AS method FROM t""",
        "runs", c=_COUNTED, t=_TEXTS,
    ),
)
def parse_settings(s, d):
    return parsed(s, d).select(
        "grid_idx", "n_runs", F.expr("CASE WHEN clip IS NOT NULL THEN CAST(size(clip.wl_bands) AS BIGINT) END").alias("n_ranges"),
        F.col("clip.wl_bands")[1][0].alias("second_low"), F.col("smooth.window_size").cast("bigint").alias("window_size"),
        "bin.sensor", "bin.bandwidth", F.regexp_replace("segment.method", " ", "").alias("method"),
    )


_LABELS = {
    "clip": ["clip_none", "clip_ends", "clip_all"],
    "smooth": ["smooth_none", "smooth_window_11"],
    "bin": ["bin_none", "bin_mimic_sentinel_2a", "bin_resample_20nm"],
    "segment": [
        "seg_none", "seg_ndi_50_upper", "seg_ndi_50_lower", "seg_mcari2_50_upper", "seg_mcari2_50_lower", "seg_mcari2_90_upper",
        "seg_mcari2_50_75_between", "seg_mcari2_75_95_between", "seg_mcari2_90_upper_green_75_upper",
    ],
}


@query(
    "scenario_labels",
    V.sql(
        "SELECT grid_idx, n_runs, "
        + ", ".join(
            f"CASE grid_idx // {G.GRID.strides()[c]} % {len(n)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(n)) + f" END AS {c}_type"
            for c, n in _LABELS.items()
        )
        + " FROM c",
        "runs",
        c=_COUNTED,
    ),
)
def scenario_labels(s, d):
    return G.scenario_labels(parsed(s, d)).select("grid_idx", "n_runs", *[f"{c}_type" for c in _LABELS])


@query(
    "scenario_slice",
    V.sql("SELECT grid_idx, count(*) AS n FROM runs WHERE grid_idx >= 162 AND grid_idx < 324 GROUP BY grid_idx", "runs"),
)
def scenario_slice(s, d):
    return G.scenario_slice(V.runs(s, d), 162, 324).groupBy("grid_idx").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prefix_rollup",
    V.sql(
        f"""SELECT {', '.join(V.STEPS)}, sum(n) AS n_rows, count(*) AS n_scenarios,
        CAST({' + '.join(f'(1 - grouping({c}))' for c in V.STEPS)} AS BIGINT) AS depth FROM
        (SELECT {', '.join(V.STEPS)}, CAST(count(*) AS BIGINT) AS n FROM (SELECT {V.DECODE_SQL} FROM runs) GROUP BY ALL)
        GROUP BY ROLLUP ({', '.join(V.STEPS)})""",
        "runs",
    ).replace("sum(n)", "CAST(sum(n) AS BIGINT)"),
)
def prefix_rollup(s, d):
    out = G.prefix_rollup(G.decode(V.runs(s, d)), V.STEPS)
    return out.select(*[F.col(c).cast("bigint").alias(c) for c in V.STEPS], "n_rows", "n_scenarios", F.col("depth").cast("bigint").alias("depth"))


@query("rename_scenarios", V.sql(f"SELECT grid_idx, n_runs, {V.NAMED_SQL} FROM c", "runs", c=_COUNTED))
def rename_scenarios(s, d):
    return G.rename_levels(texts(s, d))


@query(
    "scenario_filter",
    V.sql(
        """SELECT grid_idx, feat_n, round(value, 6) AS value FROM scores
        WHERE response = 'O' AND model = 'N' AND metric = 'RMSE' AND feat_n IS NOT NULL""",
        "scores",
    ),
)
def scenario_filter(s, d):
    out = K.scenario_filter(V.scores(s, d), present="feat_n", response="O", model="N", metric="RMSE")
    return out.select("grid_idx", "feat_n", V.r6("value").alias("value"))
