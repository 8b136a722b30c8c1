"""Study tables derived from the given tables, in Spark and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import GRID, SHORT_NAMES, decode, settings_text
from ..operators.order import following, ranked

WL = tuple(400.0 + 8.0 * k for k in range(64))
STEPS = GRID.steps


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(col: Column | str) -> Column:
    return F.round(col, 6) + F.lit(0.0)


def micros(col: str) -> Column:
    return F.unix_micros(F.col(col).cast("timestamp"))


def _refl() -> Column:
    return F.transform("embedding", lambda e: F.lit(0.5) + F.lit(0.5) * e.cast("double")).alias("refl")


def _text(col: Column) -> Column:
    return col.cast("string")


def _mod(a: Column, n: int) -> Column:
    return (a % n).cast("bigint")


def pixels(spark: SparkSession, d: str) -> DataFrame:
    e, image = table(spark, d, "embeddings"), F.col("vec_id") % 50
    return e.select(
        image.alias("image_id"),
        F.concat(F.lit("s"), _text(image % 3)).alias("study"),
        F.concat(F.lit("2024010"), _text(1 + image % 5)).alias("date"),
        image.alias("plot_id"),
        F.col("vec_id").alias("pixel_id"),
        (F.col("vec_id") % 32).alias("x"),
        F.floor(F.col("vec_id") / 32).alias("y"),
        _refl(),
    )


def spectra(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.concat(F.lit("s"), _text(F.col("label") % 3)).alias("study"),
        F.concat(F.lit("2024010"), _text(1 + F.col("label") % 5)).alias("date"),
        F.col("vec_id").alias("plot_id"),
        _refl(),
    )


def ground(spark: SparkSession, d: str) -> DataFrame:
    e, p = table(spark, d, "embeddings"), table(spark, d, "part")
    y = 50 + 40 * (F.col("embedding")[5].cast("double") - F.col("embedding")[20].cast("double")) + 0.001 * F.col("p_retailprice")
    return e.join(p, e.vec_id == p.p_partkey).select(
        F.concat(F.lit("s"), _text(F.col("label") % 3)).alias("study"),
        F.concat(F.lit("2024010"), _text(1 + F.col("label") % 5)).alias("date"),
        F.col("vec_id").alias("plot_id"),
        F.col("p_type").alias("trt"),
        F.col("p_size").cast("double").alias("rate"),
        F.col("p_brand").alias("growth_stage"),
        F.when(F.col("vec_id") % 17 != 0, y).alias("y"),
    )


def ground_image(spark: SparkSession, d: str) -> DataFrame:
    image = F.col("plot_id") % 50
    g = ground(spark, d).groupBy(image.alias("plot_id")).agg(F.avg("y").alias("y"))
    return g.select(
        F.concat(F.lit("s"), _text(F.col("plot_id") % 3)).alias("study"),
        F.concat(F.lit("2024010"), _text(1 + F.col("plot_id") % 5)).alias("date"),
        "plot_id", "y",
    )


METRICS = ["MAE", "RMSE", "R2"]


def runs(spark: SparkSession, d: str) -> DataFrame:
    """One row per run record, addressed to a scenario."""
    return table(spark, d, "lineitem").select(
        (F.col("l_partkey") % 648).alias("grid_idx"),
        F.col("l_quantity").cast("bigint").alias("feat_n"),
        F.col("l_linestatus").alias("response"),
        F.col("l_returnflag").alias("model"),
        F.element_at(F.array(*[F.lit(m) for m in METRICS]), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("metric"),
        F.sqrt("l_extendedprice").alias("value"),
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").cast("bigint").alias("line"),
    )


def scores(spark: SparkSession, d: str) -> DataFrame:
    keys = ["grid_idx", "feat_n", "response", "model", "metric"]
    return runs(spark, d).groupBy(*keys).agg(F.avg("value").alias("value"))


def named_scores(spark: SparkSession, d: str) -> DataFrame:
    return decode(scores(spark, d), names=SHORT_NAMES)


def factorial(spark: SparkSession, d: str) -> DataFrame:
    cells = runs(spark, d).groupBy("grid_idx", "metric").agg(F.avg("value").alias("value"))
    return decode(cells)


def chains(spark: SparkSession, d: str) -> DataFrame:
    """Parameter traces: one row per run of a chain, numbered in time order."""
    e = table(spark, d, "events").select(
        (F.col("user_id") % 4).alias("chain"),
        F.col("event_id"),
        micros("ts").alias("at"),
        F.col("value").alias("like1"),
        (F.get_json_object("props", "$.k").cast("double") / 5).alias("like2"),
        F.col("user_id").cast("double").alias("par_user"),
        F.hour("ts").cast("double").alias("par_hour"),
        F.get_json_object("props", "$.k").cast("double").alias("par_k"),
    )
    return ranked(e, ["chain"], ["at", "event_id"], out="idx").drop("at")


def run_log(spark: SparkSession, d: str) -> DataFrame:
    """One timed step per event; the duration is the gap to the user's next event."""
    e = table(spark, d, "events").select(
        F.col("user_id").alias("scenario"), F.col("event_type").alias("step"), "event_id", micros("ts").alias("at")
    )
    timed = following(e, ["scenario"], ["at", "event_id"], "at", "next_at")
    return timed.select("scenario", "step", "event_id", ((F.col("next_at") - F.col("at")) / 1e6).alias("duration"))


# --- the same tables as SQL ------------------------------------------------

_IMG, _LAB = "(vec_id % 50)", "label"
_DECODE = ", ".join(f"(grid_idx // {k}) % {len(GRID.settings[s])} AS {s}" for s, k in GRID.strides().items())


def _names_case(step: str, names: list) -> str:
    quoted = lambda n: "NULL" if n is None else "'" + n.replace("'", "''") + "'"
    cases = " ".join(f"WHEN {i} THEN {quoted(n)}" for i, n in enumerate(names))
    return f"CASE (grid_idx // {GRID.strides()[step]}) % {len(names)} {cases} END AS {step}"


_NAMED = ", ".join(_names_case(s, SHORT_NAMES[s]) for s in STEPS)
TEXTS_SQL = ", ".join(_names_case(s, settings_text()[s]) for s in STEPS)

_MCARI2 = (
    "1.5 * (2.5 * (r800 - r670) - 1.3 * (r800 - r550)) / "
    "sqrt(pow(2 * r800 + 1, 2) - (6 * r800 - 5 * sqrt(r670)) - 0.5)"
)
# name -> (views it reads, body)
_SQL: dict[str, tuple[list[str], str]] = {
    "px": ([], f"""SELECT vec_id AS pixel_id, {_IMG} AS image_id, 's' || ({_IMG} % 3) AS study,
        '2024010' || (1 + {_IMG} % 5) AS date, {_IMG} AS plot_id, vec_id % 32 AS x, vec_id // 32 AS y,
        list_transform(embedding, lambda e: 0.5 + 0.5 * CAST(e AS DOUBLE)) AS refl FROM embeddings"""),
    "px_long": (["px"], """SELECT pixel_id, image_id, study, date, plot_id, k AS band, 400.0 + 8.0 * k AS wl, r
        FROM (SELECT pixel_id, image_id, study, date, plot_id, unnest(refl) AS r, unnest(range(64)) AS k FROM px)"""),
    "spectra": ([], f"""SELECT 's' || ({_LAB} % 3) AS study, '2024010' || (1 + {_LAB} % 5) AS date, vec_id AS plot_id,
        list_transform(embedding, lambda e: 0.5 + 0.5 * CAST(e AS DOUBLE)) AS refl FROM embeddings"""),
    "ground": ([], f"""SELECT 's' || ({_LAB} % 3) AS study, '2024010' || (1 + {_LAB} % 5) AS date, vec_id AS plot_id,
        p_type AS trt, CAST(p_size AS DOUBLE) AS rate, p_brand AS growth_stage,
        CASE WHEN vec_id % 17 <> 0 THEN 50 + 40 * (CAST(embedding[6] AS DOUBLE) - CAST(embedding[21] AS DOUBLE))
          + 0.001 * p_retailprice END AS y
        FROM embeddings JOIN part ON vec_id = p_partkey"""),
    "ground_image": (["ground"], """SELECT 's' || (plot_id % 50 % 3) AS study, '2024010' || (1 + plot_id % 50 % 5) AS date,
        plot_id % 50 AS plot_id, avg(y) AS y FROM ground GROUP BY plot_id % 50"""),
    "px_idx": (["px"], f"""SELECT *, {_MCARI2} AS mcari2,
          (nir - red) / (nir + red) AS ndi
        FROM (SELECT *, refl[51] AS r800, refl[35] AS r670, refl[20] AS r550,
          (refl[48] + refl[49] + refl[50] + refl[51]) / 4 AS nir, (refl[33] + refl[34] + refl[35] + refl[36]) / 4 AS red,
          (refl[20] + refl[21]) / 2 AS green FROM px)"""),
    "runs": ([], """SELECT l_partkey % 648 AS grid_idx, CAST(l_quantity AS BIGINT) AS feat_n, l_linestatus AS response,
        l_returnflag AS model, CASE l_linenumber % 3 WHEN 0 THEN 'MAE' WHEN 1 THEN 'RMSE' ELSE 'R2' END AS metric,
        sqrt(l_extendedprice) AS value, l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) AS line FROM lineitem"""),
    "scores": (["runs"], """SELECT grid_idx, feat_n, response, model, metric, avg(value) AS value FROM runs
        GROUP BY grid_idx, feat_n, response, model, metric"""),
    "named_scores": (["scores"], f"SELECT grid_idx, feat_n, response, model, metric, value, {_NAMED} FROM scores"),
    "factorial": (["runs"], f"""SELECT grid_idx, metric, value, {_DECODE} FROM
        (SELECT grid_idx, metric, avg(value) AS value FROM runs GROUP BY grid_idx, metric)"""),
    "chains": ([], """SELECT user_id % 4 AS chain, event_id, value AS like1,
        CAST(json_extract_string(props, '$.k') AS DOUBLE) / 5 AS like2, CAST(user_id AS DOUBLE) AS par_user,
        CAST(hour(ts) AS DOUBLE) AS par_hour, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS par_k,
        row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS idx FROM events"""),
    "run_log": ([], """SELECT user_id AS scenario, event_type AS step, event_id,
        row_number() OVER w AS pos,
        date_diff('microsecond', ts, lead(ts) OVER w) / 1e6 AS duration FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""),
}
DECODE_SQL, NAMED_SQL = _DECODE, _NAMED


def sql(body: str, *views: str, **extra: str) -> str:
    """``body`` after the views it reads; ``extra`` adds query-local ones after them."""
    order: list[str] = []

    def need(name: str) -> None:
        for dep in _SQL[name][0]:
            need(dep)
        if name not in order:
            order.append(name)

    for v in views:
        need(v)
    parts = [f"{v} AS ({_SQL[v][1]})" for v in order] + [f"{k} AS ({v})" for k, v in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
