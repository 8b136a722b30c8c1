"""Queries over pixel and spectrum tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions import indices as I
from ..operators import pixels as P
from ..operators.design import join_keys
from ..operators.grid import GRID
from ..operators.scores import best_fit_line
from . import views as V
from .registry import query

RAW = B.identity(V.WL)
CLIP_ENDS = GRID.settings["clip"][1]["wl_bands"]
CLIP_ALL = GRID.settings["clip"][2]["wl_bands"]


def long(df: DataFrame, *keys: str, column: str = "refl") -> DataFrame:
    """One row per band, values rounded."""
    return df.select(*keys, F.posexplode(column).alias("band", "value")).select(
        *keys, F.col("band").cast("bigint").alias("band"), V.r6("value").alias("value")
    )


def indexed(s, d) -> DataFrame:
    return V.pixels(s, d).withColumns(
        {"mcari2": I.mcari2(RAW), "ndi": I.ndi(RAW), "green": I.composite(RAW, 545, 565)}
    )


PLOTS = [  # (plot, ring): ten boxes and two polygons on the pixel grid
    *[(i, [(3.0 * i - 0.5, -0.5), (3.0 * i + 2.5, -0.5), (3.0 * i + 2.5, 40.5 + i), (3.0 * i - 0.5, 40.5 + i)]) for i in range(10)],
    (10, [(0.3, 0.2), (20.7, 3.1), (9.4, 14.6)]),
    (11, [(5.2, 1.1), (30.8, 1.3), (30.6, 50.9), (18.3, 6.7), (5.4, 50.2)]),
]
_EDGES = ", ".join(
    f"({p}, {ring[i][0]}, {ring[i][1]}, {ring[(i + 1) % len(ring)][0]}, {ring[(i + 1) % len(ring)][1]})"
    for p, ring in PLOTS
    for i in range(len(ring))
)


def plots(s, d) -> DataFrame:
    """The plots of every image; those of different images lie differently."""
    rings = F.array(*[F.struct(F.lit(p).cast("bigint").alias("plot"), *[F.array(*[F.lit(v[k]) for v in ring]).alias(c) for k, c in enumerate(("xs", "ys"))]) for p, ring in PLOTS])
    each = V.pixels(s, d).select("image_id").distinct().select("image_id", F.explode(rings).alias("r"))
    return each.select("image_id", "r.plot", F.transform("r.xs", lambda x: x + F.col("image_id") % 3).alias("xs"), "r.ys")


def _crop_sql(buffer: float) -> str:
    return V.sql(
        f"""SELECT plot, pixel_id, image_id FROM (
          SELECT plot, pixel_id, image_id, min(pow(ax - bx * t, 2) + pow(ay - by_ * t, 2)) AS near,
             count(*) FILTER ((y0 > y) <> (y1 > y) AND x < (x1 - x0) * (y - y0) / (y1 - y0) + x0) AS hits
          FROM (SELECT *, least(greatest((ax * bx + ay * by_) / (bx * bx + by_ * by_), 0), 1) AS t FROM
            (SELECT *, x - x0 AS ax, y - y0 AS ay, x1 - x0 AS bx, y1 - y0 AS by_ FROM
              (SELECT plot, pixel_id, image_id, x, y, x0 + image_id % 3 AS x0, y0, x1 + image_id % 3 AS x1, y1 FROM px CROSS JOIN edges)))
          GROUP BY plot, pixel_id, image_id)
        WHERE hits % 2 = 1 AND near >= {buffer * buffer}""",
        "px",
        edges=f"SELECT * FROM (VALUES {_EDGES}) e(plot, x0, y0, x1, y1)",
    )


@query("spatial_crop", _crop_sql(0.0))
def spatial_crop(s, d):
    return P.crop_to_plots(V.pixels(s, d), plots(s, d), ["image_id"]).select("plot", "pixel_id", "image_id")


@query("spatial_crop_buffer", _crop_sql(1.0))
def spatial_crop_buffer(s, d):
    return P.crop_to_plots(V.pixels(s, d), plots(s, d), ["image_id"], buffer=1.0).select("plot", "pixel_id", "image_id")


ROUTES = [P.Route("s0", "field_2024", "many", 2024), P.Route("s0", "field_2023", "many", 2023), P.Route("s1", "small", "single"), P.Route("s2", "whole", "many")]


@query(
    "crop_subsets",
    V.sql(
        """SELECT study, date, plots, method, count(*) AS n FROM (SELECT study, date,
          CASE WHEN study = 's0' AND year(strptime(date, '%Y%m%d')) = 2024 THEN 'field_2024' WHEN study = 's0' AND year(strptime(date, '%Y%m%d')) = 2023 THEN 'field_2023'
            WHEN study = 's1' THEN 'small' WHEN study = 's2' THEN 'whole' END AS plots,
          CASE WHEN study = 's1' THEN 'single' ELSE 'many' END AS method
        FROM px WHERE NOT (study = 's1' AND date = '20240102')) WHERE plots IS NOT NULL GROUP BY ALL""",
        "px",
    ),
)
def crop_subsets(s, d):
    """Images routed to the plots of their study and year, without the set that lacks the near panel."""
    routed = P.crop_routes(V.pixels(s, d), ROUTES, [("s1", "20240102")])
    return routed.groupBy("study", "date", "plots", "method").agg(F.count(F.lit(1)).alias("n"))


def _outside(ranges) -> str:
    return " AND ".join(f"NOT (wl BETWEEN {lo} AND {hi})" for lo, hi in ranges)


_RENUMBER = "row_number() OVER (PARTITION BY pixel_id ORDER BY band) - 1"


@query(
    "clip_bands",
    V.sql(f"SELECT pixel_id, {_RENUMBER} AS band, round(r, 6) + 0.0 AS value FROM px_long WHERE {_outside(CLIP_ALL)}", "px_long"),
)
def clip_bands(s, d):
    return long(B.apply_table(V.pixels(s, d), RAW.then(B.clip(CLIP_ALL))), "pixel_id")


def _savgol_sql(src: str, n: str = "64") -> str:
    # Degree-2 least squares on 11 points in orthogonal polynomials, evaluated off-centre at the ends.
    return f"""SELECT o.pixel_id, o.band, sum(i.r * (1.0 / 11 + o.u * (i.band - o.c) / 110.0
          + (o.u * o.u - 10) * ((i.band - o.c) * (i.band - o.c) - 10) / 858.0)) AS r
        FROM (SELECT pixel_id, band, least(greatest(band, 5), {n} - 6) AS c,
                band - least(greatest(band, 5), {n} - 6) AS u FROM {src}) o
        JOIN {src} i ON i.pixel_id = o.pixel_id AND i.band BETWEEN o.c - 5 AND o.c + 5
        GROUP BY o.pixel_id, o.band"""


@query("smooth_savgol", V.sql("SELECT pixel_id, band, round(r, 6) + 0.0 AS value FROM sg", "px_long", sg=_savgol_sql("px_long")))
def smooth_savgol(s, d):
    return long(B.apply_table(V.pixels(s, d), RAW.then(B.savgol(11, 2))), "pixel_id")


@query(
    "bin_resample",
    V.sql(
        """SELECT pixel_id, dense_rank() OVER (PARTITION BY pixel_id ORDER BY b) - 1 AS band, value FROM
        (SELECT pixel_id, floor((wl - 400) / 20) AS b, round(avg(r), 6) + 0.0 AS value FROM px_long GROUP BY ALL)""",
        "px_long",
    ),
)
def bin_resample(s, d):
    return long(B.apply_table(V.pixels(s, d), RAW.then(B.resample(20))), "pixel_id")


_S2 = ", ".join(f"({i}, {c}, {w})" for i, (c, w) in enumerate(B.SENTINEL_2A))


@query(
    "bin_mimic_sensor",
    V.sql(
        f"""SELECT pixel_id, CAST(b AS BIGINT) AS band, round(sum(w * r) / sum(w), 6) + 0.0 AS value FROM
        (SELECT pixel_id, b, r, exp(-0.5 * pow((wl - c) / (fwhm / (2 * sqrt(2 * ln(2.0)))), 2)) AS w
         FROM px_long CROSS JOIN (VALUES {_S2}) s(b, c, fwhm)) GROUP BY pixel_id, b""",
        "px_long",
    ),
)
def bin_mimic_sensor(s, d):
    return long(B.apply_table(V.pixels(s, d), RAW.then(B.mimic("sentinel-2a"))), "pixel_id")


# (order, rows of: first band, last band, {offset: weight}) on the even 8 nm grid
_STENCILS = {
    1: [(0, 0, {0: -1.5, 1: 2, 2: -0.5}), (1, 62, {-1: -0.5, 1: 0.5}), (63, 63, {0: 1.5, -1: -2, -2: 0.5})],
    2: [(0, 0, {0: 2, 1: -5, 2: 4, 3: -1}), (1, 62, {-1: 1, 0: -2, 1: 1}), (63, 63, {0: 2, -1: -5, -2: 4, -3: -1})],
    3: [
        (0, 0, {0: -2.5, 1: 9, 2: -12, 3: 7, 4: -1.5}), (1, 1, {-1: -1.5, 0: 5, 1: -6, 2: 3, 3: -0.5}),
        (2, 61, {-2: -0.5, -1: 1, 1: -1, 2: 0.5}),
        (62, 62, {1: 1.5, 0: -5, -1: 6, -2: -3, -3: 0.5}), (63, 63, {0: 2.5, -1: -9, -2: 12, -3: -7, -4: 1.5}),
    ],
}
_ST = ", ".join(
    f"({o}, {lo}, {hi}, {off}, {w})" for o, rows in _STENCILS.items() for lo, hi, ws in rows for off, w in ws.items()
)


def _derivative_sql(src: str, key: str) -> str:
    return f"""SELECT a.{key}, CAST(st.o AS BIGINT) AS ord, a.band, sum(st.w * b.r) / pow(8.0, st.o) AS r
        FROM {src} a JOIN (VALUES {_ST}) st(o, lo, hi, off, w) ON a.band BETWEEN st.lo AND st.hi
        JOIN {src} b ON b.{key} = a.{key} AND b.band = a.band + st.off GROUP BY a.{key}, st.o, a.band"""


@query(
    "spectral_derivative",
    V.sql("SELECT pixel_id, ord, band, round(r, 6) + 0.0 AS value FROM der", "px_long", der=_derivative_sql("px_long", "pixel_id")),
)
def spectral_derivative(s, d):
    tables = {o: RAW.then(B.derivative(o)) for o in (1, 2, 3)}
    return long(B.apply_tables(V.pixels(s, d).select("pixel_id", "refl"), tables, "ord"), "pixel_id", "ord")


@query("ndi", V.sql("SELECT pixel_id, image_id, round(ndi, 6) + 0.0 AS ndi FROM px_idx", "px_idx"))
def ndi(s, d):
    return indexed(s, d).select("pixel_id", "image_id", V.r6("ndi").alias("ndi"))


@query("mcari2", V.sql("SELECT pixel_id, image_id, round(mcari2, 6) + 0.0 AS mcari2 FROM px_idx", "px_idx"))
def mcari2(s, d):
    return indexed(s, d).select("pixel_id", "image_id", V.r6("mcari2").alias("mcari2"))


@query(
    "composite_band",
    V.sql(
        """SELECT pixel_id, round(avg(r) FILTER (wl BETWEEN 545 AND 565), 6) AS green,
        round(avg(r) FILTER (wl BETWEEN 800 AND 820), 6) AS nir FROM px_long GROUP BY pixel_id""",
        "px_long",
    ),
)
def composite_band(s, d):
    return V.pixels(s, d).select(
        "pixel_id", V.r6(I.composite(RAW, 545, 565)).alias("green"), V.r6(I.composite(RAW, 800, 820)).alias("nir")
    )


_TARGETS = [800, [670], [545, 565], [770.0, 800.0], 431.5]


@query(
    "wavelength_lookup",
    V.sql(
        """SELECT pixel_id, CAST(t AS BIGINT) AS target, arg_min(band, abs(wl - t) * 1000 + band) AS band,
        round(arg_min(r, abs(wl - t) * 1000 + band), 6) AS value
        FROM px_long CROSS JOIN (VALUES (800), (670), (555), (785), (431)) v(t) GROUP BY pixel_id, t""",
        "px_long",
    ),
)
def wavelength_lookup(s, d):
    wanted = [B.target_wavelength(t) for t in _TARGETS]
    picks = F.array(*[F.struct(F.lit(t).cast("bigint").alias("target"), F.lit(B.nearest(V.WL, t)).alias("band")) for t in wanted])
    return V.pixels(s, d).select("pixel_id", "refl", F.explode(picks).alias("p")).select(
        "pixel_id", "p.target", F.col("p.band").cast("bigint").alias("band"), V.r6(F.col("refl")[F.col("p.band")]).alias("value")
    )


def _masked_sql(where: str, *cols: str) -> str:
    """Pixels joined to per-image quantiles q_<index>_<pctl>."""
    return V.sql(
        f"SELECT p.image_id, pixel_id, round(p.mcari2, 6) AS mcari2 FROM px_idx p JOIN q USING (image_id) WHERE {where}",
        "px_idx",
        q=_QUANTILES,
    )


_QUANTILES = "SELECT image_id, " + ", ".join(
    f"quantile_cont({v}, {p / 100}) AS q_{v}_{p}" for v in ("mcari2", "ndi", "green") for p in (50, 75, 90, 95)
) + " FROM px_idx GROUP BY image_id"


def _masked(s, d, *masks):
    out = P.mask(indexed(s, d), ["image_id"], list(masks))
    return out.select("image_id", "pixel_id", V.r6("mcari2").alias("mcari2"))


@query("mask_percentile", _masked_sql("p.ndi > q_ndi_50"))
def mask_percentile(s, d):
    return _masked(s, d, P.Mask("ndi", (50,), "lower"))


@query("mask_percentile_upper", _masked_sql("p.mcari2 <= q_mcari2_50"))
def mask_percentile_upper(s, d):
    return _masked(s, d, P.Mask("mcari2", (50,), "upper"))


@query("mask_between", _masked_sql("p.mcari2 > q_mcari2_50 AND p.mcari2 <= q_mcari2_75"))
def mask_between(s, d):
    return _masked(s, d, P.Mask("mcari2", (50, 75), "outside"))


@query("mask_two_step", _masked_sql("p.mcari2 > q_mcari2_90 AND p.green > q_green_75"))
def mask_two_step(s, d):
    return _masked(s, d, P.Mask("mcari2", (90,), "lower"), P.Mask("green", (75,), "lower"))


_MEAN = "SELECT image_id, band, avg(r) AS r FROM px_long GROUP BY image_id, band"


@query("mean_spectrum", V.sql("SELECT image_id, band, round(r, 6) AS value FROM m", "px_long", m=_MEAN))
def mean_spectrum(s, d):
    return long(P.mean_spectrum(V.pixels(s, d), ["image_id"]), "image_id")


def _stats_sql() -> str:
    pcts = ", ".join(f"round(quantile_cont(mcari2, {p}), 6) AS pctl_{int(100 * p)}th" for p in P.BM_PROBS)
    return V.sql(
        f"""SELECT image_id, count(mcari2) AS n, round(avg(mcari2), 6) AS mean, round(stddev_samp(mcari2), 6) AS std,
        round(min(mcari2), 6) AS min, round(max(mcari2), 6) AS max, {pcts} FROM px_idx GROUP BY image_id""",
        "px_idx",
    )


def rounded_stats(s, d):
    st = P.bandmath_stats(indexed(s, d), ["image_id"], "mcari2")
    return st.select("image_id", "n", *[V.r6(c).alias(c) for c in st.columns if c not in ("image_id", "n")])


@query("bandmath_stats", _stats_sql())
def bandmath_stats(s, d):
    return rounded_stats(s, d)


# Which pixels a panel and a crop setting has; images without a near panel are missing from the first.
def panels():
    return [F.col("image_id") % 10 != 9, F.lit(True)]


def crops():
    return [F.lit(True), F.col("x").between(2, 29)]


_BRANCHES = " UNION ALL ".join(
    f"SELECT {2 * p + c} AS branch, pixel_id, image_id FROM px WHERE {pw} AND {cw}"
    for p, pw in enumerate(("image_id % 10 <> 9", "true"))
    for c, cw in enumerate(("true", "x BETWEEN 2 AND 29"))
)
# Two prefixes with the ends clipped: as they are, and in bins of 20 nm; all nine segments of both.
_KEEP = [
    "true", "ndi > q_ndi_50", "ndi <= q_ndi_50", "mcari2 > q_mcari2_50", "mcari2 <= q_mcari2_50", "mcari2 > q_mcari2_90",
    "mcari2 > q_mcari2_50 AND mcari2 <= q_mcari2_75", "mcari2 > q_mcari2_75 AND mcari2 <= q_mcari2_95",
    "mcari2 > q_mcari2_90 AND green > q_green_75",
]
_PREFIXES = {54: (57, 8.0), 72: (23, 20.0)}  # first scenario: bands, distance of bands
# Both grids are even, so the plain stencils apply.
_DER = """CASE WHEN band = 0 THEN -1.5 * r + 2 * n1 - 0.5 * n2 WHEN band = bands - 1 THEN 1.5 * r - 2 * p1 + 0.5 * p2 ELSE 0.5 * n1 - 0.5 * p1 END / wide"""


@query(
    "scenario_spectra",
    V.sql(
        f"""SELECT grid_idx, image_id, n_pixels, feat, band, round(value, 6) + 0.0 AS value FROM
        (SELECT grid_idx, image_id, n_pixels, band, 'reflectance' AS feat, r AS value FROM m
         UNION ALL SELECT grid_idx, image_id, n_pixels, band, 'derivative_1', {_DER} FROM
          (SELECT *, lead(r, 1) OVER w AS n1, lead(r, 2) OVER w AS n2, lag(r, 1) OVER w AS p1, lag(r, 2) OVER w AS p2
           FROM m JOIN (VALUES {", ".join(f"({b}, {n}, {h})" for b, (n, h) in _PREFIXES.items())}) v(base, bands, wide) USING (base)
           WINDOW w AS (PARTITION BY grid_idx, image_id ORDER BY band)))""",
        "px_idx",
        "px_long",
        br=_BRANCHES,
        t="""SELECT 54 AS base, pixel_id, band - 3 AS band, r FROM px_long WHERE band BETWEEN 3 AND 59
          UNION ALL SELECT 72, pixel_id, CAST(floor((wl - 424) / 20) AS BIGINT), avg(r) FROM px_long WHERE band BETWEEN 3 AND 59 GROUP BY ALL""",
        # Bins with their centre at 434 + 20 k: near infrared 774 and 794, red 654 and 674, green 554.
        bins="""SELECT pixel_id, max(r) FILTER (band = 18) AS r800, max(r) FILTER (band = 12) AS r670, max(r) FILTER (band = 6) AS r550,
          avg(r) FILTER (band IN (17, 18)) AS nir, avg(r) FILTER (band IN (11, 12)) AS red FROM t WHERE base = 72 GROUP BY pixel_id""",
        ix=f"""SELECT 54 AS base, pixel_id, mcari2, ndi, green FROM px_idx
          UNION ALL SELECT 72, pixel_id, {V._MCARI2}, (nir - red) / (nir + red), r550 FROM bins""",
        bi="SELECT base, branch, image_id, pixel_id, mcari2, ndi, green FROM br JOIN ix USING (pixel_id)",
        q="SELECT base, branch, image_id, " + ", ".join(f"quantile_cont({v}, {p / 100}) AS q_{v}_{p}" for v in ("mcari2", "ndi", "green") for p in (50, 75, 90, 95))
        + " FROM bi GROUP BY base, branch, image_id",
        kept=" UNION ALL ".join(
            f"SELECT CAST(branch * 162 + base + {g} AS BIGINT) AS grid_idx, base, image_id, pixel_id FROM bi JOIN q USING (base, branch, image_id) WHERE {c}"
            for g, c in enumerate(_KEEP)
        ),
        m="SELECT grid_idx, base, k.image_id, count(*) AS n_pixels, band, avg(r) AS r FROM kept k JOIN t USING (base, pixel_id) GROUP BY ALL",
    ),
)
def scenario_spectra(s, d):
    """All segments of two prefixes under every panel and crop setting, all images and bands."""
    out = P.all_scenarios(V.pixels(s, d), ["image_id"], GRID, V.WL, panels(), crops(), (1,), within=[b + k for b in _PREFIXES for k in range(9)])
    return long(out, "grid_idx", "image_id", "n_pixels", "feat")


@query("scenario_spectra_grid")
def scenario_spectra_grid(s, d):
    """All 648 scenarios, every image and band, reflectance and three derivatives, from two scans of the pixels."""
    out = P.all_scenarios(V.pixels(s, d), ["image_id"], GRID, V.WL, panels(), crops())
    return out.select("grid_idx", "image_id", "n_pixels", "feat", F.transform("refl", V.r6).alias("refl"))


_FLAGSHIP = V.sql(
    """SELECT count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept,
    round(regr_r2(y, x), 6) AS r2, round(sqrt(greatest(regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x), 0) / count(*)), 6) AS rmse
    FROM ground_image g JOIN (SELECT image_id, avg(refl[6]) AS x FROM px_idx JOIN q USING (image_id)
      WHERE mcari2 > q_mcari2_50 GROUP BY image_id) m ON g.plot_id = m.image_id WHERE y IS NOT NULL""",
    "px_idx",
    "ground_image",
    q=_QUANTILES,
)


@query("masked_mean_fit", _FLAGSHIP)
def masked_mean_fit(s, d):
    """Mean spectrum of the upper half of MCARI2 pixels against ground truth."""
    px = V.pixels(s, d).withColumn("mcari2", I.mcari2(RAW))
    kept = P.mask(px, ["image_id"], [P.Mask("mcari2", (50,), "lower")])
    means = P.mean_spectrum(kept, ["study", "date", "plot_id"])
    joined = join_keys(V.ground_image(s, d).dropna(subset=["y"]), means).withColumn("x", F.col("refl")[5])
    fit = best_fit_line(joined, [], measured="y", predicted="x")
    return fit.select("n", *[V.r6(c).alias(c) for c in ("slope", "intercept", "r2", "rmse")])
