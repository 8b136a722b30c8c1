"""Queries over sensitivity indices and parameter traces."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import chains as C
from ..operators import sensitivity as Z
from ..operators.grid import GRID
from . import views as V
from .registry import query
from .results import rounded

r6 = V.r6
_STR = GRID.strides()
_LEVELS = {s: len(v) for s, v in GRID.settings.items()}


def _each_step(template: str) -> str:
    return " UNION ALL ".join(template.format(step=s, rest=", ".join(x for x in V.STEPS if x != s)) for s in V.STEPS)


_VAR = _each_step(
    """SELECT metric, '{step}' AS step, (SELECT var_pop(m) FROM (SELECT avg(value) AS m FROM factorial g WHERE g.metric = t.metric GROUP BY {step})) / tot AS s1,
    1 - (SELECT var_pop(m) FROM (SELECT avg(value) AS m FROM factorial g WHERE g.metric = t.metric GROUP BY {rest})) / tot AS st
    FROM (SELECT metric, var_pop(value) AS tot FROM factorial GROUP BY metric) t"""
)


def indices(s, d):
    return Z.variance_indices(V.factorial(s, d), GRID, ["metric"])


@query("variance_sensitivity", V.sql("SELECT metric, step, round(s1, 6) AS s1, round(st, 6) AS st FROM v", "factorial", v=_VAR))
def variance_sensitivity(s, d):
    return rounded(indices(s, d), "s1", "st")


@query(
    "missing_cells",
    V.sql(
        """SELECT source, g AS grid_idx FROM (SELECT DISTINCT source FROM c) k CROSS JOIN range(648) r(g)
        WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.source = k.source AND c.grid_idx = g)""",
        "runs",
        c="SELECT DISTINCT response || model || line AS source, grid_idx FROM runs",
    ),
)
def missing_cells(s, d):
    key = F.concat("response", "model", F.col("line").cast("string"))
    cells = V.runs(s, d).select(key.alias("source"), "grid_idx").distinct()
    return Z.missing_cells(cells, GRID, ["source"])


def _u(which: str, step: str) -> str:
    return f"CAST(concat('0x', substr(md5('{which}-{step}|' || id || '|7818'), 1, 8)) AS BIGINT) / 4294967296.0"


_DRAWS = "SELECT id, " + ", ".join(
    f"CAST(round({_u(w, s)} * {_LEVELS[s] - 1}) AS BIGINT) AS {w}_{s}" for w in "AB" for s in V.STEPS
) + " FROM range(400) r(id)"


def _idx(use) -> str:
    return " + ".join(f"{use(s)}_{s} * {k}" for s, k in _STR.items())


_SOBOL = " UNION ALL ".join(
    f"""SELECT metric, '{x}' AS step, avg(b.value * (c.value - a.value)) / var_both AS s1, 0.5 * avg(pow(a.value - c.value, 2)) / var_both AS st
    FROM d JOIN factorial a ON a.grid_idx = {_idx(lambda s: 'A')} JOIN factorial b USING (metric) JOIN factorial c USING (metric)
    JOIN vb USING (metric) WHERE b.grid_idx = {_idx(lambda s: 'B')} AND c.grid_idx = {_idx(lambda s, x=x: 'B' if s == x else 'A')} GROUP BY metric, var_both"""
    for x in V.STEPS
)
_VB = f"""SELECT metric, var_pop(value) AS var_both FROM
  (SELECT {_idx(lambda s: 'A')} AS grid_idx FROM d UNION ALL SELECT {_idx(lambda s: 'B')} FROM d) JOIN factorial USING (grid_idx) GROUP BY metric"""


@query(
    "sobol_sample_indices",
    V.sql("SELECT metric, step, round(s1, 6) AS s1, round(st, 6) AS st FROM z", "factorial", d=_DRAWS, vb=_VB, z=_SOBOL),
)
def sobol_sample_indices(s, d):
    return rounded(Z.sampled_indices(V.factorial(s, d), GRID, ["metric"]), "s1", "st")


PARAMS = ["user", "hour", "k"]


@query(
    "fast_sensitivity",
    V.sql(
        """SELECT chain, ['user', 'hour', 'k'][block + 1] AS param, round(sum(sp) FILTER (k IN (w, 2 * w, 3 * w, 4 * w)) / sum(sp), 6) AS s1,
        round(1 - coalesce(sum(sp) FILTER (k <= w // 2), 0) / sum(sp), 6) AS st FROM f GROUP BY chain, block""",
        "chains",
        b="""SELECT chain, (idx - 1) // n AS block, (idx - 1) % n AS t, n, (n - 1) // 8 AS w, like1 FROM
          (SELECT *, count(*) OVER (PARTITION BY chain) // 3 AS n FROM chains) WHERE (idx - 1) // n < 3""",
        f="""SELECT chain, block, w, k, pow(sum(like1 * cos(2 * pi() * ((k * t) % n) / n)), 2) + pow(sum(like1 * sin(2 * pi() * ((k * t) % n) / n)), 2) AS sp
          FROM b JOIN (SELECT unnest(range(1, 20000)) AS k) ON k < (n + 1) // 2 GROUP BY chain, block, w, k""",
    ),
)
def fast_sensitivity(s, d):
    return rounded(Z.fast_indices(V.chains(s, d), ["chain"], PARAMS, "like1"), "s1", "st")


def starts(s, d):
    """One trajectory per order."""
    return V.table(s, d, "orders").select(F.col("o_orderkey").alias("traj"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 648).alias("grid_idx"))


def effects(s, d):
    return Z.elementary_effects(starts(s, d), V.factorial(s, d), GRID, ["metric"])


def _walk() -> str:
    """One row per hop of every trajectory, digit by digit."""
    out, moved = [], []
    for s in V.STEPS:
        digit = lambda x: f"((g // {_STR[x]}) % {_LEVELS[x]})"
        nxt = lambda x: f"(({digit(x)} + 1) % {_LEVELS[x]})"
        before = " + ".join(f"{nxt(x) if x in moved else digit(x)} * {_STR[x]}" for x in V.STEPS)
        moved.append(s)
        after = " + ".join(f"{nxt(x) if x in moved else digit(x)} * {_STR[x]}" for x in V.STEPS)
        out.append(f"SELECT traj, '{s}' AS step, {before} AS a, {after} AS b, {nxt(s)} - {digit(s)} AS delta FROM s0")
    return " UNION ALL ".join(out)


_EFFECTS = """SELECT y0.metric, traj, step, (y1.value - y0.value) / delta AS effect FROM w JOIN factorial y0 ON y0.grid_idx = a
  JOIN factorial y1 ON y1.grid_idx = b AND y1.metric = y0.metric"""
_STARTS = "SELECT o_orderkey AS traj, (o_custkey * 7 + o_orderkey) % 648 AS g FROM orders"


@query(
    "morris_effects",
    V.sql(
        "SELECT metric, step, round(avg(effect), 6) AS mu, round(avg(abs(effect)), 6) AS mu_star, round(stddev_samp(effect), 6) AS sigma FROM e GROUP BY metric, step",
        "factorial",
        s0=_STARTS,
        w=_walk(),
        e=_EFFECTS,
    ),
)
def morris_effects(s, d):
    return rounded(Z.morris(effects(s, d), ["metric"]), "mu", "mu_star", "sigma")


@query(
    "delta_sensitivity",
    V.sql(
        "SELECT metric, step, round(sum(shift * nl) / sum(nl), 6) AS delta FROM g GROUP BY metric, step",
        "runs",
        r=f"SELECT metric, CAST(CASE WHEN value < 30 THEN 0 WHEN value >= 330 THEN 21 ELSE floor((value - 30) / 15) + 1 END AS BIGINT) AS bkt, {V.DECODE_SQL} FROM runs",
        l=" UNION ALL ".join(f"SELECT metric, bkt, '{x}' AS step, {x} AS lvl FROM r" for x in V.STEPS),
        pa="SELECT metric, bkt, count(*) / sum(count(*)) OVER (PARTITION BY metric) AS p FROM r GROUP BY metric, bkt",
        pl="SELECT metric, step, lvl, bkt, count(*) / sum(count(*)) OVER (PARTITION BY metric, step, lvl) AS p FROM l GROUP BY metric, step, lvl, bkt",
        n="SELECT metric, step, lvl, count(*) AS nl FROM l GROUP BY metric, step, lvl",
        g="""SELECT n.metric, n.step, n.lvl, n.nl, 0.5 * sum(abs(pa.p - coalesce(pl.p, 0))) AS shift FROM n JOIN pa USING (metric)
          LEFT JOIN pl ON pl.metric = n.metric AND pl.step = n.step AND pl.lvl = n.lvl AND pl.bkt = pa.bkt GROUP BY ALL""",
    ),
)
def delta_sensitivity(s, d):
    return rounded(Z.delta_indices(V.runs(s, d), GRID, ["metric"], "value", 30, 330, 20), "delta")


def _poisson_sql(u: str, top: int = 9) -> str:
    term, cdf, out = math.exp(-1), 0.0, []
    for k in range(top):
        cdf += term
        out.append(f"CASE WHEN {u} >= {cdf!r} THEN 1 ELSE 0 END")
        term /= k + 1
    return " + ".join(out)


@query(
    "bootstrap_ci",
    V.sql(
        """SELECT metric, step, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM
        (SELECT metric, step, rep, sum(size * w) / sum(w) AS m FROM z JOIN wt USING (g) GROUP BY metric, step, rep) GROUP BY metric, step""",
        "factorial",
        s0=_STARTS,
        w=_walk(),
        e=_EFFECTS,
        z="SELECT DISTINCT metric, step, g, abs(effect) AS size FROM e JOIN s0 USING (traj)",
        u="SELECT g, rep, ('0x' || substr(md5(traj || '|' || rep || '|7818'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM s0 CROSS JOIN range(1, 101) r(rep)",
        wt=f"SELECT g, rep, sum({_poisson_sql('u')}) AS w FROM u GROUP BY g, rep",
    ),
)
def bootstrap_ci(s, d):
    """Interval of mu_star per step from 100 resamples of the trajectories."""
    sizes = effects(s, d).select("metric", "step", "start", F.abs("effect").alias("size"))
    out = Z.bootstrap(starts(s, d).withColumnRenamed("grid_idx", "start"), "traj", "start", sizes, ["metric", "step"], "size")
    return rounded(out, "mean", "low", "high")


@query(
    "sensitivity_rank",
    V.sql(
        "SELECT step, round(sum(st), 6) AS total, row_number() OVER (ORDER BY sum(st), step) - 1 AS position FROM v GROUP BY step", "factorial", v=_VAR
    ),
)
def sensitivity_rank(s, d):
    out = Z.sensitivity_rank(indices(s, d).withColumn("all", F.lit(0)), ["all"], "st")
    return rounded(out.drop("all"), "total")


# --- traces -----------------------------------------------------------------


@query(
    "posterior_top_pct",
    V.sql("SELECT chain, idx, like1 FROM chains JOIN (SELECT chain, quantile_cont(like1, 0.9) AS q FROM chains GROUP BY chain) USING (chain) WHERE like1 >= q", "chains"),
)
def posterior_top_pct(s, d):
    return C.posterior(V.chains(s, d), ["chain"], "like1").select("chain", "idx", "like1")


@query(
    "posterior_minimise",
    V.sql("SELECT chain, idx, like1 FROM chains JOIN (SELECT chain, quantile_cont(like1, 0.1) AS q FROM chains GROUP BY chain) USING (chain) WHERE like1 <= q", "chains"),
)
def posterior_minimise(s, d):
    return C.posterior(V.chains(s, d), ["chain"], "like1", maximize=False).select("chain", "idx", "like1")


@query(
    "best_parameter_set",
    V.sql("SELECT chain, idx, like1, par_user, par_hour, par_k FROM chains WHERE like2 = (SELECT max(like2) FROM chains c WHERE c.chain = chains.chain)", "chains"),
)
def best_parameter_set(s, d):
    return C.best_runs(V.chains(s, d), ["chain"], "like2").select("chain", "idx", "like1", "par_user", "par_hour", "par_k")


_SIMS = ["like1", "like2", "par_hour"]
_PCT = [2.5, 5, 25, 50, 75, 95, 97.5]


@query(
    "simulation_percentiles",
    V.sql(
        " UNION ALL ".join(
            f"SELECT chain, '{c}' AS name, " + ", ".join(f"round(quantile_cont({c}, {p / 100}), 6) AS p{str(p).replace('.', '_')}" for p in _PCT) + " FROM chains GROUP BY chain"
            for c in _SIMS
        ),
        "chains",
    ),
)
def simulation_percentiles(s, d):
    out = C.simulation_percentiles(V.chains(s, d), ["chain"], _SIMS, _PCT)
    return rounded(out, *[c for c in out.columns if c not in ("chain", "name")])


_WELCH = """SELECT chain, (m0 - m1) / sqrt(e0 + e1) AS t, pow(e0 + e1, 2) / (e0 * e0 / (n0 - 1) + e1 * e1 / (n1 - 1)) AS df FROM
  (SELECT chain, avg(like1) AS m0, avg(like2) AS m1, count(like1) AS n0, count(like2) AS n1, var_samp(like1) / count(like1) AS e0,
    var_samp(like2) / count(like2) AS e1 FROM chains GROUP BY chain)"""


@query("welch_t_test", V.sql("SELECT chain, round(t, 6) AS t, round(df, 4) AS df FROM w", "chains", w=_WELCH))
def welch_t_test(s, d):
    out = C.welch_t(V.chains(s, d), ["chain"], "like1", "like2", p_value=False)
    return out.select("chain", r6("t").alias("t"), F.round("df", 4).alias("df"))


# The tail of the t distribution is an integral of a power of the cosine, summed by Simpson's rule.
_STEPS = 20_000


@query(
    "welch_t_p_value",
    V.sql(
        f"""SELECT chain, round(sum(k * pow(greatest(cos(a + (pi() / 2 - a) * i / {_STEPS}.0), 0), df - 1)) * (pi() / 2 - a)
          / (sum(k * pow(greatest(cos(pi() / 2 * i / {_STEPS}.0), 0), df - 1)) * (pi() / 2)), 6) AS p
        FROM (SELECT chain, df, atan(abs(t) / sqrt(df)) AS a FROM w)
        CROSS JOIN (SELECT range AS i, CASE WHEN range IN (0, {_STEPS}) THEN 1 WHEN range % 2 = 1 THEN 4 ELSE 2 END AS k FROM range({_STEPS} + 1))
        GROUP BY chain, a""",
        "chains",
        w=_WELCH,
    ),
)
def welch_t_p_value(s, d):
    return C.welch_t(V.chains(s, d), ["chain"], "like1", "like2").select("chain", r6("p").alias("p"))


@query(
    "objective_functions",
    V.sql(
        """SELECT run, round(sqrt(avg(pow(sim - obs, 2))), 6) AS rmse, round(1 - sum(pow(sim - obs, 2)) / (var_pop(obs) * count(*)), 6) AS nse,
        round(1 - sum(pow(ls - lo, 2)) / (var_pop(lo) * count(lo)), 6) AS log_nse
        FROM (SELECT *, CASE WHEN sim > 0 AND obs > 0 THEN ln(sim) END AS ls, CASE WHEN sim > 0 AND obs > 0 THEN ln(obs) END AS lo
        FROM (SELECT par_user AS run, par_hour AS step, avg(like1) AS sim FROM chains GROUP BY ALL)
        JOIN (SELECT par_hour AS step, avg(like2) * (1 + par_hour) AS obs FROM chains GROUP BY par_hour) USING (step)) GROUP BY run""",
        "chains",
    ),
)
def objective_functions(s, d):
    ch = V.chains(s, d)
    sims = ch.groupBy(F.col("par_user").alias("run"), F.col("par_hour").alias("step")).agg(F.avg("like1").alias("sim"))
    obs = ch.groupBy(F.col("par_hour").alias("step")).agg((F.avg("like2") * (1 + F.first("par_hour"))).alias("obs"))
    out = C.objectives(sims, obs, "step", ["run"], {"rmse": C.rmse, "nse": C.nse, "log_nse": C.log_nse})
    return rounded(out, "rmse", "nse", "log_nse")


@query("running_best", V.sql("SELECT chain, idx, min(like1) OVER (PARTITION BY chain ORDER BY idx) AS best FROM chains", "chains"))
def running_best(s, d):
    return C.running_best(V.chains(s, d), ["chain"], "like1").select("chain", "idx", "best")


# Critical value of t from that of the normal distribution, by powers of 1 / df.
_Z = 3.2905267314919255
_T = " + ".join(
    f"{g!r} / pow(n - 1, {i})"
    for i, g in enumerate(
        [
            _Z, (_Z**3 + _Z) / 4, (5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96, (3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384,
            (79 * _Z**9 + 776 * _Z**7 + 1482 * _Z**5 - 1920 * _Z**3 - 945 * _Z) / 92160,
        ]
    )
)


@query(
    "first_below_mean",
    V.sql(
        """SELECT chain, round(mean, 6) AS mean, round(upper, 6) AS upper, min(idx) FILTER (like1 < upper) AS first_run FROM chains JOIN u USING (chain)
        GROUP BY chain, mean, upper""",
        "chains",
        u=f"""SELECT chain, mean, mean + ({_T}) * sd / sqrt(n) AS upper FROM
          (SELECT chain, avg(like1) AS mean, stddev_samp(like1) AS sd, count(like1)::DOUBLE AS n FROM chains GROUP BY chain)""",
    ),
)
def first_below_mean(s, d):
    return rounded(C.first_below_mean(V.chains(s, d), ["chain"], "like1"), "mean", "upper")


_TRACED = ["like1", "par_hour", "par_k"]


@query(
    "gelman_rubin",
    V.sql(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS name, round((w * (n - 1) / n + b + b / k) / w, 6) AS r_hat FROM (SELECT var_samp(m) AS b, avg(v) AS w, count(*) AS k, min(n) AS n FROM
            (SELECT chain, avg({c}) AS m, var_samp({c}) AS v, count(*) AS n FROM chains WHERE idx <= (SELECT min(n) FROM (SELECT count(*) AS n FROM chains GROUP BY chain))
             GROUP BY chain))"""
            for c in _TRACED
        ),
        "chains",
    ),
)
def gelman_rubin(s, d):
    return rounded(C.gelman_rubin(V.chains(s, d), "chain", _TRACED), "r_hat")


@query(
    "geweke",
    V.sql(
        """SELECT chain, k, round((avg(a.like1) - avg(b.like1)) / sqrt(var_pop(a.like1) + var_pop(b.like1)), 6) AS z
        FROM (SELECT DISTINCT chain, n FROM c) CROSS JOIN range(20) r(k) JOIN c a USING (chain)
        JOIN c b USING (chain) WHERE a.i >= floor(0.1 * a.n) + k * (a.n // 40) AND a.i < floor(0.1 * a.n) + (k + 1) * (a.n // 40)
          AND b.i - floor(b.n / 2) = a.i - floor(0.1 * a.n) GROUP BY chain, k""",
        "chains",
        c="SELECT chain, idx - 1 AS i, like1, count(*) OVER (PARTITION BY chain) AS n FROM chains",
    ),
)
def geweke(s, d):
    return rounded(C.geweke(V.chains(s, d), ["chain"], "like1"), "z")


@query(
    "autocorrelation",
    V.sql(
        """SELECT a.chain, h AS lag, round(sum((b.like1 - m) * (a.like1 - m)) / any_value(n * v), 6) AS r FROM chains a CROSS JOIN range(1, 11) r(h)
        JOIN chains b ON b.chain = a.chain AND b.idx = a.idx + h
        JOIN (SELECT chain, avg(like1) AS m, var_pop(like1) AS v, count(*) AS n FROM chains GROUP BY chain) s ON s.chain = a.chain GROUP BY a.chain, h""",
        "chains",
    ),
)
def autocorrelation(s, d):
    out = C.autocorrelation(V.chains(s, d), ["chain"], "like1", list(range(1, 11)))
    return rounded(out.withColumn("lag", F.col("lag").cast("bigint")), "r")


_COLS = ["like1", "par_hour", "par_k", "par_user"]


@query(
    "parameter_correlation",
    V.sql(
        " UNION ALL ".join(
            f"SELECT chain, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM chains GROUP BY chain" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]
        ),
        "chains",
    ),
)
def parameter_correlation(s, d):
    return rounded(C.correlations(V.chains(s, d), ["chain"], _COLS), "r")


@query(
    "parameter_bounds",
    V.sql(" UNION ALL ".join(f"SELECT '{c}' AS name, min({c}) AS low, max({c}) AS high FROM chains" for c in _COLS[1:]), "chains"),
)
def parameter_bounds(s, d):
    return C.bounds(V.chains(s, d), [], _COLS[1:])


@query(
    "chain_tail_histogram",
    V.sql(
        """SELECT chain, CAST(least(floor(par_k / (100.0 / 19)), 18) AS BIGINT) AS bin, count(*) AS n FROM
        (SELECT *, max(idx) OVER (PARTITION BY chain) AS last FROM chains) WHERE idx > last - 100 AND par_k BETWEEN 0 AND 100 GROUP BY 1, 2""",
        "chains",
    ),
)
def chain_tail_histogram(s, d):
    return C.tail_histogram(V.chains(s, d), ["chain"], "par_k", 0, 100, 19)


@query(
    "chain_trace_and_tail",
    V.sql(
        """SELECT chain, rn - 1 - cut AS pos, like1, par_k FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY like1, event_id) AS rn,
        CAST(floor(count(*) OVER (PARTITION BY chain) * 0.1) AS BIGINT) AS cut FROM chains) WHERE rn > cut""",
        "chains",
    ),
)
def chain_trace_and_tail(s, d):
    return C.sorted_trace(V.chains(s, d), ["chain"], ["like1", "event_id"]).select("chain", "pos", "like1", "par_k")


@query(
    "sentinel_to_null",
    V.sql("SELECT chain, count(*) AS n, count(v) AS n_valid, round(avg(v), 6) AS mean FROM (SELECT chain, nullif(CASE WHEN like1 < 1 THEN -9999 ELSE like1 END, -9999) AS v FROM chains) GROUP BY chain", "chains"),
)
def sentinel_to_null(s, d):
    marked = V.chains(s, d).withColumn("v", F.when(F.col("like1") < 1, -9999.0).otherwise(F.col("like1")))
    clean = C.sentinel_to_null(marked, ["v"])
    return clean.groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_valid"), r6(F.avg("v")).alias("mean"))
