"""Student t distribution and reproducible uniforms, for aggregated rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, h = 1e-300, 1.0
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t."""
    if not (df > 0) or math.isnan(t):
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_critical(level: float, df: float) -> float:
    """Half-width factor of a central interval, by bisection on the tail."""
    lo, hi = 0.0, 1.0
    while t_two_sided(hi, df) > 1 - level:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > 1 - level else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) for a, b in zip(t, df)])


def t_factor(level: float):
    """Column function: critical value for a column of degrees of freedom."""

    @F.pandas_udf(T.DoubleType())
    def factor(df: pd.Series) -> pd.Series:
        return df.map(lambda v: t_critical(level, v) if np.isfinite(v) and v > 0 else np.nan)

    return factor


def md5_uniform(*parts: Column) -> Column:
    """Uniform in [0, 1) from 32 bits of an md5, equal on every engine."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def poisson_weight(u: Column, top: int = 9) -> Column:
    """Poisson(1) count by inversion of its distribution function."""
    out, cdf, term = F.lit(0), 0.0, math.exp(-1)
    for k in range(top):
        cdf += term
        out = out + (u >= cdf).cast("int")
        term /= k + 1
    return out
