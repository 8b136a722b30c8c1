"""Yeo-Johnson transform of the response, as columns and as arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def forward(y: Column, lam: Column) -> Column:
    pos = F.when(lam == 0, F.log1p(y)).otherwise((F.pow(y + 1, lam) - 1) / lam)
    neg = F.when(lam == 2, -F.log1p(-y)).otherwise(-(F.pow(1 - y, 2 - lam) - 1) / (2 - lam))
    return F.when(y >= 0, pos).otherwise(neg)


def inverse(z: Column, lam: Column) -> Column:
    """Back to the response; null where no response has this value."""
    pos = F.when(lam == 0, F.exp(z) - 1).when(lam * z + 1 > 0, F.pow(lam * z + 1, 1 / lam) - 1)
    neg = F.when(lam == 2, 1 - F.exp(-z)).when(1 - (2 - lam) * z > 0, 1 - F.pow(1 - (2 - lam) * z, 1 / (2 - lam)))
    return F.when(z >= 0, pos).otherwise(neg)


def forward_np(y, lam):
    """Transform with broadcasting; ``lam`` may be an array."""
    y, lam = np.broadcast_arrays(np.asarray(y, float), np.asarray(lam, float))
    up, out = y >= 0, np.empty(y.shape)
    a, b = np.where(lam == 0, 1.0, lam), np.where(lam == 2, 1.0, 2 - lam)
    with np.errstate(all="ignore"):
        out[up] = np.where(lam == 0, np.log1p(y), np.expm1(lam * np.log1p(y)) / a)[up]
        out[~up] = np.where(lam == 2, -np.log1p(-y), -np.expm1((2 - lam) * np.log1p(-y)) / b)[~up]
    return out


def inverse_np(z, lam: float):
    """Inverse for one parameter; NaN outside the range of the transform."""
    z = np.asarray(z, float)
    with np.errstate(all="ignore"):
        pos = np.expm1(z) if lam == 0 else np.expm1(np.log1p(lam * z) / lam)
        neg = -np.expm1(-z) if lam == 2 else -np.expm1(np.log1p(-(2 - lam) * z) / (2 - lam))
    out = np.where(z >= 0, pos, neg)
    return np.where(np.isfinite(out), out, np.nan)
