"""Band-math indices as column expressions on the raw spectrum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bands import BandTable, mean_row, pick_row, row_sql


def ndi(table: BandTable, column: str = "refl", wl1=(770, 800), wl2=(650, 680)) -> Column:
    """Normalised difference of two range means; null when their sum is zero."""
    a, b = (F.expr(row_sql(mean_row(table, *w), column)) for w in (wl1, wl2))
    return F.when(a + b != 0, (a - b) / (a + b))


def mcari2(table: BandTable, column: str = "refl", wl1=800, wl2=670, wl3=550) -> Column:
    """Second modified chlorophyll absorption ratio index (published formula); null where its root is not positive."""
    nir, red, green = (F.expr(row_sql(pick_row(table, w), column)) for w in (wl1, wl2, wl3))
    root = F.pow(2 * nir + 1, F.lit(2.0)) - (6 * nir - 5 * F.sqrt(red)) - 0.5
    return F.when(root > 0, F.try_divide(1.5 * (2.5 * (nir - red) - 1.3 * (nir - green)), F.sqrt(root)))


def composite(table: BandTable, low: float, high: float, column: str = "refl") -> Column:
    """Mean reflectance over a wavelength range."""
    return F.expr(row_sql(mean_row(table, low, high), column))
