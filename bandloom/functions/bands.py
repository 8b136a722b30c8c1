"""Linear band operators as small coefficient tables.

Clip, smooth, re-bin, sensor mimic and derivative are all ``out = W @ in`` on
the bands of one spectrum. Tables compose on the driver (they are at most a few
hundred bands square), so any chain of steps costs one projection of the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Public Sentinel-2A centres and widths in nm (VNIR bands).
SENTINEL_2A = [
    (443.0, 21.0), (492.4, 66.0), (559.8, 36.0), (664.6, 31.0), (704.1, 15.0),
    (740.5, 15.0), (782.8, 20.0), (832.8, 106.0), (864.7, 21.0),
]
SENSORS = {"sentinel-2a": SENTINEL_2A}
FWHM_PER_SIGMA = 2.0 * np.sqrt(2.0 * np.log(2.0))


@dataclass(frozen=True)
class BandTable:
    """Coefficients (rows: output bands) and the output wavelengths."""

    weights: np.ndarray
    wavelengths: tuple[float, ...]

    def then(self, make) -> "BandTable":
        """Chain the step built by ``make(wavelengths)`` after this one."""
        step = make(self.wavelengths)
        return BandTable(step.weights @ self.weights, step.wavelengths)


def identity(wl) -> BandTable:
    return BandTable(np.eye(len(wl)), tuple(wl))


def clip(ranges):
    """Drop the bands inside any of the closed wavelength ranges."""

    def make(wl):
        keep = [i for i, w in enumerate(wl) if not any(lo <= w <= hi for lo, hi in ranges)]
        return BandTable(np.eye(len(wl))[keep], tuple(wl[i] for i in keep))

    return make


def savgol(window: int, order: int):
    """Savitzky-Golay smoothing; the ends use the polynomial of the end window."""

    def make(wl):
        n, half = len(wl), window // 2
        weights = np.zeros((n, n))
        for i in range(n):
            centre = min(max(i, half), n - 1 - half)
            t = np.arange(centre - half, centre + half + 1)
            fit = np.linalg.pinv(np.vander(t - i, order + 1, increasing=True).astype(float))
            weights[i, t] = fit[0]
        return BandTable(weights, tuple(wl))

    return make


def resample(bandwidth: float):
    """Mean of the bands in each ``bandwidth`` wide bin, counted from the first band."""

    def make(wl):
        bins = np.floor((np.asarray(wl) - wl[0]) / bandwidth).astype(int)
        used = sorted(set(bins.tolist()))
        weights = np.array([(bins == b) / np.sum(bins == b) for b in used])
        return BandTable(weights, tuple(wl[0] + bandwidth * (b + 0.5) for b in used))

    return make


def mimic(sensor: str):
    """Response-weighted mean for each band of a sensor (Gaussian responses)."""

    def make(wl):
        w = np.asarray(wl)
        rows = [np.exp(-0.5 * ((w - c) / (fwhm / FWHM_PER_SIGMA)) ** 2) for c, fwhm in SENSORS[sensor]]
        return BandTable(np.array([r / r.sum() for r in rows]), tuple(c for c, _ in SENSORS[sensor]))

    return make


def difference_weights(x: np.ndarray, at: float, order: int) -> np.ndarray:
    """Weights of the ``order``-th derivative at ``at`` on points ``x`` of any spacing.

    Solves the moment conditions sum(w * (x-at)^j) = order! * [j == order].
    """
    scale = np.max(np.abs(x - at))
    moments = np.vander((x - at) / scale, len(x), increasing=True).T
    rhs = np.zeros(len(x))
    rhs[order] = float(np.prod(np.arange(1, order + 1)))
    return np.linalg.solve(moments, rhs) / scale**order


def derivative(order: int):
    """Second-order accurate derivative on the wavelength grid, one-sided at the ends."""

    def make(wl):
        x, n = np.asarray(wl, float), len(wl)
        half = (order + 1) // 2
        weights = np.zeros((n, n))
        for i in range(n):
            if half <= i < n - half:
                pts = np.arange(i - half, i + half + 1)
            else:
                size = min(order + 2, n)
                first = 0 if i < half else n - size
                pts = np.arange(first, first + size)
            weights[i, pts] = difference_weights(x[pts], x[i], order)
        return BandTable(weights, tuple(wl))

    return make


def row_sql(weights: np.ndarray, column: str, tiny: float = 1e-13) -> str:
    """One output band as a sum of products of array elements (stays in generated code)."""
    floor = tiny * np.max(np.abs(weights), initial=0.0)
    terms = [
        f"{column}[{k}]" if w == 1.0 else f"{float(w)!r}D * {column}[{k}]" for k, w in enumerate(weights) if abs(w) > floor
    ]
    return "(" + (" + ".join(terms) if terms else "0D") + ")"


def table_column(table: BandTable, column: str) -> Column:
    """The whole table as one unrolled array expression."""
    return F.expr("array(" + ", ".join(row_sql(r, column) for r in table.weights) + ")")


def list_matrix(column, width: int) -> np.ndarray:
    """An Arrow list column of equal-length lists as a matrix (null lists and elements become NaN)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        out = np.full((len(column), width), np.nan)
        out[column.is_valid().to_numpy(zero_copy_only=False)] = list_matrix(column.drop_null(), width)
        return out
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def matrix_list(matrix: np.ndarray):
    """A matrix as an Arrow list column."""
    n, width = matrix.shape
    offsets = pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))


def batch_groups(batch: pa.RecordBatch, keys: list[str]):
    """Rows of each distinct key in a batch: (first row, row numbers)."""
    number = np.zeros(batch.num_rows, dtype=np.int64)
    for k in keys:
        codes = batch.column(batch.schema.names.index(k)).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        number = number * (codes.max(initial=0) + 1) + codes
    _, first, number = np.unique(number, return_index=True, return_inverse=True)
    order = np.argsort(number, kind="stable")
    cuts = np.searchsorted(number[order], np.arange(len(first) + 1))
    for g, row in enumerate(first):
        yield int(row), order[cuts[g] : cuts[g + 1]]


def apply_table(df: DataFrame, table: BandTable, column: str = "refl", max_terms: int = 128) -> DataFrame:
    """Replace ``column`` by the transformed spectrum.

    Small tables (clip, re-bin) become an unrolled expression inside whole-stage
    code; larger ones would exceed the size of a generated method and run as a
    matrix product per Arrow batch. Both are narrow.
    """
    if np.count_nonzero(np.abs(table.weights) > 1e-13) <= max_terms:
        return df.withColumn(column, table_column(table, column))
    weights, at = table.weights, df.columns.index(column)

    def product(batches):
        for batch in batches:
            arrays = list(batch.columns)
            arrays[at] = matrix_list(list_matrix(arrays[at], weights.shape[1]) @ weights.T)
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return df.mapInArrow(product, df.schema)


def apply_tables(df: DataFrame, tables: dict[int, BandTable], tag: str, column: str = "refl") -> DataFrame:
    """One output row per table and input row, ``tag`` naming the table; one scan for all."""
    at, weights = df.columns.index(column), {k: t.weights for k, t in tables.items()}
    schema = T.StructType([*df.schema.fields, T.StructField(tag, T.LongType())])

    def products(batches):
        for batch in batches:
            matrix = list_matrix(batch.column(at), next(iter(weights.values())).shape[1])
            for k, w in weights.items():
                arrays = list(batch.columns)
                arrays[at] = matrix_list(matrix @ w.T)
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(matrix), k))], names=schema.names)

    return df.mapInArrow(products, schema)


def nearest(wl, target: float) -> int:
    """Band nearest to a wavelength, the lower one on ties."""
    return int(min(range(len(wl)), key=lambda k: (abs(wl[k] - target), k)))


def target_wavelength(wl, step: int = 0) -> int:
    """Wavelength meant by a setting: number, [number], [low, high], or one list per step."""
    if isinstance(wl, list):
        if len(wl) == 2 and isinstance(wl[0], list):
            wl = wl[step]
        return int(sum(wl) / len(wl))
    return int(wl)


def pick_row(table: BandTable, target: float) -> np.ndarray:
    """Input-band weights of the output band nearest to a wavelength."""
    return table.weights[nearest(table.wavelengths, target)]


def mean_row(table: BandTable, low: float, high: float) -> np.ndarray:
    """Input-band weights of the mean over a wavelength range; its nearest band if none is inside."""
    rows = [k for k, w in enumerate(table.wavelengths) if low <= w <= high]
    return table.weights[rows].mean(axis=0) if rows else pick_row(table, (low + high) / 2)
