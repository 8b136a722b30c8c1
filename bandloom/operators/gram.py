"""Sufficient statistics of linear models, one distributed pass for all splits.

A *split* is a training subset with its own target: column ``member`` holds one
0/1 flag per split and ``target`` one value per split. Everything a penalised or
latent-variable fit needs is n, sum x, X'X, X'z, sum z and sum z^2 per split.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bands import batch_groups, list_matrix, matrix_list
from ..functions.target import forward_np
from .order import broadcast_if_small, null_safe_join

#: Numbers that the statistics of all keys may have while rows need not move.
FLUSH_VALUES = 8_000_000


@dataclass
class Stats:
    """Unpacked statistics of one split."""

    n: float
    sx: np.ndarray
    xx: np.ndarray
    xz: np.ndarray
    sz: float
    szz: float

    @classmethod
    def unpack(cls, v: np.ndarray, width: int) -> "Stats":
        t = width * (width + 1) // 2
        xx = np.zeros((width, width))
        xx[np.triu_indices(width)] = v[1 + width : 1 + width + t]
        xx = xx + np.triu(xx, 1).T
        at = 1 + width + t
        return cls(v[0], v[1 : 1 + width], xx, v[at : at + width], v[at + width], v[at + width + 1])

    def centred(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Covariance sums, cross sums, means of x and mean of z."""
        mx, mz = self.sx / self.n, self.sz / self.n
        return self.xx - np.outer(self.sx, mx), self.xz - self.sx * mz, mx, mz


class Sums:
    """Running sums of one key: X'X of all rows once, and of the rows each split holds out."""

    def __init__(self, width: int, splits: int):
        self.n, self.sx = np.zeros(splits), np.zeros((splits, width))
        self.all, self.out = np.zeros((width, width)), [None] * splits
        self.xz, self.sz, self.szz = np.zeros((splits, width)), np.zeros(splits), np.zeros(splits)

    def add(self, x: np.ndarray, member: np.ndarray, target: np.ndarray) -> None:
        flags = member.astype(float)
        z = np.where(member, target, 0.0)
        self.all += x.T @ x
        for s in np.flatnonzero(~member.all(axis=0)):
            # Most rows train in most splits: only the few that do not are added up again.
            held = x[~member[:, s]]
            self.out[s] = held.T @ held if self.out[s] is None else self.out[s] + held.T @ held
        self.n += flags.sum(axis=0)
        self.sx += flags.T @ x
        self.xz += z.T @ x
        self.sz += z.sum(axis=0)
        self.szz += (z * z).sum(axis=0)

    def packed(self) -> np.ndarray:
        """Splits x packed statistics, totals minus what a split holds out."""
        tri = np.triu_indices(self.all.shape[0])
        xx = np.array([(self.all if o is None else self.all - o)[tri] for o in self.out])
        return np.column_stack([self.n, self.sx, xx, self.xz, self.sz, self.szz])


def packed_values(width: int) -> int:
    return 3 + 2 * width + width * (width + 1) // 2


def _sorted_rows(rows: DataFrame, keys: list[str], width: int) -> tuple[DataFrame, bool]:
    """Rows ordered by key in every task, so that a task adds up one key at a time, and whether a key is in one task only.

    While the statistics of all keys fit into ``FLUSH_VALUES`` numbers, rows stay where
    they are. Otherwise every key's rows move to as few tasks as its size needs, at
    least four times as many bytes of rows as of statistics to a task, so that the
    statistics sent on are a fraction of the rows however many keys are mixed.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.max(F.size("member")).alias("__k"))
    found = counts.agg(F.count(F.lit(1)).alias("n_keys"), F.max("__k").alias("splits"), F.max("__n").alias("most")).first()
    splits = max(found.splits or 0, 1)
    if (found.n_keys or 0) * splits * packed_values(width) <= FLUSH_VALUES:
        return rows.sortWithinPartitions(*keys), False
    per_task = max(10_000, 4 * splits * packed_values(width) // (width + 2 * splits))
    if found.most <= per_task:
        return rows.repartition(*keys).sortWithinPartitions(*keys), True
    parts = broadcast_if_small(counts.filter(F.col("__n") > per_task).select(*keys, F.ceil(F.col("__n") / per_task).cast("bigint").alias("__parts")))
    salted = null_safe_join(rows, parts, keys, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64("x", "target"), F.col("__parts")), F.lit(0)))
    return salted.repartition(*keys, "__salt").sortWithinPartitions(*keys, "__salt").drop("__parts", "__salt"), False


def gram_stats(df: DataFrame, keys: list[str], width: int, x: str = "x", member: str = "member", target: str = "target") -> DataFrame:
    """Packed statistics per key and split (columns split, stats).

    Rows come to a task ordered by key. It holds the sums of one key, whatever the
    number of keys and rows, and sends them on as one packed vector per split when
    the key changes. Rows with a null in ``x`` or ``target`` are an error; null keys
    form a key like any other.
    """
    rows = df.select(*keys, F.col(x).alias("x"), F.transform(member, lambda m: m.cast("double")).alias("member"), F.col(target).alias("target"))
    fields = [rows.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("split", T.LongType()), T.StructField("part", T.ArrayType(T.DoubleType()))])
    nk = len(keys)

    def emit(key, sums):
        packed = sums.packed()
        lead = [pa.array([v.as_py()] * len(packed), type=v.type) for v in key]
        return pa.RecordBatch.from_arrays([*lead, pa.array(np.arange(len(packed))), matrix_list(packed)], names=schema.names)

    def partial(batches):
        key, sums = None, None
        for b in batches:
            if not b.num_rows:
                continue
            splits = len(b.column(nk + 1)[0])
            xs, zs = list_matrix(b.column(nk), width), list_matrix(b.column(nk + 2), splits)
            ms = list_matrix(b.column(nk + 1), splits) > 0
            runs = sorted(batch_groups(b, keys), key=lambda g: g[1][0])
            for row, at in runs:
                k = [b.column(i)[row] for i in range(nk)]
                if key is None or [v.as_py() for v in k] != [v.as_py() for v in key]:
                    if sums is not None:
                        yield emit(key, sums)
                    key, sums = k, Sums(width, splits)
                sums.add(xs[at], ms[at], zs[at])
        if sums is not None:
            yield emit(key, sums)

    ordered, whole = _sorted_rows(rows, keys, width)
    parts = ordered.mapInArrow(partial, schema)
    if whole:
        return parts.withColumnRenamed("part", "stats")
    summed = parts.groupBy(*keys, "split").agg(Summarizer.metrics("sum").summary(array_to_vector("part")).alias("s"))
    return summed.select(*keys, "split", vector_to_array("s.sum").alias("stats"))


def unpack_rows(stats: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Packed statistics as rows: (i, j) of X'X, (i, -1) of X'z, (-1, -1) for n."""
    pairs = [(-1, -1), *[(-2, i) for i in range(width)], *[(i, j) for i in range(width) for j in range(i, width)], *[(i, -1) for i in range(width)]]
    # As many rows as a packed vector has numbers, whatever the data.
    names = stats.sparkSession.createDataFrame([(p, i, j) for p, (i, j) in enumerate(pairs)], "p int, i bigint, j bigint")
    long = stats.select(*keys, "split", F.posexplode("stats").alias("p", "value"))
    return long.join(F.broadcast(names), "p").select(*keys, "split", "i", "j", "value")


def ml_lambda(df: DataFrame, keys: list[str], y: str = "y", member: str = "member", low: float = -5.0, high: float = 5.0, refine: int = 2) -> DataFrame:
    """Yeo-Johnson parameter of maximum likelihood per key, one per split (array ``lambdas``).

    Log-likelihoods on a grid of parameters come from one pass of sums; the
    grid is narrowed around the best and its vertex interpolated at the end.
    """
    points, step = 41, (high - low) / 40
    ref = df.groupBy(*keys).agg(F.avg(y).alias("__ref"), F.first(F.size(member)).alias("__k"))
    centre = ref.select(*keys, "__ref", F.array_repeat(F.lit((low + high) / 2), F.col("__k")).alias("lambdas"))
    for _ in range(refine + 1):
        centre = _lambda_pass(df, keys, y, member, broadcast_if_small(centre), points, step)
        points, step = 21, step / 10
    return centre


def _lambda_pass(df, keys, y, member, centre, points, step):
    rows = df.select(*keys, y, F.transform(member, lambda m: m.cast("double")).alias("__m")).join(centre, keys)
    fields = [rows.schema[k] for k in keys]
    schema = T.StructType(
        [*fields, T.StructField("split", T.LongType()), T.StructField("__n", T.DoubleType()), T.StructField("__slog", T.DoubleType())]
        + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("__s1", "__s2")]
    )
    offsets = (np.arange(points) - points // 2) * step
    cols = rows.select(*keys, y, "__m", "__ref", "lambdas")

    def sums(batches):
        for b in batches:
            if not b.num_rows:
                continue
            yv, n_splits = b.column(len(keys)).to_numpy(), len(b.column(len(keys) + 1)[0])
            m = list_matrix(b.column(len(keys) + 1), n_splits)
            refs, lam = b.column(len(keys) + 2).to_numpy(), list_matrix(b.column(len(keys) + 3), n_splits)
            out = {c: [] for c in ("key", "split", "__n", "__slog", "__s1", "__s2")}
            for first, at in batch_groups(b, keys):
                k, ys, known = tuple(b.column(i)[first].as_py() for i in range(len(keys))), yv[at], {}
                for s in range(n_splits):
                    grid = lam[first, s] + offsets
                    if lam[first, s] not in known:
                        # Taken relative to the mean response, so small spreads keep their digits.
                        known[lam[first, s]] = forward_np(ys[:, None], grid[None, :]) - forward_np(refs[first], grid)[None, :]
                    psi = known[lam[first, s]]
                    w = m[at, s]
                    out["key"].append(k)
                    out["split"].append(s)
                    out["__n"].append(w.sum())
                    out["__slog"].append((w * np.sign(ys) * np.log1p(np.abs(ys))).sum())
                    out["__s1"].append(w @ psi)
                    out["__s2"].append(w @ psi**2)
            lead = [pa.array([k[i] for k in out["key"]], type=b.column(i).type) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays(
                [*lead, pa.array(out["split"], pa.int64()), pa.array(out["__n"]), pa.array(out["__slog"]), matrix_list(np.array(out["__s1"])), matrix_list(np.array(out["__s2"]))],
                names=schema.names,
            )

    vec = lambda c: Summarizer.metrics("sum").summary(array_to_vector(c)).alias(c)
    total = cols.mapInArrow(sums, schema).groupBy(*keys, "split").agg(F.sum("__n").alias("__n"), F.sum("__slog").alias("__slog"), vec("__s1"), vec("__s2"))
    total = total.select(*keys, "split", "__n", "__slog", vector_to_array("__s1.sum").alias("__s1"), vector_to_array("__s2.sum").alias("__s2"))
    back = total.join(centre, keys)
    grid = lambda j: F.element_at("lambdas", (F.col("split") + 1).cast("int")) + (j - F.lit(points // 2)) * F.lit(step)

    def loglik(j: Column) -> Column:
        s1, s2 = F.element_at("__s1", j + 1), F.element_at("__s2", j + 1)
        var = (s2 - s1 * s1 / F.col("__n")) / F.col("__n")
        return F.when(var > 0, -F.col("__n") / 2 * F.log(var) + (grid(j) - 1) * F.col("__slog"))

    ll = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda j: F.coalesce(loglik(j), F.lit(float("-inf"))))
    best = back.withColumn("__ll", ll).withColumn("__j", F.array_position("__ll", F.array_max("__ll")).cast("int") - 1)
    a, b, c = (F.try_element_at("__ll", F.greatest(F.col("__j") + d, F.lit(1))) for d in (0, 1, 2))
    bend = a - 2 * b + c
    shift = F.when((F.col("__j") > 0) & (F.col("__j") < points - 1) & (bend < 0), 0.5 * (a - c) / bend)
    lam = grid(F.col("__j")) + F.coalesce(shift, F.lit(0.0)) * step
    # One value per split of a key: a short array in split order.
    packed = best.groupBy(*keys, "__ref").agg(F.sort_array(F.collect_list(F.struct("split", lam.alias("__lam")))).alias("__p"))
    return packed.select(*keys, "__ref", F.transform("__p", lambda s: s["__lam"]).alias("lambdas"))
