"""Centroid clustering over dictionaries of subvectors.

Vectors of whole numbers are cut into row groups, and a row group into blocks of a
few dimensions. A block is a dictionary of its distinct subvectors and a code per
row, so nothing is lost. In a round each dictionary entry gets its distances to the
centroids once; a row's distance is the sum of the entries its codes name, and a
centroid's new sum is the entries times how often the cluster holds their code. The
row groups are stored once and read in every round: no vector is ever shuffled, and
what goes through the driver is ``k`` centroids.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandloom.llm import vectors
from bandloom.session import stored

_GROUP = "n int, vec_ids array<bigint>, sizes array<int>, entries binary, codes binary"
#: Sums leave a task in limbs of so many bits, so that adding them up cannot overflow a long.
_LIMB, _LIMBS = 40, 5
_LONG = 2**63 - 1


@dataclass(frozen=True)
class Plan:
    """``seed`` and the identifier decide the first centroids; ``width`` dimensions are one subvector."""

    dims: int = 64
    k: int = 40
    rounds: int = 5
    width: int = 2
    rows: int = 16_384
    seed: str = "2"

    def blocks(self) -> list[slice]:
        return [slice(i, min(i + self.width, self.dims)) for i in range(0, self.dims, self.width)]


def dictionary(sub: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the code of each row."""
    order = np.lexsort(sub.T)
    ordered = sub[order]
    new = np.ones(len(sub), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(1)
    codes = np.empty(len(sub), np.int64)
    codes[order] = np.cumsum(new) - 1
    return ordered[new], codes


def row_groups(df: DataFrame, plan: Plan) -> DataFrame:
    """One row per up to ``plan.rows`` vectors: identifiers, dictionary sizes, entries and codes, block after block.

    ``df`` has ``vec_id, vector`` as ``vectors.clean`` returns them.
    """
    blocks, dims, most = plan.blocks(), plan.dims, min(plan.rows, 2**16)

    def pack(ids, q):
        sizes, codes, entries = [], [], []
        for b in blocks:
            sub, code = dictionary(q[:, b])
            sizes.append(len(sub))
            entries.append(sub.ravel())
            codes.append(code.astype("<u2").tobytes())
        row = [[len(ids)], [ids], [sizes], [vectors.packed(np.concatenate(entries))], [b"".join(codes)]]
        kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], names=["n", "vec_ids", "sizes", "entries", "codes"])

    def run(batches):
        ids, parts = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            parts.append(vectors.whole(batch, 1, dims))
            while len(ids) >= most:
                q = np.concatenate(parts)
                yield pack(ids[:most], q[:most])
                ids, parts = ids[most:], [q[most:]]
        if ids:
            yield pack(ids, np.concatenate(parts))

    return df.mapInArrow(run, _GROUP)


class RowGroup:
    """A stored row group with its dictionaries."""

    def __init__(self, n: int, sizes: list[int], entries: bytes, codes: bytes, plan: Plan):
        self.n, self.blocks = n, plan.blocks()
        widths = [b.stop - b.start for b in self.blocks]
        flat = vectors.unpacked(entries, 1, sum(s * w for s, w in zip(sizes, widths)))[0]
        ends = np.cumsum([0] + [s * w for s, w in zip(sizes, widths)])
        self.subs = [flat[i:j].reshape(s, w) for i, j, s, w in zip(ends, ends[1:], sizes, widths)]
        self.codes = np.frombuffer(codes, "<u2").reshape(len(self.blocks), n)
        self.largest = float(np.abs(flat.astype(np.float64)).max()) if len(flat) else 0.0

    def nearest(self, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid per row; the smaller number on ties."""
        most = max([self.largest, *(abs(x) for c in centroids for x in c)])
        bound = 4.0 * most * most * sum(b.stop - b.start for b in self.blocks)
        c = vectors.exact(np.array(centroids, object).astype(np.float64), bound) if bound < 2**62 else np.array(centroids, object)
        total = 0
        for b, sub, code in zip(self.blocks, self.subs, self.codes):
            gap = vectors.exact(sub, bound)[:, None, :] - c[None, :, b]
            total = total + (gap * gap).sum(2)[code]  # the entries' distances, looked up by code
        total = total.astype(np.int64) if bound < 2**62 else total
        nearest = total.argmin(1)
        return nearest, total[np.arange(self.n), nearest]

    def sums(self, nearest: np.ndarray, k: int) -> list[tuple[int, int, list[int]]]:
        """``(cluster, rows, sum per dimension)`` of the clusters that have rows."""
        rows, parts = np.bincount(nearest, minlength=k), []
        exact = self.largest * self.n < 2**53
        for sub, code in zip(self.subs, self.codes):
            held = np.bincount(nearest * len(sub) + code, minlength=k * len(sub)).reshape(k, len(sub))
            parts.append(held.astype(np.float64) @ sub.astype(np.float64) if exact else held.astype(object) @ vectors.exact(sub, 2.0**70))
        whole = np.concatenate(parts, 1)
        return [(c, int(rows[c]), [int(x) for x in whole[c]]) for c in np.flatnonzero(rows).tolist()]


def _groups(batches, plan: Plan):
    for batch in batches:
        for i in range(len(batch)):
            n, ids, sizes, entries, codes = (batch.column(c)[i] for c in range(5))
            yield ids, RowGroup(n.as_py(), sizes.as_py(), entries.as_py(), codes.as_py(), plan)


def first_centroids(df: DataFrame, plan: Plan) -> list[list[int]]:
    """The ``k`` vectors with the smallest hash of seed and identifier; equal identifiers by their components, null ones last."""
    at = F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.col("vec_id").cast("string")), 256)
    rows = df.orderBy(at.asc_nulls_last(), "vector").limit(plan.k).select("vector").collect()
    return [[int(np.floor(x * vectors.SCALE)) for x in r.vector] for r in rows]


def moved(groups: DataFrame, centroids: list[list[int]], plan: Plan) -> list[list[int]]:
    """Centroids after one round: the floor of each cluster's mean; clusters without rows stay."""
    mask = (1 << _LIMB) - 1

    def run(batches):
        for _, group in _groups(batches, plan):
            nearest, _ = group.nearest(centroids)
            out = []
            for c, rows, sums in group.sums(nearest, len(centroids)):
                out.append((c, -1, rows))
                for d, total in enumerate(sums):
                    limbs = [(total >> (_LIMB * i)) & mask for i in range(_LIMBS - 1)] + [total >> (_LIMB * (_LIMBS - 1))]
                    out += [(c, d * _LIMBS + i, x) for i, x in enumerate(limbs) if x]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["cluster", "place", "part"])

    parts = groups.mapInArrow(run, "cluster bigint, place bigint, part bigint").groupBy("cluster", "place").agg(F.sum("part").alias("part"))
    rows, sums = {}, {}
    for r in parts.collect():  # at most k * (1 + dims * limbs) rows
        if r.place < 0:
            rows[r.cluster] = r.part
        else:
            d, limb = divmod(r.place, _LIMBS)
            sums[r.cluster, d] = sums.get((r.cluster, d), 0) + (r.part << (_LIMB * limb))
    return [[sums.get((c, d), 0) // rows[c] for d in range(plan.dims)] if c in rows else old for c, old in enumerate(centroids)]


def assigned(groups: DataFrame, centroids: list[list[int]], plan: Plan) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""

    def run(batches):
        for ids, group in _groups(batches, plan):
            nearest, distance = group.nearest(centroids)
            distance = distance if distance.dtype != object else np.array([min(x, _LONG) for x in distance], np.int64)
            columns = [ids.values, pa.array(nearest.astype(np.int32)), pa.array(distance.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return groups.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def cluster(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", plan: Plan = Plan()) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance`` of every usable vector, and the final centroids.

    A vector takes part if it has exactly ``plan.dims`` components, none null and none
    non-finite (beyond the range of a 32-bit float). Repeated rows each count, also
    with equal or null identifiers. Fewer than ``k`` vectors give as many centroids;
    none, or an empty table, gives no rows. All sums are exact; a distance beyond a
    long is reported as the largest long, and compared as what it is.
    """
    rows = vectors.clean(df, id_col, vector, plan.dims)
    groups = stored(row_groups(rows, plan), "row-groups")
    centroids = first_centroids(rows, plan)
    for _ in range(plan.rounds if centroids else 0):
        centroids = moved(groups, centroids, plan)
    return stored(assigned(groups, centroids, plan), "clusters"), centroids


def inertia(assigned: DataFrame) -> DataFrame:
    """Per cluster ``cluster_inertia`` and, over all, ``inertia``; at most one row per centroid."""
    capped = lambda x: F.least(x, F.lit(_LONG).cast("decimal(38,0)")).cast("bigint")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    return sums.select("cluster", capped(F.col("s")).alias("cluster_inertia"), capped(F.sum("s").over(Window.partitionBy())).alias("inertia"))
