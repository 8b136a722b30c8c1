"""Exact top-k inner products through a pivot-distance index.

With ``M`` the largest norm, ``x' = (x, sqrt(M^2 - |x|^2))`` and ``q' = (q, 0)``,
``|q' - x'|^2 = |q|^2 + M^2 - 2 q.x``: the highest inner products are the smallest
distances. Every vector is keyed by its nearest pivot and its distance to it. The
index is ordered by that key and cut into cells, each an annulus around its pivot. By
the triangle inequality nothing in an annulus is nearer to a query than its distance
to the pivot is to the annulus, so annuli are visited inside out, in a few rounds, and
those further than a query's k-th best so far are left out.

Queries travel in blocks to the cells they may not leave out; cells stay where they
are sorted and are never paired row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandloom.llm import vectors
from bandloom.session import stored

_KEYED = "row bigint, vec_id bigint, dims int, norm2 double, pivot bigint, d double, q binary"
_CELL = "pivot bigint, dims int, dmin double, dmax double, n int, d binary, rows array<bigint>, vec_ids array<bigint>, q binary"
_BIG = 10**38 - 1
#: Room for pivots of one number of components in a pivot's number.
_PER_DIMS = 1 << 20


@dataclass(frozen=True)
class Search:
    """``sample`` rows, by hash, give the pivots; every row is indexed. ``steps`` are the rounds, as shares of what is open."""

    k: int = 5
    pivots: int = 64
    sample: int = 4_096
    cell: int = 4_096
    block: int = 256
    steps: tuple[float, ...] = (0.5, 1.0)


class Pivots:
    """Pivots by number of components, in the space with one more dimension."""

    def __init__(self, top: float, by_dims: dict[int, np.ndarray]):
        self.top, self.by_dims = top, by_dims  # largest squared norm

    def of(self, dims: int) -> np.ndarray:
        return self.by_dims.get(dims, np.zeros((1, dims)))

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.top - (x * x).sum(1), 0.0))

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Distance of every row to every pivot; queries lie where the last component is 0."""
        p = self.of(x.shape[1])
        up = np.zeros(len(x)) if query else self.lift(x)
        norms = (x * x).sum(1) + up * up
        square = norms[:, None] + ((p * p).sum(1) + self.lift(p) ** 2)[None, :] - 2 * (x @ p.T + up[:, None] * self.lift(p)[None, :])
        return np.sqrt(np.maximum(square, 0.0))

    @property
    def slack(self) -> float:
        """More than rounding can take from a distance."""
        return 1e-6 * np.sqrt(self.top) + 1e-9


def encoded(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``row, vec_id, dims, norm2, q`` of every finite vector; ``row`` tells equal rows apart."""
    rows = vectors.clean(df, id_col, vector).withColumn("dims", F.size("vector"))

    def run(batches):
        for batch in batches:
            lists, out = batch.column(1), []
            flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * vectors.SCALE)
            ends = np.cumsum([0, *batch.column(2).to_pylist()])
            for i, j in zip(ends, ends[1:]):
                out.append(flat[i:j])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([float(q @ q) for q in out], pa.float64()), pa.array(map(vectors.packed, out), pa.binary())],
                names=["vec_id", "dims", "norm2", "q"],
            )

    found = rows.mapInArrow(run, "vec_id bigint, dims int, norm2 double, q binary")
    return found.select(F.monotonically_increasing_id().alias("row"), "*")


def choose(rows: DataFrame, search: Search) -> Pivots:
    """Pivots far from each other, taken one by one from a bounded sample by hash."""
    top = rows.agg(F.max("norm2")).first()[0]
    pivots = Pivots(top or 0.0, {})
    by_dims: dict[int, list[np.ndarray]] = {}
    for r in rows.orderBy(F.xxhash64("q"), "row").limit(search.sample).select("dims", "q").collect():
        by_dims.setdefault(r.dims, []).append(vectors.unpacked(r.q, 1, r.dims)[0].astype(np.float64))
    for dims, some in by_dims.items():
        x = np.stack(some)
        chosen, gap = [0], None
        while len(chosen) < min(search.pivots, len(x)):
            pivots.by_dims[dims] = x[chosen[-1:]]
            d = pivots.distances(x, query=False)[:, 0]
            gap = d if gap is None else np.minimum(gap, d)
            if gap.max() <= pivots.slack:
                break
            chosen.append(int(gap.argmax()))
        pivots.by_dims[dims] = x[chosen]
    return pivots


def keyed(rows: DataFrame, pivots: Pivots, query: bool) -> DataFrame:
    """``rows`` with the nearest pivot and the distance to it."""

    def run(batches):
        for batch in batches:
            dims, data = batch.column(2).to_numpy(), batch.column(4).to_pylist()
            pivot, d = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            for k in np.unique(dims).tolist():
                at = np.flatnonzero(dims == k)
                all_d = pivots.distances(np.stack([vectors.unpacked(data[i], 1, k)[0] for i in at]).astype(np.float64), query)
                near = all_d.argmin(1)
                pivot[at], d[at] = k * _PER_DIMS + near, all_d[np.arange(len(at)), near]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(pivot), pa.array(d), batch.column(4)],
                names=["row", "vec_id", "dims", "norm2", "pivot", "d", "q"],
            )

    return rows.select("row", "vec_id", "dims", "norm2", "q").mapInArrow(run, _KEYED)


def cells(keyed: DataFrame, most: int) -> DataFrame:
    """Rows in the order of pivot and distance, cut into cells of at most ``most`` rows of one pivot.

    Identical vectors are told apart by their row, so that copies of one are spread as well.
    """

    def pack(rows):
        dims = rows[0][2]
        q = np.stack([vectors.unpacked(r[6], 1, dims)[0] for r in rows])
        d = np.array([r[5] for r in rows])
        one = [rows[0][4], dims, d[0], d[-1], len(rows), d.tobytes(), [r[0] for r in rows], [r[1] for r in rows], vectors.packed(q)]
        kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        names = ["pivot", "dims", "dmin", "dmax", "n", "d", "rows", "vec_ids", "q"]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one, kinds)], names=names)

    def run(batches):
        rows = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                # Long vectors: fewer to a cell, so that a cell stays within some megabytes.
                if rows and (r[4] != rows[0][4] or len(rows) >= max(1, min(most, 2**20 // max(1, rows[0][2])))):
                    yield pack(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield pack(rows)

    ordered = keyed.repartitionByRange("pivot", "d", "row").sortWithinPartitions("pivot", "d", "row")
    return ordered.mapInArrow(run, _CELL).select(F.monotonically_increasing_id().alias("cell"), "*")


def query_reach(blocks: DataFrame, pivots: Pivots) -> DataFrame:
    """Of every block of queries, the least and the greatest distance to each pivot, one row per pivot."""

    def run(batches):
        for batch in batches:
            for block, home, dims, n, q in zip(*(batch.column(i).to_pylist() for i in range(5))):
                d = pivots.distances(vectors.unpacked(q, n, dims).astype(np.float64), query=True)
                p = dims * _PER_DIMS + np.arange(d.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(p), block)), pa.array(p), pa.array(p == home), pa.array(d.min(0)), pa.array(d.max(0))],
                    names=["block", "pivot", "home", "qmin", "qmax"],
                )

    narrow = blocks.select(F.col("cell").alias("block"), "pivot", "dims", "n", "q")
    return narrow.mapInArrow(run, "block bigint, pivot bigint, home boolean, qmin double, qmax double")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows: in 32- or 64-bit floats where no partial sum can lose a digit, in whole numbers elsewhere."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    bound = np.sqrt((x * x).sum(1).max(initial=0.0) * (y * y).sum(1).max(initial=0.0))
    if bound < 2**23:
        return x.astype(np.float32) @ y.astype(np.float32).T
    if bound < 2**52:
        return x @ y.T
    return vectors.exact(x, 2.0**70) @ vectors.exact(y, 2.0**70).T


def best_in_cell(scores: np.ndarray, least: np.ndarray, rows: np.ndarray, ids: list, own: np.ndarray, k: int) -> list[tuple]:
    """``(query, score, vec_id, row)`` of the ``k`` best per query that reach ``least``, without the query's own row."""
    if scores.dtype == object:
        floor = least
    else:
        floor = least.astype(np.float64)
        if scores.shape[1] > k + 1:  # its own row may be one of them
            kth = np.partition(scores, scores.shape[1] - k - 1, axis=1)[:, scores.shape[1] - k - 1]
            floor = np.maximum(floor, kth)
    i, j = np.nonzero(np.asarray(scores >= floor[:, None], bool))
    found: dict[int, list] = {}
    for a, b in zip(i.tolist(), j.tolist()):
        if rows[b] != own[a]:
            vec_id = ids[b]
            found.setdefault(a, []).append((-int(scores[a, b]), vec_id is None, vec_id or 0, int(rows[b])))
    return [(int(own[a]), -s, None if gone else vec_id, row) for a, hits in found.items() for s, gone, vec_id, row in sorted(hits)[:k]]


def visit(pairs: DataFrame, blocks: DataFrame, index: DataFrame, limits: DataFrame, pivots: Pivots, k: int) -> DataFrame:
    """``query, score, vec_id, row`` of what the queries of each pair's block find in its cell.

    ``limits`` has the k-th best score of each query so far. The cell comes first in
    the order of its partition, then its blocks of queries, one at a time.
    """
    held = limits.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("query", "least"))).alias("least"))  # one entry per query of a block
    asked = pairs.select("block", "cell").join(blocks.select(F.col("cell").alias("block"), "dims", "n", "rows", "q"), "block").join(held, "block", "left")
    empty = {"pivot": "bigint", "d": "binary", "vec_ids": "array<bigint>", "least": "map<bigint,decimal(38,0)>"}
    asked = asked.select("cell", F.col("block"), "dims", "n", "rows", "q", "least", *[F.lit(None).cast(empty[c]).alias(c) for c in ("pivot", "d", "vec_ids")])
    there = index.join(pairs.select("cell").distinct(), "cell", "left_semi")
    there = there.select("cell", F.lit(-1).cast("bigint").alias("block"), "dims", "n", "rows", "q", F.lit(None).cast(empty["least"]).alias("least"), "pivot", "d", "vec_ids")
    together = asked.unionByName(there).repartition("cell").sortWithinPartitions("cell", "block")

    def run(batches):
        cell = None
        for batch in batches:
            for one in batch.to_pylist():
                q = vectors.unpacked(one["q"], one["n"], one["dims"])
                if one["block"] < 0:
                    cell = (q, np.frombuffer(one["d"]), np.array(one["rows"], np.int64), one["vec_ids"], one["pivot"] % _PER_DIMS)
                    continue
                x, d, rows, ids, pivot = cell
                least = dict(one["least"] or ())
                own = np.array(one["rows"], np.int64)
                floor = np.array([int(least[r]) if r in least else -_BIG for r in one["rows"]], object)
                far = pivots.distances(q.astype(np.float64), query=True)[:, pivot]
                norm2 = (q.astype(np.float64) ** 2).sum(1)
                reach = np.sqrt(np.maximum(norm2 + pivots.top - 2 * floor.astype(np.float64), 0.0)) + pivots.slack
                open_ = np.flatnonzero(np.maximum(d[0] - far, far - d[-1]) <= reach)
                if not len(open_):
                    continue
                first = np.searchsorted(d, (far - reach)[open_].min(), "left")
                last = np.searchsorted(d, (far + reach)[open_].max(), "right")
                scores = products(q[open_], x[first:last])
                hits = best_in_cell(scores, floor[open_], rows[first:last], ids[first:last], own[open_], k)
                if hits:
                    query, score, vec_id, row = zip(*hits)
                    score = [str(max(-_BIG, min(_BIG, x))) for x in score]
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((query, score, vec_id, row), kinds)], names=["query", "score", "vec_id", "row"])

    found = together.mapInArrow(run, "query bigint, score string, vec_id bigint, row bigint")
    return found.withColumn("score", F.col("score").cast("decimal(38,0)"))


def top(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best hits of each query: highest score, then smallest identifier, null last."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", search: Search = Search()) -> DataFrame:
    """``query_id, rank, vec_id, score``: of every query the ``k`` rows with the highest integer inner products.

    ``is_query`` is a condition on ``vec_id`` and picks the queries; candidates are all
    rows but the query's own. Null vectors and those with null or non-finite components
    (beyond the range of a 32-bit float) take no part. Rows with equal identifiers are
    rows of their own: each is a query, and a candidate for the others. Only vectors with
    as many components as the query's are candidates. Ties go to the smaller identifier,
    null last. An empty table, or a query without candidates, gives no rows. Scores are
    exact; beyond a long they are reported as the largest or smallest long, and beyond
    38 digits they count as equal.
    """
    rows = stored(encoded(df, id_col, vector), "vectors")
    pivots = choose(rows, search)
    index = stored(cells(keyed(rows, pivots, query=False), search.cell), "annuli")
    blocks = stored(cells(keyed(rows.filter(is_query), pivots, query=True), search.block), "queries")
    members = blocks.select(F.col("cell").alias("block"), F.explode(F.arrays_zip(F.col("rows").alias("query"), F.col("vec_ids").alias("query_id"))).alias("m"))
    members = members.select("block", "m.query", "m.query_id").join(rows.select(F.col("row").alias("query"), "norm2"), "query")
    members = stored(members, "members")
    # A block's distances to each pivot meet the annuli around it; seen is what an earlier round has visited.
    bounds = query_reach(blocks, pivots).join(index.select("cell", "pivot", "dmin", "dmax", "n"), "pivot")
    gap = F.greatest(F.lit(0.0), F.col("dmin") - F.col("qmax"), F.col("qmin") - F.col("dmax"))
    bounds = bounds.withColumn("gap", gap)
    # First the annuli nearest to the block, of its own pivot before others, until they hold k rows besides its own.
    nearest = Window.partitionBy("block").orderBy(F.desc("home"), "gap", "cell").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(nearest), F.lit(0)) <= search.k
    bounds = stored(bounds.select("block", "cell", "gap", (first | (F.col("home") & (F.col("gap") == 0))).alias("seen")), "bounds")
    none = members.limit(0).select("block", "query", F.lit(None).cast("decimal(38,0)").alias("least"))
    best = stored(top(visit(bounds.filter("seen"), blocks, index, none, pivots, search.k), search.k), "best")
    reached = None
    for step in search.steps:
        kth = best.filter(F.col("rank") == search.k).select("query", F.col("score").alias("least"))
        limits = stored(members.join(kth, "query", "left"), "limits")
        far = F.sqrt(F.greatest(F.lit(0.0), F.col("norm2") + pivots.top - 2 * F.col("least").cast("double")))
        # Without k hits everything is open, whatever the step.
        open_ = F.when(F.col("least").isNull(), F.lit(float("inf"))).otherwise(far)
        furthest = limits.groupBy("block").agg(F.max(open_).alias("reach"))
        now = furthest.select("block", F.when(F.col("reach") == float("inf"), F.col("reach")).otherwise(F.col("reach") * step + pivots.slack).alias("reach"))
        pairs = bounds.filter("NOT seen").join(now, "block").filter(F.col("gap") <= F.col("reach"))
        if reached is not None:
            before = reached.withColumnRenamed("reach", "before")
            pairs = pairs.join(before, "block").filter(F.col("gap") > F.col("before"))
            now = now.join(before, "block").select("block", F.greatest("reach", "before").alias("reach"))
        more = visit(pairs, blocks, index, limits.filter("least IS NOT NULL"), pivots, search.k)
        best = stored(top(best.drop("rank").unionByName(more), search.k), "best")
        reached = stored(now, "reached")
    long = lambda x: F.least(F.greatest(x, F.lit(-(2**63)).cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("bigint")
    return best.join(members.select("query", "query_id"), "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", long(F.col("score")).alias("score"))
