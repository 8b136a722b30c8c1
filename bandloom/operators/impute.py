"""Filling missing values of feature arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bands import list_matrix, matrix_list
from ..session import checkpointed
from .gram import Stats, gram_stats
from .order import broadcast_if_small, ranked


def has_missing(df: DataFrame, x: str = "x") -> bool:
    """Whether any value is missing; stops at the first one found."""
    return not df.filter(F.exists(x, lambda v: v.isNull())).isEmpty()


def impute_iterative(df: DataFrame, width: int, x: str = "x", rounds: int = 10, ridge: float = 1e-3, tol: float = 1e-4) -> DataFrame:
    """Missing values predicted from the other features, repeated until stable.

    Each round is one aggregation: the covariance of the filled rows gives the
    ridge regression of every feature on the others at once (from the inverse
    covariance). Rounds are replayed on the original rows in one narrow step, so
    neither copies nor lineage build up.
    """
    if not has_missing(df, x):
        return df
    means = np.array([v or 0.0 for v in df.agg(*[F.avg(F.col(x)[k]).alias(f"m{k}") for k in range(width)]).first()])
    updates: list[tuple[np.ndarray, np.ndarray]] = []
    at = df.columns.index(x)

    def filled(steps):
        def fill(batches):
            for b in batches:
                raw = list_matrix(b.column(at), width)
                gap = np.isnan(raw)
                now = np.where(gap, means, raw)
                for w, c in steps:
                    now = np.where(gap, now @ w + c, raw)
                arrays = list(b.columns)
                arrays[at] = matrix_list(now)
                yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names)

        return df.mapInArrow(fill, df.schema)

    for _ in range(rounds):
        rows = filled(list(updates)).select(F.lit(0).alias("g"), x, F.array(F.lit(1)).alias("member"), F.array(F.lit(0.0)).alias("target"))
        # One packed covariance comes back, whatever the number of rows.
        st = Stats.unpack(np.array(gram_stats(rows, ["g"], width, x=x).first()["stats"]), width)
        cov, _, mean, _ = st.centred()
        cov = cov / st.n
        inv = np.linalg.inv(cov + ridge * np.mean(np.diag(cov)) * np.eye(width))
        w = -inv / np.diag(inv)[None, :]
        np.fill_diagonal(w, 0.0)
        updates.append((w, mean - mean @ w))
        if len(updates) > 1 and np.max(np.abs(w - updates[-2][0])) < tol:
            break
    return filled(list(updates))


#: Boxes that are sent to every task of the neighbour search; more are looked through level by level.
TOP_BOXES = 4_096
#: Boxes that make one box of the next level.
FAN = 64


def _distances(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Squared distances over jointly present features, scaled up to all of them."""
    pq, pd_ = ~np.isnan(q), ~np.isnan(d)
    a, b = np.where(pq, q, 0.0), np.where(pd_, d, 0.0)
    fq, fd = pq.astype(float), pd_.astype(float)
    joint = fq @ fd.T
    out = (a * a) @ fd.T + fq @ (b * b).T - 2 * a @ b.T
    with np.errstate(all="ignore"):
        return np.where(joint > 0, np.maximum(out, 0) * q.shape[1] / joint, np.inf)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, each added up by itself: equal donors are equally far."""
    gap = a - b
    here = ~np.isnan(gap)
    joint = here.sum(axis=1)
    total = (np.where(here, gap, 0.0) ** 2).sum(axis=1)
    return np.where(joint > 0, total * a.shape[1] / np.maximum(joint, 1), np.inf)


def _closest(q, q_ids, d, d_ids, i, j, dist, k) -> tuple:
    """k nearest donors of every missing value among the pairs ``i, j``, as columns."""
    use = np.isfinite(dist) & (q_ids[i] != d_ids[j])
    i, j, dist = i[use], j[use], dist[use]
    pair, f = np.nonzero(np.isnan(q[i]) & ~np.isnan(d[j]))
    i, j, dist = i[pair], j[pair], dist[pair]
    order = np.lexsort((d_ids[j], dist, f, i))
    i, j, f, dist = i[order], j[order], f[order], dist[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (f[1:] != f[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
    top = np.arange(len(i)) - first < k
    i, j, f, dist = i[top], j[top], f[top], dist[top]
    return q_ids[i], f, dist, d_ids[j], d[j, f]


def _together(found: list[tuple]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0)] * 5


def _nearest(q, q_ids, d, d_ids, k):
    """k nearest donors of every missing value: columns (query, feature, distance, donor, value)."""
    out, k_at, chunk = [], min(k, len(d)) - 1, max(16, (1 << 19) // max(len(d), 1))
    absent = np.isnan(d)
    for lo in range(0, len(q), chunk):
        part, ids = q[lo : lo + chunk], q_ids[lo : lo + chunk]
        dist = _distances(part, d)
        dist[ids[:, None] == d_ids[None, :]] = np.inf
        row, f = np.nonzero(np.isnan(part))
        for at in range(0, len(row), chunk):
            r, g = row[at : at + chunk], f[at : at + chunk]
            mine = np.where(absent[:, g].T, np.inf, dist[r])
            # A little more than the k-th distance: pairs are measured again one by one.
            kth = np.partition(mine, k_at, axis=1)[:, k_at]
            big = np.nanmax(np.abs(part[r]), axis=1, initial=0.0) ** 2 * q.shape[1]
            pair, j = np.nonzero(mine <= (kth * (1 + 1e-9) + 1e-9 * big)[:, None])
            lone = np.full((len(r), q.shape[1]), 0.0)
            lone[np.arange(len(r)), g] = np.nan
            for start in range(0, len(pair), PAIRS):
                p, c = pair[start : start + PAIRS], j[start : start + PAIRS]
                out.append(_closest(lone, ids[r], d, d_ids, p, c, _exact(part[r[p]], d[c]), k))
    return _together(out)


#: Pairs of rows that are measured one by one at a time.
PAIRS = 1 << 16
#: Neighbouring blocks that a row visits in one go.
TILE = 16


def _within(q, q_ids, home, reach, d, d_ids, block, k, rows=512, donors=2048):
    """k nearest donors of every missing value among those within ``reach`` and outside a row's own block.

    Sums of squares come first, for all pairs at once and in single precision; a pair
    that may be within reach is then measured by itself.
    """
    out, width = [], q.shape[1]
    mid = np.nanmean(np.concatenate([d, np.zeros((1, width))]), axis=0)
    a, b = np.nan_to_num(q - mid), np.nan_to_num(d - mid)
    no_a, no_b = np.isnan(q), np.isnan(d)
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    # Over features that both rows have: |a|^2 + |b|^2 - 2ab, less what only one of them has.
    left = np.column_stack([-2 * a, -(a * a), -no_a.astype(float), aa, np.ones(len(a))]).astype(np.float32)
    right = np.column_stack([b, no_b, b * b, np.ones(len(b)), bb]).astype(np.float32).T
    most = bb.max(initial=0.0)
    limit = (reach * (1 + 1e-6) * (width - no_a.sum(axis=1)) / width + 1e-4 * (aa + most)).astype(np.float32)
    for lo in range(0, len(q), rows):
        for start in range(0, len(d), donors):
            part = slice(start, start + donors)
            i, j = np.nonzero(left[lo : lo + rows] @ right[:, part] <= limit[lo : lo + rows, None])
            i, j = i + lo, j + start
            other = home[i] != block[j]
            i, j, near = i[other], j[other], []
            for at in range(0, len(i), PAIRS):
                p, c = i[at : at + PAIRS], j[at : at + PAIRS]
                dist = _exact(q[p], d[c])
                use = dist <= reach[p] * (1 + 1e-9)
                near.append((p[use], c[use], dist[use]))
            if near:
                p, c, dist = (np.concatenate(v) for v in zip(*near))
                out.append(_closest(q, q_ids, d, d_ids, p, c, dist, k))
    return _together(out)


def _reached(row: np.ndarray, reach: float, lo: np.ndarray, hi: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Boxes that may hold a donor of ``row`` within ``reach``."""
    here = ~np.isnan(row)
    gap = np.maximum(np.maximum(lo[:, here] - row[here], row[here] - hi[:, here]), 0.0)
    gap = np.where(np.isfinite(gap), gap, 0.0) ** 2
    near = gap.sum(axis=1) <= reach * (1 + 1e-9)
    far = np.flatnonzero(~near)
    # A donor may miss up to ``gaps`` features: the largest gaps may not count.
    gap = np.sort(gap[far], axis=1)
    cum = np.concatenate([np.zeros((len(gap), 1)), np.cumsum(gap, axis=1)], axis=1)
    near[far] = cum[np.arange(len(gap)), np.maximum(gap.shape[1] - gaps[far], 0)] <= reach * (1 + 1e-9)
    return np.flatnonzero(near)


_GUEST = "node bigint, id bigint, x array<double>, reach double, home bigint"
_NODE = "node bigint, lo array<double>, hi array<double>, gaps bigint, kids array<bigint>, klo array<double>, khi array<double>, kgaps array<bigint>"


def _coarser(boxes: DataFrame, width: int) -> DataFrame:
    """Up to ``FAN`` neighbouring boxes as one around them, with the boxes inside it."""

    def around(t: pa.Table) -> pa.Table:
        lo, hi, gaps = list_matrix(t.column("lo"), width), list_matrix(t.column("hi"), width), t.column("gaps").to_numpy()
        one = [t.column("node")[0].as_py() // FAN, lo.min(axis=0), hi.max(axis=0), int(gaps.max()), t.column("node").to_numpy(), lo.ravel(), hi.ravel(), gaps]
        many, number = pa.list_(pa.float64()), pa.list_(pa.int64())
        kinds = (pa.int64(), many, many, pa.int64(), number, many, many, number)
        return pa.table([pa.array([v], k) for v, k in zip(one, kinds)], names=[f.strip().split()[0] for f in _NODE.split(",")])

    return boxes.select("node", "lo", "hi", "gaps").groupBy(F.floor(F.col("node") / FAN)).applyInArrow(around, _NODE)


def _dealt(guests: DataFrame, rows: DataFrame, visit_rows: int) -> tuple:
    """Guests and rows grouped by node, the guests of popular nodes in several parts."""
    parts = broadcast_if_small(guests.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / visit_rows).cast("bigint").alias("parts")))
    left = guests.join(parts, "node").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    right = rows.join(parts, "node").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
    return left.groupBy("node", "part"), right.groupBy("node", "part")


def _inside(guests: DataFrame, level: DataFrame, width: int, visit_rows: int) -> DataFrame:
    """Guests of a level's boxes moved on to the boxes inside that they may need."""
    names = [f.strip().split()[0] for f in _GUEST.split(",")]

    def move(q: pa.Table, d: pa.Table) -> pa.Table:
        if not q.num_rows or not d.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.int64())], names=names)
        m, reach = list_matrix(q.column("x"), width), q.column("reach").to_numpy()
        kids, gaps = (np.asarray(d.column(c)[0].as_py()) for c in ("kids", "kgaps"))
        lo, hi = (np.asarray(d.column(c)[0].as_py(), float).reshape(-1, width) for c in ("klo", "khi"))
        go = [_reached(m[i], reach[i], lo, hi, gaps) for i in range(len(m))]
        take = pa.array(np.repeat(np.arange(len(m)), [len(g) for g in go]))
        return pa.table([pa.array(kids[np.concatenate(go)].astype(np.int64)), *(q.column(c).take(take) for c in names[1:])], names=names)

    left, right = _dealt(guests, level, visit_rows)
    return left.cogroup(right).applyInArrow(move, _GUEST)


_FOUND = "id bigint, feature bigint, dist double, donor bigint, value double"


def _found_table(cols) -> pa.Table:
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64()]
    return pa.table([pa.array(np.asarray(c, dtype=t.to_pandas_dtype()), t) for c, t in zip(cols, kinds)], names=["id", "feature", "dist", "donor", "value"])


def impute_knn(df: DataFrame, width: int, id_col: str, x: str = "x", k: int = 2, block_rows: int = 2000, visit_rows: int = 20_000) -> DataFrame:
    """Missing values as the mean of the k nearest rows that have the value. Exact.

    Rows are cut into equal blocks along their mean value, of ``block_rows`` rows
    however many rows there are. Each block first searches itself, which bounds every
    distance; a row then visits only blocks whose bounding box is not farther than that
    bound. It finds them from large boxes to the smaller ones inside. Popular boxes and
    blocks are visited in several parts. Only k donors per value and block are kept.
    """
    if not has_missing(df, x):
        return df
    mean = F.expr(f"aggregate(filter({x}, v -> v IS NOT NULL), 0D, (s, v) -> s + v) / greatest(size(filter({x}, v -> v IS NOT NULL)), 1)")
    base = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(x).alias("x"), mean.alias("u"), F.lit(0).alias("g"))
    rows = ranked(base, ["g"], ["u", "id"], "rn").select(F.floor((F.col("rn") - 1) / block_rows).alias("block"), "id", "x")
    rows = checkpointed(rows)

    hit = "array<struct<id:bigint,feature:bigint,dist:double,donor:bigint,value:double>>"
    own_schema = f"block bigint, id bigint, x array<double>, reach double, lo array<double>, hi array<double>, gaps bigint, found {hit}"

    def own(table: pa.Table) -> pa.Table:
        m, ids = list_matrix(table.column("x"), width), table.column("id").to_numpy()
        hits = list(zip(*_nearest(m, ids, m, ids, k)))
        by: dict[int, list] = {}
        for h in hits:
            by.setdefault(int(h[0]), []).append(h)
        reach = []
        for i, row in zip(ids, m):
            per: dict[int, list[float]] = {int(f): [] for f in np.flatnonzero(np.isnan(row))}
            for h in by.get(int(i), []):
                per[int(h[1])].append(h[2])
            reach.append(max((v[k - 1] if len(v) >= k else np.inf for v in per.values()), default=-1.0))
        with np.errstate(all="ignore"):
            lo, hi = np.where(np.isnan(m), np.inf, m).min(axis=0), np.where(np.isnan(m), -np.inf, m).max(axis=0)
        gaps = int(np.isnan(m).sum(axis=1).max())
        names = ["id", "feature", "dist", "donor", "value"]
        found = [[dict(zip(names, (int(h[0]), int(h[1]), float(h[2]), int(h[3]), float(h[4])))) for h in by.get(int(i), [])] for i in ids]
        first = np.arange(len(ids)) == 0
        # The block's box travels with its first row.
        box = lambda v: pa.array([v.tolist() if f else None for f in first], pa.list_(pa.float64()))
        struct = pa.struct([("id", pa.int64()), ("feature", pa.int64()), ("dist", pa.float64()), ("donor", pa.int64()), ("value", pa.float64())])
        return pa.table(
            [
                table.column("block"), table.column("id"), table.column("x"), pa.array(reach), box(lo), box(hi),
                pa.array([gaps if f else None for f in first], pa.int64()), pa.array(found, pa.list_(struct)),
            ],
            names=["block", "id", "x", "reach", "lo", "hi", "gaps", "found"],
        )

    searched = checkpointed(rows.groupBy("block").applyInArrow(own, own_schema))
    levels = [searched.filter("lo IS NOT NULL").select(F.col("block").alias("node"), "lo", "hi", "gaps")]
    n_top = n_blocks = levels[0].count()
    while n_top > TOP_BOXES:
        levels.append(checkpointed(_coarser(levels[-1], width)))
        n_top = levels[-1].count()
    # A row is sent once to neighbouring blocks that it may need; one level of boxes tells them all.
    tile, one_level = (TILE, True) if len(levels) == 1 else (1, False)
    top = levels[-1].select("node", "lo", "hi", "gaps").toArrow()  # at most TOP_BOXES rows
    ids_t, gaps_t = top.column("node").to_numpy(), top.column("gaps").to_numpy()
    lo_t, hi_t = list_matrix(top.column("lo"), width), list_matrix(top.column("hi"), width)
    names = ["node", "id", "x", "reach", "home"]

    def visits(batches):
        for b in batches:
            if not b.num_rows:
                continue
            m, reach, home = list_matrix(b.column(2), width), b.column(3).to_numpy(), b.column(0).to_numpy()
            for i in np.flatnonzero(reach >= 0):
                go = ids_t[_reached(m[i], reach[i], lo_t, hi_t, gaps_t)]
                if one_level:
                    go = np.unique(go[go != home[i]] // tile)
                if len(go):
                    take = pa.array(np.full(len(go), i))
                    yield pa.RecordBatch.from_arrays([pa.array(go), *(b.column(c).take(take) for c in (1, 2, 3, 0))], names=names)

    found = searched.select(F.explode("found").alias("f")).select("f.*")
    if n_blocks > 1:
        guests = searched.select("block", "id", "x", "reach").mapInArrow(visits, _GUEST)
        for level in reversed(levels[1:]):
            guests = checkpointed(_inside(guests, level, width, visit_rows))

        def meet(q: pa.Table, d: pa.Table) -> pa.Table:
            if not q.num_rows or not d.num_rows:
                return _found_table([[]] * 5)
            (qx, dx), (q_ids, d_ids) = (list_matrix(t.column("x"), width) for t in (q, d)), (t.column("id").to_numpy() for t in (q, d))
            reach, home, block = q.column("reach").to_numpy(), q.column("home").to_numpy(), d.column("block").to_numpy()
            # Single precision holds squares up to 1e38; a row without a bound looks at all donors of the other blocks.
            sure = np.isfinite(reach) & (max(np.nanmax(np.abs(qx), initial=0.0), np.nanmax(np.abs(dx), initial=0.0)) < 1e15)
            found = [_within(qx[sure], q_ids[sure], home[sure], reach[sure], dx, d_ids, block, k)] if sure.any() else []
            for h in np.unique(home[~sure]):
                mine, away = ~sure & (home == h), block != h
                if away.any():
                    found.append(_nearest(qx[mine], q_ids[mine], dx[away], d_ids[away], k))
            return _found_table(_together(found))

        blocks = rows.select(F.floor(F.col("block") / tile).alias("node"), "block", "id", "x")
        left, right = _dealt(guests if one_level else guests.filter("node <> home"), blocks, visit_rows)
        found = found.unionByName(left.cogroup(right).applyInArrow(meet, _FOUND))
    nearest = F.row_number().over(Window.partitionBy("id", "feature").orderBy("dist", "donor"))
    values = found.withColumn("rn", nearest).filter(F.col("rn") <= k).groupBy("id", "feature").agg(F.avg("value").alias("value"))
    values = values.select("id", F.struct(F.col("feature").cast("int"), "value").alias("e"))
    # A row's missing values, at most its width.
    fills = values.groupBy(F.col("id").alias("__id")).agg(F.map_from_entries(F.collect_list("e")).alias("__fill"))
    joined = df.join(fills, F.col(id_col) == F.col("__id"), "left")
    full = F.transform(x, lambda v, i: F.coalesce(v, F.try_element_at("__fill", i)))
    return joined.withColumn(x, full).drop("__id", "__fill")
