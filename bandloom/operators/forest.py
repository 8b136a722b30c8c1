"""Regression forests from one binned table, for all candidates, folds and trees at once.

Features are cut into bins at quantiles, so a row is a few bytes. The trees of all
feature shares, repeats and folds grow together, level by level: a job per level adds
up histograms (rows and responses per bin) of the open nodes, and the best split of a
node is read from its histogram. The number of jobs is the depth, whatever the number
of candidates. Candidates that differ only in the smallest node that is split share
their trees: such a limit cuts a tree back when it predicts and changes no split.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bands import list_matrix
from ..session import checkpointed


@dataclass(frozen=True)
class Forest:
    """``shares`` (of the features a node may use) times ``min_split`` are the candidates, numbered in this order."""

    width: int
    shares: tuple[float, ...] = (0.05, 0.1, 0.3, 0.9)
    min_split: tuple[int, ...] = (2, 4, 6, 8, 10)
    trees: int = 300
    depth: int = 8
    bins: int = 32
    n_splits: int = 4
    n_repeats: int = 3
    bootstrap: bool = True
    seed: int = 973717

    @property
    def size(self) -> int:
        """Trees of all shares, repeats, folds."""
        return len(self.shares) * self.n_repeats * self.n_splits * self.trees

    def place(self, tree: int) -> tuple[int, int, int]:
        """Share, repeat and held-out fold of a tree."""
        rest = tree // self.trees
        return rest // (self.n_repeats * self.n_splits), rest // self.n_splits % self.n_repeats, rest % self.n_splits

    def features(self, tree: int, node: int) -> np.ndarray:
        """The features that a node may use; the same in every task."""
        k = max(1, round(self.shares[self.place(tree)[0]] * self.width))
        return np.sort(np.random.default_rng((self.seed, tree, node)).choice(self.width, k, replace=False))

    def weights(self, keys: np.ndarray, tree: int) -> np.ndarray:
        """How often each row is drawn for a tree: Poisson by a hash of row and tree."""
        if not self.bootstrap:
            return np.ones(len(keys))
        with np.errstate(over="ignore"):
            h = keys.view(np.uint64) + np.uint64(tree * 2 + 1) * np.uint64(0x9E3779B97F4A7C15)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        u, out, cdf, term = (h >> np.uint64(11)) / float(1 << 53), np.zeros(len(keys)), 0.0, np.exp(-1.0)
        for k in range(9):
            cdf += term
            out += u >= cdf
            term /= k + 1
        return out


@dataclass
class Trees:
    """Grown trees as arrays: node i has the children 2i and 2i + 1; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    rows: np.ndarray
    mean: np.ndarray

    @classmethod
    def empty(cls, plan: Forest) -> "Trees":
        shape = (plan.size, 2 << plan.depth)
        return cls(np.full(shape, -1, np.int16), np.zeros(shape, np.uint8), np.zeros(shape, np.float32), np.zeros(shape, np.float64))

    def nodes(self, tree: int, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row at ``depth``, 0 where its way ended before."""
        flat, base = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
        feature, cut = self.feature[tree].astype(np.int64), self.cut[tree]
        at = np.ones(len(bins), np.int64)
        for _ in range(depth):
            f = feature.take(at)
            right = flat.take(base + np.maximum(f, 0)) > cut.take(at)
            at = np.where((f >= 0) & (at > 0), 2 * at + right, 0)
        return at


def binned(df: DataFrame, plan: Forest, row_id: str, x: str = "x", y: str = "y") -> DataFrame:
    """``key, y, folds, bins``: a row's features as one byte each, cut at approximate quantiles.

    The cuts are ``width`` times ``bins`` numbers. Rows without a response are left out.
    """
    probs = [i / plan.bins for i in range(1, plan.bins)]
    known = df.filter(F.col(y).isNotNull())
    cuts = known.agg(*[F.percentile_approx(F.col(x)[i], probs, 10_000).alias(f"c{i}") for i in range(plan.width)]).first()
    edges = [np.unique(np.asarray(c if c is not None else [], float)) for c in cuts]
    folds = F.array(*[F.col(f"fold_{r}").cast("int") for r in range(plan.n_repeats)])
    rows = known.select(F.xxhash64(row_id).alias("key"), F.col(y).cast("double").alias("y"), folds.alias("folds"), F.col(x).alias("x"))
    width = plan.width

    def cut(batches):
        for b in batches:
            m = list_matrix(b.column(3), width)
            code = np.column_stack([np.searchsorted(e, m[:, i], "left") for i, e in enumerate(edges)]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r.tobytes() for r in code], pa.binary())], names=["key", "y", "folds", "bins"])

    return rows.mapInArrow(cut, "key bigint, y double, folds array<int>, bins binary")


def _unpack(b: pa.RecordBatch, plan: Forest) -> tuple[np.ndarray, ...]:
    folds = list_matrix(b.column(2), plan.n_repeats).astype(int)
    return b.column(0).to_numpy(), b.column(1).to_numpy(), folds, np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(len(b), plan.width)


_HIST = "tree int, node int, hist binary"
#: Bytes of histograms that a task sends on at a time.
SENT = 8 << 20
#: Rows that a task holds at a time; a row is ``width`` bytes and a few numbers.
ROWS_HELD = 1 << 18
#: Rows whose places in the histograms are worked out at a time.
STEP = 1 << 14


def _blocks(batches, plan: Forest):
    """Group, keys, responses, folds and bins of up to about ``ROWS_HELD`` rows at a time, whatever the size of a batch."""
    held: dict[int, list] = {}
    size = 0

    def blocks():
        for g, parts in held.items():
            yield g, *(np.concatenate(c) for c in zip(*parts))

    for b in batches:
        if not len(b):
            continue
        cols, groups = _unpack(b, plan), b.column(4).to_numpy()
        for g in np.unique(groups).tolist():
            mine = np.flatnonzero(groups == g)
            held.setdefault(g, []).append([c[mine] for c in cols])
        size += len(b)
        if size >= ROWS_HELD:
            yield from blocks()
            held, size = {}, 0
    yield from blocks()


def _tree_histograms(trees: Trees, plan: Forest, tree: int, depth: int, key, y, folds, bins):
    """``node, histogram`` of a tree's open nodes at ``depth`` that any of the rows is drawn for."""
    # Nodes whose rows are too few or alike are not open.
    opened = np.flatnonzero(trees.feature[tree] == -2) if depth else np.ones(1, np.int64)
    if not len(opened):
        return
    _, r, f = plan.place(tree)
    slot = np.full(trees.feature.shape[1], -1, np.int64)
    slot[opened] = np.arange(len(opened))
    feats = np.array([plan.features(tree, n) for n in opened.tolist()])
    k, flat = feats.shape[1], bins.ravel()
    cells = k * (plan.bins + 1)
    first = np.arange(len(opened))[:, None] * cells + np.arange(k) * (plan.bins + 1)
    weight, response = np.zeros(len(opened) * cells), np.zeros(len(opened) * cells)
    squares, seen = np.zeros(len(opened)), np.zeros(len(opened), np.int64)
    for lo in range(0, len(y), STEP):
        at = lo + np.flatnonzero(folds[lo : lo + STEP, r] != f)
        own = slot.take(trees.nodes(tree, bins[at], depth))
        live = np.flatnonzero(own >= 0)
        at, own = at[live], own[live]
        w = plan.weights(key[at], tree)
        live = np.flatnonzero(w > 0)
        at, own, w = at[live], own[live], w[live]
        z = w * y[at]
        place = (first[own] + flat.take(at[:, None] * plan.width + feats[own])).ravel()
        weight += np.bincount(place, np.repeat(w, k), len(weight))
        response += np.bincount(place, np.repeat(z, k), len(weight))
        order = np.argsort(own, kind="stable")
        here, starts = np.unique(own[order], return_index=True)
        for n, start, end in zip(here.tolist(), starts, [*starts[1:], len(order)]):
            i = order[start:end]
            squares[n] += np.dot(w[i], y[at[i]] ** 2)
            seen[n] += len(i)
    weight, response = weight.reshape(-1, cells), response.reshape(-1, cells)
    for i in np.flatnonzero(seen):
        yield int(opened[i]), np.concatenate([weight[i], response[i], squares[i : i + 1]])


def _histograms(rows: DataFrame, plan: Forest, grown, depth: int, n_groups: int) -> DataFrame:
    """Histograms of the open nodes of one level, one partial per block of rows and node.

    A task takes its rows through one tree after the other, so that it holds the
    histograms of one tree and sends as many as there are nodes, whatever the number of rows.
    """

    def emit(made):
        arrays = [pa.array([m[i] for m in made], pa.int32()) for i in (0, 1)] + [pa.array([m[2].tobytes() for m in made], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["tree", "node", "hist"])

    def run(batches):
        trees = grown.value
        for group, *cols in _blocks(batches, plan):
            made, size = [], 0
            for tree in range(int(group), plan.size, n_groups):
                for node, hist in _tree_histograms(trees, plan, tree, depth, *cols):
                    made.append((tree, node, hist))
                    size += hist.nbytes
                    if size >= SENT:
                        yield emit(made)
                        made, size = [], 0
            if made:
                yield emit(made)

    return rows.mapInArrow(run, _HIST)


def _splits(hists: DataFrame, plan: Forest) -> DataFrame:
    """The best split of every node: feature -1 where none lowers the squared error."""
    schema = "tree int, node int, feature int, cut int, n double, mean double, n_left double, mean_left double, n_right double, mean_right double, varied boolean"

    def best(tree, node, hist):
        feats = plan.features(tree, node)
        w, s = hist[:-1].reshape(2, len(feats), plan.bins + 1)
        n, total = w[0].sum(), s[0].sum()
        left_n, left_s = w.cumsum(axis=1)[:, :-1], s.cumsum(axis=1)[:, :-1]
        right_n, right_s = n - left_n, total - left_s
        with np.errstate(all="ignore"):
            gain = left_s**2 / left_n + right_s**2 / right_n - total**2 / n
        # Rounded, so that equal splits stay equal in whatever order rows were added up.
        scale = max(hist[-1] - total**2 / n, 1e-300)
        gain = np.where((left_n > 0.5) & (right_n > 0.5), np.round(gain / scale, 9), -np.inf)
        i, c = np.unravel_index(int(gain.argmax()), gain.shape)
        varied = hist[-1] - total**2 / n > 1e-12 * max(hist[-1], 1e-300)
        if not gain[i, c] > 0 or not varied:
            return (tree, node, -1, 0, n, total / n, 0.0, 0.0, 0.0, 0.0, bool(varied))
        return (tree, node, int(feats[i]), int(c), n, total / n, left_n[i, c], left_s[i, c] / left_n[i, c], right_n[i, c], right_s[i, c] / right_n[i, c], True)

    def run(batches):
        key, total = None, None
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 6, pa.bool_())
        names = [f.split()[0] for f in schema.split(", ")]
        for b in batches:
            out = []
            for tree, node, hist in zip(*(c.to_pylist() for c in b.columns)):
                if (tree, node) != key:
                    if key:
                        out.append(best(*key, total))
                    key, total = (tree, node), np.zeros(len(hist) // 8)
                total = total + np.frombuffer(hist)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(best(*key, total), kinds)], names=names)

    return hists.repartition("tree", "node").sortWithinPartitions("tree", "node").mapInArrow(run, schema)


def grow(rows: DataFrame, plan: Forest) -> Trees:
    """All trees; a job per level. What comes to the driver is a row per open node.

    Rows are cut into as few parts as tasks can hold, because every part sends on
    histograms of its own; with fewer parts than cores the trees are dealt to copies of the rows.
    """
    spark = rows.sparkSession
    parts = max(1, -(-rows.count() // ROWS_HELD))
    n_groups = min(plan.size, max(1, -(-2 * spark.sparkContext.defaultParallelism // parts)))
    part = F.pmod(F.xxhash64("key", "y", "bins"), F.lit(parts)).cast("int")
    dealt = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    dealt = checkpointed(dealt.repartitionById(n_groups * parts, F.col("group") * parts + part))
    trees = Trees.empty(plan)
    for depth in range(plan.depth):
        sent = spark.sparkContext.broadcast(trees)
        found = _splits(_histograms(dealt, plan, sent, depth, n_groups), plan).toPandas()
        sent.unpersist()
        if not len(found):
            break
        t, n = found["tree"].to_numpy(), found["node"].to_numpy()
        trees.rows[t, n], trees.mean[t, n] = found["n"], found["mean"]
        trees.feature[t, n], trees.cut[t, n] = found["feature"], found["cut"]
        split = found[found["feature"] >= 0]
        t, n = split["tree"].to_numpy(), split["node"].to_numpy()
        for side, child in (("left", 2 * n), ("right", 2 * n + 1)):
            trees.rows[t, child], trees.mean[t, child] = split[f"n_{side}"], split[f"mean_{side}"]
            enough = split[f"n_{side}"].to_numpy() >= max(2, min(plan.min_split))
            trees.feature[t, child] = np.where(enough & (depth + 1 < plan.depth), -2, -1)  # -2: open
    trees.feature[trees.feature == -2] = -1
    return trees


def predictions(trees: Trees, plan: Forest, tree: int, bins: np.ndarray) -> np.ndarray:
    """Rows x ``min_split``: the mean at the first node on the way that is too small to split, or at the leaf."""
    out, at = np.zeros((len(bins), len(plan.min_split))), np.ones(len(bins), np.int64)
    open_ = np.ones(out.shape, bool)
    limit = np.asarray(plan.min_split)
    for _ in range(plan.depth + 1):
        f = trees.feature[tree, at]
        ends = open_ & ((trees.rows[tree, at][:, None] < limit[None, :]) | (f < 0)[:, None])
        out = np.where(ends, trees.mean[tree, at][:, None], out)
        open_ &= ~ends
        if not open_.any():
            break
        right = bins[np.arange(len(bins)), np.maximum(f, 0)] > trees.cut[tree, at]
        at = np.where(f >= 0, 2 * at + right, at)
    return out


def forest_sweep(df: DataFrame, plan: Forest, row_id: str, x: str = "x", y: str = "y") -> DataFrame:
    """Scores of every candidate on the rows that each fold holds out (``cand, repeat, fold, n, mae, rmse, r2``).

    ``df`` has a fold column per repeat (``fold_0``, ...). Errors are added up in the
    tasks; a row per candidate, repeat and fold is what is shuffled.
    """
    rows = checkpointed(binned(df, plan, row_id, x, y))
    trees = rows.sparkSession.sparkContext.broadcast(grow(rows, plan))
    sums = ["n", "sae", "sse", "sy", "syy"]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("cand", "repeat", "fold")] + [T.StructField(c, T.DoubleType()) for c in sums])
    block = len(plan.min_split)

    def score(batches):
        for b in batches:
            _, y, folds, bins = _unpack(b, plan)
            out = []
            for first in range(0, plan.size, plan.trees):
                s, r, f = plan.place(first)
                at = np.flatnonzero(folds[:, r] == f)
                if not len(at):
                    continue
                pred = sum(predictions(trees.value, plan, first + t, bins[at]) for t in range(plan.trees)) / plan.trees
                err, v = pred - y[at][:, None], y[at]
                for m in range(block):
                    out.append((s * block + m, r, f, float(len(at)), np.abs(err[:, m]).sum(), (err[:, m] ** 2).sum(), v.sum(), (v * v).sum()))
            kinds = [pa.int64()] * 3 + [pa.float64()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=schema.names)

    spread = rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)  # every row goes through all trees
    total = spread.mapInArrow(score, schema).groupBy("cand", "repeat", "fold").agg(*[F.sum(c).alias(c) for c in sums])
    around = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return total.select(
        "cand", "repeat", "fold", F.col("n").cast("bigint").alias("n"), (F.col("sae") / F.col("n")).alias("mae"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
        F.when(around > 0, 1 - F.col("sse") / around).alias("r2"),
    )
