"""The model sweep: feature selection, tuning, final fits and predictions.

Rows are read three times whatever the number of candidates: once for the
target transform, once for the sufficient statistics of every split, once to
score all candidates. Fits run from the statistics, one row per key and split,
spread over the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.bands import list_matrix, matrix_list
from ..functions.solvers import lasso_all, lasso_path, pls1_batch, subsets
from ..functions.target import forward, inverse_np
from ..session import checkpointed
from .gram import Stats, gram_stats, ml_lambda
from .order import broadcast_if_small
from .scores import best_candidate, best_per_feature_count
from .selection import MIN_WEIGHT, feature_sets, path_dedupe


#: Predictions that a task holds at a time while it scores candidates.
SCORE_VALUES = 1 << 19


@dataclass(frozen=True)
class Plan:
    """Settings of a sweep."""

    keys: tuple[str, ...]
    width: int
    row_id: str
    n_splits: int = 4
    n_repeats: int = 3
    n_feats: int = 30
    path_steps: int = 300
    lasso_alphas: tuple[float, ...] = tuple(10.0**k for k in range(-4, 4))
    components: tuple[int, ...] = tuple(range(2, 11))
    chunk_rows: int | None = None

    @property
    def rows_per_chunk(self) -> int:
        """Rows scored by one task at a time: as many as 32 MB hold."""
        return self.chunk_rows or max(1_000, (32 << 20) // (8 * self.width))

    @property
    def cv_splits(self) -> int:
        return self.n_splits * self.n_repeats

    @property
    def raw_split(self) -> int:
        """Split 0 is all training rows, then the folds, then all rows with the raw response."""
        return self.cv_splits + 1


# One row per fitted model, with the weights of its features only. ``cand`` orders the
# candidates of a model as tuned; ``gap`` is how far a Lasso is from its optimum.
def _model_schema(keys: list[T.StructField]) -> T.StructType:
    fields = [("split", T.LongType()), ("alpha", T.DoubleType()), ("model", T.StringType()), ("cand", T.LongType())]
    fields += [("feat_n", T.LongType()), ("las_alpha", T.DoubleType()), ("n_components", T.LongType()), ("scale", T.BooleanType())]
    fields += [("lam", T.DoubleType()), ("intercept", T.DoubleType()), ("gap", T.DoubleType())]
    fields += [("feats", T.ArrayType(T.IntegerType())), ("coef", T.ArrayType(T.DoubleType()))]
    return T.StructType(keys + [T.StructField(n, t) for n, t in fields])


class SparseModels:
    """Weights of many models as features and values, widened a block at a time."""

    def __init__(self, feats, coef, width: int):
        feats, coef = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (feats, coef))
        sizes = np.array([len(f) for f in feats], dtype=np.int64) if len(feats) else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.feats, self.coef, self.width = feats.flatten().to_numpy(zero_copy_only=False), coef.flatten().to_numpy(zero_copy_only=False), width

    def dense(self, idx: np.ndarray) -> np.ndarray:
        out = np.zeros((len(idx), self.width))
        for i, m in enumerate(idx):
            part = slice(self.starts[m], self.starts[m + 1])
            out[i, self.feats[part]] = self.coef[part]
        return out


def members(df: DataFrame, plan: Plan) -> DataFrame:
    """Training flags of every split from the fold columns."""
    flags = [F.lit(1)] + [(F.col(f"fold_{r}") != f).cast("int") for r in range(plan.n_repeats) for f in range(plan.n_splits)]
    return df.withColumn("member", F.array(*flags))


def prepare(train: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """Target transform and statistics per split: (lambdas per key, stats per key and split)."""
    keys = list(plan.keys)
    rows = members(train, plan)
    lambdas = broadcast_if_small(ml_lambda(rows, keys).select(*keys, "lambdas"))
    z = F.concat(F.transform("lambdas", lambda lam: forward(F.col("y"), lam)), F.array("y"))
    full = rows.join(lambdas, keys).withColumns({"target": z, "member": F.concat("member", F.array(F.lit(1)))})
    return lambdas, gram_stats(full, keys, plan.width)


def _spread(rows: DataFrame) -> DataFrame:
    """Few rows, much work each: one or two to a task, not merged by their small size."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def alpha_path(stats: DataFrame, plan: Plan) -> DataFrame:
    """Weights along the penalty path of the raw response (keys, alpha, gap, coef).

    ``gap`` is the optimality gap of a fit, 0 but for rounding.
    """
    keys = list(plan.keys)
    raw = stats.filter(F.col("split") == plan.raw_split).select(*keys, "stats")
    extra = [T.StructField("alpha", T.DoubleType()), T.StructField("gap", T.DoubleType()), T.StructField("coef", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([raw.schema[k] for k in keys] + extra)
    width, n_feats, steps = plan.width, plan.n_feats, plan.path_steps

    def solve(batches):
        for b in batches:
            for i in range(len(b)):
                st = Stats.unpack(b.column(len(keys))[i].values.to_numpy(), width)
                cov, cross, _, _ = st.centred()
                path = lasso_path(cov, cross, st.n, n_feats, steps, min_weight=MIN_WEIGHT)
                lead = [b.column(k).take(pa.array([i] * len(path))) for k in range(len(keys))]
                weights = matrix_list(np.array([w for _, w, _ in path]))
                yield pa.RecordBatch.from_arrays([*lead, pa.array([a for a, _, _ in path]), pa.array([g for _, _, g in path]), weights], names=schema.names)

    return _spread(raw).mapInArrow(solve, schema)


def distinct_sets(path: DataFrame, plan: Plan) -> DataFrame:
    """Distinct feature sets of a path, each with its largest penalty."""
    return path_dedupe(feature_sets(path).drop("coef"), list(plan.keys))


def _lasso_fits(st: Stats, centred: tuple, sets: list[np.ndarray], alphas) -> list[tuple]:
    """``(set, penalty number, weights, gap)`` of every set and penalty."""
    cov, cross, _, _ = centred
    out = []
    for i, f in enumerate(sets):
        w, gaps = lasso_all(cov[np.ix_(f, f)], cross[f], st.n, alphas)
        out += [(i, a, w[a], gaps[a]) for a in range(len(alphas))]
    return out


def _pls_fits(st: Stats, centred: tuple, sets: list[np.ndarray], components: int) -> np.ndarray:
    """Weights ``(scaled or not, components, sets, features)``; a set's rows beyond its features are 0."""
    cov, cross = subsets(centred[0], centred[1], sets)
    spread = np.sqrt(np.maximum(np.einsum("gjj->gj", cov), 0) / max(st.n - 1, 1))
    out = []
    for sd in (np.where(spread > 0, spread, 1.0), np.ones_like(spread)):
        out.append(pls1_batch(cov / (sd[:, :, None] * sd[:, None, :]), cross / sd, components) / sd)
    return np.array(out)


def fit_candidates(stats: DataFrame, lambdas: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Every model candidate of every feature set on every fold's training part.

    A key has at most ``path_steps`` feature sets; they travel with the
    statistics, whose rows (one per key and fold) are spread evenly. All penalties of
    a set are read from one exact path, all sets' latent variables come as one batch.
    """
    keys = list(plan.keys)
    packed = sets.filter("feat_n > 0").groupBy(*keys).agg(F.collect_list(F.struct("alpha", "feats")).alias("sets"))
    folds = stats.filter((F.col("split") > 0) & (F.col("split") < plan.raw_split))
    rows = folds.join(broadcast_if_small(lambdas), keys).withColumn("lam", F.element_at("lambdas", (F.col("split") + 1).cast("int"))).drop("lambdas")
    rows = _spread(rows.join(packed, keys).select(*keys, "split", "lam", "stats", "sets"))
    schema = _model_schema([rows.schema[k] for k in keys])
    width, alphas, comps, nk = plan.width, plan.lasso_alphas, plan.components, len(keys)

    def fitted(st, known):
        """Columns of all models of one key and fold, as lists."""
        centred = cov, cross, mx, mz = st.centred()
        feats = [np.asarray(s["feats"], dtype=np.int32) for s in known]
        out = {n: [] for n in schema.names[nk:] if n not in ("split", "lam")}

        def add(i, model, cand, w, gap=None, las_alpha=None, n_components=None, scale=None):
            f = feats[i]
            for name, v in zip(out, (known[i]["alpha"], model, cand, len(f), las_alpha, n_components, scale, mz - w @ mx[f], gap, f, w)):
                out[name].append(v)

        for i, a, w, gap in _lasso_fits(st, centred, feats, alphas):
            add(i, "lasso", a, w, gap, las_alpha=alphas[a])
        several = [i for i, f in enumerate(feats) if len(f) >= 2]
        if several:
            most = max(len(feats[i]) for i in several)
            w = _pls_fits(st, centred, [feats[i] for i in several], min(max(comps), most))
            for at, i in enumerate(several):
                for c, k in enumerate(comps):
                    for j, scale in enumerate((True, False)):
                        if k <= len(feats[i]):
                            add(i, "pls", 2 * c + j, w[j, k - 1, at, : len(feats[i])], n_components=k, scale=scale)
        return out

    def solve(batches):
        for b in batches:
            for i in range(len(b)):
                lam = b.column(nk + 1)[i].as_py()
                out = fitted(Stats.unpack(b.column(nk + 2)[i].values.to_numpy(), width), b.column(nk + 3)[i].as_py())
                same = pa.array([i] * len(out["alpha"]), pa.int64())
                sizes = pa.array(np.cumsum([0, *map(len, out["feats"])]), pa.int32())
                lists = {n: pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(out[n]))) for n in ("feats", "coef") if out[n]}
                if not lists:
                    continue
                lead = {k: b.column(c).take(same) for c, k in enumerate(keys)} | {"split": b.column(nk).take(same), "lam": pa.array([lam] * len(same), pa.float64())}
                kinds = {"cand": pa.int64(), "feat_n": pa.int64(), "n_components": pa.int64(), "model": pa.string(), "scale": pa.bool_()}
                cols = {n: pa.array(v, kinds.get(n, pa.float64())) for n, v in out.items() if n not in lists}
                yield pa.RecordBatch.from_pydict({n: (lead | cols | lists)[n] for n in schema.names})

    return rows.mapInArrow(solve, schema)


def _salted(rows: DataFrame, side: DataFrame, plan: Plan):
    """Rows and models grouped by key and row chunk, so a large key is scored by many tasks."""
    keys = list(plan.keys)
    parts = broadcast_if_small(rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / plan.rows_per_chunk).cast("bigint").alias("__parts")))
    left = rows.join(parts, keys).withColumn("__salt", F.pmod(F.xxhash64(plan.row_id), F.col("__parts"))).drop("__parts")
    right = side.join(parts, keys).withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__parts") - 1))).drop("__parts")
    by = [*keys, "__salt"]
    return left.groupBy(*by), right.groupBy(*by)


def score_candidates(train: DataFrame, models: DataFrame, plan: Plan, block: int = 256) -> DataFrame:
    """Errors of every candidate on the training and validation rows of its split.

    Predictions are taken back through the split's transform. Rows whose prediction
    has no inverse are counted in ``n_bad``; a candidate with any has no score there.
    """
    keys, width = list(plan.keys), plan.width
    rows = members(train, plan).select(*keys, plan.row_id, "x", "y", F.transform("member", lambda m: m.cast("double")).alias("member"))
    rest = ["split", "alpha", "model", "cand"]
    side = models.select(*keys, *rest, "lam", "intercept", "feats", "coef")
    sums = ["n", "n_bad", "sae", "sse", "sy", "syy"]
    schema = T.StructType(
        [side.schema[c] for c in (*keys, *rest)] + [T.StructField("role", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in sums]
    )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        n_rows, n_models = left.num_rows, right.num_rows
        if not n_rows or not n_models:
            return schema_arrow.empty_table()
        x, y = list_matrix(left.column("x"), width), left.column("y").to_numpy()
        member = list_matrix(left.column("member"), len(left.column("member")[0])) > 0
        coef, lam = SparseModels(right.column("feats"), right.column("coef"), width), right.column("lam").to_numpy()
        icpt, split = right.column("intercept").to_numpy(), right.column("split").to_numpy()
        out = {role: np.zeros((n_models, len(sums))) for role in ("train", "val")}
        # As many rows at a time as a block of models may predict, so that the many temporary arrays stay small.
        step = max(1, SCORE_VALUES // block)
        for s in np.unique(split):
            at = np.flatnonzero(split == s)
            for lo in range(0, len(at), block):
                idx = at[lo : lo + block]
                weights = coef.dense(idx).T
                for start in range(0, n_rows, step):
                    part = slice(start, start + step)
                    pred = inverse_np(x[part] @ weights + icpt[idx], float(lam[idx[0]]))
                    for role, mask in (("train", member[part, s]), ("val", ~member[part, s])):
                        p, t = pred[mask], y[part][mask][:, None]
                        ok = np.isfinite(p)
                        e, tv = np.where(ok, p - t, 0.0), np.where(ok, t, 0.0)
                        out[role][idx] += np.column_stack(
                            [ok.sum(0), (~ok).sum(0), np.abs(e).sum(0), (e * e).sum(0), tv.sum(0), (tv * tv).sum(0)]
                        )
        tables = []
        for role, m in out.items():
            cols = [right.column(c) for c in (*keys, *rest)] + [pa.array([role] * n_models)] + [pa.array(m[:, i]) for i in range(len(sums))]
            tables.append(pa.table(cols, names=schema.names))
        return pa.concat_tables(tables)

    schema_arrow = pa.schema(
        [(f.name, {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}[f.dataType.simpleString()]) for f in schema.fields]
    )
    left, right = _salted(rows, side, plan)
    partial = left.cogroup(right).applyInArrow(score, schema)
    total = partial.groupBy(*keys, *rest, "role").agg(*[F.sum(c).alias(c) for c in sums])
    n = F.col("n")
    spread = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)
    whole = (n > 0) & (F.col("n_bad") == 0)
    return total.select(
        *keys, *rest, "role", n.cast("bigint").alias("n"), F.col("n_bad").cast("bigint").alias("n_bad"),
        F.when(whole, F.col("sae") / n).alias("mae"), F.when(whole, F.col("sse") / n).alias("mse"),
        F.when(whole & (spread > 0), 1 - F.col("sse") / spread).alias("r2"),
    )


def cv_scores(train: DataFrame, models: DataFrame, plan: Plan) -> DataFrame:
    """One row per candidate and split with validation and training errors."""
    long = score_candidates(train, models, plan)
    by = [*plan.keys, "split", "alpha", "model", "cand"]
    pick = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    return long.groupBy(*by).agg(
        *[pick("val", c).alias(c) for c in ("mae", "mse", "r2")], *[pick("train", c).alias(f"train_{c}") for c in ("mae", "mse", "r2")], F.sum("n_bad").alias("n_bad")
    )


def tune(train: DataFrame, plan: Plan) -> dict[str, DataFrame]:
    """Run the sweep up to the tuning table.

    Returns the statistics, feature sets, candidate scores and ``tuning``: the
    best candidate per key, feature set and model with its parameters. Sets too
    small for a model appear with empty scores. The candidate scores (``cv``)
    are not kept; reading them scores the candidates again.
    """
    keys = list(plan.keys)
    lambdas, stats = prepare(train, plan)
    # Every later step starts from the stored statistics and sets, not from the rows.
    stats = checkpointed(stats)
    path = alpha_path(stats, plan)
    sets = checkpointed(distinct_sets(path, plan))
    models = fit_candidates(stats, lambdas, sets, plan)
    cv = cv_scores(train, models, plan)
    metrics = ("mae", "mse", "r2", "train_mae", "train_mse", "train_r2", "n_bad")
    best = best_candidate(cv, [*keys, "alpha", "model"], metrics=metrics)
    las = F.array(*[F.lit(a) for a in plan.lasso_alphas])
    comp = F.array(*[F.lit(c) for c in plan.components])
    is_lasso = F.col("model") == "lasso"
    best = best.withColumns(
        {
            "las_alpha": F.when(is_lasso, F.try_element_at(las, (F.col("cand") + 1).cast("int"))),
            "n_components": F.when(~is_lasso, F.try_element_at(comp, (F.floor(F.col("cand") / 2) + 1).cast("int"))),
            "scale": F.when(~is_lasso, F.col("cand") % 2 == 0),
        }
    )
    every = sets.withColumn("model", F.explode(F.array(F.lit("lasso"), F.lit("pls"))))
    tuning = checkpointed(every.join(best, [*keys, "alpha", "model"], "left"))
    return {"lambdas": lambdas, "stats": stats, "path": path, "sets": sets, "models": models, "cv": cv, "tuning": tuning}


def best_by_count(tuning: DataFrame, plan: Plan) -> DataFrame:
    """Best tuned row per model and feature count, with its parameters."""
    keys = [*plan.keys, "model"]
    signed = tuning.withColumn("score", -F.col("mean_mae"))
    best = best_per_feature_count(signed.select(*keys, "feat_n", "score", "alpha"), keys, "score", ["alpha"])
    return best.join(tuning, [*keys, "feat_n", "alpha"]).filter("cand IS NOT NULL")


def final_models(stats: DataFrame, lambdas: DataFrame, best: DataFrame, plan: Plan) -> DataFrame:
    """Best candidates refitted on all training rows; for Lasso also the features used on the raw response.

    A key's candidates travel together, so its two statistics are sent once.
    """
    keys = list(plan.keys)
    lead = ["model", "feat_n", "alpha", "feats", "feat_ranking", "las_alpha", "n_components", "scale"]
    packed = best.groupBy(*keys).agg(F.collect_list(F.struct(*lead)).alias("best"))  # at most two per feature count
    rows = packed.join(stats.filter("split = 0").select(*keys, "stats"), keys)
    rows = rows.join(stats.filter(F.col("split") == plan.raw_split).select(*keys, F.col("stats").alias("raw")), keys)
    rows = rows.join(lambdas.select(*keys, F.col("lambdas")[0].alias("lam")), keys).select(*keys, "lam", "stats", "raw", "best")
    extra = [T.StructField("intercept", T.DoubleType()), T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("gap", T.DoubleType())]
    extra += [T.StructField("feats_used", T.ArrayType(T.LongType()))]
    fitted = T.ArrayType(T.StructType([best.schema[c] for c in lead] + extra))
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("lam", T.DoubleType()), T.StructField("fitted", fitted)])
    width = plan.width

    def one(st, raw, m):
        centred, feats = st.centred(), np.asarray(m["feats"], dtype=int)
        used, gap = None, None
        if m["model"] == "lasso":
            ((_, _, w, gap),) = _lasso_fits(st, centred, [feats], [m["las_alpha"]])
            ((_, _, plain, _),) = _lasso_fits(raw, raw.centred(), [feats], [m["las_alpha"]])
            used = feats[np.abs(plain) > MIN_WEIGHT].tolist()
        else:
            w = _pls_fits(st, centred, [feats], int(m["n_components"]))[0 if m["scale"] else 1, -1, 0]
        return m | {"intercept": float(centred[3] - w @ centred[2][feats]), "coef": w.tolist(), "gap": gap, "feats_used": used}

    arrow = to_arrow_schema(schema)

    def solve(batches):
        for b in batches:
            for r in b.to_pylist():
                st, raw = (Stats.unpack(np.asarray(r[c]), width) for c in ("stats", "raw"))
                row = {k: r[k] for k in (*keys, "lam")} | {"fitted": [one(st, raw, m) for m in r["best"]]}
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    return _spread(rows).mapInArrow(solve, schema).select(*keys, "lam", F.inline("fitted"))


def predict(rows: DataFrame, models: DataFrame, plan: Plan, carry: list[str]) -> DataFrame:
    """Predictions of every model for every row, in long form (carry, model, feat_n, y, y_pred)."""
    keys, width = list(plan.keys), plan.width
    data = rows.select(*keys, *[c for c in (plan.row_id, *carry) if c not in keys], "x", "y")
    side = models.select(*keys, "model", "feat_n", "lam", "intercept", "feats", "coef")
    kept = [c for c in data.columns if c not in ("x", "y", *keys)]
    schema = T.StructType(
        [data.schema[c] for c in (*keys, *kept)] + [side.schema["model"], side.schema["feat_n"], T.StructField("y", T.DoubleType()), T.StructField("y_pred", T.DoubleType())]
    )

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [*keys, *kept]
        if not left.num_rows or not right.num_rows:
            empty = [left.column(c).slice(0, 0) for c in names] + [pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.float64())]
            return pa.table(empty, names=schema.names)
        coef = SparseModels(right.column("feats"), right.column("coef"), width).dense(np.arange(right.num_rows))
        z = list_matrix(left.column("x"), width) @ coef.T + right.column("intercept").to_numpy()
        tables = []
        for m in range(right.num_rows):
            pred = inverse_np(z[:, m], right.column("lam")[m].as_py())
            cols = [left.column(c) for c in names]
            cols += [pa.array([right.column("model")[m].as_py()] * left.num_rows, pa.string()), pa.array(np.full(left.num_rows, right.column("feat_n")[m].as_py(), dtype=np.int64))]
            tables.append(pa.table([*cols, left.column("y"), pa.array(pred, from_pandas=True)], names=schema.names))
        return pa.concat_tables(tables)

    left, right = _salted(data, side, plan)
    return left.cogroup(right).applyInArrow(apply, schema)
