import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bandloom.functions import stats as S
from bandloom.operators import design as D
from bandloom.operators import grid as G
from bandloom.operators import impute as N


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 400
    pdf = pd.DataFrame({"plot_id": np.arange(n), "study": rng.choice(["a", "b", "b", "b"], n), "date": rng.choice(["1", "2", "3"], n)})
    return D.dataset_id(spark.createDataFrame(pdf).repartition(5))


def test_dataset_id_is_dense_and_sorted(rows):
    pdf = rows.toPandas()
    want = pdf.groupby(["study", "date"]).ngroup()
    assert (pdf["dataset_id"] == want).all()


def test_split_takes_its_share_of_every_stratum(rows):
    pdf = D.stratified_split(rows, "dataset_id", "plot_id").toPandas()
    assert len(pdf) == 400
    for _, g in pdf.groupby("dataset_id"):
        assert g.is_test.sum() == np.floor(0.4 * len(g) + 0.5)


def test_folds_partition_and_balance(rows):
    wide = D.repeated_kfold(rows, "dataset_id", "plot_id").toPandas()
    assert len(wide) == 400
    for r in range(3):
        sizes = wide.groupby(["dataset_id", f"fold_{r}"]).size().unstack(fill_value=0)
        assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all()
    long = D.fold_rows(rows, "dataset_id", "plot_id").toPandas()
    merged = long[long["repeat"] == 1].merge(wide, on="plot_id")
    assert (merged["fold"] == merged["fold_1"]).all()
    assert not (wide.fold_0 == wide.fold_1).all()


def test_folds_do_not_depend_on_partitioning(rows):
    a = D.repeated_kfold(rows.coalesce(1), "dataset_id", "plot_id").toPandas().sort_values("plot_id")
    b = D.repeated_kfold(rows.repartition(8), "dataset_id", "plot_id").toPandas().sort_values("plot_id")
    assert (a.fold_2.values == b.fold_2.values).all()


def _brute_knn(x, k):
    out = x.copy()
    for i, f in zip(*np.nonzero(np.isnan(x))):
        d = []
        for j in range(len(x)):
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            if j != i and not np.isnan(x[j, f]) and both.any():
                d.append((x.shape[1] / both.sum() * ((x[i, both] - x[j, both]) ** 2).sum(), j))
        out[i, f] = np.mean([x[j, f] for _, j in sorted(d)[:k]])
    return out


@pytest.mark.parametrize("block,visit", [(2000, 20_000), (25, 30)])
def test_knn_equals_brute_force_in_one_or_many_blocks(spark, block, visit):
    rng = np.random.default_rng(2)
    n, p = 160, 6
    x = rng.normal(0, 3, (n, 1)) + rng.normal(0, 0.5, (n, p))
    x[rng.random(n) < 0.3] = x[0] + rng.normal(0, 1e-3, p)  # many near-equal rows
    x[rng.random((n, p)) < 0.08] = np.nan
    x[:, 0] = np.where(np.isnan(x).all(axis=1), 1.0, x[:, 0])
    data = [(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(data, "id bigint, x array<double>").repartition(4)
    got = {r.id: r.x for r in N.impute_knn(df, p, "id", block_rows=block, visit_rows=visit).collect()}
    assert np.allclose([got[i] for i in range(n)], _brute_knn(x, 2))


def test_iterative_fill_recovers_linear_structure(spark):
    rng = np.random.default_rng(4)
    n = 500
    z = rng.normal(size=(n, 2))
    x = np.column_stack([z, z @ [1.0, 2.0] + 3, z @ [-1.0, 0.5]]) + rng.normal(0, 0.01, (n, 4))
    gap = rng.random(n) < 0.1
    data = [(i, [float(v) if not (gap[i] and j == 2) else None for j, v in enumerate(r)]) for i, r in enumerate(x)]
    df = spark.createDataFrame(data, "id bigint, x array<double>").repartition(4)
    got = {r.id: r.x for r in N.impute_iterative(df, 4, ridge=1e-6, rounds=30).collect()}
    fill = np.array([got[i][2] for i in range(n)])
    assert np.allclose(fill[~gap], x[~gap, 2])
    assert np.sqrt(np.mean((fill[gap] - x[gap, 2]) ** 2)) < 0.3 * np.std(x[:, 2])


def test_no_missing_values_returns_the_input(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id bigint, x array<double>")
    assert N.impute_iterative(df, 2) is df and N.impute_knn(df, 2, "id") is df


def test_grid_size_and_decoding(spark):
    assert G.GRID.size == 648
    rows = G.decode(G.GRID.all_indices(spark), names=G.SHORT_NAMES).toPandas()
    assert len(rows.drop(columns="grid_idx").drop_duplicates()) == 648
    one = rows[rows.grid_idx == 521].iloc[0]
    want = G.GRID.level(521)
    assert one["segment"] == G.SHORT_NAMES["segment"][G.SETTINGS["segment"].index(want["segment"])]


def test_older_and_two_step_labels(spark):
    texts = [
        "{'method': ['mcari2', 'mcari2'], 'mask_percentile': [50, 75], 'mask_side': ['lower', 'upper']}",
        "{'method': ['mcari2', [800, 820]], 'mask_percentile': [90, 75], 'mask_side': ['lower', 'lower']}",
        "{'method': 'mcari2', 'wl1': [800], 'mask_percentile': [95, 98], 'mask_side': 'outside'}",
        None,
    ]
    df = spark.createDataFrame([(None, "{'window_size': 5, 'order': 2}", None, t) for t in texts], "clip string, smooth string, bin string, segment string")
    for c in df.columns:
        df = df.withColumn(c, G.parse_setting(F.col(c)))
    got = [(r.smooth_type, r.segment_type) for r in G.scenario_labels(df).collect()]
    assert got == [
        ("smooth_window_5", "seg_mcari2_between_50_75_pctl"), ("smooth_window_5", "seg_mcari2_90_upper_nir_75_upper"),
        ("smooth_window_5", "seg_mcari2_95_98_between"), ("smooth_window_5", "seg_none"),
    ]


def test_t_distribution():
    # Textbook two-sided critical values.
    assert abs(S.t_critical(0.95, 10) - 2.228139) < 1e-5
    assert abs(S.t_critical(0.999, 30) - 3.645959) < 1e-5
    assert abs(S.t_two_sided(2.228139, 10) - 0.05) < 1e-6
    assert abs(S.t_two_sided(1.0, 1) - 0.5) < 1e-12
