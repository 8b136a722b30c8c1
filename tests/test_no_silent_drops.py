"""Rows, groups and records that must not get lost, and groups in which nothing varies."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bandloom.operators import chains, design, order, scores, sensitivity
from bandloom.operators.grid import GRID
from bandloom.sources import tables
from bandloom.streaming import ingest

PATHS = [2_000_000, 0]  # the built-in window or aggregate, and the path for large groups


@pytest.mark.parametrize("limit", PATHS)
def test_null_keys_are_a_group(spark, limit):
    rows = [(None, i, float(i)) for i in range(5)] + [("a", i, float(i)) for i in range(3)] + [("a", 9, None)]
    df = spark.createDataFrame(rows, "k string, i bigint, v double")
    got = order.ranked(df, ["k"], ["i"], small_group_rows=limit).collect()
    assert sorted((str(r.k), r.i, r.rn) for r in got) == sorted([("None", i, i + 1) for i in range(5)] + [("a", i, i + 1) for i in range(3)] + [("a", 9, 4)])


@pytest.mark.parametrize("limit", PATHS)
def test_groups_without_values_keep_their_row(spark, limit):
    rows = [(None, 1.0, 4.0), (None, 3.0, None), ("b", None, 2.0), ("b", None, 6.0), ("c", None, None)]
    got = order.exact_percentiles(spark.createDataFrame(rows, "k string, v double, w double"), ["k"], ["v", "w"], [0.0, 0.5], small_group_rows=limit)
    assert {(r.k, str(r.v_pctl), str(r.w_pctl)) for r in got.collect()} == {
        (None, "[1.0, 2.0]", "[4.0, 4.0]"), ("b", "None", "[2.0, 4.0]"), ("c", "None", "None"),
    }


def test_null_strata_studies_and_dates_stay(spark):
    df = spark.createDataFrame([(None, None, 1), ("s", None, 2), ("s", "d", 3), (None, "d", 4)], "study string, date string, id bigint")
    assert sorted(r.dataset_id for r in design.dataset_id(df).collect()) == [0, 1, 2, 3]
    strata = spark.createDataFrame([(None if i % 2 else 1, i) for i in range(20)], "g bigint, id bigint")
    assert design.stratified_split(strata, "g", "id").filter("is_test").groupBy().count().first()[0] == 8
    assert design.repeated_kfold(strata, "g", "id").filter("fold_0 is not null").count() == 20


def test_candidates_that_fail_anywhere_come_last(spark):
    rows = [("k", 0, 0, 0.1, 0), ("k", 0, 1, None, 3), ("k", 1, 0, 5.0, 0), ("k", 1, 1, 5.0, 0), ("only", 0, 0, None, 1)]
    cv = spark.createDataFrame(rows, "k string, cand bigint, split bigint, mae double, n_bad bigint")
    got = {r.k: r for r in scores.best_candidate(cv, ["k"], metrics=("mae", "n_bad")).collect()}
    assert (got["k"].cand, got["k"].mean_mae) == (1, 5.0)
    assert (got["only"].mean_mae, got["only"].mean_n_bad) == (None, 1.0)
    preds = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, None), ("b", 1.0, 2.0), ("b", 3.0, 3.0), ("c", 1.0, float("nan"))], "m string, y double, y_pred double")
    found = {r.m: (r.n, r.n_bad, r.mae) for r in scores.error_metrics(preds, ["m"]).collect()}
    assert found == {"a": (1, 1, None), "b": (2, 0, 0.5), "c": (0, 1, None)}


def test_ties_take_the_largest_penalty(spark):
    df = spark.createDataFrame([("k", 1, -2.0, 0.1), ("k", 1, -2.0, 0.5), ("k", 1, -3.0, 0.9)], "k string, feat_n bigint, score double, alpha double")
    assert scores.best_per_feature_count(df, ["k"], "score", ["alpha"]).first().alpha == 0.5


@pytest.mark.parametrize("max_files", [1, 1000])
def test_no_record_is_too_late(spark, tmp_path, max_files):
    schema = "event_id bigint, ts timestamp_ntz"
    for i, day in enumerate((20, 1, 10)):
        row = [(i, dt.datetime(2024, 1, day))]
        spark.createDataFrame(row, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.stream_records(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, max_files=max_files)
    ingest.ingest(stream, ["event_id"], "ts", str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_csv_by_each_header_and_unreadable_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text("study,plot_id\nx,1\ny,NA\nz,\n")
    (tmp_path / "b.csv").write_text("plot_id,study\n3,w\n")
    (tmp_path / "bad.csv").write_text("study,plot_id\nv,3x\n")
    paths = [str(tmp_path / f) for f in ("a.csv", "b.csv")]
    got = tables.read_csv(spark, paths, "study string, plot_id bigint").collect()
    assert sorted((r.study, r.plot_id) for r in got if r.plot_id) == [("w", 3), ("x", 1)]
    assert len(got) == 4
    with pytest.raises(Exception, match="unreadable cell: 3x"):
        tables.read_csv(spark, str(tmp_path / "bad.csv"), "study string, plot_id bigint").collect()


def test_constant_groups_are_undefined_not_an_error(spark):
    flat = spark.range(40).select(F.lit("g").alias("run"), (F.col("id") + 1).alias("idx"), F.lit(2.0).alias("v"), F.lit(3.0).alias("w"))
    assert chains.geweke(flat, ["run"], "v").filter("z is not null").count() == 0
    assert chains.autocorrelation(flat, ["run"], "v", [1, 2]).filter("r is not null").count() == 0
    assert chains.welch_t(flat, ["run"], "v", "w", p_value=False).first().t is None
    assert chains.gelman_rubin(flat.withColumn("chain", F.col("idx") % 2), "chain", ["v"]).first().r_hat is None
    assert flat.groupBy("run").agg(chains.nse(F.col("v"), F.col("w")).alias("e")).first().e is None
    assert scores.density(flat, ["run"], "v", [1.0, 2.0]).filter("density is not null").count() == 0
    assert scores.best_fit_line(flat, ["run"], "v", "w").first().rmse is None
    assert scores.relative_rmse(flat, flat.select(F.lit(0.0).alias("y")), ["run"], "v").first().rrmse is None
    cells = GRID.all_indices(spark).select(F.lit("g").alias("k"), "grid_idx", F.lit(1.0).alias("value"))
    assert sensitivity.variance_indices(cells, GRID, ["k"]).filter("s1 is not null or st is not null").count() == 0
    assert sensitivity.sampled_indices(cells, GRID, ["k"], n=20).filter("s1 is not null").count() == 0
    one = spark.createDataFrame([("k", "s", 1, 2.0)], "k string, step string, n bigint, effect double")
    assert sensitivity.morris(one, ["k"]).first().sigma is None
    assert sensitivity.fast_indices(flat.select("run", "idx", "v"), ["run"], ["a", "b"], "v").filter("s1 is not null").count() == 0
