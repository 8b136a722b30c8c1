import datetime as dt

import pytest
from pyspark.sql import functions as F

from bandloom.sources import sinks, tables as T
from bandloom.streaming import ingest as I


def test_ground_csv_is_typed_filtered_and_stacked(spark, tmp_path):
    head = "study,date_image,plot_id,trt,rate_n_pp_kgha,rate_n_sd_plan_kgha,rate_n_total_kgha,growth_stage,biomass_kgha,notes\n"
    (tmp_path / "a.csv").write_text(head + "wells,2018-06-28,3,1,0,0,40.5,V8,1200.5,x\nwells,2018-06-28,4,1,0,0,40.5,V8,,x\n")
    # Another column order.
    (tmp_path / "b.csv").write_text("biomass_kgha,plot_id,study,date_image,trt,rate_n_pp_kgha,rate_n_sd_plan_kgha,rate_n_total_kgha,growth_stage\n900,7,aerf,2019-07-10,2,1,1,1,V6\n")
    rows = T.scan_ground(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).orderBy("plot_id").collect()
    assert [(r.study, r.date, r.plot_id, r.biomass_kgha) for r in rows] == [("wells", "20180628", 3, 1200.5), ("aerf", "20190710", 7, 900.0)]


def test_image_key_and_stem(spark):
    df = spark.createDataFrame([("study_wells_small_date_20180628_plot_12-clip-mean.spec",), ("junk",)], "fname string")
    rows = T.image_key(df).collect()
    assert tuple(rows[0])[1:] == ("wells_small", "20180628", 12)
    assert rows[1].plot_id is None
    assert df.select(T.key_stem("fname").alias("s")).first().s == "study_wells_small_date_20180628_plot_12"


def test_wide_spectra(spark):
    df = spark.createDataFrame([("p", 1.0, 2.0, 3.0)], "plot string, `10` double, `2` double, `1` double")
    assert T.band_columns(df) == ["1", "2", "10"]
    assert T.wide_to_array(df).first().refl == [3.0, 2.0, 1.0]
    assert {(r.band, r.value) for r in T.wide_to_long(df).collect()} == {(1, 3.0), (2, 2.0), (10, 1.0)}


def test_inventory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.bip").write_bytes(b"x" * 1536)
    (tmp_path / "b.bip").write_bytes(b"y" * 10)
    (tmp_path / "empty.bip").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"x")
    rows = T.file_inventory(spark, str(tmp_path), "*.bip").withColumn("s", T.readable_size(F.col("length"))).collect()
    assert sorted((r.length, r.s) for r in rows) == [(0, "0B"), (10, "10.0 B"), (1536, "1.5 KB")]


def test_rerun_replaces_its_partition(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.range(100).select((F.col("id") % 2).alias("run"), "id")
    sinks.append(df, path, ["run"])
    sinks.append(df.filter("run = 1"), path, ["run"])
    assert sinks.load(spark, path).count() == 100
    assert sinks.load(spark, path, run=1).count() == 50
    sinks.append(spark.range(5).select(F.lit(7).alias("run"), "id"), path, ["run"])
    assert sinks.load(spark, path).count() == 105


@pytest.mark.parametrize("partition", [None, "kind"])
def test_stream_keeps_each_record_once(spark, tmp_path, partition):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i % 40, t0 + dt.timedelta(seconds=i % 40), "ab"[i % 2]) for i in range(80)]
    schema = "event_id bigint, ts timestamp_ntz, kind string"
    src = tmp_path / "in"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src))
    sink, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):  # the second run finds nothing new
        I.ingest(I.stream_records(spark, str(src), spark.read.parquet(str(src)).schema), ["event_id"], "ts", sink, state, partition=partition)
    assert spark.read.parquet(sink).count() == 40
    spark.createDataFrame([(99, t0 + dt.timedelta(hours=2), "a")], schema).coalesce(1).write.mode("append").parquet(str(src))
    I.ingest(I.stream_records(spark, str(src), spark.read.parquet(str(src)).schema), ["event_id"], "ts", sink, state, partition=partition)
    assert spark.read.parquet(sink).count() == 41
