"""How many documents labelled junk are rejected that the fit has not seen."""

import os

import pytest
from pyspark.sql import functions as F

from bandloom.llm import quality
from tests.llm.helpers import docs

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not here")
def test_junk_not_used_in_the_fit_is_rejected(spark):
    table, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    judged = quality.judge(table.select("doc_id", "text"), labels.filter(half == 0))
    unseen = judged.join(labels.filter(half == 1).select("doc_id", "quality"), "doc_id").filter("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in unseen.groupBy("quality", "kept").count().collect()}
    bad, good = n.get((0, True), 0) + n.get((0, False), 0), n.get((1, True), 0) + n.get((1, False), 0)
    assert bad >= 100 and n.get((0, False), 0) >= 0.95 * bad, n
    assert n.get((1, True), 0) >= 0.99 * good, n


def test_what_lies_between_the_good_and_the_middle_of_the_bad_goes(spark):
    rows = [(i, "the sun rises over a quiet town by the old sea") for i in range(20)] + [(20 + i, "## %% && ** ## || %% ** && ## $$ %%") for i in range(20)]
    between = (99, "the sun rises over a quiet town ## %% && **")
    labels = spark.createDataFrame([(i, int(i < 20), 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs(spark, [*rows, between]), labels, quality.Ratio(buckets=4096)).collect()}
    assert got[20].llr < got[99].llr < got[0].llr
    assert got[99].llr > (got[0].llr + got[20].llr) / 2, "in the gap that the halfway point left open"
    assert got[0].kept and not got[99].kept


def test_all_labels_are_fitted_on(spark):
    labels = spark.range(30_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert quality.labelled(labels).count() == 30_000
