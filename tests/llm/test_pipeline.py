"""Each stage on what the one before kept, against brute force on the smallest tables."""

import os

import pyarrow as pa
import pytest

import corpus_pipeline
from bandloom.llm import jaccard, mixing, quality
from bandloom.session import stored
from tests.llm import test_jaccard as near
from tests.llm.helpers import docs as table
from tests.llm.test_exact import brute as exact_brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not here")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        out.append(docs)
    return [spark.read.parquet(f"{SF}/documents.parquet"), *out]


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:5])
    assert stages[5].columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]


def test_quality_keeps_what_passes(spark, stages):
    judged = quality.judge(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(judged.filter("kept")) == ids(stages[1])
    good = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").join(stages[0], "doc_id")
    assert good.join(stages[1], "doc_id", "left_anti").count() <= 0.05 * good.count()


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_duplicates_go(stages):
    before = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert len(ids(stages[2])) == sum(", True, " in row for row in exact_brute(before))
    before = [(r.doc_id, r.text) for r in stages[2].collect()]
    classes = near.brute(before, jaccard.Join(5, 80, 100))
    assert ids(stages[3]) == sorted({int(c.strip("()").split(", ")[2]) for c in classes})


def test_mix_and_tokens(stages):
    times = mixing.mix(stages[3]).select("doc_id", "mix_times").collect()
    assert ids(stages[4]) == sorted(r.doc_id for r in times for _ in range(r.mix_times))
    assert stages[5].filter("not round_trip").count() == 0
    assert ids(stages[5]) == ids(stages[4])


def test_empty_input(spark):
    docs = table(spark, []).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
    assert docs.count() == 0


@pytest.mark.parametrize("name", ["near_dedup", "tokenise"])
def test_batches_of_long_rows_are_small(spark, name):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = table(spark, [(i, f"{i} " * 10_000) for i in range(100, 400)]).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["size", "rows"])

    dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    seen = docs.select("text").mapInArrow(sizes, "size bigint, rows bigint").collect()
    assert sum(r.rows for r in seen) == 300
    assert max(r["size"] for r in seen) < 5 << 20
