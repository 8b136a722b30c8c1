import math
import random
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from bandloom.llm import quality
from tests.llm.helpers import ODD, docs, words

LABELS = "doc_id bigint, quality int, toxic int"
RATIO = quality.Ratio(buckets=64, sample=100, loss=0.0)


def base(text):
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            cover.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover), failed


def buckets(text, n):
    w = words(text)
    h = lambda data, seed: xxhash.xxh64_intdigest(data, seed)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    one = [h(x.encode(), 42) for x in w]
    two = [h(struct.pack("<Q", b), h(struct.pack("<Q", a), 42)) for a, b in zip(one, one[1:])]
    return [signed(x) % n for x in one + two]


def rows():
    rnd = random.Random(1)
    good = [" ".join(rnd.choices(["the", "sun", "rises", "over", "a", "quiet", "town"], k=30)) for _ in range(30)]
    bad = [" ".join(x + "!!!" for x in rnd.choices(["BUY", "NOW", "###"], k=25)) for _ in range(10)]
    again = ["one two three four five six seven\none two three four five six\n\nx x\nx x", "a b c d e " * 3 + "f g h"]
    return [*ODD, *[(100 + i, t) for i, t in enumerate(good + bad + again)]]


@pytest.fixture(scope="module")
def labels(spark):
    known = [(100 + i, 1, 0) for i in range(20)] + [(130 + i, 0, 0) for i in range(6)] + [(None, 1, 0), (140, None, None), (100, 1, 0)]
    return spark.createDataFrame(known, LABELS)


def test_against_brute_force(spark, labels):
    table = rows()
    got = quality.judge(docs(spark, table, clash=True).repartition(3), labels, RATIO)
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    found = got.select("doc_id", "text", *made, "llr", "kept").collect()
    n = 64
    folds = {r.doc_id: r.fold for r in spark.range(100, 120).selectExpr("id AS doc_id").withColumn("fold", F.pmod(F.xxhash64(F.lit(RATIO.seed), "doc_id"), F.lit(RATIO.folds))).collect()}
    raw, good = Counter(), {k: Counter() for k in range(RATIO.folds)}
    for d, t in table:
        raw.update(buckets(t, n))
        if d in folds:
            good[folds[d]].update(buckets(t, n))

    def llr(text, without=None):
        """Mean log ratio by a target without one part."""
        target = sum((c for k, c in good.items() if k != without), Counter())
        weight = lambda b: math.log((target[b] + 1) / (sum(target.values()) + n)) - math.log((raw[b] + 1) / (sum(raw.values()) + n))
        found = buckets(text, n)
        return sum(map(weight, found)) / len(found) if found else 0.0

    # The lowest of the good ones, each by the target of the other parts, cut down to a step; no share of them is lost.
    threshold = math.floor(min(llr(t, folds[d]) for d, t in table if d in folds) / quality.STEP) * quality.STEP
    assert len(found) == len(table)
    for r in found:
        want = base(r.text)
        assert tuple(r[c] for c in made) == want, r.doc_id
        assert r.llr == pytest.approx(llr(r.text), abs=1e-9)
        assert r.kept == (not want[-1] and llr(r.text) >= threshold - 1e-12)


def test_clean_stays_junk_goes(spark, labels):
    df = docs(spark, rows(), clash=True)
    kept = quality.kept_rows(df, labels, RATIO)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {100 + i for i in range(30)}


def test_without_rows_or_labels(spark, labels):
    df = docs(spark, rows())
    assert quality.judge(df.limit(0), labels, RATIO).count() == 0
    free = quality.judge(df, labels.limit(0), RATIO)
    assert free.filter("kept = base_failed").count() == 0
