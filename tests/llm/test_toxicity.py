import random
import zlib

import pytest

from bandloom.llm import toxicity
from tests.llm.helpers import ODD, docs

HOW = toxicity.Lexicon(least_docs=3, least_odds=2.0)


def corpus():
    rnd = random.Random(12)
    calm = ["river", "stone", "cloud", "garden", "light", "paper", "clown", "fish", "walk", "evening"]
    rude = ["grobnik", "vlorp", "zurkhead"]
    rows, labels = [], []
    for i in range(1, 400):
        words = rnd.choices(calm[:6] + calm[8:], k=rnd.randrange(5, 60))
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(1 + len(words) // 15):
                words.insert(rnd.randrange(len(words) + 1), rnd.choice(rude))
        elif i % 7 == 0:
            at = rnd.randrange(len(words))
            words[at:at] = ["clown", "fish"]
        rows.append((i, " ".join(words)))
        if i < 350:
            labels.append((i, 1, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def learned(spark):
    rows, labels = corpus()
    table = spark.createDataFrame([*labels, (None, 1, 1), (7, None, None), (5, 1, 1)], "doc_id bigint, quality int, toxic int")
    df = docs(spark, [*rows, *ODD], clash=True)
    return df, table, toxicity.learn(df, table, HOW)


def test_held_out_accuracy(spark, learned):
    df, labels, model = learned
    got = toxicity.score(df, labels, HOW, learned=model).collect()
    assert len(got) == df.count()
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    truth = {d: int(d % 5 == 0) for d, _ in corpus()[0]}
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id > 9]
    assert len(held) > 40
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_disguises(spark, learned):
    _, labels, model = learned
    texts = ["a quiet VLORP here by the river", "a quiet vl0rp here by the river", "a quiet vlоrp here by the river", "a quiet vlo​rp here by the river"]
    got = toxicity.score(docs(spark, list(enumerate(texts + ["a quiet walk here by the river"], 1))), labels, HOW, learned=model).collect()
    assert [r.predicted for r in sorted(got, key=lambda r: r.doc_id)] == [1, 1, 1, 1, 0]


def test_exceptions_spare_their_phrase():
    matcher = toxicity.Matcher({"w:clown": 5.0, "b:trash": 3.0}, ["clown fish"])
    assert matcher.evidence("a clown fish swims") == (0, 0, 4)
    assert matcher.evidence("a clown swims")[:2] == (5.0, 1)
    assert matcher.evidence("Clown fish and trashy clown")[:2] == (8.0, 2)
    assert matcher.evidence("1 2 3")[1:] == (0, 0)


def test_numbers_are_left_alone():
    assert toxicity.fold("in 2014 and 50 ways") == "in 2014 and 50 ways"
    assert toxicity.fold("1d10t sTup!d $cum") == "idiot stupid scum"


def test_without_labels_or_rows(spark, learned):
    df, labels, model = learned
    assert toxicity.score(df.limit(0), labels, HOW, learned=model).count() == 0
    none = toxicity.score(df, labels.limit(0), HOW).select("predicted").distinct().collect()
    assert len(none) == 1
