import random

import pytest

from bandloom.llm import jaccard
from bandloom.llm.components import components
from tests.llm.helpers import ODD, docs, words


def brute(rows, how):
    sets = []
    for _, text in rows:
        w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
        sets.append(frozenset(tuple(w[i : i + how.words]) for i in range(max(len(w) - how.words, 0) + 1)) if w else frozenset())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and how.of * len(a & b) >= how.least * len(a | b):
                up[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if sets[i] and doc_id is not None:
            ids[find(i)] = min(ids.get(find(i), doc_id), doc_id)
    return sorted(str((d, len(sets[i]), ids.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def near_copies(seed=3):
    """Classes of near copies around both thresholds, sharing a long phrase with everything else."""
    rnd, rows = random.Random(seed), []
    vocab = [f"w{i}" for i in range(400)]
    phrase = " ".join(rnd.choices(vocab, k=30))
    for base in range(12):
        text = rnd.choices(vocab, k=rnd.choice([20, 60, 150, 600]))
        for _ in range(rnd.choice([1, 3, 12])):
            copy = list(text)
            for _ in range(rnd.randrange(0, 1 + len(copy) // 40)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append((len(rows) + 100, " ".join(copy) + (f"\n{phrase.upper()}" if base % 2 else "")))
    return rows


@pytest.mark.parametrize(
    "how", [jaccard.Join(3, 90, 100), jaccard.Join(5, 80, 100), jaccard.Join(2, 80, 100, block=3, leaf=2, frequent=2)], ids=["3x90", "5x80", "blocks"]
)
def test_against_brute_force(spark, how):
    rows = [*ODD, *near_copies()]
    got = jaccard.join(docs(spark, rows, clash=True).repartition(3), how).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, how)


def test_one_of_each_and_empty(spark):
    df = docs(spark, near_copies(), clash=True)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.component_id for r in jaccard.join(df).collect()}
    assert jaccard.join(df.limit(0)).count() == 0
    assert jaccard.one_of_each(df.limit(0)).count() == 0


def test_components_of_long_chain(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}
