import hashlib
import random
from collections import defaultdict

import pytest

from bandloom.llm import mixing
from tests.llm.helpers import ODD, docs, words


def fill(sizes, weights, cap=3):
    """Clamp, share again, until nobody is above."""
    target, free, rest = {}, set(sizes), sum(sizes.values())
    while free:
        total = sum(weights[s] for s in free)
        over = [s for s in free if rest * weights[s] / total > cap * sizes[s]]
        if not over:
            target |= {s: rest * weights[s] / total for s in free}
            break
        for s in over:
            target[s] = float(cap * sizes[s])
            rest -= cap * sizes[s]
            free.discard(s)
    return target


def rows():
    rnd = random.Random(8)
    made = []
    for source, n in (("a", 400), ("b", 30), ("ä", 5), ("Z", 60), (None, 25), ("empty", 0)):
        made += [(1000 + len(made) + i, "w " * rnd.choice([1, 5, 40, 300]), source) for i in range(n)]
    return [*[(d, t, "odd") for d, t in ODD], (900, "", "nothing"), (901, None, "nothing"), *made]


def test_against_brute_force(spark):
    table = rows()
    df = docs(spark, table, clash=True).repartition(4)
    got = mixing.mix(df).select("doc_id", "source", "mix_size", "mix_source_size", "mix_target", "mix_times").collect()
    assert len(got) == len(table)
    sizes = defaultdict(int)
    for _, t, s in table:
        sizes[s] += len(words(t))
    order = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None]
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, taken = fill(sizes, weights), defaultdict(int)
    for r in got:
        assert r.mix_source_size == sizes[r.source]
        assert r.mix_target == pytest.approx(target[r.source], rel=1e-12)
        assert 0 <= r.mix_times <= 3
        taken[r.source] += r.mix_size * r.mix_times
    longest = defaultdict(int)
    for _, t, s in table:
        longest[s] = max(longest[s], len(words(t)))
    for s in sizes:
        # Half a document; rows of one identifier and size go together.
        assert abs(taken[s] - target[s]) <= longest[s]
    again = mixing.mix(df.repartition(2)).select("doc_id", "mix_size", "mix_times").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixing.mix(df).select("doc_id", "mix_size", "mix_times").collect())


def test_small_steps_take_the_same_rows(spark):
    made = spark.createDataFrame(
        [("s", (i * 7) % 23, hashlib.md5(str(i).encode()).hexdigest()) for i in range(500)], "source string, size bigint, at string"
    )
    target = spark.createDataFrame([("s", sum((i * 7) % 23 for i in range(500)), 1, 1234.0)], "source string, source_size bigint, weight bigint, target double")
    cuts = [mixing.plan(made, target, step_rows=n).select("cut", "cut_size", "epochs").first() for n in (10_000, 50, 3)]
    assert cuts[0] == cuts[1] == cuts[2]


def test_rows_and_empty(spark):
    df = docs(spark, rows())
    mixed, times = mixing.mixed_rows(df), mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == times.agg({"mix_times": "sum"}).first()[0]
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.filter("source = 'nothing'")).agg({"mix_target": "max"}).first()[0] == 0
