import random

import pytest

from bandloom.llm import lines
from tests.llm.helpers import ODD, docs

WS = " \t\n\x0b\f\r"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    order = lambda d: (d is None, d or 0)
    key = lambda x: x.strip(WS).translate(UP)
    first = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                first[key(x)] = min(first.get(key(x), order(d)), order(d))
    out = []
    for d, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if len(key(x)) < 10 or first[key(x)] == order(d)]
        out.append((d, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(map(str, out))


def rows():
    rnd = random.Random(5)
    pool = [f"Line number {i} of all" for i in range(40)] + ["short", "ÄÖÜäöü€", "äöüäöüäöüä", "ÄÖÜÄÖÜÄÖÜÄ", "", "a very common line"]
    made = [(100 + i, "\n".join(rnd.choice(["", "  ", "\t"]) + rnd.choice(pool) + rnd.choice(["", " "]) for _ in range(rnd.randrange(1, 9)))) for i in range(60)]
    hot = [(500 + i, "A VERY COMMON LINE\nA very common line\n" + f"own line of {i} only") for i in range(200)]
    return [*ODD, *made, *hot, made[3], (None, made[4][1]), (None, "only without name")]


@pytest.mark.parametrize("partitions", [1, 13])
def test_against_brute_force(spark, partitions):
    table = rows()
    df = docs(spark, table, clash=True).repartition(4)
    bitmaps = lines.keep_bitmaps(df, partitions=partitions)
    assert bitmaps.columns == ["doc_id", "doc_key", "bitmap"]
    got = lines.apply_keep(df, bitmaps).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(str(tuple(r)) for r in got) == brute(table)


def test_bitmap_round_trip_and_empty(spark):
    assert lines.dropped_positions(None) == set()
    df = docs(spark, [(1, "the same line\nx"), (2, "y\nthe same line")])
    (row,) = lines.keep_bitmaps(df).collect()
    assert (row.doc_id, lines.dropped_positions(row.bitmap)) == (2, {1})
    assert lines.apply_keep(df.limit(0), lines.keep_bitmaps(df.limit(0))).count() == 0
