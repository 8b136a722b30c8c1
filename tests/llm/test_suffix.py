import random
from collections import Counter

import numpy as np
import pytest

from bandloom.llm import suffix
from tests.llm.helpers import ODD, docs


def brute(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for (d, _), x in zip(rows, data):
        gone = [False] * len(x)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(x), sum(gone), spans, bytes(b for b, g in zip(x, gone) if not g)))
    return sorted(map(str, out))


def rows(seed=1):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choices("abcdefg äé日", k=n))
    shared, made = [text(n) for n in (50, 61, 90, 300)], []
    for i in range(60):
        made.append((100 + i, text(rnd.randrange(40)) + rnd.choice(shared) + text(rnd.randrange(80)) + (rnd.choice(shared) if i % 3 == 0 else "")))
    whole = text(500)
    near = [whole[:k] + "#" + whole[k + 1 :] for k in (0, 59, 60, 61, 200, 499)]
    periodic = ["ab" * 80, "a" * 200, "a" * 59, "a" * 60, "xyz" * 50 + "q"]
    return [*[r for r in ODD if r[0] not in (6, 9)], *made, *[(300 + i, t) for i, t in enumerate([whole, whole, *near, *periodic])], made[5], (None, shared[3]), (None, shared[3])]


@pytest.mark.parametrize("most_blocks", [4096, 2], ids=["collections", "narrowed"])
def test_against_brute_force(spark, most_blocks):
    table = rows()
    df = docs(spark, table, clash=True).repartition(3)
    got = suffix.remove_repeats(df, 60, gram=12, most_blocks=most_blocks).collect()
    want = brute(table, 60)
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in got) == want
    assert suffix.remove_repeats(df.limit(0), 60, gram=12).count() == 0


def test_column_sort_is_the_suffix_order():
    rnd = random.Random(3)
    blocks = [np.array(rnd.choices([1, 2, 3], k=rnd.randrange(1, 12)), np.uint16) for _ in range(40)]
    owner, size, prefix = suffix.column_sort(blocks, np.ones(4, np.int32))
    suffixes = [tuple(blocks[o][len(blocks[o]) - s :].tolist()) for o, s in zip(owner, size)]
    assert len(suffixes) == sum(len(b) + 1 for b in blocks)
    assert suffixes == sorted(suffixes)
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert prefix[1:].tolist() == [common(a, b) for a, b in zip(suffixes, suffixes[1:])]


def test_chunks_do_not_matter(monkeypatch):
    data = bytes(random.Random(7).choices(b"abcd", k=5000))
    whole = set(zip(*[x.tolist() for x in suffix.segments(data, 60, 12)][:2]))
    monkeypatch.setattr(suffix, "CHUNK", 700)
    assert set(zip(*[x.tolist() for x in suffix.segments(data, 60, 12)][:2])) == whole
