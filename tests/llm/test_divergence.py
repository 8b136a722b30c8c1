"""Source divergence against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from bandloom.llm import divergence
from tests.llm.helpers import CLASH, SCHEMA

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, audit):
    rows = [(lang or "", source or "", [lower(t) for t in TERM.findall(text or "")]) for _, text, lang, source, _ in rows]
    one, out = 1_000_000_000, []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        seen = Counter(t for r in own for t in set(r[2]))
        kept = {t for t, n in seen.items() if n >= audit.min_docs}
        counts = {s: Counter() for s in {r[1] for r in own}}
        for _, s, terms in own:
            counts[s].update(t for t in terms if t in kept)
        total = sum(counts.values(), Counter())
        v = len(kept)
        p = lambda c, t: 1 + one * (c[t] + 1) // (sum(c.values()) + v)
        for s, c in counts.items():
            pairs = [(-sum((p(c, t) - p(d, t)) ** 2 // p(d, t) for t in kept), o.encode()) for o, d in counts.items() if o != s]
            terms = [(-((p(c, t) - p(total, t)) ** 2 // p(total, t)), t.encode()) for t in c if p(c, t) > p(total, t)]
            out += [(lang, s, "pair", o.decode(), -x, i + 1) for i, (x, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t.decode(), -x, i + 1) for i, (x, t) in enumerate(sorted(terms)[: audit.top])]
    return sorted(out)


def table(n, seed, sources=7):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Ärger", "ärger", "日本", "ABC", "abc", "x1y", "don't"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 40))), rnd.choice(["en", "de", None]), f"s{min(rnd.randint(0, 2 * sources), sources)}", None) for i in range(n)]
    rows += [(n + 1, None, "en", "quiet", None), (n + 2, "", "xx", "a", None), (n + 3, "1 2 3", "xx", None, None), (None, "only once", "yy", "b", None)]
    return rows + [rows[0]] * 5 + [(n + 4, "long " * 200_000 + "tail", "en", "s1", None)]


@pytest.mark.parametrize("audit", [divergence.Audit(), divergence.Audit(entries=50, block=3, window=10, tile=2, salts=3, top=4), divergence.Audit(min_docs=2, tile=3)])
def test_audit(spark, audit):
    rows = table(250, 1)
    found = divergence.audit_sources(spark.createDataFrame(rows, SCHEMA).repartition(5), audit=audit)
    assert sorted(map(tuple, found.collect())) == brute(rows, audit)


def test_empty_table_one_source_and_clashing_columns(spark):
    assert divergence.audit_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(i, "a b c", "en", "only", None) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'x' AS {c}" for c in [*CLASH, "term", "value", "part", "item", "body", "shard"] if c != "n_chars"])
    assert sorted(map(tuple, divergence.audit_sources(df).collect())) == brute(rows, divergence.Audit())


@pytest.mark.parametrize("window", [1, 40, 10**6])
def test_runs_merge_in_windows_of_whole_terms(window):
    """A term is in one window only, windows come in order, and nothing is lost."""
    rnd = random.Random(3)
    runs = [sorted(rnd.sample(range(400), 90)) for _ in range(6)]
    blocks = [(run[i : i + 10], k) for k, run in enumerate(runs) for i in range(0, 90, 10)]
    made = []
    for terms, k in blocks:
        block = divergence.Block(pa.array([b"t%03d" % t for t in terms]), np.ones(10, int), np.full(10, k), np.ones(10, int), np.ones(10, int))
        made.append(((0, "en"), b"t%03d" % terms[0], block))
    made.sort(key=lambda b: b[1])
    found = []
    for _, parts in divergence.merged(iter(made), window):
        found.append(sorted((t.as_py(), int(s)) for p in parts for t, s in zip(p[0], p[2])))
    assert [x for part in found for x in part] == sorted((b"t%03d" % t, k) for k, run in enumerate(runs) for t in run)
    assert all(a[-1][0] < b[0][0] for a, b in zip(found, found[1:]))


def test_share_is_exact_for_large_counts():
    rnd = random.Random(4)
    for _ in range(2_000):
        total = rnd.randint(1, 9 * 10**15)
        count = rnd.randint(1, total)
        assert divergence.share(np.array([count]), np.array([total]))[0] == 1 + 10**9 * count // total
