import random
import re

import pytest

from bandloom.llm import secrets
from tests.llm.helpers import ODD, docs

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda x: (x[1], secrets.BASE.index(x[0])))


def rows():
    rnd = random.Random(6)
    parts = [
        "password", "PassWord", "ſecret", "secret", "token", "api_key", "APIKEY", "toKen", "'", '"', " ", ":", "=", ": ", "AKIA", "akia", "ABCD1234",
        "deadbeef", "0123456789abcdef", "F00D", "ä🙂", "\n", "-._/+=", "xyz", "passwd=", "secret='",
    ]
    made = [(100 + i, "".join(rnd.choices(parts, k=rnd.randrange(1, 25)))) for i in range(400)]
    fixed = ["ghp_" + "a1B2" * 10, "-----BEGIN RSA PRIVATE KEY-----", "https://me:passw0rd@host.org/x", "xoxb-123456789012-abc", "token token: aaaaaaaaaaaaaa"]
    return [*ODD, *made, *[(600 + i, t) for i, t in enumerate(fixed)]]


def test_against_brute_force(spark):
    table = rows()
    df = docs(spark, table, clash=True).repartition(3)
    got = secrets.scan(df).collect()
    base = lambda spans: [(s.kind, s.start, s.end) for s in spans if s.kind in secrets.BASE]
    assert sorted(str((r.doc_id, base(r.spans))) for r in got) == sorted(str((d, brute(t or ""))) for d, t in table)
    kinds = {r.doc_id: {s.kind for s in r.spans} for r in got}
    assert [("github" in kinds[600]), ("pem" in kinds[601]), ("url" in kinds[602]), ("slack" in kinds[603])] == [True] * 4
    assert all(list(r.spans) == sorted(r.spans, key=lambda s: s.start) for r in got)
    assert secrets.scan(df.limit(0)).count() == 0


def test_queries_lose_nothing():
    texts = [t or "" for _, t in rows()]
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        index = secrets.BlockIndex(texts, secrets.trigrams_of(query))
        hit = index.find(query)
        assert all(hit[i] for i, t in enumerate(texts) if rule.compiled.search(t)), rule.kind
    assert secrets.trigram_query("[0-9a-f]{16,}") == secrets.TRUE
    assert secrets.trigram_query("abcd") == ("and", ("tri", "abc"), ("tri", "bcd"))


@pytest.mark.parametrize("pattern", ["x*abc", "(ab|cd)e+fgh", "a.bcd|xyz", "(?:foo)?bar", "[ab]cd", "(a|b(c|de)f)ghi{2,3}"])
def test_query_of_a_match_is_true(pattern):
    rnd, compiled = random.Random(9), re.compile(pattern)
    texts = ["".join(rnd.choices("abcdefghioxyz", k=8)) for _ in range(3000)] + ["foobar", "bar", "abefgh", "bcfghii", "bdefghiii"]
    query = secrets.trigram_query(pattern)
    hit = secrets.BlockIndex(texts, secrets.trigrams_of(query)).find(query)
    assert all(hit[i] for i, t in enumerate(texts) if compiled.search(t))


def test_postings_table(spark):
    found = {r.trigram: sorted(r.doc_ids) for r in secrets.postings(docs(spark, [(1, "a token"), (2, "TOKEN"), (3, "none")]).coalesce(1)).collect()}
    assert found["tok"] == found["ken"] == [1, 2]
