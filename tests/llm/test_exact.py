import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bandloom.llm import exact
from tests.llm.helpers import ODD, docs

ROWS = [*ODD, (10, "b c"), (11, "b  c"), (12, "bc"), (13, "b\nc"), (14, "B c"), (15, "same length 1"), (16, "same  length1"), (17, "q" * 9), (17, "q" * 9)]


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for key, members in groups.items():
        keep = min(members)
        for i, m in enumerate(sorted(members)):
            out.append((m[3], keep[3], len(members), i == 0, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("digest", [exact.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1)], ids=["sha", "colliding"])
def test_against_brute_force(spark, digest):
    df = docs(spark, ROWS, clash=True).repartition(5)
    got = exact.dedup(df, digest, files_per_batch=2).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    want = brute(ROWS)
    if digest is exact.sha256:
        assert sorted(str(tuple(r)) for r in got) == want
    else:  # only one hex digit: all groups are told apart by their texts
        assert sorted(str(tuple(r)[:4]) for r in got) == sorted(w[: w.rindex(",")] + ")" for w in want)


def test_kept_rows_and_empty_table(spark):
    df = docs(spark, ROWS, clash=True).repartition(3)
    kept = exact.kept_rows(df)
    assert kept.columns == df.columns
    assert kept.count() == len({re.sub(r"\s", "", t or "") for _, t in ROWS})
    empty = df.limit(0)
    assert exact.dedup(empty).count() == 0
    assert exact.kept_rows(empty).count() == 0


def test_state_resumes(spark, tmp_path):
    arrived, state = str(tmp_path / "arrived"), str(tmp_path / "state")
    exact.arrivals(docs(spark, [(1, "a b"), (2, "c")])).write.parquet(arrived)
    assert {r.group_size for r in exact.advance(spark, arrived, state).collect()} == {1}
    exact.arrivals(docs(spark, [(3, "a  b"), (4, "d")])).write.mode("append").parquet(arrived)
    found = {r.keep_id: r.group_size for r in exact.advance(spark, arrived, state).collect()}
    assert found == {3: 2, 2: 1, 4: 1}
