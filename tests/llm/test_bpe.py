import random
import sys

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from bandloom.llm import bpe
from tests.llm.helpers import ODD, docs

RANKS = bpe.rank_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_against_tiktoken(spark, reference):
    rnd = random.Random(2)
    odd = ["<|endoftext|>", "don't we'll  \n\n x", "한국어 العربية हिन्दी 🙂👩‍👩‍👧", "\x00\x01 \xa0 　y", "1234567 12 ١٢٣"]
    made = ["".join(rnd.choices("abentionsr äüé日本нѐ 1290'.,\n\t", k=rnd.randrange(80))) for _ in range(300)]
    long = ["".join(rnd.choices("abcdefgh", k=5_000)), "a" * 3_000, "日" * 2_000]
    table = [*ODD, *[(100 + i, t) for i, t in enumerate(odd + made + long)]]
    df = docs(spark, table, clash=True).repartition(3)
    tokens = bpe.encode(df, RANKS, public_tokenizers.PATTERN, decoded="again", keep=False)
    got = bpe.decode(tokens, RANKS).collect()
    assert len(got) == len(table)
    for r in got:
        ids = reference.encode_ordinary(r.text or "")
        assert (r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (len(ids), ids)
        assert r.decoded == r.again == (r.text or "")
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bounded_states_change_nothing():
    ranks = bpe.read_ranks(RANKS)
    small, large = bpe.Transducer(ranks, bpe.Limits(states=20, pairs=10)), bpe.Transducer(ranks)
    rnd = random.Random(4)
    for _ in range(300):
        piece = "".join(rnd.choices("thaneriou", k=rnd.randrange(1, 30))).encode()
        assert small.encode(piece) == large.encode(piece)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.lists(st.integers(1, 5), max_size=20))
def test_stream_decodes_any_cut(data, cuts):
    stream, out, at = bpe.Utf8Stream(), "", 0
    for n in [*cuts, len(data)]:
        out += stream.feed(data[at : at + n])
        assert len(stream.open) <= 3
        at += n
    assert out + stream.finish() == data.decode("utf-8", "replace")


def test_a_token_of_many_merges_is_kept_once():
    data = bytes(range(256))
    ranks = {data[i : i + 1]: i for i in range(256)} | {data[:n]: 254 + n for n in range(2, 257)}
    made = bpe.Transducer(ranks)
    assert sum(sys.getsizeof(x) for ends in (made.left, made.right) for x in ends.values()) < 100 * len(ranks)
    for piece in (data + data[:3], data[5:] + data[:200], data[:7] * 3):
        assert made.encode(piece) == [ranks[x] for x in bpe.greedy_merge(piece, ranks)]
