"""Byte-level BPE as a transducer, and decoding by an incremental UTF-8 machine.

A token sequence is the greedy-merge encoding of its bytes exactly when every
token and every two neighbours are the encoding of their own bytes. So encoding is
the only path through an automaton whose hypotheses are open tokens. It is
determinised on demand: a state is the set of live hypotheses. They differ only
within the longest token, so that is how far a token has to wait.

Documents are encoded one by one inside the scan's partitions: no shuffle, and a
lost task repeats alone. What is kept between documents (states, frequent pieces)
is bounded and rebuilt when full.
"""

from __future__ import annotations

import base64
import gc
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bandloom.llm.common import text_of

ROOT = 0


class Limits(NamedTuple):
    """Determinised states, pairs of tokens and encoded pieces held by one worker: speed against memory, about 0.4 GB as given."""

    states: int = 150_000
    pairs: int = 250_000
    pieces: int = 250_000


#: Bytes of a piece after which tokens are emitted that nothing can change any more.
EMIT_EVERY = 1024
#: Rows of a batch that are encoded together.
SLICE_ROWS = 500
#: Tokens per step of the streaming decoder.
DECODE_STEP = 8192


def read_ranks(rows: bytes) -> dict[bytes, int]:
    """Rank file: per line the base64 of a token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in rows.splitlines() if line.strip())}


def greedy_merge(piece: bytes, ranks: dict[bytes, int], stop: int = 1) -> list[bytes]:
    """Merge the neighbours of least rank until none can be or ``stop`` parts are left; the definition."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > stop:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


class Transducer:
    """Lazily determinised encoder of one piece of text.

    A hypothesis is an open token: the token before it and its place in the trie. A
    state is the tuple of live hypotheses, oldest first, each packed as
    ``(token before + 1) << 24 | node``. Every prefix has exactly one encoding, so a
    step also names its last token; tokens are emitted up to the last border that all
    live hypotheses share.
    """

    def __init__(self, ranks: dict[bytes, int], limits: Limits = Limits()):
        self.ranks, self.limits = ranks, limits
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        self.accept, self.depth, self.inner = [-1], [0], [True]  # per node: token, length, whether it goes on
        # The token at each end of a token that its last merge joined: the fragments there while it was merged, latest
        # first, each arising at its own rank. A single byte has none; a token that no merges lead to is absent.
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: len(x[0])):
            if len(token) == 1:
                self.left[rank] = self.right[rank] = -1
            else:
                parts = greedy_merge(token, ranks, 2)
                if len(parts) != 2 or any(ranks[x] not in self.left for x in parts):
                    continue  # it only stands for a whole piece
                a, b = (ranks[x] for x in parts)
                if (self.left[a] >= 0 and a > rank) or (self.right[b] >= 0 and b > rank):
                    raise ValueError(f"rank {rank} comes before its parts")
                self.left[rank], self.right[rank] = a, b
            node = ROOT
            for b in token:
                at = node << 8 | b
                if at not in self.child:
                    self.inner[node] = True
                    self.child[at] = len(self.accept)
                    self.accept.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.inner.append(False)
                node = self.child[at]
            self.accept[node] = rank
        self.fits: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states, self.number = [(ROOT,)], {(ROOT,): 0}
        self.next: dict[int, int] = {}  # state << 8 | byte -> state << 32 | last token
        if len(self.fits) > self.limits.pairs:
            self.fits.clear()

    def forget(self) -> None:
        """Drop what was found while encoding."""
        self.fits.clear()
        self._reset()

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both gives these two tokens again.

        Going back in time, the two fragments at the border must never have been
        mergeable before one of them grew. On equal ranks the left place is first.
        """
        right, left, bytes_of = self.right, self.left, self.bytes_of
        until, from_left, rank_of = 1 << 60, True, self.ranks.get
        while True:
            in_a, in_b = right[a], left[b]
            r = rank_of(bytes_of[a] + bytes_of[b])
            if r is not None and (r < until or (r == until and not from_left)):
                return False
            if in_a < 0 and in_b < 0:
                return True
            from_left = in_b < 0 or (in_a >= 0 and a > b)
            if from_left:
                until, a = a, in_a
            else:
                until, b = b, in_b

    def _step(self, state: int, byte: int) -> int:
        child, accept, inner, fits, last, live = self.child, self.accept, self.inner, self.fits, -1, []
        for h in self.states[state]:
            node = h & 0xFFFFFF
            to = child.get(node << 8 | byte)
            if to is None:
                continue
            if inner[to]:
                live.append(h - node + to)
            token = accept[to]
            if token >= 0 and last < 0:
                before = h >> 24
                pair = before << 32 | token
                fit = fits.get(pair)
                if fit is None:
                    fit = fits[pair] = before == 0 or self._apart(before - 1, token)
                if fit:
                    last = token
        live.append(last + 1 << 24)
        key = tuple(live)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        step = self.next[state << 8 | byte] = number << 32 | last
        return step

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.limits.states:
            self._reset()
        out: list[int] = []
        state, known, waiting = 0, self.next, []  # waiting: per byte, the token that ends there
        for byte in piece:
            step = known.get(state << 8 | byte)
            if step is None:
                step = self._step(state, byte)
            state = step >> 32
            waiting.append(step & 0xFFFFFFFF)
            if not len(waiting) % EMIT_EVERY:
                settled = self._settled(waiting, state)
                out += self._tokens(waiting, settled)
                del waiting[:settled]
        return out + self._tokens(waiting, len(waiting))

    def _settled(self, ends: list[int], state: int) -> int:
        """Bytes up to the last border that all live hypotheses have come through."""
        borders = {len(ends) - self.depth[h & 0xFFFFFF] for h in self.states[state]}
        while len(borders) > 1:
            last = max(borders)
            borders.remove(last)
            borders.add(last - len(self.bytes_of[ends[last - 1]]))
        return borders.pop()

    def _tokens(self, ends: list[int], upto: int) -> list[int]:
        """The tokens of the first ``upto`` bytes, followed back from the last."""
        back = []
        while upto:
            back.append(ends[upto - 1])
            upto -= len(self.bytes_of[back[-1]])
        return back[::-1]


class Pieces(dict):
    """Packed ids of a piece of text (little-endian unsigned 32-bit), encoded when first asked for."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer, self.limit = transducer, transducer.limits.pieces

    def __missing__(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = packed
        return packed


class Utf8Stream:
    """Text from bytes that arrive in arbitrary cuts; only an unfinished character waits.

    The machine's state is that character's bytes so far (at most three). What is
    not UTF-8 becomes U+FFFD, as when all bytes were decoded at once.
    """

    def __init__(self):
        self.open = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Bytes at the end that can still become a character."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead < 0x80:
                return 0
            if lead >= 0xC0:
                size = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
                if size <= back:
                    return 0
                if back > 1:
                    low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                    high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                    if not low <= data[-back + 1] <= high:
                        return 0
                return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.open + data
        wait = self._unfinished(data)
        self.open = data[len(data) - wait :]
        return data[: len(data) - wait].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


def decode_ids(packed: bytes, bytes_of: dict[int, bytes], step: int = DECODE_STEP) -> Iterator[str]:
    """Text of packed ids, a few thousand tokens at a time."""
    stream, ids = Utf8Stream(), np.frombuffer(packed, "<u4")
    for i in range(0, len(ids), step):
        yield stream.feed(b"".join(map(bytes_of.__getitem__, ids[i : i + step].tolist())))
    yield stream.finish()


_BUILT: dict[tuple[int, Limits], tuple[Transducer, Pieces]] = {}


def _built(rank_rows: bytes, limits: Limits = Limits()) -> tuple[Transducer, Pieces]:
    """One transducer per worker process and vocabulary."""
    key = hash(rank_rows), limits
    if key not in _BUILT:
        _BUILT.clear()
        transducer = Transducer(read_ranks(rank_rows), limits)
        _BUILT[key] = transducer, Pieces(transducer)
    return _BUILT[key]


def _slices(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(i, SLICE_ROWS)


def rank_file(path: str) -> bytes:
    """The vocabulary is read where the driver runs: tens of thousands of lines, sent with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, rank_rows: bytes, pattern: str, text: str = "text", decoded: str | None = None, limits: Limits = Limits(), keep: bool = True) -> DataFrame:
    """Add ``n_tokens`` and ``ids`` (packed little-endian unsigned 32-bit) to every row.

    With ``decoded``, a column of that name has the text that the streaming decoder
    makes of the ids, in the same pass.

    With ``keep`` false a worker drops its states after each task, which costs time
    and leaves its memory to whatever runs there next.

    Each match of ``pattern`` is encoded by itself; there are no special tokens. A
    null or empty text has no tokens. Rows, repeated ones too, are independent of
    each other and keep their other columns; columns of those names are
    replaced. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rank_rows)
    docs = docs.withColumn("__bpe_text", text_of(docs, text)).drop("n_tokens", "ids", *([decoded] if decoded else []))
    kept = [c for c in docs.columns if c != "__bpe_text"]

    def run(batches):
        find, (transducer, pieces) = regex.compile(pattern).findall, _built(shared.value, limits)
        gc.disable()  # states are many small tuples without cycles; walking them is a quarter of the time
        try:
            for batch in _slices(batches):
                ids = [b"".join(map(pieces.__getitem__, find(t))) for t in batch.column(len(kept)).to_pylist()]
                made = [pa.array([len(x) >> 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    made.append(pa.array(["".join(decode_ids(x, transducer.bytes_of)) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names=names)
        finally:
            if not keep:
                transducer.forget()
                pieces.clear()
            gc.enable()

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    added += [T.StructField(decoded, T.StringType())] if decoded else []
    names = [*kept, *[f.name for f in added]]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[: len(kept)], *added]))


def decode(tokens: DataFrame, rank_rows: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of packed ids as ``out``; null ids give an empty text, an id outside the vocabulary is an error."""
    shared = tokens.sparkSession.sparkContext.broadcast(rank_rows)
    tokens = tokens.drop(out) if out != ids else tokens
    at = tokens.columns.index(ids)

    def run(batches):
        bytes_of = {rank: token for token, rank in read_ranks(shared.value).items()}
        for batch in _slices(batches):
            texts = ["".join(decode_ids(x or b"", bytes_of)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(out, T.StringType())]))
