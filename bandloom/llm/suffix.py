"""Repeated byte strings across documents, by column-wise suffix sorting of the places that can repeat.

Sorting all suffixes column by column takes as many rounds as the longest document
has bytes, each over the whole collection. Here it runs where it decides something:

1. Every window of ``length`` bytes has an anchor, the gram of least hash in it, the
   same in equal windows. The windows of one anchor are a segment. A segment whose
   anchor is found once repeats nowhere; segments equal as a whole repeat entirely.
2. The rest is cut into blocks of a few windows. All windows of a block share a
   core; a core found once ends the matter again.
3. Blocks with a common core and different surroundings go, core by core, through the
   construction: each round inserts one symbol per block, from the last to the first,
   into the collection's Burrows-Wheeler transform and its common prefixes, both passed
   over in order and written anew. Neighbours with a common prefix of
   ``length`` bytes or more repeat. A core with very many blocks is first cut into
   narrower ones; single windows need only be counted.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom.llm.common import broadcast_within, text_of
from bandloom.session import stored

LENGTH = 400
GRAM = 64
#: Windows of a block, level by level, and the blocks of one core that one collection may hold.
WIDTHS = (32, 4, 1)
MOST_BLOCKS = 4_096
#: Document keys (16 bytes each) that may be broadcast to leave out the other documents before a shuffle.
NAMED_KEYS = 200_000
#: Bytes of a document that are looked at together; windows do not depend on the cut.
CHUNK = 4 << 20
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE, inverse):
            p = np.full(size, b & ((1 << 64) - 1), np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS.clear()
        _POWERS[size] = tuple(out)
    return _POWERS[size]


def gram_hashes(data: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hash of the ``k`` bytes from each position on."""
    n = len(data) - k + 1
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of every ``w`` neighbours, from running minima of blocks in both directions."""
    n = len(x) - w + 1
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM):
    """``(gram hash, anchor, first window, last window)`` of all windows, as four arrays."""
    parts = []
    for at in range(0, max(len(data) - length + 1, 0), CHUNK):
        piece = np.frombuffer(data, np.uint8, count=min(CHUNK + length - 1, len(data) - at), offset=at)
        h = gram_hashes(piece, gram)
        keyed = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        anchor = (_sliding_min(keyed, length - gram + 1) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(first[1:], len(anchor)) - 1
        parts.append((h[anchor[first]], anchor[first] + at, first + at, last + at))
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3]


def doc_key(doc_id, data: bytes) -> bytes:
    return md5(f"{doc_id}\n".encode() + data).digest()


def _segment_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                cols = [[], [], [], [], [], []]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    data = text.encode()
                    h, anchor, first, last = segments(data, length, gram)
                    if not len(h):
                        continue
                    whole = [int.from_bytes(md5(data[s : e + length]).digest()[:8], "little", signed=True) for s, e in zip(first.tolist(), last.tolist())]
                    for c, v in zip(cols, (h.view(np.int64), whole, [doc_key(doc_id, data)] * len(h), anchor, first, last)):
                        c.extend(v if isinstance(v, list) else v.tolist())
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["h", "whole", "doc_key", "anchor", "first", "last"])

    return docs.mapInArrow(run, "h bigint, whole bigint, doc_key binary, anchor int, first int, last int")


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_key, text`` of narrow documents, by built-in functions."""
    mark = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")), F.lit("\n"), F.col("text"))))
    return docs.select(mark.alias("doc_key"), "text")


def _fetch(docs: DataFrame, ranges: DataFrame, run, schema: str) -> DataFrame:
    """Run ``run(data, ranges of the document)`` on the bytes of each document that ``ranges`` (``doc_key, ...``) names."""
    fields = [c for c in ranges.columns if c != "doc_key"]
    lists = stored(ranges.groupBy("doc_key").agg(F.collect_list(F.struct(*fields)).alias("ranges")), "suffix-wanted")
    # Only documents that are named are shuffled; what is broadcast is a counted number of keys.
    named = _keyed(docs).join(broadcast_within(lists.select("doc_key"), NAMED_KEYS), "doc_key", "left_semi")
    texts = named.join(lists, "doc_key")
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def each(batches):
        for batch in batches:
            rows = []
            for key, text, wanted in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                rows += run(key, text.encode(), wanted)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    by_name = {"binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32()}
    kinds = [by_name[f.split(" ")[1]] for f in schema.split(", ")]
    return texts.mapInArrow(each, schema)


def _blocks(docs: DataFrame, ranges: DataFrame, width: int, length: int) -> DataFrame:
    """Ranges of windows cut where the distance to the anchor is a multiple of ``width``, with digests of core and whole."""

    def run(key, data, wanted):
        rows = []
        for r in wanted:
            anchor, p, last = r["anchor"], r["first"], r["last"]
            while p <= last:
                core = anchor - (anchor - p) // width * width  # the last window of the full block
                to = min(core, last)
                inner = data[core : core - width + 1 + length]
                whole = int.from_bytes(md5(data[p : to + length]).digest()[:8], "little", signed=True)
                rows.append((md5(inner).digest(), whole, r["n"], key, anchor, p, to, core))
                p = to + 1
        return rows

    schema = "core binary, whole bigint, n bigint, doc_key binary, anchor int, first int, last int, core_at int"
    return _fetch(docs, ranges, run, schema).dropDuplicates(["core", "whole", "doc_key", "first"])


def _range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of ``values[first..last]`` for each pair, by minima over powers of two."""
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    out = np.empty(len(first), values.dtype)
    table = values
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            step = 1 << (k - 1)
            table = np.minimum(table[:-step], table[step:])
        at = level == k
        out[at] = np.minimum(table[first[at]], table[last[at] - (1 << k) + 1])
    return out


def column_sort(blocks: list[np.ndarray], weight: np.ndarray):
    """Sorted suffixes of a collection: ``(owner, suffix length, common prefix with the one before)``.

    Symbols are positive, 0 ends every block. Round j inserts the suffix of length j
    of every block that has one: its place follows from the transform so far, as
    equal symbols keep their order when put in front. Only neighbours of insertions
    get a new common prefix: a symbol's weight plus the least prefix in between.
    """
    m, sizes = len(blocks), np.array([len(b) for b in blocks])
    longest = int(sizes.max())
    columns = np.zeros((longest + 1, m), np.uint16)
    for i, b in enumerate(blocks):
        columns[: len(b), i] = b[::-1]
    bwt, prefix = columns[0].copy(), np.zeros(m, np.int32)
    owner, size = np.arange(m, dtype=np.int32), np.zeros(m, np.int32)
    for j in range(1, longest + 1):
        order = np.argsort(bwt, kind="stable")
        order = order[np.count_nonzero(bwt == 0) :]
        new = size[order] == j - 1
        symbol, n = bwt[order], len(order)
        now_bwt, now_prefix = np.empty(m + n, np.uint16), np.zeros(m + n, np.int32)
        now_owner, now_size = np.empty(m + n, np.int32), np.empty(m + n, np.int32)
        for now, old, fresh in (
            (now_bwt, bwt, columns[j][owner[order[new]]]), (now_prefix, prefix, 0), (now_owner, owner, owner[order[new]]), (now_size, size, j),
        ):
            now[:m] = old[:m]
            now[m:][~new] = old[m:]
            now[m:][new] = fresh
        touched = new.copy()
        touched[1:] |= new[:-1]
        at = np.flatnonzero(touched)
        same = at[(at > 0) & (symbol[at] == symbol[at - 1])]
        now_prefix[m + at] = 0
        if len(same):
            now_prefix[m + same] = weight[symbol[same]] + _range_min(prefix, order[same - 1] + 1, order[same])
        bwt, prefix, owner, size = now_bwt, now_prefix, now_owner, now_size
    return owner, size, prefix


def repeated_windows(blocks: list[tuple[bytes, bytes, bytes, int]], length: int) -> list[np.ndarray]:
    """Per block (core digest, bytes before the core, bytes after it, bytes of the core): windows that another block holds too.

    Blocks with one core differ around it only, so the core is one symbol that
    weighs its bytes. The windows of a block are its first suffixes.
    """
    cores = {c: 257 + i for i, c in enumerate(dict.fromkeys(b[0] for b in blocks))}
    weight = np.ones(257 + len(cores), np.int32)
    rows = []
    for core, before, after, inner in blocks:
        weight[cores[core]] = inner
        left, right = (np.frombuffer(x, np.uint8).astype(np.uint16) + 1 for x in (before, after))
        rows.append(np.concatenate([left, np.array([cores[core]], np.uint16), right]))
    owner, size, prefix = column_sort(rows, weight)
    hit = prefix >= length
    hit[:-1] |= hit[1:]
    out = [np.zeros(len(b[1]) + 1, bool) for b in blocks]
    sizes = np.array([len(r) for r in rows])
    for i, k in zip(owner[hit].tolist(), (sizes[owner[hit]] - size[hit]).tolist()):
        if k < len(out[i]):
            out[i][k] = True
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def _sorted_groups(docs: DataFrame, blocks: DataFrame, width: int, length: int) -> DataFrame:
    """Repeated windows of ``blocks`` with shared cores, by the column-wise construction: ``doc_key, first, last``."""
    kinds = blocks.groupBy("core", "whole").agg(
        F.count(F.lit(1)).alias("k"), F.max("n").alias("n"), F.min(F.struct("doc_key", "first", "last", "core_at")).alias("r")
    )
    kinds = stored(kinds, "suffix-kinds")

    def run(key, data, wanted):
        inner = length - width + 1
        return [
            (r["core"], r["whole"], data[r["first"] : r["core_at"]], data[r["core_at"] + inner : r["last"] + length], r["last"] - r["first"]) for r in wanted
        ]

    cut = _fetch(
        docs, kinds.select("r.doc_key", "core", "whole", "r.first", "r.last", "r.core_at"), run, "core binary, whole bigint, before binary, after binary, span int"
    ).dropDuplicates(["core", "whole"])

    def sort(batches):
        def emit(rows):
            found = repeated_windows([(r[0], r[2], r[3], length - width + 1) for r in rows], length)
            out = [(r[0], r[1], a, min(b, r[4])) for r, flags in zip(rows, found) for a, b in _runs(flags) if a <= r[4]]
            return pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], k) for i, k in enumerate((pa.binary(), pa.int64(), pa.int32(), pa.int32()))], names=["core", "whole", "a", "b"]
            )

        held, last = [], None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[0] != last and len(held) >= MOST_BLOCKS:
                    yield emit(held)
                    held = []
                last = row[0]
                held.append(row)
        if held:
            yield emit(held)

    found = cut.repartition("core").sortWithinPartitions("core").mapInArrow(sort, "core binary, whole bigint, a int, b int")
    some = blocks.join(found, ["core", "whole"]).select("doc_key", (F.col("first") + F.col("a")).alias("first"), (F.col("first") + F.col("b")).alias("last"))
    twice = blocks.join(kinds.filter("k > 1").select("core", "whole"), ["core", "whole"], "left_semi").select("doc_key", "first", "last")
    return some.unionAll(twice)


def repeated_ranges(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, widths: tuple[int, ...] = WIDTHS, most_blocks: int = MOST_BLOCKS, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_key, first, last``: ranges of starts of ``length``-byte strings that start elsewhere too."""
    narrow = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_of(docs, text).alias("text"))
    segs = stored(_segment_rows(narrow, length, gram), "suffix-segments")
    per = segs.groupBy("h", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_key", "anchor", "first", "last")).alias("r"))
    kinds = per.groupBy("h").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).filter("all > 1")
    per = stored(per.join(kinds, "h").select("h", "whole", "n", "kinds", "r"), "suffix-repeated")
    whole = segs.join(per.filter("n > 1").select("h", "whole"), ["h", "whole"], "left_semi").select("doc_key", "first", "last")
    found = [stored(whole, "suffix-whole")]
    open_ranges = per.filter("kinds > 1").select("r.doc_key", "n", "r.anchor", "r.first", "r.last")
    for width in widths:
        blocks = stored(_blocks(narrow, open_ranges, width, length), "suffix-blocks")
        cores = blocks.groupBy("core").agg(F.count(F.lit(1)).alias("k"), F.min("whole").alias("least"), F.max("whole").alias("greatest")).filter("k > 1")
        blocks = stored(blocks.join(cores, "core"), "suffix-open")
        found.append(blocks.filter("least = greatest").select("doc_key", "first", "last"))
        mixed = blocks.filter("least != greatest")
        found.append(stored(_sorted_groups(narrow, mixed.filter(F.col("k") <= most_blocks), width, length), "suffix-sorted"))
        open_ranges = mixed.filter(F.col("k") > most_blocks).select("doc_key", "n", "anchor", "first", "last")
        if open_ranges.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes).

    A byte goes if a ``length``-byte string that covers it also starts anywhere
    else, in the same document or another one; strings are judged on the input and
    never cross documents. A null text is empty; shorter texts keep all. All
    occurrences go, so of copies and repeated rows that are long enough nothing
    stays. Identifiers may be null or repeat. An empty table gives an empty result.
    Other columns are not looked at.
    """
    ranges = repeated_ranges(docs, length, id_col=id_col, text=text, **how)
    lists = ranges.groupBy("doc_key").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    narrow = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_of(docs, text).alias("text"))
    mark = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")), F.lit("\n"), F.col("text"))))
    both = narrow.withColumn("doc_key", mark).join(stored(lists, "suffix-lists"), "doc_key", "left").select("doc_id", "text", "ranges")

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, body, found in zip(*[c.to_pylist() for c in batch.columns]):
                data = body.encode()
                cover = np.zeros(len(data) + 1, np.int32)
                for r in found or []:
                    cover[r["first"]] += 1
                    cover[r["last"] + length] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if found else data
                rows.append((doc_id, len(data), int(gone.sum()), len(_runs(gone)), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    return both.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
