"""Source divergence audit: which sources of a language differ, and by which terms.

Term counts are made in one pass: a task builds postings in memory until they fill
it, then spills them as a run sorted by term, cut by hash shard into blocks. The
blocks of a shard arrive ordered by their first term and are merged by a heap that
holds one block per run; what comes out are the frequencies of a term in all sources
of its language. A pair of sources without a term has a closed form for it, so the
sum over all terms is that form times the number of terms, and only terms that one
of the two has are streamed, each as a correction. All arithmetic is on whole numbers.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandloom.llm.common import broadcast_within
from bandloom.session import stored

#: Fixed value: probabilities are whole numbers of this part.
ONE = 1_000_000_000
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
#: A-Z lower-cased; every other ASCII character separates; bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in _LETTERS else 32 for b in range(256))
#: A block: its distinct terms in order, how many postings each has, and per posting source, count and documents.
_RUN = "shard int, lang string, first binary, terms array<binary>, names array<string>, sizes binary, source binary, counts binary, docs binary"
_FREQ = "lang string, term binary, total bigint, sources array<string>, counts array<bigint>"
_PART = "lang string, source string, part string, item binary, value decimal(38,0)"


@dataclass(frozen=True)
class Audit:
    """``entries`` postings fill a task's memory and ``window`` of them are merged at a time; ``tile`` sources meet ``tile`` others in one task; ``salts`` tasks share a language."""

    min_docs: int = 3
    top: int = 200
    entries: int = 400_000
    block: int = 4_096
    window: int = 200_000
    tile: int = 256
    salts: int = 32


def slices(body: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """Terms of a folded text, some megabytes at a time."""
    at = 0
    while at < len(body):
        end = len(body) if len(body) - at <= size else body.find(b" ", at + size)
        end = len(body) if end < 0 else end
        yield body[at:end].split()
        at = end


def _sorted_run(lang: str, sources: list[tuple[str, Counter, Counter]], audit: Audit, shards: int) -> Iterator[tuple]:
    """Blocks of the postings of one language, in the order of shard and term."""
    names = [name for name, _, _ in sources]
    terms = pa.array([t for _, counts, _ in sources for t in counts], pa.binary()).dictionary_encode()
    distinct, term = terms.dictionary, terms.indices.to_numpy()
    source = np.repeat(np.arange(len(names), dtype=np.int32), [len(counts) for _, counts, _ in sources])
    counts = np.fromiter((n for _, c, _ in sources for n in c.values()), np.int64, len(term))
    docs = np.fromiter((d[t] for _, c, d in sources for t in c), np.int64, len(term))
    shard = np.fromiter((crc32(t) % shards for t in distinct.to_pylist()), np.int64, len(distinct))
    rank = np.empty(len(distinct), np.int64)
    rank[pc.sort_indices(distinct).to_numpy()] = np.arange(len(distinct))
    place = np.empty(len(distinct), np.int64)  # of a term in the order of shard and term
    place[np.lexsort((rank, shard))] = np.arange(len(distinct))
    order = np.argsort(place[term], kind="stable")
    at = term[order]
    cuts = np.flatnonzero(np.diff(place[at], prepend=-1))  # where a term starts
    owner = shard[at[cuts]]
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    for lo, hi in zip(starts, [*starts[1:], len(cuts)]):
        for i in range(lo, hi, audit.block):
            k = min(i + audit.block, hi)
            first, last = cuts[i], cuts[k] if k < len(cuts) else len(at)
            own = distinct.take(pa.array(at[cuts[i:k]]))
            some = order[first:last]
            sizes = np.diff(np.append(cuts[i:k], last)).astype("<i4")
            used, code = np.unique(source[some], return_inverse=True)
            yield int(owner[i]), lang, own[0].as_py(), own, [names[u] for u in used], sizes.tobytes(), code.astype("<i4").tobytes(), counts[some].tobytes(), docs[some].tobytes()


def runs(docs: DataFrame, audit: Audit, shards: int) -> DataFrame:
    """Sorted blocks of postings; ``docs`` has ``lang, source, body`` (binary)."""
    names = ["shard", "lang", "first", "terms", "names", "sizes", "source", "counts", "docs"]
    kinds = (pa.int32(), pa.string(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.binary())

    def batch_of(rows):
        shard, lang, first, terms, *rest = zip(*rows)
        ends = pa.array(np.cumsum([0, *map(len, terms)]), pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.concat_arrays(terms))
        cols = [pa.array(v, t) for v, t in zip((shard, lang, first), kinds)] + [lists] + [pa.array(v, t) for v, t in zip(rest, kinds[4:])]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def spill(index):
        langs: dict[str, list] = {}
        for (lang, source), (counts, in_docs) in index.items():
            langs.setdefault(lang, []).append((source, counts, in_docs))
        rows = []
        for lang, sources in langs.items():
            for block in _sorted_run(lang, sources, audit, shards):
                rows.append(block)
                if len(rows) >= 512:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    def run(batches):
        index, held = {}, 0
        for batch in batches:
            for lang, source, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                counts, in_docs = index.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(counts), set()
                for terms in slices(body.translate(_FOLD)):
                    counts.update(terms)
                    seen.update(terms)
                in_docs.update(seen)
                held += len(counts) - before
                if held >= audit.entries:
                    yield from spill(index)
                    index, held = {}, 0
        if held:
            yield from spill(index)

    return docs.mapInArrow(run, _RUN)


class Block:
    """An open block of a run: what of it has not been merged yet."""

    def __init__(self, terms: pa.Array, sizes: np.ndarray, source: np.ndarray, counts: np.ndarray, docs: np.ndarray):
        self.terms, self.source, self.counts, self.docs = terms, source, counts, docs
        self.starts, self.at = np.concatenate([[0], np.cumsum(sizes)]), 0

    def before(self, term: bytes | None) -> int:
        """How many of its terms come before ``term``."""
        lo, hi = self.at, len(self.terms)
        if term is None:
            return hi
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.terms[mid].as_py() < term else (lo, mid)
        return lo

    def take(self, upto: int) -> tuple:
        """The postings of the terms up to there: terms, postings of each, source, count and documents of each posting."""
        part, own = slice(self.at, upto), slice(self.starts[self.at], self.starts[upto])
        sizes = np.diff(self.starts[self.at : upto + 1])
        out = self.terms[part], sizes, self.source[own], self.counts[own], self.docs[own]
        self.at = upto
        return out


def merged(blocks: Iterator[tuple], window: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """``(key, parts)`` for windows of terms, in order, from ``(key, first, Block)`` in order.

    The heap holds the open blocks by the first term not merged yet, one block per
    run or two. Once they hold ``window`` postings, everything before the term at which
    the next block starts is complete and leaves together; a term is never in two windows.
    """
    heap: list = []
    key, number, held = None, 0, 0

    def drain(until):
        parts = []
        while heap and (until is None or heap[0][0] < until):
            _, n, block = heapq.heappop(heap)
            parts.append(block.take(block.before(until)))
            if block.at < len(block.terms):
                heapq.heappush(heap, (block.terms[block.at].as_py(), n, block))
        return parts

    for own, first, block in blocks:
        if own != key:
            if heap:
                yield key, drain(None)
            key, held = own, 0
        elif held >= window and (parts := drain(first)):
            held -= sum(len(p[2]) for p in parts)
            yield key, parts
        number += 1
        held += len(block.source)
        heapq.heappush(heap, (first, number, block))
    if heap:
        yield key, drain(None)


def _counted(lang: str, parts: list[tuple], names: list[str], min_docs: int) -> pa.RecordBatch | None:
    """Frequencies of the terms of a window that are in enough documents."""
    coded = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
    term = np.repeat(coded.indices.to_numpy(), np.concatenate([p[1] for p in parts]))
    source, counts, docs = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
    # Postings of one term and source of different runs become one.
    order = np.lexsort((source, term))
    new = np.flatnonzero(np.diff(term[order].astype(np.int64) * len(names) + source[order], prepend=-1))
    term, source, counts, docs = term[order][new], source[order][new], np.add.reduceat(counts[order], new), np.add.reduceat(docs[order], new)
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    kept = np.flatnonzero(np.add.reduceat(docs, starts) >= min_docs)
    if not len(kept):
        return None
    sizes = np.diff(np.append(starts, len(term)))
    mask = np.repeat(np.isin(np.arange(len(starts)), kept), sizes)
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes[kept])]), pa.int32())
    sources = pa.array(names, pa.string()).take(pa.array(source[mask]))
    total = np.add.reduceat(counts, starts)[kept]
    lists = [pa.ListArray.from_arrays(ends, v) for v in (sources, pa.array(counts[mask]))]
    columns = [pa.array([lang] * len(kept), pa.string()), coded.dictionary.take(pa.array(term[starts[kept]])), pa.array(total), *lists]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "term", "total", "sources", "counts"])


def frequencies(docs: DataFrame, audit: Audit) -> DataFrame:
    """``lang, term, total, sources, counts`` of the terms in at least ``min_docs`` documents of a language."""
    shards = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = runs(docs, audit, shards).repartition("shard").sortWithinPartitions("shard", "lang", "first")

    def run(batches):
        codes: dict[str, int] = {}

        def opened():
            for batch in batches:
                for i in range(len(batch)):
                    shard, lang, first, names, sizes, source, counts, seen = (batch.column(c)[i].as_py() for c in (0, 1, 2, 4, 5, 6, 7, 8))
                    own = np.array([codes.setdefault(n, len(codes)) for n in names], np.int64)
                    packed = (np.frombuffer(sizes, "<i4"), own[np.frombuffer(source, "<i4")], np.frombuffer(counts, np.int64), np.frombuffer(seen, np.int64))
                    yield (shard, lang), first, Block(batch.column(3)[i].values, *packed)

        for (_, lang), parts in merged(opened(), audit.window):
            found = _counted(lang, parts, list(codes), audit.min_docs)
            if found is not None:
                yield found

    return blocks.mapInArrow(run, _FREQ)


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(ONE * count / total)``, by long division in thousands, so that 64 bits hold it up to 9e15."""
    out, rest = count // total, count % total
    for _ in range(3):
        rest = rest * 1_000
        out, rest = out * 1_000 + rest // total, rest % total
    return 1 + out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Tile:
    """Sums over the terms for the sources ``a`` of one tile against ``b`` of another of the same language."""

    def __init__(self, lang: str, a: list, a_words: list, b: list, b_words: list, terms: int, words: int):
        self.lang, self.a, self.b, self.terms, self.words = lang, a, b, terms, words
        self.a_at, self.b_at = {s: i for i, s in enumerate(a)}, {s: i for i, s in enumerate(b)}
        self.a_total, self.b_total = np.array(a_words, np.int64) + terms, np.array(b_words, np.int64) + terms
        one = np.ones(1, np.int64)
        self.p0, self.q0 = (share(one, np.maximum(t, 1)) for t in (self.a_total, self.b_total))
        self.base = distance(self.p0[:, None], self.q0[None, :])  # of a term that neither has
        self.sums = np.zeros((len(a), len(b)), np.int64)

    @staticmethod
    def _held(at: dict, sources: pa.ListArray, counts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Term, place in the tile and count of every posting of the tile's sources."""
        term = np.repeat(np.arange(len(sources)), np.diff(sources.offsets.to_numpy()))
        coded = sources.flatten().dictionary_encode()
        place = np.array([at.get(s, -1) for s in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
        mine = np.flatnonzero(place >= 0)
        return term[mine], place[mine], counts.flatten().to_numpy()[mine]

    def _add(self, sums: np.ndarray, place: np.ndarray, change: np.ndarray) -> None:
        """Add rows of ``change`` to the rows of ``sums`` that ``place`` names."""
        order = np.argsort(place, kind="stable")
        starts = np.flatnonzero(np.diff(place[order], prepend=-1))
        if len(starts):
            sums[place[order][starts]] += np.add.reduceat(change[order], starts, axis=0)

    def correct(self, sources: pa.ListArray, counts: pa.ListArray) -> None:
        """Add what these terms change against the closed form."""
        ta, a, na = self._held(self.a_at, sources, counts)
        tb, b, nb = self._held(self.b_at, sources, counts)
        p, q = share(na + 1, self.a_total[a]), share(nb + 1, self.b_total[b])
        # Sources of the first tile that have the term, against all of the second.
        all_q = np.broadcast_to(self.q0, (len(sources), len(self.b))).copy()
        all_q[tb, b] = q
        for i in range(0, len(ta), 4_096):
            some = slice(i, i + 4_096)
            self._add(self.sums, a[some], distance(p[some, None], all_q[ta[some]]) - self.base[a[some]])
        # Those that do not have it, against the sources of the second that do.
        without = np.ones((len(sources), len(self.a)), bool)
        without[ta, a] = False
        for i in range(0, len(tb), 4_096):
            some = slice(i, i + 4_096)
            change = distance(self.p0[None, :], q[some, None]) - self.base[:, b[some]].T
            self._add(self.sums.T, b[some], np.where(without[tb[some]], change, 0))

    def above(self, totals: np.ndarray, sources: pa.ListArray, counts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Term, source and value where a source of the first tile has more of a term than its language."""
        term, a, n = self._held(self.a_at, sources, counts)
        p, q = share(n + 1, self.a_total[a]), share(totals[term] + 1, np.array([self.words + self.terms], np.int64))
        more = np.flatnonzero(p > q)
        return term[more], a[more], distance(p[more], q[more])

    def pairs(self, whole: bool) -> Iterator[tuple]:
        """Value of every pair; the closed form over all terms is added by one task of the language."""
        for i, s in enumerate(self.a):
            for j, other in enumerate(self.b):
                value = int(self.sums[i, j]) + (self.terms * int(self.base[i, j]) if whole else 0)
                if s != other and (whole or value):
                    yield (self.lang, s, "pair", other.encode(), value)


def _parts(batches, top: int):
    """Pair sums and the best terms from rows ordered by language, tiles and salt, the tile's own row first."""
    from decimal import Decimal

    def out(rows):
        rows = [(*r[:4], Decimal(r[4])) for r in rows]
        kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.decimal128(38, 0))
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=["lang", "source", "part", "item", "value"])

    def closed(tile, salt, best):
        rows = [(tile.lang, tile.a[s], "term", item, -v) for s, found in best.items() for v, item in heapq.nsmallest(top, found)]
        rows += tile.pairs(whole=salt == 0)
        for i in range(0, len(rows), 10_000):
            yield out(rows[i : i + 10_000])

    tile, key, best, least = None, None, {}, None
    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        lang, t1, t2, salt = (cols[n].to_pylist() for n in ("lang", "t1", "t2", "salt"))
        start = 0
        while start < len(batch):
            here = (lang[start], t1[start], t2[start], salt[start])
            end = start + 1
            while end < len(batch) and (lang[end], t1[end], t2[end], salt[end]) == here:
                end += 1
            if here != key:
                if tile is not None:
                    yield from closed(tile, key[3], best)
                key, best = here, {}
                one = {n: cols[n][start].as_py() for n in ("a", "a_words", "b", "b_words", "n_terms", "n_words")}
                tile = Tile(here[0], one["a"], one["a_words"], one["b"], one["b_words"], one["n_terms"], one["n_words"])
                least = np.zeros(len(tile.a), np.int64)
                start += 1
            for i in range(start, end, 2_000):
                some = slice(i, min(i + 2_000, end))
                sources, counts, items = (cols[n][some] for n in ("sources", "counts", "term"))
                tile.correct(sources, counts)
                if here[2] == 0:
                    term, source, value = tile.above(cols["total"][some].to_numpy(), sources, counts)
                    for k in np.flatnonzero(value >= least[source]).tolist():
                        best.setdefault(int(source[k]), []).append((-int(value[k]), items[int(term[k])].as_py()))
                    for s, found in best.items():
                        if len(found) > 8 * top:
                            best[s] = heapq.nsmallest(top, found)
                            least[s] = -best[s][-1][0]
            start = end
    if tile is not None:
        yield from closed(tile, key[3], best)


def tiles(groups: DataFrame, audit: Audit) -> DataFrame:
    """One row per pair of tiles of a language's sources and per salt."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    own = groups.withColumn("tile", F.floor(place / audit.tile).cast("int")).groupBy("lang", "n_terms", "n_words", "tile")
    own = stored(own.agg(F.sort_array(F.collect_list(F.struct("source", "words"))).alias("s")), "tiles")  # at most tile entries
    a = own.select("lang", "n_terms", "n_words", F.col("tile").alias("t1"), F.col("s.source").alias("a"), F.col("s.words").alias("a_words"))
    b = own.select("lang", F.col("tile").alias("t2"), F.col("s.source").alias("b"), F.col("s.words").alias("b_words"))
    return a.join(b, "lang").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(audit.salts - 1))))


def audit_sources(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", audit: Audit = Audit()) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every occurring (language, source) group.

    Part ``pair`` has every other source of the language; part ``term`` the ``top``
    terms of which the source has more than its language. Terms are runs of A-Z, a-z
    (lower-cased) and non-ASCII characters; a language keeps those in at least
    ``min_docs`` of its rows. Null text, language and source count as empty; rows
    repeated as a whole count each time. A group without terms still has its pairs; a
    language without kept terms has pairs of value 0; a language with one source has
    no pairs, and an empty table gives no rows.
    """
    empty = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    narrow = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).cast("binary").alias("body"))
    freq = stored(frequencies(narrow, audit), "frequencies")
    counts = freq.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source"))
    counts = counts.agg(F.sum("c.counts").alias("words"))
    langs = freq.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("total").alias("n_words"))
    groups = narrow.select("lang", "source").distinct().join(counts, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stored(groups.fillna(0, ["words", "n_terms", "n_words"]), "groups")
    profile = stored(tiles(groups, audit), "profiles")
    n_tiles = profile.groupBy("lang").agg((F.max("t1") + 1).alias("n"))
    sent = freq.join(broadcast_within(stored(n_tiles, "n-tiles")), "lang")
    sent = sent.withColumn("t1", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("t2", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    sent = sent.select("lang", "t1", "t2", F.pmod(F.xxhash64("term"), F.lit(audit.salts)).cast("int").alias("salt"), "term", "total", "sources", "counts")
    gone = lambda df, other: [F.lit(None).cast(other.schema[c].dataType).alias(c) for c in other.columns if c not in df.columns]
    together = profile.select("*", *gone(profile, sent)).unionByName(sent.select("*", *gone(sent, profile)))
    key = ["lang", "t1", "t2", "salt"]
    ordered = together.repartition(*key).sortWithinPartitions(*key, F.asc_nulls_first("term"))
    columns = [*key, "a", "a_words", "b", "b_words", "n_terms", "n_words", "term", "total", "sources", "counts"]
    top = audit.top
    parts = ordered.select(*columns).mapInArrow(lambda batches: _parts(batches, top), _PART)
    parts = stored(parts, "parts")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = parts.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # A term comes out of one task only; with the limit alone, tasks leave out what cannot be among the best before the shuffle.
    terms = parts.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms).withColumn("value", F.col("value").cast("bigint"))
    return ranked.select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", F.col("rank").cast("int").alias("rank"))
