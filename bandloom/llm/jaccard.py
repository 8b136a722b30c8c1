"""Exact n-gram Jaccard join with signature trees.

Two sets that are similar enough share a token among the first few of each, in any
fixed order (here: tokens seen often in a sample last, then by hash, so that a
phrase half the corpus holds hardly ever brings documents together). Documents
that share such a token form a group; a long group is cut into blocks ordered by
size, and blocks meet only where sizes allow. A group is searched by a signature
tree: nodes hold OR-combined token bitmaps and size ranges, and a dual traversal
prunes pairs of nodes whose largest possible overlap is too small.

What comes out is linear in what goes in. The first pass over bitmaps names the
documents that have a partner left; only their sets are computed again and checked
exactly, and pairs already in one component are passed over, so a class of
thousands yields a spanning tree, not its pairs. A first round over one token per
document joins most of each class; the second covers all tokens, looking only for
links between different components.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom.llm.common import broadcast_within, text_of
from bandloom.llm.components import components
from bandloom.session import stored

_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: End of the first quarter of the hashes.
_LOW = np.uint64(1 << 62)


@dataclass(frozen=True)
class Join:
    """Words per shingle, and the similarity as a fraction ``least / of``."""

    words: int = 5
    least: int = 80
    of: int = 100
    #: Documents and tokens of one block; a tree's leaf.
    block: int = 1024
    block_tokens: int = 2_000_000
    leaf: int = 48
    #: Documents looked at to find frequent tokens, and how many of them make a token frequent. Only speed depends on them.
    sample: int = 16_000
    frequent: int = 6

    def prefix(self, n: int) -> int:
        return n - -(-self.least * n // self.of) + 1

    def links(self, overlap, a, b):
        return self.of * overlap >= self.least * (a + b - overlap)


class _Words(dict):
    """Hashes of words met before; dropped when there are many, as they only save time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str, k: int, memo: dict | None = None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``k``-word shingles, the whole sequence if it is shorter."""
    words = text.encode().lower().split()  # A-Z only; the six ASCII white space characters
    if not words:
        return np.empty(0, np.uint64)
    memo = _Words() if memo is None else memo
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    acc = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        acc = acc * _P1 + h[i : len(words) - k + 1 + i]
        acc ^= acc >> np.uint64(29)
    for p in (_P2, _P3):
        acc ^= acc >> np.uint64(33)
        acc *= p
    return np.unique(acc ^ (acc >> np.uint64(33)))


def bitmap(tokens: np.ndarray) -> bytes:
    """Two to four bits per token, a power of two of them, so that long sets prune as well as short ones."""
    bits = max(256, 1 << (2 * len(tokens) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of fewer bits: a token's place is its hash modulo the bits, so halves are OR-ed."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


class SignatureTree:
    """Bulk-loaded by size: leaves of a few documents, nodes with OR-ed bitmaps, size ranges and slack.

    A set's overlap with any other is at most the common bits plus its slack, the
    tokens that share a bit with another of its own.
    """

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, comps: np.ndarray, leaf: int, fan: int = 4):
        self.order = np.argsort(sizes, kind="stable")
        self.sizes, self.maps, self.comps = sizes[self.order], maps[self.order], comps[self.order]
        self.slack = self.sizes - np.bitwise_count(self.maps).sum(1).astype(np.int64)
        self.nodes = []  # (first, last, OR, least size, greatest size, slack, only component or -1, children)
        level = []
        for i in range(0, len(sizes), leaf):
            part = slice(i, min(i + leaf, len(sizes)))
            one = self.comps[part]
            level.append(self._add(part.start, part.stop, np.bitwise_or.reduce(self.maps[part]), self.slack[part].max(), one[0] if (one == one[0]).all() else -1, []))
        while len(level) > 1:
            up = []
            for i in range(0, len(level), fan):
                kids = level[i : i + fan]
                n = [self.nodes[k] for k in kids]
                same = n[0][6] if all(x[6] == n[0][6] for x in n) else -1
                up.append(self._add(n[0][0], n[-1][1], np.bitwise_or.reduce([x[2] for x in n]), max(x[5] for x in n), same, kids))
            level = up
        self.root = level[0]

    def _add(self, first, last, joined, slack, comp, kids) -> int:
        self.nodes.append((first, last, joined, int(self.sizes[first]), int(self.sizes[last - 1]), int(slack), int(comp), kids))
        return len(self.nodes) - 1


def candidates(left: SignatureTree, right: SignatureTree, how: Join) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs of different components that may be similar enough, leaf by leaf."""
    same, stack = left is right, [(left.root, right.root)]
    while stack:
        a, b = stack.pop()
        x, y = left.nodes[a], right.nodes[b]
        if x[6] >= 0 and x[6] == y[6]:
            continue
        if how.of * x[4] < how.least * y[3] or how.of * y[4] < how.least * x[3]:
            continue
        most = int(np.bitwise_count(x[2] & y[2]).sum()) + max(x[5], y[5])
        if not how.links(min(most, x[4], y[4]), x[3], y[3]):
            continue
        if x[7] or y[7]:
            if x[7] and (not y[7] or x[1] - x[0] >= y[1] - y[0]):
                if same and a == b:
                    kids = x[7]
                    stack += [(k, m) for i, k in enumerate(kids) for m in kids[i:]]
                else:
                    stack += [(k, b) for k in x[7]]
            else:
                stack += [(a, k) for k in y[7]]
            continue
        p, q = slice(x[0], x[1]), slice(y[0], y[1])
        common = np.bitwise_count(left.maps[p][:, None, :] & right.maps[q][None, :, :]).sum(2, dtype=np.int64)
        n, m = left.sizes[p][:, None], right.sizes[q][None, :]
        most = np.minimum(common + np.minimum(left.slack[p][:, None], right.slack[q][None, :]), np.minimum(n, m))
        ok = how.links(most, n, m) & (left.comps[p][:, None] != right.comps[q][None, :])
        if same and a == b:
            ok = np.triu(ok, 1)
        i, j = np.nonzero(ok)
        if len(i):
            yield left.order[i + x[0]], right.order[j + y[0]]


def sketches(docs: DataFrame, how: Join, frequent: np.ndarray, id_col: str, text: str) -> DataFrame:
    """Per document: set size, digest of the set, digest of the text, bitmap and prefix tokens."""
    narrow = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_of(docs, text).alias("text"))

    frequent_and_end = np.append(frequent, np.uint64(0))

    def run(batches):
        memo = _Words()
        for batch in batches:
            out = []
            for body in batch.column(1).to_pylist():
                s = shingles(body, how.words, memo)
                n = len(s)
                at = np.searchsorted(frequent, s)
                hot = frequent_and_end[at] == s
                prefix = np.concatenate([s[~hot], s[hot]])[: how.prefix(n) if n else 0]
                out.append((n, md5(s.tobytes()).digest(), md5(body.encode()).digest(), bitmap(s), prefix.view(np.int64)))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]],
                names=["doc_id", "n", "digest", "text_key", "bits", "prefix"],
            )

    return narrow.mapInArrow(run, "doc_id bigint, n bigint, digest binary, text_key binary, bits binary, prefix array<bigint>")


def frequent_tokens(docs: DataFrame, how: Join, text: str) -> np.ndarray:
    """Tokens that many documents of a bounded sample hold, the 200,000 most frequent at most.

    Only the quarter of all tokens that comes first by hash is counted: the first few
    of a document are hardly ever others.
    """
    share = min(1.0, how.sample / max(docs.count(), 1))
    body = docs.select(text_of(docs, text).alias("text")).sample(fraction=share, seed=1)

    def run(batches):
        for batch in batches:
            found = [s[: np.searchsorted(s, _LOW)] for t in batch.column(0).to_pylist() for s in (shingles(t, how.words),)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], names=["token"])

    counted = body.mapInArrow(run, "token bigint").groupBy("token").count().filter(F.col("count") >= how.frequent)
    rows = counted.orderBy(F.desc("count"), "token").limit(200_000).toArrow().column(0).to_numpy()
    return np.sort(rows.view(np.uint64))


def _groups(nodes: DataFrame, tokens, how: Join) -> DataFrame:
    """``group, left, right``: nodes that share a token, each such set of nodes once; ``right`` is empty within a block.

    Only runs of sizes in which neighbours could link, and that hold more than one component, come out.
    """
    rows = nodes.select(tokens.alias("token"), "n", "node", "comp").repartition("token").sortWithinPartitions("token", "n", "node")

    def near(run: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
        start = 0
        for i in range(1, len(run) + 1):
            if i == len(run) or how.of * run[i - 1][0] < how.least * run[i][0]:
                if i - start > 1 and any(x[2] != run[start][2] for x in run[start + 1 : i]):
                    yield run[start:i]
                start = i

    def cut(members: list[tuple[int, int, int]]) -> Iterator[tuple[list[int], list[int]]]:
        for run in near(members):
            yield from blocked(run)

    def blocked(run: list[tuple[int, int, int]]) -> Iterator[tuple[list[int], list[int]]]:
        blocks, held = [[]], 0
        for row in run:
            if blocks[-1] and (len(blocks[-1]) == how.block or held + row[0] > how.block_tokens):
                blocks.append([])
                held = 0
            blocks[-1].append(row)
            held += row[0]
        for i, left in enumerate(blocks):
            ids = [x[1] for x in left]
            if len(ids) > 1:
                yield ids, []
            for right in blocks[i + 1 :]:
                if how.of * left[-1][0] < how.least * right[0][0]:
                    break
                yield ids, [x[1] for x in right]

    def run(batches):
        token, members = None, []

        def packed(found):
            found = list(found)
            keys = [md5(np.array([*a, -1, *b], np.int64).tobytes()).digest() for a, b in found]
            lists = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array([f[0] for f in found], lists), pa.array([f[1] for f in found], lists)], names=["group", "left", "right"]
            )

        for batch in batches:
            ts, ns, ids, cs = (batch.column(i).to_numpy() for i in range(4))
            edges = np.flatnonzero(np.diff(ts)) + 1
            found = []
            for a, b in zip([0, *edges], [*edges, len(ts)]):
                if b == a:
                    continue
                if ts[a] != token:
                    if len(members) > 1:
                        found += cut(members)
                    token, members = ts[a], []
                if b - a > 1 or members or b == len(ts) or a == 0:
                    members += zip(ns[a:b].tolist(), ids[a:b].tolist(), cs[a:b].tolist())
            if found:
                yield packed(found)
        if len(members) > 1:
            yield packed(cut(members))

    found = rows.mapInArrow(run, "group binary, left array<bigint>, right array<bigint>")
    return found.dropDuplicates(["group"])


def _members(groups: DataFrame) -> DataFrame:
    side = lambda c, r: F.transform(c, lambda x: F.struct(x.alias("node"), F.lit(r).alias("right")))
    return groups.select("group", F.explode(F.concat(side("left", False), side("right", True))).alias("m")).select("group", "m.node", "m.right")


def _by_group(batches):
    """Sorted rows as one table per group; a group has two blocks at most."""
    key, parts = None, []
    for batch in batches:
        keys = batch.column(0).to_pylist()
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if keys[start] != key:
                    if parts:
                        yield key, pa.Table.from_batches(parts)
                    key, parts = keys[start], []
                parts.append(batch.slice(start, i - start))
                start = i
    if parts:
        yield key, pa.Table.from_batches(parts)


def _trees(table: pa.Table, how: Join, comps: np.ndarray):
    """Candidate pairs of a group: one tree per side and bitmap length, lengths meeting at the shorter."""
    sizes, bits = table.column("n").to_numpy(), table.column("bits").to_pylist()
    right = table.column("right").to_numpy(zero_copy_only=False).astype(bool)
    length = np.array([len(x) for x in bits])
    classes: dict[tuple[bool, int], tuple[np.ndarray, np.ndarray]] = {}
    for r, k in sorted(set(zip(right.tolist(), length.tolist()))):
        rows = np.flatnonzero((right == r) & (length == k))
        maps = np.frombuffer(b"".join([bits[i] for i in rows]), np.uint64).reshape(len(rows), -1)
        classes[r, k] = rows, maps
    tree = functools.cache(
        lambda key, words: SignatureTree(sizes[classes[key][0]], folded(classes[key][1], words), comps[classes[key][0]], how.leaf)
    )
    two = right.any() and not right.all()
    for x in classes:
        for y in classes:
            if (x[0] or not y[0]) if two else y < x:
                continue
            words = min(x[1], y[1]) // 8
            for i, j in candidates(tree(x, words), tree(y, words), how):
                yield classes[x][0][i], classes[y][0][j]


def _with_partner(members: DataFrame, how: Join) -> DataFrame:
    """Members that have a possible partner of another component in their group; equal sets of them are named alike."""

    def run(batches):
        for _, table in _by_group(batches):
            comps = table.column("comp").to_numpy()
            hit = np.zeros(table.num_rows, bool)
            for i, j in _trees(table, how, comps):
                hit[i] = hit[j] = True
            if hit.any():
                left = table.filter(pa.array(hit)).sort_by([("right", "ascending"), ("node", "ascending")]).combine_chunks()
                name = md5(left.column("node").to_numpy().tobytes() + left.column("right").to_numpy(zero_copy_only=False).tobytes()).digest()
                named = left.drop_columns(["group"]).add_column(0, "group", pa.array([name] * left.num_rows, pa.binary()))
                yield from named.to_batches()

    ordered = members.repartition("group").sortWithinPartitions("group")
    return ordered.mapInArrow(run, ordered.schema)


def _sets(docs: DataFrame, need: DataFrame, how: Join, text: str) -> DataFrame:
    """``node, tokens`` of the nodes in ``need`` (``text_key, node``), from the documents' texts."""
    body = text_of(docs, text)
    keyed = docs.select(body.alias("text"), F.unhex(F.md5(body)).alias("text_key")).join(broadcast_within(need, 200_000), "text_key")

    def run(batches):
        memo = _Words()
        for batch in batches:
            sets = [shingles(t, how.words, memo).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "tokens"])

    return keyed.select("node", "text").mapInArrow(run, "node bigint, tokens binary").dropDuplicates(["node"])


def _verified(members: DataFrame, how: Join) -> DataFrame:
    """Exact links that join different components, found group by group: ``a, b``."""

    def run(batches):
        for _, table in _by_group(batches):
            nodes, comps = table.column("node").to_numpy(), table.column("comp").to_numpy()
            tokens = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
            up = {c: c for c in comps.tolist()}

            def find(c):
                while up[c] != c:
                    up[c] = up[up[c]]
                    c = up[c]
                return c

            a, b = [], []
            for i, j in _trees(table, how, comps):
                for p, q in zip(i.tolist(), j.tolist()):
                    x, y = find(int(comps[p])), find(int(comps[q]))
                    if x == y:
                        continue
                    s, t = tokens[p], tokens[q]
                    if how.links(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t)):
                        up[max(x, y)] = min(x, y)
                        a.append(int(nodes[p]))
                        b.append(int(nodes[q]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    ordered = members.repartition("group").sortWithinPartitions("group")
    return ordered.mapInArrow(run, "a bigint, b bigint")


def _without_subsets(members: DataFrame) -> DataFrame:
    """Leave out groups that lie inside another one: all their nodes have the same largest group.

    That group is one block, so it compares all pairs of its nodes.
    """
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.bool_or("right").alias("two"))
    rows = members.select("group", "node").join(sizes, "group")
    largest = rows.filter("not two").groupBy("node").agg(F.max(F.struct("size", "group"))["group"].alias("largest"))
    seen = rows.join(largest, "node", "left").groupBy("group").agg(
        F.min("largest").alias("a"), F.max("largest").alias("b"), (F.count("largest") == F.count(F.lit(1))).alias("all")
    )
    return members.join(seen.filter("all and a = b and a != group").select("group"), "group", "left_anti")


def _round(docs: DataFrame, nodes: DataFrame, tokens, how: Join, text: str, overlapping: bool) -> DataFrame:
    """Links between different components of ``nodes`` among those that share one of ``tokens``; overlapping: a node can have several."""
    members = _members(_groups(nodes, tokens, how)).join(nodes.select("node", "n", "bits", "comp"), "node")
    members = members.select("group", "node", "right", "n", "bits", "comp")
    left = stored(_with_partner(members, how).dropDuplicates(["group", "node", "right"]), "jaccard-partners")
    need = stored(left.select("node").distinct().join(nodes.select("node", "text_key"), "node"), "jaccard-need")
    if overlapping:
        left = stored(_without_subsets(left), "jaccard-groups")
    checked = left.join(_sets(docs, need, how, text), "node").select("group", "node", "right", "n", "bits", "comp", "tokens")
    return stored(_verified(checked, how), "jaccard-links")


def join(docs: DataFrame, how: Join = Join(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row.

    Words are lower-cased in A-Z. A set is the distinct shingles of ``how.words``
    words; a shorter text is one shingle; a null text or one without words has an
    empty set and is linked with nothing. Rows link when the intersection is at
    least ``least / of`` of the union; repeated rows and copies have equal sets and
    so one component. ``component_id`` is the smallest identifier in the component,
    null only if all of them are null. An empty table gives an empty result. Other
    columns are not looked at.
    """
    sketch = stored(sketches(docs, how, frequent_tokens(docs, how, text), id_col, text), "jaccard-sketch")
    some = ["n", "text_key", "bits", "prefix"]
    nodes = sketch.filter("n > 0").groupBy("digest").agg(F.any_value(F.struct(*some)).alias("s"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "s.*"), "jaccard-nodes")
    first = _round(docs, nodes.withColumn("comp", F.col("node")), F.get("prefix", F.lit(0)), how, text, False)
    merged = nodes.join(components(first), "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    second = _round(docs, merged, F.explode("prefix"), how, text, True)
    comps = components(first.unionAll(second))
    owner = nodes.select("digest", "node").join(comps, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    ids = stored(sketch.select("doc_id", "n", "digest").join(owner, "digest", "left").select("doc_id", "n", "component"), "jaccard-ids")
    least = ids.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = ids.filter("n > 0").join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionAll(ids.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, how: Join = Join(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that a smaller identifier of their component stands for.

    Rows without identifier stay: there is nothing to name them by.
    """
    found = join(docs, how, id_col, text)
    lost = found.filter("component_id < doc_id").select(F.col("doc_id").alias("__lost_id")).distinct()
    lost = stored(lost, "jaccard-lost")
    return docs.join(broadcast_within(lost, 200_000), docs[id_col] == F.col("__lost_id"), "left_anti")
