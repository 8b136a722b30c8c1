"""Line dedup: lines that an earlier document holds, as compressed keep bitmaps.

Line hashes are partitioned by range with document and position as secondary
order, in the range bounds too, so a line that a third of all documents hold is
spread over many tasks. Each task streams its sorted rows and keeps only the
current hash in memory. A hash cut by a bound is settled by the heads of the
partitions: two small rows each.
"""

from __future__ import annotations

import zlib
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandloom.llm.common import WS, text_of
from bandloom.session import stored

MIN_CHARS = 10
_WS = WS.encode()
_ROW = "h binary, doc_id bigint, doc_key binary, pos int"


def _key(line: bytes, min_chars: int) -> bytes | None:
    """Digest of a line's key, None for keys that are too short."""
    key = line.strip(_WS)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return md5(key.lower()).digest()  # bytes.lower changes A-Z only


def _doc_key(doc_id, text: str) -> bytes:
    return md5(f"{doc_id}\n{text}".encode()).digest()


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line that is long enough: ``h, doc_id, doc_key, pos``."""
    narrow = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_of(docs, text).alias("text"))

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mark = _doc_key(doc_id, body)
                for pos, line in enumerate(body.encode().split(b"\n")):
                    h = _key(line, min_chars)
                    if h is not None:
                        rows.append((h, doc_id, mark, pos))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.binary(), pa.int32()))],
                names=["h", "doc_id", "doc_key", "pos"],
            )

    return narrow.mapInArrow(run, _ROW)


def _later(batches):
    """From sorted hashes, the rows that are not of the first document with that hash.

    An earlier partition may hold the first document of a partition's first hash:
    all its rows come out with ``cut`` set, and the last hash comes out once more
    with its first document (no ``doc_key``), for the partitions after this one.
    """
    current, first, head = None, None, None
    names = ["h", "doc_id", "doc_key", "pos", "cut"]
    for batch in batches:
        keep, cut = [], []
        for i, (h, doc) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if h != current:
                current, first = h, doc
                head = h if head is None else head
            if h == head or doc != first:
                keep.append(i)
                cut.append(h == head)
        rows = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cut, pa.bool_())], names=names)
    if current is not None:
        last = [[current], [first], [None], [-1], [True]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(last, (pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.bool_()))], names=names
        )


def _pack(batches):
    for batch in batches:
        packed = []
        for positions in batch.column(2).to_pylist():
            bits = np.zeros(max(positions) + 1, np.uint8)
            bits[positions] = 1
            packed.append(zlib.compress(np.packbits(bits).tobytes(), 6))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc_id", "doc_key", "bitmap"])


def dropped_positions(bitmap: bytes | None) -> set[int]:
    """Positions of the lines that a bitmap drops."""
    if bitmap is None:
        return set()
    return set(np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))).tolist())


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """``doc_id, doc_key, bitmap`` of each document that loses a line; set bits are dropped lines.

    A line's key is the line without white space at its ends and with A-Z
    lower-cased. Keys of ``min_chars`` code points or more stay only in the
    smallest identifier that holds them. A null identifier comes after all others,
    and all rows of one identifier count as one document: repeated rows keep or
    lose the same lines. A null or empty text is one empty line, which stays. An
    empty table gives no bitmap. Other columns are not looked at.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("h"), F.col("doc_id").asc_nulls_last(), F.col("doc_key"), F.col("pos")]
    hashes = line_hashes(docs, min_chars, id_col, text).repartitionByRange(n, *order).sortWithinPartitions(*order)
    later = stored(hashes.mapInArrow(_later, f"{_ROW}, cut boolean"), "line-later")
    # At most two hashes per partition are cut by a bound: their first document over all partitions decides.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    heads = F.broadcast(later.filter("cut").groupBy("h").agg(F.min(rank).alias("head")))
    cut = later.filter("cut and doc_key is not null").join(heads, "h").filter(~F.col("doc_id").eqNullSafe(F.col("head.doc_id")))
    dropped = later.filter("not cut").select("doc_id", "doc_key", "pos").unionAll(cut.select("doc_id", "doc_key", "pos"))
    lists = dropped.groupBy("doc_id", "doc_key").agg(F.collect_set("pos").alias("pos"))
    return lists.mapInArrow(_pack, "doc_id bigint, doc_key binary, bitmap binary")


def apply_keep(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with ``n_lines``, ``n_dropped`` and ``kept_text`` (columns of these names are replaced)."""
    bitmaps = stored(bitmaps.select(F.col("doc_key").alias("__doc_key"), F.col("bitmap").alias("__bitmap")), "line-bitmaps")
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    names = docs.columns
    mark = F.unhex(F.md5(F.concat(F.coalesce(docs[id_col].cast("bigint").cast("string"), F.lit("None")), F.lit("\n"), text_of(docs, text))))
    marked = docs.withColumn("__doc_key", mark).join(bitmaps, "__doc_key", "left")
    wide = marked.select(*[f"`{c}`" for c in names], text_of(marked, text).alias("__text"), "__bitmap")

    def run(batches):
        for batch in batches:
            counts, lost, kept = [], [], []
            for body, bitmap in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
                parts, gone = body.split("\n"), dropped_positions(bitmap)
                counts.append(len(parts))
                lost.append(len(gone))
                kept.append("\n".join(x for i, x in enumerate(parts) if i not in gone) if gone else body)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())],
                names=[*names, "n_lines", "n_dropped", "kept_text"],
            )

    added = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())]
    return wide.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
