"""Exact deduplication with keyed streaming state on disk.

Arrivals (digest, identifier, locator, no text) are appended to a table. A
streaming aggregate without watermark keeps, per digest, the best row so far and
a count in the RocksDB state store; nothing expires. The state is checkpointed
in the shared folder, so a later call with the same folder resumes from it and
an executor lost on the way costs only its part. Digests hit more than once are
checked byte by byte: the least and the greatest text of a digest are equal only
if all are. Texts that share a digest without being equal are grouped by the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.llm.common import WS, broadcast_within, text_of
from bandloom.session import scratch_path, stored

#: Keyed state on each executor's disk, its changes saved in the shared folder, without space reserved ahead.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
ARRIVAL = "doc_id bigint, digest string, n_chars int, row_no bigint, file string"
#: Arrival files taken by one micro-batch.
FILES_PER_BATCH = 1000


def normalised(text: Column) -> Column:
    """The text without any white space character."""
    for c in WS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rank() -> Column:
    """Greater is better: most code points, then smallest identifier (none last), then first row."""
    return F.struct(
        F.col("n_chars").alias("n_chars"),
        F.bitwise_not("doc_id").alias("id_order"),  # reversed order; null is the least
        (-F.col("row_no")).alias("row_order"),
        F.col("doc_id").alias("doc_id"),
        F.col("file").alias("file"),
    )


def arrivals(docs: DataFrame, digest: Callable[[Column], Column] = sha256, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per document: digest, identifier, length and where the content is."""
    raw = text_of(docs, text)
    return docs.select(
        docs[id_col].cast("bigint").alias("doc_id"),
        digest(normalised(raw)).alias("digest"),
        F.length(raw).alias("n_chars"),
        F.monotonically_increasing_id().alias("row_no"),
        F.input_file_name().alias("file"),
    )


def advance(spark: SparkSession, arrived: str, state: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Take all files of ``arrived`` not yet seen into the state; return the state as a table."""
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", files_per_batch).parquet(arrived)
        best = stream.groupBy("digest").agg(F.max(_rank()).alias("best"), F.count(F.lit(1)).alias("group_size"))
        run = (
            best.writeStream.format("noop").outputMode("update")
            .option("checkpointLocation", state).trigger(availableNow=True).start()
        )
        run.awaitTermination()
        held = spark.read.format("statestore").load(state)
        return stored(
            held.select(
                "key.digest", F.col("value.max.doc_id").alias("keep_id"), (-F.col("value.max.row_order")).alias("keep_row"),
                F.col("value.max.file").alias("keep_file"), F.col("value.count").alias("group_size"),
            ),
            "exact-state",
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _decide(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"),
        F.col("digest").alias("text_sha256"), "n_chars",
    )


def _unequal(docs: DataFrame, groups: DataFrame, digest, text: str) -> DataFrame:
    """Digests whose texts are not all equal, compared over their full bytes."""
    hit = broadcast_within(stored(groups.filter("group_size > 1").select("digest"), "exact-hits"))
    body = normalised(text_of(docs, text))
    texts = docs.select(body.alias("body")).withColumn("digest", digest(F.col("body"))).join(hit, "digest", "left_semi")
    ends = texts.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("greatest"))
    return stored(ends.filter("least != greatest").select("digest"), "exact-unequal")


def dedup(
    docs: DataFrame,
    digest: Callable[[Column], Column] = sha256,
    id_col: str = "doc_id",
    text: str = "text",
    files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """Per row: ``doc_id, keep_id, group_size, kept, text_sha256, n_chars``.

    Texts are equal when identical without white space; a null text is an empty
    one, and empty texts are equal to each other. The longest original stays, then
    the smallest identifier; a null identifier comes after all others, and of
    repeated rows exactly one stays. Other columns are not looked at. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    arrived, state = scratch_path(spark, "exact-arrivals"), scratch_path(spark, "exact-checkpoint")
    arrivals(docs, digest, id_col, text).write.parquet(arrived)
    rows = spark.read.schema(ARRIVAL).parquet(arrived)
    groups = advance(spark, arrived, state, files_per_batch)
    unequal = _unequal(docs, groups, digest, text)
    if unequal.isEmpty():
        return _decide(rows, groups)
    clean = _decide(rows.join(unequal, "digest", "left_anti"), groups)
    body = normalised(text_of(docs, text))
    again = docs.select(docs[id_col].cast("bigint").alias("doc_id"), body.alias("body"), F.length(text_of(docs, text)).alias("n_chars"))
    again = again.withColumn("digest", digest(F.col("body"))).join(unequal, "digest", "left_semi")
    again = stored(again.withColumns({"row_no": F.monotonically_increasing_id(), "file": F.lit("")}), "exact-again")
    by_text = again.groupBy("body").agg(F.max(_rank()).alias("best"), F.count(F.lit(1)).alias("group_size"))
    by_text = by_text.select("body", F.col("best.doc_id").alias("keep_id"), (-F.col("best.row_order")).alias("keep_row"), "group_size")
    split = again.join(by_text, "body").select(
        "doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"),
        F.col("digest").alias("text_sha256"), "n_chars",
    )
    return clean.unionByName(split)


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    A dropped row is found again by identifier and digest. Rows repeated as a whole
    are the only ones of which one is kept and one dropped under the same pair;
    they are told apart by a second pass that runs only if there are any.
    """
    verdict = stored(dedup(docs, sha256, id_col, text), "exact-verdict")
    names = [f"`{c}`" for c in docs.columns]
    none = F.lit("-")
    lost = verdict.groupBy(F.coalesce(F.col("doc_id").cast("string"), none).alias("__exact_id"), F.col("text_sha256").alias("__exact_digest"))
    lost = lost.agg(F.bool_or("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    lost = stored(lost.filter("not stays or n > 1"), "exact-lost")
    pair = ["__exact_id", "__exact_digest"]
    marked = docs.withColumns(
        {
            "__exact_id": F.coalesce(docs[id_col].cast("string"), none),
            "__exact_digest": sha256(normalised(text_of(docs, text))),
            "__exact_n": F.length(text_of(docs, text)),
        }
    )
    single = marked.join(broadcast_within(lost.select(*pair)), pair, "left_anti").select(*names)
    repeated = lost.filter("stays").select(*pair)
    if repeated.isEmpty():
        return single
    twice = marked.join(broadcast_within(repeated), pair, "left_semi")
    best = twice.groupBy(*pair).agg(F.max_by(F.struct(*names), F.col("__exact_n")).alias("row"))
    return single.unionByName(best.select("row.*"))
