"""Registered queries of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from bandloom.llm import bpe, centroids, chat, divergence, exact, jaccard, lines, mixing, pivots, quality, secrets, suffix, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document and of what they decode to."""
    ranks = bpe.rank_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded="decoded").select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 90% of their 3-word shingles."""
    return jaccard.join(documents(spark, sf_dir).select("doc_id", "text"), jaccard.Join(words=3, least=90, of=100))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict for every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(documents(spark, sf_dir).select("doc_id", "text"), labels)


def op6_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of every conversation without quotes, with the turn it answers and its thread."""
    return chat.conversations_without_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of equal texts stays, for every document."""
    found = exact.dedup(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS raw, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY length(raw) DESC, doc_id NULLS LAST) AS rn,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(raw) DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM r
"""


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 400-byte strings that are found twice."""
    found = suffix.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    repeated = (F.col("n_removed") > 0).alias("has_repeats")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), repeated)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_times")).alias("taken"),
    )


OP9_SQL = """
WITH t AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat_ws(':', 'mix-1', doc_id::VARCHAR)) AS at
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM t GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM s
), o AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER p, 0))::BIGINT AS rest,
         (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0))::BIGINT AS open_weight
  FROM w WINDOW p AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT rest, open_weight FROM o WHERE rest * weight <= 3 * source_size * open_weight ORDER BY open_weight DESC LIMIT 1
), g AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, level.rest::DOUBLE * weight / level.open_weight::DOUBLE) AS target FROM w, level
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM g
), r AS (
  SELECT t.doc_id, t.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS missing, t.source, t.at,
         sum(t.size) OVER (PARTITION BY t.source ORDER BY t.at, t.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - t.size AS ahead
  FROM t JOIN e ON t.source IS NOT DISTINCT FROM e.source
), m AS (
  SELECT *, max(CASE WHEN ahead + size / 2.0 < missing THEN ahead END) OVER (PARTITION BY source) AS last_ahead FROM r
)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN ahead <= coalesce(last_ahead, -1) THEN 1 ELSE 0 END))::BIGINT AS taken FROM m
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without lines that an earlier one has."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    kept = lines.apply_keep(docs, lines.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key
), d AS (
  SELECT k.*, coalesce(f.first_doc < k.doc_id, false) AS dropped FROM k LEFT JOIN f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, of the three base kinds and of the further rules."""
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda x: x.kind.isin(*secrets.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("bigint").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    return found.select(
        "doc_id", *[count(k) for k in secrets.BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and distance of every vector after five rounds of 40 centroids."""
    found, final = centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(final)]
    names = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    per_cluster = centroids.inertia(found).join(F.broadcast(names), "cluster")  # a row per centroid
    return found.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op11_sql(k: int = 40, dims: int = 64, rounds: int = 5) -> str:
    """A pair of common tables per round; the rounds are unrolled."""
    ctes = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dims}
)""",
        """part AS MATERIALIZED (
  SELECT vec_id, generate_subscripts(embedding, 1) AS dim, floor(256 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM kept
)""",
        f"""first AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) - 1 AS cluster FROM kept
  QUALIFY cluster < {k}
)""",
        "c0 AS MATERIALIZED (SELECT cluster, dim, x FROM first JOIN part USING (vec_id))",
    ]
    for r in range(rounds + 1):
        ctes.append(
            f"""a{r} AS MATERIALIZED (
  SELECT vec_id, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM (
    SELECT vec_id, cluster, sum((part.x - c.x) * (part.x - c.x))::BIGINT AS distance FROM part JOIN c{r} c USING (dim) GROUP BY vec_id, cluster
  ) GROUP BY vec_id
)"""
        )
        if r < rounds:
            ctes.append(
                f"""c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, c.dim, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT cluster, dim, floor(sum(x) / count(*))::BIGINT AS x FROM a{r} JOIN part USING (vec_id) GROUP BY cluster, dim
  ) m USING (cluster, dim)
)"""
            )
    return f"""
WITH {", ".join(ctes)}
SELECT vec_id, cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster) USING (cluster)
"""


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector."""
    return pivots.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id != b.vec_id AND len(a.q) = len(b.q)
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence between the sources of each language, and the terms that set a source apart."""
    return divergence.audit_sources(documents(spark, sf_dir).select("text", "lang", "source"))


OP13_SQL = """
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), g AS MATERIALIZED (
  SELECT DISTINCT lang, source FROM d
), w AS MATERIALIZED (
  SELECT row, lang, source, term, count(*) AS n FROM (
    SELECT row, lang, source, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
  ) GROUP BY ALL
), k AS MATERIALIZED (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(*) >= 3
), v AS (
  SELECT lang, count(*)::HUGEINT AS terms, sum(n)::HUGEINT AS words FROM k GROUP BY lang
), c AS MATERIALIZED (
  SELECT w.lang, w.source, w.term, sum(w.n)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY w.lang, w.source, w.term
), s AS (
  SELECT lang, source, sum(n)::HUGEINT AS words FROM c GROUP BY lang, source
), p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(s.words, 0) + v.terms) AS p,
         1 + 1000000000::HUGEINT * (k.n + 1) // (v.words + v.terms) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM every
QUALIFY part = 'pair' OR rank <= 200
"""


def queries() -> dict[str, Query]:
    found = (op1_bpe, op2_jaccard_join, op3_quality, op4_line_dedup, op5_toxicity, op6_chat_quotes, op7_exact_dedup, op8_suffix_dedup, op9_mixing, op10_secrets, op11_centroids, op12_topk, op13_divergence)
    return {fn.__name__: fn for fn in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op7_exact_dedup": OP7_SQL, "op9_mixing": OP9_SQL, "op11_centroids": _op11_sql(), "op12_topk": OP12_SQL, "op13_divergence": OP13_SQL}
