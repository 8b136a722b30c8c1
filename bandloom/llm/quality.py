"""Quality rules: a few exact counts and a hashed n-gram log-likelihood ratio.

Uni- and bigrams are hashed into buckets. The trusted target is
all documents labelled good; the raw corpus is all documents. A document's verdict
is the mean log ratio of its n-grams against a threshold taken from the labelled
documents, so every document is decided by itself and reruns agree.
Two narrow scans; only bucket counts are shuffled. All in built-in functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandloom.llm.common import WORD, broadcast_within, text_of, words_of
from bandloom.session import stored

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Labels of 16 bytes that may be sent to every executor; more are joined by a shuffle.
BROADCAST_LABELS = 200_000
#: The threshold is found among log ratios cut down to this step, so that its aggregate stays small.
STEP = 1e-4


@dataclass(frozen=True)
class Ratio:
    """Parameters of the likelihood ratio."""

    buckets: int = 20_000
    #: Labelled documents that the target and the threshold are fitted on: all, or so many by hash of their identifier.
    sample: int | None = None
    #: Share of the labelled good documents that the threshold may lose.
    loss: float = 0.001
    #: Parts of the labelled documents; each part is scored for the threshold with the target of the others.
    folds: int = 4
    seed: int = 7


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_hashes(words: Column) -> Column:
    """A hash per word; every longer n-gram is hashed from these."""
    return F.transform(words, lambda x: F.xxhash64(x))


def _joined(a: Column, b: Column, ahead: int, n: Column) -> Column:
    """``n`` hashes, each of a hash of ``a`` and of the one ``ahead`` places on in ``b``."""
    n = F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, ahead + 1, n), lambda x, y: F.xxhash64(x, y))


def pair_hashes(h: Column) -> Column:
    """A hash per two neighbouring words, from the hashes of the words."""
    return _joined(h, h, 1, F.size(h) - 1)


def window_hashes(h: Column, pairs: Column) -> Column:
    """A hash per window of five words: two pairs and a word."""
    fours = _joined(pairs, pairs, 2, F.size(h) - 3)
    return _let(fours, lambda x: _joined(x, h, 4, F.size(h) - 4))


def _covered(words: Column, windows: Column) -> Column:
    """Words inside windows that occur twice or more: neighbours in the order of hashes whose words agree too."""
    window = WINDOW
    placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), (i + 1).alias("i"))))
    same = lambda a, b: F.coalesce((a["h"] == b["h"]) & (F.slice(words, a["i"], window) == F.slice(words, b["i"], window)), F.lit(False))
    twin = lambda s, k: same(F.get(s, k - 1), s[k]) | same(F.get(s, k + 1), s[k])
    at = _let(
        placed,
        lambda s: F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: twin(s, k)), lambda k: s[k]["i"])),
    )
    # A window adds the words up to the next repeated window's start, at most its own length.
    gaps = lambda p: F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(window)), F.lit(window)))
    return _let(at, lambda p: F.aggregate(gaps(p), F.lit(0), lambda a, x: a + x))


def _repeated(words: Column, h: Column, pairs: Column) -> Column:
    """Windows are compared by hash first; only a text in which two hashes agree is looked at further."""

    def count(x: Column) -> Column:
        again = F.size(F.array_distinct(x)) < F.size(x)
        return F.when(again, _covered(words, x)).otherwise(0).cast("bigint")

    return _let(window_hashes(h, pairs), count)


def repeated_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more in the array."""
    return _let(words, lambda w: _let(word_hashes(w), lambda h: _let(pair_hashes(h), lambda p: _repeated(w, h, p))))


def labelled(labels: DataFrame, ratio: Ratio = Ratio()) -> DataFrame:
    """One row per labelled identifier: all of them, or ``ratio.sample`` spread by a hash."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    if ratio.sample is not None:
        known = known.orderBy(F.xxhash64(F.lit(ratio.seed), "doc_id"), "doc_id").limit(ratio.sample)
    return broadcast_within(stored(known, "quality-labels"), BROADCAST_LABELS)


def _mean_ratio(h: Column, pairs: Column, weights: Column, buckets: int) -> Column:
    """Mean log ratio of all uni- and bigrams, from the hashes of words and pairs; 0 without words."""
    total = lambda b: F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(weights, F.pmod(x, F.lit(buckets)).cast("int")))
    return (total(h) + total(pairs)) / F.greatest(F.size(h) + F.size(pairs), F.lit(1))


def mean_ratio(words: Column, weights: Column, buckets: int) -> Column:
    return _let(word_hashes(words), lambda h: _let(pair_hashes(h), lambda p: _mean_ratio(h, p, weights, buckets)))


def measured(words: Column, weights: Column, buckets: int) -> Column:
    """What the verdict rests on, from words that are taken apart and hashed once."""
    return _let(
        words,
        lambda w: _let(
            word_hashes(w),
            lambda h: _let(
                pair_hashes(h),
                lambda p: F.struct(
                    F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), _repeated(w, h, p).alias("n_repeat_words"), _mean_ratio(h, p, weights, buckets).alias("llr")
                ),
            ),
        ),
    )


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def _constant(values: list[float]) -> Column:
    """A constant array, folded once into the plan."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def fit(docs: DataFrame, labels: DataFrame, ratio: Ratio = Ratio(), id_col: str = "doc_id", text: str = "text") -> tuple[list[float], float]:
    """Log ratios per bucket (as many numbers as ``ratio.buckets``, whatever the input) and the threshold.

    Both multinomials have one added count per bucket. The threshold is the low end
    of the good labelled documents (all but ``loss`` of them), cut down to a
    multiple of ``STEP``. For it they are scored in ``folds`` parts by a target
    without their own part, as a document that nobody labelled is. Without good
    labels every document passes.
    """
    fold = F.when(F.col("quality") == 1, F.pmod(F.xxhash64(F.lit(ratio.seed), "doc_id"), F.lit(ratio.folds)).cast("int"))
    known = labelled(labels, ratio).select("doc_id", fold.alias("fold"))
    narrow = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text).alias("body"))
    marked = narrow.join(known, "doc_id", "left").select("fold", word_hashes(words_of(F.col("body"))).alias("h"))
    grams = marked.select("fold", F.explode(_let(F.col("h"), lambda h: F.concat(h, pair_hashes(h)))).alias("gram"))
    place = F.pmod("gram", F.lit(ratio.buckets)).cast("int").alias("bucket")
    # One count per bucket and part; unlabelled documents and those labelled bad are one more part.
    counts = grams.select(place, F.coalesce("fold", F.lit(ratio.folds)).alias("part")).groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    parts = [F.coalesce(F.sum(F.when(F.col("part") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(ratio.folds + 1)]
    good, rest = [[0] * ratio.buckets for _ in range(ratio.folds)], [0] * ratio.buckets
    for bucket, *n in stored(counts, "quality-counts").groupBy("bucket").agg(*parts).collect():  # at most one row per bucket
        rest[bucket] = n.pop()
        for part, own in zip(good, n):
            part[bucket] = own
    total = [sum(x) for x in zip(*good)]
    raw = [a + b for a, b in zip(total, rest)]
    weights = _log_ratios(total, raw)
    others = [_log_ratios([g - own for g, own in zip(total, part)], raw) for part in good]
    scored = narrow.join(known.filter("fold is not null"), "doc_id").select("fold", words_of(F.col("body")).alias("words")).filter(F.size("words") > 0)
    per_fold = F.array(*[_constant(w) for w in others])
    llr = _let(F.get(per_fold, F.col("fold")), lambda w: mean_ratio(F.col("words"), w, ratio.buckets))
    low = scored.select(F.floor(llr / STEP).alias("llr")).agg(F.percentile("llr", F.lit(ratio.loss))).first()[0]
    return weights, float("-inf") if low is None else math.floor(low) * STEP


def _log_ratios(good: list[int], raw: list[int]) -> list[float]:
    n_good, n_raw = sum(good) + len(good), sum(raw) + len(raw)
    return [math.log((g + 1) / n_good) - math.log((r + 1) / n_raw) for g, r in zip(good, raw)]


def judge(
    docs: DataFrame, labels: DataFrame, ratio: Ratio = Ratio(), id_col: str = "doc_id", text: str = "text", fitted: tuple[list[float], float] | None = None
) -> DataFrame:
    """All rows and columns with the base counts, ``base_failed``, ``llr`` and ``kept`` (such names are replaced).

    A null or empty text has no words and fails. Rows, repeated ones too, are
    decided one by one; identifiers may be null and are then not labelled. Labels
    that repeat count as their smallest value, null ones not at all. An empty table
    gives an empty result.
    """
    weights, threshold = fitted or fit(docs, labels, ratio, id_col, text)
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    docs = docs.drop(*made)
    body, m = text_of(docs, text), F.col("__measured")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    out = docs.withColumn("__measured", measured(words_of(body), _constant(weights), ratio.buckets)).withColumns(
        {
            "n_words": m["n_words"],
            "word_chars": m["word_chars"],
            "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("bigint"),
            "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
            "n_repeat_words": m["n_repeat_words"],
            "base_failed": base_failed(m),
            "llr": m["llr"],
            "kept": ~base_failed(m) & (m["llr"] >= F.lit(threshold)),
        }
    )
    return out.drop("__measured")


def kept_rows(docs: DataFrame, labels: DataFrame, ratio: Ratio = Ratio()) -> DataFrame:
    """The documents that pass, with their own columns. The condition is one expression, so it is worked out once per row."""
    weights, threshold = fit(docs, labels, ratio)
    found = measured(words_of(text_of(docs)), _constant(weights), ratio.buckets)
    return docs.filter(_let(found, lambda m: ~base_failed(m) & (m["llr"] >= F.lit(threshold))))
