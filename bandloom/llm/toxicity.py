"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Texts are folded first: case, homoglyphs, digits and signs written for letters.
The lexicon is learned from the training part of a bounded sample of labelled
rows: whole words and word beginnings that toxic texts hold and others do not,
weighted by their log odds. Phrases that contain an entry but stand in other texts
are exceptions: a match inside one does not count. A document's evidence is the
sum of weights against its length, turned into a probability by a logistic fit on
the same sample. One narrow pass scores every document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandloom.llm.common import text_of
from bandloom.session import stored

# Signs and letters of other scripts that are written for Latin letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏкмтвнαορνικτ", "aeopcyxijsdhlkmtbhaopvikt"))
#: Characters that are dropped: they only hide a word.
INVISIBLE = "​‌‍⁠﻿­"
_TABLE = str.maketrans(HOMOGLYPHS | dict.fromkeys(INVISIBLE))
_SIGNED = re.compile(r"(?<=[^\W\d_])[013457@$!]+(?=[^\W\d_])|(?<![\w@$])[013457@$!](?=[^\W\d_])")
_SIGN_TABLE = str.maketrans(SIGNS)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Lexicon:
    """Parameters: labelled rows used at most, entries kept at most, and when an entry is one."""

    sample: int = 40_000
    entries: int = 5_000
    beginnings: tuple[int, ...] = (4, 5)
    least_docs: int = 5
    least_odds: float = 3.0
    parts: int = 4
    held_out: int = 2


def fold(text: str) -> str:
    """Lower case with look-alikes as plain letters. Signs count as letters only inside or before a word."""
    text = text.lower().translate(_TABLE)
    return _SIGNED.sub(lambda m: m[0].translate(_SIGN_TABLE), text)


def _terms(words: Iterable[str], how: Lexicon) -> set[str]:
    """Entries a text can have: ``w:word`` and ``b:beginning``."""
    words = set(words)
    return {f"w:{w}" for w in words} | {f"b:{w[:k]}" for w in words for k in how.beginnings if len(w) > k}


def part_of(id_col: Column, how: Lexicon = Lexicon()) -> Column:
    """Remainder that decides whether a row may be learned from."""
    return F.crc32(id_col.cast("string").cast("binary")) % how.parts


class Matcher:
    """Automaton over the words of a folded text; exceptions are longer phrases that cover their entries."""

    def __init__(self, weights: dict[str, float], exceptions: Iterable[str]):
        self.machine = ahocorasick.Automaton()
        for term, weight in weights.items():
            kind, word = term.split(":", 1)
            self.machine.add_word(f" {word} " if kind == "w" else f" {word}", (kind, weight, len(word)))
        for phrase in exceptions:
            self.machine.add_word(f" {phrase} ", ("x", 0.0, len(phrase)))
        self.machine.make_automaton() if len(self.machine) else None

    def evidence(self, text: str) -> tuple[float, int, int]:
        """Sum of weights, number of matched words, number of words."""
        words = _WORD.findall(fold(text))
        if not words or not len(self.machine):
            return 0.0, 0, len(words)
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (kind, weight, size) in self.machine.iter(" " + " ".join(words) + " "):
            start = end - size + (kind == "b")
            if kind == "x":
                spared.append((start - 1, end - 1))
            else:
                start -= kind == "w"
                found[start] = max(found.get(start, 0.0), weight)
        kept = [w for at, w in found.items() if not any(a <= at < b for a, b in spared)]
        return sum(kept), len(kept), len(words)


def features(total: float, hits: int, words: int) -> tuple[float, float, float, float]:
    """Evidence that something is there, how much, its density, and that there is any text."""
    return float(hits > 0), math.log1p(total), total / (words + 20.0), float(words > 0)


def labelled(docs: DataFrame, labels: DataFrame, how: Lexicon, id_col: str, text: str) -> DataFrame:
    """``text, toxic`` of at most ``how.sample`` labelled rows of the training part, spread by a hash."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(part_of(F.col("doc_id"), how) != how.held_out)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.sample), "toxic-sample")
    return stored(docs.select(docs[id_col].alias("doc_id"), text_of(docs, text).alias("text")).join(F.broadcast(chosen), "doc_id"), "toxic-rows")


def learn(docs: DataFrame, labels: DataFrame, how: Lexicon = Lexicon(), id_col: str = "doc_id", text: str = "text"):
    """Weights, exceptions and the four coefficients and offset of the logistic fit; everything of bounded size."""
    rows = labelled(docs, labels, how, id_col, text)
    sizes = dict(rows.groupBy("toxic").count().collect())
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    if not n_bad or not n_good:
        return {}, [], [0.0, 0.0, 0.0, 0.0, -3.0 if n_good else 0.0]

    def terms(batches):
        for batch in batches:
            found = [sorted(_terms(_WORD.findall(fold(t)), how)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for f in found for x in f], pa.string()), pa.array([y for f, y in zip(found, batch.column(1).to_pylist()) for _ in f], pa.int32())],
                names=["term", "toxic"],
            )

    counted = rows.select("text", "toxic").mapInArrow(terms, "term string, toxic int").groupBy("term")
    counted = counted.agg(F.sum("toxic").cast("bigint").alias("bad"), F.count(F.lit(1)).alias("n"))
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1.0)) - F.log((F.col("n") - F.col("bad") + 0.5) / (n_good + 1.0))
    strong = counted.filter(F.col("bad") >= how.least_docs).withColumn("odds", odds).filter(F.col("odds") >= how.least_odds)
    weights = {r.term: r.odds for r in strong.orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "term").limit(how.entries).collect()}
    matcher = Matcher(weights, [])

    def phrases(batches):
        """Two-word phrases around a matched word."""
        for batch in batches:
            out = []
            for body, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _WORD.findall(fold(body))
                hit = [i for i, w in enumerate(words) if any(t in weights for t in _terms([w], how))]
                out += [(p, toxic) for p in {" ".join(words[max(j, 0) : j + 2]) for i in hit for j in (i - 1, i) if j >= 0 and j + 2 <= len(words)}]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32())], names=["phrase", "toxic"])

    seen = rows.select("text", "toxic").mapInArrow(phrases, "phrase string, toxic int").groupBy("phrase")
    seen = seen.agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).filter((F.col("n") - F.col("bad") >= how.least_docs) & (F.col("bad") * 10 < F.col("n")))
    exceptions = [r.phrase for r in seen.orderBy(F.desc("n"), "phrase").limit(how.entries).collect()]
    matcher = Matcher(weights, exceptions)

    def measure(batches):
        for batch in batches:
            x = [features(*matcher.evidence(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[pa.array([v[i] for v in x], pa.float64()) for i in range(4)], batch.column(1)], names=["a", "b", "c", "d", "toxic"])

    table = rows.select("text", "toxic").mapInArrow(measure, "a double, b double, c double, d double, toxic int")
    table = table.toArrow()  # at most ``sample`` rows of five numbers
    rows = np.column_stack([table.column(i).to_numpy().astype(float) for i in range(5)] + [np.ones(table.num_rows)])
    rows = rows[np.lexsort(rows.T)]  # sums do not depend on which task was first
    return weights, exceptions, _logistic(rows[:, [0, 1, 2, 3, 5]], rows[:, 4]).tolist()


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Newton steps with a small ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(x.shape[1]), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def score(
    docs: DataFrame, labels: DataFrame, how: Lexicon = Lexicon(), threshold: float = 0.3, id_col: str = "doc_id", text: str = "text", learned=None
) -> DataFrame:
    """``doc_id, held_out, score, predicted, hits`` per row.

    Only the text is an input of a score. A null or empty text has no evidence and
    gets the score of such texts. Rows, repeated ones too, are scored one by one. A
    null identifier is never labelled and not held out. Labels that repeat count as
    toxic if any says so; null ones do not count; without labels of both kinds the
    lexicon is empty. An empty table gives an empty result.
    """
    weights, exceptions, beta = learned or learn(docs, labels, how, id_col, text)
    narrow = docs.select(
        docs[id_col].alias("doc_id"), F.coalesce(part_of(docs[id_col], how) == how.held_out, F.lit(False)).alias("held_out"), text_of(docs, text).alias("text")
    )
    kind = dict(narrow.dtypes)["doc_id"]

    def run(batches):
        matcher = Matcher(weights, exceptions)
        for batch in batches:
            scores, hits = [], []
            for body in batch.column(2).to_pylist():
                found = matcher.evidence(body)
                z = sum(b * v for b, v in zip(beta, (*features(*found), 1.0)))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                hits.append(found[1])
            predicted = [int(s >= threshold) for s in scores]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(predicted, pa.int32()), pa.array(hits, pa.int64())],
                names=["doc_id", "held_out", "score", "predicted", "hits"],
            )

    return narrow.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, hits bigint")
