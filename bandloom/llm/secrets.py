"""Secret scans through a trigram index.

Each rule's pattern is parsed, and what every match must contain becomes a Boolean
query over trigrams. Documents are indexed in blocks: one posting bitmap per
trigram and block, over ASCII-lower-cased text. Postings are intersected and united
as the query says, and only the candidates are matched. A rule without mandatory
trigrams has the query TRUE and is matched against every text.

The index lives in the blocks of the scan: nothing is shuffled, and a lost task
repeats alone. ``postings`` gives it as a table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom.llm.common import text_of

TRUE: tuple = ("and",)
#: Most strings followed while a pattern is taken apart; beyond it a part is no condition.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``group`` must have ``least`` code points, ``fold``: letters in either case."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    fold: bool = False
    compiled: re.Pattern = field(init=False, compare=False, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "compiled", re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.fold else 0)))


# The base kinds.
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # All maximal runs are matches of [0-9a-f]+; shorter ones are dropped either way.
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{4,64}@[A-Za-z0-9.-]+"),
)


def _either(parts: list[tuple]) -> tuple:
    if any(p == TRUE for p in parts):
        return TRUE
    return parts[0] if len(set(parts)) == 1 else ("or", *dict.fromkeys(parts))


def _all(parts: list[tuple]) -> tuple:
    flat = [q for p in parts for q in (p[1:] if p[0] == "and" else (p,))]
    flat = list(dict.fromkeys(flat))
    return flat[0] if len(flat) == 1 else ("and", *flat)


def _of_string(s: str) -> tuple:
    return _all([("tri", s[i : i + 3]) for i in range(len(s) - 2)]) if len(s) >= 3 else TRUE


def trigram_query(pattern: str) -> tuple:
    """What every match contains: ``("tri", xyz)``, ``("and", ...)``, ``("or", ...)``; ``TRUE`` is the empty "and".

    Runs of exact parts are followed as a set of strings; where a part is open
    (a class, a repetition), the strings so far give trigrams and a new run begins.
    """

    def walk(items) -> tuple[list[tuple], set[str]]:
        """Conditions so far, and the strings that the end of the run can be."""
        found: list[tuple] = []
        run: set[str] = {""}

        def close():
            nonlocal run
            found.append(_either([_of_string(s) for s in sorted(run)]))
            run = {""}

        def extend(strings: set[str]):
            nonlocal run
            if len(run) * len(strings) > MAX_STRINGS:
                close()
            run = {a + b for a in run for b in strings}

        for op, arg in items:
            if op is sre.LITERAL:
                extend({chr(arg).lower() if arg < 128 else chr(arg)})
            elif op is sre.IN and all(k is sre.LITERAL for k, _ in arg) and len(arg) <= 8:
                extend({chr(c).lower() if c < 128 else chr(c) for _, c in arg})
            elif op is sre.SUBPATTERN or op is sre.BRANCH:
                branches = [arg[3]] if op is sre.SUBPATTERN else arg[1]
                done = [walk(b) for b in branches]
                if all(not conditions for conditions, _ in done) and sum(len(strings) for _, strings in done) <= MAX_STRINGS:
                    extend(set().union(*[strings for _, strings in done]))
                else:
                    close()
                    found.append(_either([_all([*c, _either([_of_string(s) for s in sorted(r)])]) for c, r in done]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
                low, high, inner = arg
                conditions, strings = walk(inner)
                if low == 0 and high == 1 and not conditions and len(strings) < MAX_STRINGS:
                    extend({"", *strings})
                else:
                    close()
                    if low:
                        found.append(_all([*conditions, _either([_of_string(s) for s in sorted(strings)])]))
            elif op is sre.AT:
                continue
            else:
                close()
        return [f for f in found if f != TRUE], run if not found or run != {""} else {""}

    conditions, run = walk(parser.parse(pattern))
    return _all([*conditions, _either([_of_string(s) for s in sorted(run)])])


def trigrams_of(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "tri" else set().union(*[trigrams_of(q) for q in query[1:]])


class BlockIndex:
    """Postings of one block of texts, for the trigrams that queries ask for."""

    def __init__(self, texts: list[str], trigrams: set[str]):
        self.size = len(texts)
        # As bytes: lower() changes A-Z only, and a trigram's bytes occur only where its characters do.
        folded = [t.encode().lower() for t in texts]
        self.postings = {t: np.fromiter((b in x for x in folded), bool, self.size) for t in trigrams for b in (t.encode(),)}

    def find(self, query: tuple) -> np.ndarray:
        if query[0] == "tri":
            return self.postings[query[1]]
        out = np.full(self.size, query[0] == "and")
        for part in query[1:]:
            out = out & self.find(part) if query[0] == "and" else out | self.find(part)
        return out


def _blocks(rules):
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    return queries, set().union(*[trigrams_of(q) for q in queries.values()])


def spans_of(rule: Rule, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in rule.compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans``: per row the ``kind, start, end`` of all matches, by start, then as the rules are listed.

    Offsets are code points, ends exclusive. Matches of one kind do not overlap;
    those of different kinds may. A null or empty text has no spans. Rows,
    repeated ones too, are independent; identifiers may be null. An empty table
    gives an empty result. Other columns are not looked at.
    """
    narrow = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text).alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        queries, trigrams = _blocks(rules)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            index, found = BlockIndex(texts, trigrams), [[] for _ in texts]
            for order, rule in enumerate(rules):
                for i in np.flatnonzero(index.find(queries[rule.kind])):
                    found[i] += [(start, order, end) for start, end in spans_of(rule, texts[i])]
            spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(x)] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span)], names=["doc_id", "spans"])

    kind = dict(narrow.dtypes)["doc_id"]
    return narrow.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: int, end: int>>")


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The index as a table: per block of rows and trigram of the rules, the identifiers that hold it."""
    narrow = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text).alias("text"))
    kind = dict(narrow.dtypes)["doc_id"]

    def run(batches):
        trigrams = sorted(_blocks(rules)[1])
        for batch in batches:
            index = BlockIndex(batch.column(1).to_pylist(), set(trigrams))
            ids = [batch.column(0).take(pa.array(np.flatnonzero(index.postings[t]))).to_pylist() for t in trigrams]
            yield pa.RecordBatch.from_arrays([pa.array(trigrams), pa.array(ids, pa.list_(batch.schema.field(0).type))], names=["trigram", "doc_ids"])

    return narrow.mapInArrow(run, f"trigram string, doc_ids array<{kind}>").filter(F.size("doc_ids") > 0)
