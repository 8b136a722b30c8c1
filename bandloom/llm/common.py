"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters that separate words.
WS = " \t\n\x0b\f\r"
WS_CLASS = "[ \\t-\\r]"
WORD = "[^ \\t-\\r]+"
#: Rows of a counted side that may be sent to every executor.
BROADCAST_ROWS = 50_000


def text_of(docs: DataFrame, text: str = "text") -> Column:
    """The text column, null as empty, whatever other columns there are."""
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def broadcast_within(side: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only for a side counted to be small; larger ones are joined by a shuffle.

    ``side`` should be a stored table, so that counting costs a scan of it.
    """
    return F.broadcast(side) if side.limit(max_rows + 1).count() <= max_rows else side


def words_of(text: Column) -> Column:
    """Array of the words; empty for a text without any."""
    trimmed = F.btrim(text, F.lit(WS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{WS_CLASS}+"))
