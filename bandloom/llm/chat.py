"""Chat formatting by quotation linking.

Quoted lines carry one ``>`` per level. What a message quotes and what it says
itself are hashed in normalised units (lines, paragraphs, the whole). The first
message of a conversation that says a unit is its original: one row per unit after
a combined aggregate, so a phrase everybody repeats costs no more than another.
Quotes meet originals in one join; the best original is the parent. Threads follow
by pointer doubling, in rounds that grow with the logarithm of the longest chain.
"""

from __future__ import annotations

import re
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom.session import stored

#: Every unit that is not empty counts; length ranks originals that compete.
MIN_CHARS = 1
_MARK = re.compile(r"[ \t]{0,3}>")
_SAID = re.compile(r"(?:^|\s)(?:wrote|schrieb|escribió|a écrit)\s*:\s*$", re.IGNORECASE)


def quote_level(line: str) -> tuple[int, str]:
    """Level of a line and what stands behind its marks: ``> > a`` and ``>>a`` are level 2."""
    level = 0
    while m := _MARK.match(line):
        level, line = level + 1, line[m.end() :]
    return level, line[1:] if level and line.startswith(" ") else line


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def _units(lines: list[str], least: int) -> dict[bytes, int]:
    """Digest and length of each line, each paragraph and the whole."""
    found: dict[bytes, int] = {}
    paragraph: list[str] = []
    pieces = [*lines, " ".join(lines)]
    for line in [*lines, ""]:
        if line.strip():
            paragraph.append(line)
        else:
            pieces.append(" ".join(paragraph))
            paragraph = []
    for piece in pieces:
        norm = normalised(piece)
        if len(norm) >= least:
            found[md5(norm.encode()).digest()] = len(norm)
    return found


def parse(text: str, least: int = MIN_CHARS) -> tuple[str, int, dict[bytes, int], list[tuple[int, bytes, int]]]:
    """Text without quotes, quoted lines, own units, and quoted units with their level.

    A line that only says who wrote goes with the quote right after it.
    """
    own: list[str] = []
    quoted, run, level_of_run = 0, [], 0
    quotes: dict[tuple[int, bytes], int] = {}

    def close():
        for digest, size in _units(run, least).items():
            quotes[level_of_run, digest] = size

    for line in text.split("\n"):
        level, rest = quote_level(line)
        if level != level_of_run and run:
            close()
            run = []
        level_of_run = level
        if level:
            if not run and own and _SAID.search(own[-1]):
                own.pop()
            run.append(rest)
            quoted += 1
        else:
            own.append(line)
    if run:
        close()
    body = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n") if quoted else text
    return body, quoted, _units(own, least), [(level, digest, size) for (level, digest), size in quotes.items()]


def messages(conversations: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """Parsed messages; a null text is an empty one."""
    narrow = conversations.select("conv_id", "turn", "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kinds = dict(narrow.dtypes)
    unit = pa.list_(pa.binary())
    quote = pa.list_(pa.struct([("level", pa.int32()), ("unit", pa.binary()), ("size", pa.int32())]))

    def run(batches):
        for batch in batches:
            done = [parse(t, least) for t in batch.column(3).to_pylist()]
            quotes = [[{"level": a, "unit": b, "size": c} for a, b, c in d[3]] for d in done]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3], pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
                    pa.array([list(d[2]) for d in done], unit), pa.array(quotes, quote),
                ],
                names=["conv_id", "turn", "role", "text", "n_quoted_lines", "own", "quotes"],
            )

    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role {kinds['role']}, text string, n_quoted_lines bigint"
    return narrow.mapInArrow(run, f"{schema}, own array<binary>, quotes array<struct<level: int, unit: binary, size: int>>")


def parents(parsed: DataFrame) -> DataFrame:
    """``conv_id, turn, parent_turn, n_linked``: for each message with a place, whom it answers.

    Of the originals it quotes, the one quoted at the lowest level, then with most
    characters, then the latest. A message without a linked quote answers the turn
    before it, if there is one.
    """
    placed = parsed.filter("conv_id is not null and turn is not null")
    first = placed.select("conv_id", "turn", F.explode("own").alias("unit")).groupBy("conv_id", "unit").agg(F.min("turn").alias("original"))
    quoted = placed.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*")
    linked = quoted.join(first, ["conv_id", "unit"]).filter("original < turn")
    votes = linked.groupBy("conv_id", "turn", "original").agg(F.min("level").alias("level"), F.sum("size").alias("chars"), F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("conv_id", "turn").agg(
        F.max(F.struct((-F.col("level")).alias("near"), "chars", "original"))["original"].alias("quoted_turn"), F.sum("n").alias("n_linked")
    )
    turns = placed.select("conv_id", "turn").distinct()
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("previous"))
    out = turns.join(before, ["conv_id", "turn"], "left").join(best, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", F.coalesce("quoted_turn", "previous").alias("parent_turn"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))


def threads(links: DataFrame) -> DataFrame:
    """Add ``root_turn`` and ``depth``: jump from parent to parent's parent until all have arrived.

    A round moves only the messages that have not; a chain of n takes about log n rounds.
    """
    is_root = F.col("parent_turn").isNull()
    state = links.select("*", F.coalesce("parent_turn", "turn").alias("root_turn"), (~is_root).cast("int").alias("depth"), is_root.alias("done"))
    while True:
        state = stored(state, "chat-threads")
        open_ = state.filter("not done")
        if open_.isEmpty():
            return state.drop("done")
        up = state.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("above"), F.col("depth").alias("steps"), F.col("done").alias("there"))
        moved = open_.join(up, ["conv_id", "root_turn"]).select(
            *links.columns, F.col("above").alias("root_turn"), (F.col("depth") + F.col("steps")).alias("depth"), F.col("there").alias("done")
        )
        state = state.filter("done").unionByName(moved)


def conversations_without_quotes(conversations: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """Every message with ``parent_turn, root_turn, depth``, counts and its text without quotes.

    Ordered by ``conv_id, root_turn, turn`` the rows of a conversation read thread by
    thread, each answer after what it answers. A message without conversation or
    turn is linked with nothing. Messages that share both (repeated rows) are all
    returned and share one place; what any of them says or quotes counts for it. A
    null or empty text stays, empty. Quotes of something nobody said before are
    removed and not linked. An empty table gives an empty result. Other columns are
    not looked at.
    """
    parsed = stored(messages(conversations, least), "chat-messages")
    placed = threads(parents(parsed))
    out = parsed.drop("own", "quotes").join(placed, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
        "n_quoted_lines", F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), "text",
    )
