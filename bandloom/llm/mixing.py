"""Mixing sources to target weights by capped water-filling and seeded repetition.

Only three numbers go through the driver per round. Whole repetitions are
arithmetic; the fractional one takes a source's documents in seeded hash order up
to the missing words. The order is cut at equal steps of the hash, so that no
source is ever ordered as a whole: words are summed per step, and only the step in
which the target is met is ordered, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandloom.llm.common import WORD, broadcast_within, text_of
from bandloom.session import stored

MAX_EPOCHS = 3
SEED = "mix-1"
#: Rows of a source that one step of the hash order holds on average.
STEP_ROWS = 2_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def weigh(sizes: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, 3, repeating, over the sources by code point, null last; one row per source, so one window is enough."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sizes.withColumn("weight", ((place - 1) % cycle + 1).cast("bigint"))


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target``: shares of all words by ``weight``, none above ``max_epochs`` times ``source_size``.

    Sources above their cap are clamped and what they leave is shared again by
    weight, until none is above. Shares only grow from round to round, so a
    clamped source stays clamped. Without any word all targets are 0.
    """
    sources = stored(sources, "mix-sources")
    cap = F.col("source_size") * max_epochs
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    held, clamped = (0, 0), None
    while clamped != held:
        clamped = held
        rest, open_weight = (total or 0) - clamped[0], (weights or 0) - clamped[1]
        above = (F.lit(rest).cast("decimal(38,0)") * F.col("weight") > cap * F.lit(open_weight)) if open_weight > 0 else F.lit(False)
        found = sources.filter(above).agg(F.sum(cap), F.sum("weight")).first()
        held = (found[0] or 0, found[1] or 0) if open_weight > 0 else clamped
    if open_weight > 0:
        share = F.lit(rest).cast("double") * F.col("weight") / F.lit(open_weight).cast("double")
    else:
        share = cap.cast("double")
    return sources.withColumn("target", F.least(cap.cast("double"), share))


def plan(rows: DataFrame, targets: DataFrame, seed: str = SEED, step_rows: int = STEP_ROWS) -> DataFrame:
    """Per source: ``target, epochs`` (whole repetitions) and the last hash order (``cut``, ``cut_size``) taken once more.

    ``rows`` has ``source, size, at`` (hash order in [0, 1) as a hex digest). A
    document is taken once more if the words before it, plus half its own, are
    within what is missing, so a source misses its target by half a document at most.
    """
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    t = targets.join(counts, targets.source.eqNullSafe(counts.source)).select(targets["*"], "n_rows")
    t = t.withColumns(
        {
            "epochs": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"),
            "steps": F.ceil(F.col("n_rows") / step_rows).cast("bigint"),
        }
    )
    t = stored(t.withColumn("missing", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-plan")
    side = broadcast_within(t.select(F.col("source").alias("t_source"), "steps", "missing"))
    placed = rows.join(side, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    # The first 13 hex digits are 52 bits: exact in a double.
    placed = placed.withColumn("step", F.floor(F.conv(F.substring("at", 1, 13), 16, 10).cast("bigint") / F.lit(2.0**52) * F.col("steps")))
    sums = placed.groupBy("source", "step").agg(F.sum("size").alias("words"), F.first("missing").alias("missing"))
    before = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    edge = sums.filter("before <= missing").groupBy("source").agg(F.max(F.struct("step", "before")).alias("e"))
    edge = stored(edge.select(F.col("source").alias("e_source"), F.col("e.step").alias("e_step"), F.col("e.before").alias("before")), "mix-edge")
    near = placed.join(broadcast_within(edge), F.col("source").eqNullSafe(F.col("e_source")) & (F.col("step") == F.col("e_step")))
    # Rows alike in order and size are taken together.
    same = near.groupBy("source", "at", "size").agg(F.count(F.lit(1)).alias("n"), F.first("before").alias("before"), F.first("missing").alias("missing"))
    upto = Window.partitionBy("source").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("size") * F.col("n")
    same = same.withColumn("ahead", F.col("before") + F.coalesce(F.sum(words).over(upto), F.lit(0)))
    last = same.filter(F.col("ahead") + words / 2.0 < F.col("missing")).groupBy("source").agg(F.max(F.struct("at", "size")).alias("last"))
    last = last.select(F.col("source").alias("l_source"), F.col("last.at").alias("cut"), F.col("last.size").alias("cut_size"))
    t = t.join(edge, F.col("source").eqNullSafe(F.col("e_source")), "left").join(last, F.col("source").eqNullSafe(F.col("l_source")), "left")
    return t.select(
        "source", "source_size", "target", "epochs", "steps",
        F.coalesce("e_step", F.lit(-1)).alias("edge"), F.coalesce("cut", F.lit("")).alias("cut"), F.coalesce("cut_size", F.lit(-1)).alias("cut_size"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """All rows and columns of ``docs`` with ``mix_size, mix_source_size, mix_target, mix_times`` (how often a row is taken).

    Size is the number of words, 0 for a null or empty text. A null source is one
    more source, ordered last. Rows without words have no influence and are taken
    as often as their source's whole repetitions say. Equal seeds give equal mixes.
    Rows repeated as a whole share one place in the order and are taken together.
    An empty table gives an empty result.
    """
    at = F.md5(F.concat_ws(":", F.lit(seed), docs[id_col].cast("string")))
    size = word_count(text_of(docs, text))
    narrow = docs.select(docs[source].cast("string").alias("source"), size.alias("size"), at.alias("at"))
    rows = stored(narrow, "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    decided = stored(plan(rows, water_fill(weigh(sizes), max_epochs), seed), "mix-decided")
    p = {c: F.col(f"__mix_{c}") for c in decided.columns}
    decided = decided.select(*[F.col(c).alias(f"__mix_{c}") for c in decided.columns])
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_times")
    out = docs.withColumns({"mix_size": size, "__mix_at": at}).join(broadcast_within(decided), docs[source].cast("string").eqNullSafe(p["source"]))
    step = F.floor(F.conv(F.substring("__mix_at", 1, 13), 16, 10).cast("bigint") / F.lit(2.0**52) * p["steps"])
    inside = (F.col("__mix_at") < p["cut"]) | ((F.col("__mix_at") == p["cut"]) & (F.col("mix_size") <= p["cut_size"]))
    once_more = (step < p["edge"]) | ((step == p["edge"]) & inside)
    return out.select(
        *[f"`{c}`" for c in docs.columns], "mix_size", p["source_size"].alias("mix_source_size"), p["target"].alias("mix_target"),
        (p["epochs"] + once_more.cast("bigint")).alias("mix_times"),
    )


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of ``docs``."""
    names = [f"`{c}`" for c in docs.columns]
    taken = mix(docs, **how).filter("mix_times > 0")
    return taken.select(*names, F.explode(F.sequence(F.lit(1), F.col("mix_times"))).alias("mix_copy")).select(*names)
