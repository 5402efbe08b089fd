"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target size: its share of the mix, at most ``most`` times what
it has, the excess shared again by weight. Within a source each document is wanted
``e`` times, in proportion to its liking and at most ``most`` times, so that the
wanted words add up to the target. The whole part of ``e`` is allocated as certain
copies; the rest is an inclusion probability. For it, each document gets a random
rank: the odds of a fixed uniform draw over the odds of inclusion. Documents are
taken in order of rank as long as they fit what is left of the target, and of the
first that doesn't, as many words as are missing.

How far down the ranks a source goes is found from sums by rank interval and, in
the one interval where the sum passes the target, by single rank; no task sees all
documents of a source.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.storage import persist_table
from lodestone.llm.words import NON_SPACE, map_texts, split_words

#: Rank intervals by source.
INTERVALS = 4096
#: Steps of liking in a doubling; likings count rounded to a step, so that a source has few of them.
STEPS = 8
#: Tables of sources, or of sources and steps, up to this number of rows are sent to every
#: task; larger ones are joined by shuffle.
BROADCAST_SOURCES = 100_000


def word_sizes(docs: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """``columns`` and ``size``: the number of words (runs of anything but ASCII white space)."""
    kinds = {c: docs.schema[c].dataType.simpleString() for c in columns}
    names = [f"c{i}" for i in range(len(columns))]

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        size = pa.array(split_words(part.column("text"), NON_SPACE).counts)
        return pa.RecordBatch.from_arrays([*(part.column(n) for n in names), size], [*names, "size"])

    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)), F.col(text).alias("text"))
    out = map_texts(rows, kernel, ", ".join([f"{n} {kinds[c]}" for c, n in zip(columns, names, strict=True)] + ["size long"]))
    return out.select(*(F.col(n).alias(c) for c, n in zip(columns, names, strict=True)), "size")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row by source: source, source_size, target.

    ``weights`` repeat over the sources in code point order, null last. All targets
    add up to ``share`` of all sizes (or ``most`` of them, if less). The table of sources
    is ordered in one task.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(order) - 1) % len(weights) + 1)
    by = by.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    # In order of cap by weight, the first k sources are at their cap; the rest divide what is left.
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below = ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    spare = share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    level = spare / F.sum("weight").over(ratio.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", level).withColumn("free", F.col("cap") >= F.col("level") * F.col("weight"))
    whole = ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("unit", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(whole))
    target = F.when(F.col("unit").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("unit") * F.col("weight")))
    return by.select("source", "source_size", target.alias("target"))


def _source_key() -> Column:
    """The source as text that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))


def _sent(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table


def _wanted(rows: DataFrame, weights: tuple[float, ...], share: float, most: float) -> tuple[DataFrame, DataFrame]:
    """(source_key, step, copies, chance) and (source_key, source_size, target, room).

    In a source's steps, from the most liked on, the first k are wanted ``most`` times and
    the others in proportion to their liking.
    """
    steps = persist_table(rows.groupBy("source", "source_key", "step").agg(F.sum("size").alias("size")), "mix-steps")
    targets = source_targets(steps, weights, share, most).withColumn("source_key", _source_key())
    by = steps.join(targets.select("source_key", "source_size", "target"), "source_key").withColumn("liking", F.pow(F.lit(2.0), F.col("step") / STEPS))
    w = Window.partitionBy("source_key").orderBy(F.col("step").desc())
    above = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("size") * F.col("liking")).over(w.rowsBetween(0, Window.unboundedFollowing))
    unit = F.when(rest > 0, (F.col("target") - most * above) / rest)
    by = by.withColumn("unit", F.when(unit * F.col("liking") <= most, unit))
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    times = F.coalesce(F.least(F.first("unit", ignorenulls=True).over(every) * F.col("liking"), F.lit(most)), F.lit(most))
    by = by.withColumn("times", times).withColumn("copies", F.floor("times").cast("long"))
    by = persist_table(by.withColumn("chance", F.col("times") - F.col("copies")), "mix-wanted")
    room = F.greatest(F.round(F.first("target")).cast("long") - F.sum(F.col("copies") * F.col("size")), F.lit(0))
    state = by.groupBy("source_key").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), room.alias("room"))
    return by.select("source_key", "step", "copies", "chance"), persist_table(state, "mix-state")


def _stops(ranked: DataFrame, state: DataFrame) -> DataFrame:
    """(source_key, stop, left, tied): the rank that no longer fits, words left there, and the words of that rank.

    A source that fits whole has none.
    """
    rows = ranked.filter("rank < 2 AND size > 0").withColumn("interval", F.floor(F.col("rank") * INTERVALS))
    running = Window.partitionBy("source_key").orderBy("interval").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("source_key", "interval").agg(F.sum("size").alias("sum")).join(state.select("source_key", "room"), "source_key")
    sums = sums.withColumn("upto", F.sum("sum").over(running))
    cross = F.min(F.when(F.col("upto") > F.col("room"), F.struct("interval", (F.col("upto") - F.col("sum")).alias("before"), "room")))
    cross = persist_table(sums.groupBy("source_key").agg(cross.alias("cross")).filter("cross is not null").select("source_key", "cross.*"), "mix-interval")
    single = rows.join(_sent(cross), ["source_key", "interval"]).groupBy("source_key", "rank").agg(F.sum("size").alias("tied"), F.first("before").alias("before"), F.first("room").alias("room"))
    by_rank = Window.partitionBy("source_key").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    single = single.withColumn("upto", F.col("before") + F.sum("tied").over(by_rank)).filter("upto > room")
    stop = F.min(F.struct("rank", (F.col("room") - F.col("upto") + F.col("tied")).alias("left"), "tied"))
    return persist_table(single.groupBy("source_key").agg(stop.alias("s")).select("source_key", F.col("s.rank").alias("stop"), "s.left", "s.tied"), "mix-stops")


def mix_sources(docs: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 1, key: str = "doc_id", source: str = "source", text: str = "text", preference: str | None = None) -> DataFrame:
    """What a mix takes of each document; one row for each row of ``docs``.

    ``preference`` names a column of likings, positive numbers that documents are wanted in
    proportion to within a source (null counts as 1). Without it the liking is the square
    root of the size: between equal chances, and chances by size, which vary the sum least.

    Each source's taken words are its target, rounded. A null text has size 0 and takes
    nothing; a null source is a source, the last in order; an empty table gives none. Rows
    that repeat the same key and size share one draw: where the target ends among them,
    they share what is missing, rounded down. Keys may be of any type and null. Reruns take
    the same rows. Other columns are not read. Returns key, size, source_size, target,
    copies (whole ones), part (words of one more, its first ones), taken (copies times
    size, and part).
    """
    columns = [key, source, *([preference] if preference else [])]
    rows = word_sizes(docs, *dict.fromkeys(columns), text=text)
    liking = F.coalesce(F.col(preference).cast("double"), F.lit(1.0)) if preference else F.sqrt(F.greatest("size", F.lit(1)).cast("double"))
    step = F.round(F.log2(F.greatest(F.least(liking, F.lit(1e15)), F.lit(1e-15))) * STEPS).cast("int")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key), F.col("size")), 11)
    rows = rows.select(F.col(key).alias("key"), F.col(source).alias("source"), "size", step.alias("step"), ((draw + 0.5) / float(1 << 53)).alias("draw"))
    rows = persist_table(rows.withColumn("source_key", _source_key()), "mix-sizes")
    wanted, state = _wanted(rows, weights, share, most)
    ranked = rows.join(_sent(wanted), ["source_key", "step"])
    chance = F.least(F.col("chance"), F.lit(1 - 1e-12))
    odds = (F.col("draw") / (1 - F.col("draw"))) / (chance / (1 - chance))
    rank = F.when(F.col("chance") > 0, odds / (1 + odds)).otherwise(2.0)
    ranked = persist_table(ranked.select("key", "source_key", "size", "copies", rank.alias("rank")), "mix-ranks")
    limits = persist_table(state.select("source_key", "source_size", "target").join(_stops(ranked, state), "source_key", "left"), "mix-limits")
    out = ranked.join(_sent(limits), "source_key")
    inside = (F.col("rank") < 2) & (F.col("stop").isNull() | (F.col("rank") < F.col("stop")))
    copies = F.col("copies") + inside.cast("long")
    share_of = F.when(F.col("rank") == F.col("stop"), F.floor(F.col("left") * F.col("size") / F.col("tied"))).otherwise(0).cast("long")
    out = out.select(F.col("key").alias(key), "size", "source_size", "target", copies.alias("copies"), share_of.alias("part"))
    return out.withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))
