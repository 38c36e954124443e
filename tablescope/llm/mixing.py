"""Operator 9: mixing sources to target weights by capped water-filling.

Every source asks for its weight's share of the budget; a source that would have to repeat its text more than
``max_epochs`` times is clamped there, and what it leaves over is shared out again by weight until no source is
above its limit. A source's rate (target / size) is then met with whole repetitions of every document and, for
the fraction, one more repetition of documents in the order of seeded hashes, as long as they fit; smaller ones
then fill what is left. The hash borders of a source are found by counting words in ever finer bands of the hash, so no source is ever sorted or held in one task.

Null texts have size 0 and are taken as such, at most ``max_epochs`` times like others. The null source is a source of its own. Rows that agree in id and
text share a hash: they are taken together. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.ranges import with_position
from tablescope.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
BAND_BITS = 10  # bands that each step of the search splits a band into, as a power of two
HASH_BITS = 40


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, scratch: Scratch, weights: Sequence[int], budget: float, max_epochs: float) -> DataFrame:
    """``source, source_size, weight, target`` for one row per source; weights go round in code point order, null last."""
    ranked = with_position(sources, [F.col("source").asc_nulls_last()], scratch, "ranked")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % len(weights)).cast("int"))
    own = scratch.write(ranked.select("source", "source_size", weight.alias("weight")), "weighted")
    total = own.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * float(max_epochs)
    level = 0.0  # words for a unit of weight; it only rises, so clamped sources stay clamped
    while total:
        clamped = cap <= F.col("weight") * level
        left, open_weight = own.agg(
            F.lit(float(budget) * total) - F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0.0)), F.sum(F.when(~clamped, F.col("weight")))
        ).first()
        if not open_weight or left / open_weight <= level:
            break
        level = left / open_weight
    return own.withColumn("target", F.least(cap, F.col("weight") * level))


def mix(
    docs: DataFrame, scratch: Scratch, weights: Sequence[int] = (5, 2, 1), budget: float = 1.5, max_epochs: float = 2.0, seed: int = 20240601,
    doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: Sequence[str] = (),
) -> DataFrame:
    """``doc_id, source, size, source_size, target, repeats, taken`` and the columns in ``keep``, one row per document."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), F.col(f"`{text}`")), 64 - HASH_BITS)
    sized = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"), u.alias("u"),
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
    )
    # The sums need the narrow columns alone; texts wait until every document's share is known.
    rows = scratch.write(sized.select("source", "size", "u"), "sized")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = scratch.write(_with_border(rows, targets(sums, scratch, weights, budget, max_epochs), scratch), "plan")
    right = plan.select(F.col("source").alias("s"), "source_size", "target", "whole", "border", "second", "room")
    joined = sized.join(right, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    more = (F.col("u") < F.col("border")) | ((F.col("u") < F.col("second")) & (F.col("size") <= F.col("room")))
    # A document without words fits anywhere; it too stays within the limit.
    repeats = F.least(F.col("whole") + more.cast("long"), F.lit(math.ceil(max_epochs)).cast("long"))
    return joined.withColumn("repeats", repeats).select(
        "doc_id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"),
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
    )


def _with_border(rows: DataFrame, plan: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``whole``, ``border``, ``second`` and ``room``: who is repeated once more.

    Documents with a hash below ``border`` are, as many as fit in order. What is then still missing is less than the next
    document; of the others, those no larger than this ``room`` and below ``second`` fill it.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    state = plan.withColumn("whole", F.floor(rate + F.lit(1e-12)))
    state = state.withColumn("need", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    state = _bordered(rows, state, scratch, "first", F.lit(True)).withColumnsRenamed({"low": "border"})
    state = state.withColumn("room", F.col("need"))
    state = _bordered(rows, state, scratch, "second", (F.col("u") >= F.col("border")) & (F.col("size") <= F.col("room")))
    return state.withColumn("second", F.col("low")).drop("low", "need")


def _bordered(rows: DataFrame, state: DataFrame, scratch: Scratch, name: str, taking_part: Column) -> DataFrame:
    """``low``: the hash below which the documents that take part fit into ``need``, and the need that is left.

    Each step counts words per source in the bands of the one band that holds the border, map-side first, so at
    most ``2 ** BAND_BITS`` rows a source are shuffled however many documents it has.
    """
    state = state.withColumn("low", F.lit(0).cast("long"))
    shift = HASH_BITS
    while shift > 0:
        width = shift
        shift = max(0, shift - BAND_BITS)
        state = scratch.write(state, f"{name}{width}")
        ask = state.select(F.col("source").alias("s"), "low", "need", *[c for c in ("border", "room") if c in state.columns])
        inside = rows.join(ask, F.col("source").eqNullSafe(F.col("s"))).filter((F.shiftright("u", width) == F.shiftright("low", width)) & taking_part)
        bands = inside.groupBy("s", F.shiftright("u", shift).alias("band")).agg(F.sum("size").alias("words"), F.first("need").alias("need"))
        summed = bands.withColumn("upto", F.sum("words").over(Window.partitionBy("s").orderBy("band")))
        # The last band that fits whole; the border lies in the one after it.
        step = 1 << shift
        fits = F.col("upto") <= F.col("need")
        found = summed.groupBy("s").agg(
            F.max(F.when(fits, F.col("upto"))).alias("used"), F.min(F.when(~fits, F.col("band"))).alias("next"), F.max("band").alias("top")
        )
        state = (
            state.join(found, F.col("source").eqNullSafe(F.col("s")), "left")
            .withColumn("low", F.when(F.col("next").isNotNull(), F.col("next") * step).when(F.col("top").isNotNull(), (F.col("top") + 1) * step).otherwise(F.col("low")))
            .withColumn("need", F.col("need") - F.coalesce("used", F.lit(0)))
            .drop("s", "used", "next", "top")
        )
    return scratch.write(state, f"{name}0")
