"""Global order without a single-task window.

Rows are range-partitioned on ``keys + order``, sorted inside each partition and stamped with a
block number and a place in the block, then checkpointed so the stamps cannot move. What a global
window would do then splits into work inside blocks plus a summary of one row per (block, key),
whose size is the number of partitions plus the number of keys. A key that holds a third of all
rows simply spans many blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.plans.materialize import materialize, settled

BLOCK, SEQ = "_block", "_seq"
_SEQ_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


FEW_ROWS = 200_000


def counted(df: DataFrame) -> tuple[DataFrame, bool]:
    """``df`` written as a table, and whether it has at most ``FEW_ROWS`` rows.

    So few rows need no blocks: one sort does, and gives the same. The functions below are told so by ``few``.
    """
    table = settled(df)
    return table, table.count() <= FEW_ROWS


def _plain(keys: Sequence[str], order: Sequence[str | Column]):
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)


def ordered_blocks(df: DataFrame, order: Sequence[str | Column], keys: Sequence[str] = ()) -> DataFrame:
    """``df`` plus ``_block`` and ``_seq``; blocks and places follow ``keys`` then ``order``."""
    by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_mid", F.monotonically_increasing_id())
    return (
        materialize(placed)
        .withColumn(BLOCK, F.shiftright("_mid", _SEQ_BITS))
        .withColumn(SEQ, F.col("_mid").bitwiseAND(F.lit((1 << _SEQ_BITS) - 1)))
        .drop("_mid")
    )


def _key_window(keys: Sequence[str]):
    # Over the per-block summary only: one row per (block, key).
    spec = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return spec.orderBy(BLOCK)


def block_summary(blocks: DataFrame, keys: Sequence[str], weight: Column) -> DataFrame:
    """One row per (block, key): first place, weight before the block, weight in it, weight of the key."""
    w = _key_window(keys)
    return (
        blocks.groupBy(BLOCK, *keys)
        .agg(F.min(SEQ).alias("_b_first"), F.sum(weight).alias("_b_weight"))
        .withColumn("_b_before", F.coalesce(F.sum("_b_weight").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn(
            "_b_total",
            F.sum("_b_weight").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        )
    )


def join_summary(blocks: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bring the summary back to the rows: broadcast while small, else joined on (block, key), at most one block a key."""
    names = {k: f"_s_{k}" for k in (BLOCK, *keys)}
    right = settled(summary)
    for old, new in names.items():
        right = right.withColumnRenamed(old, new)
    condition = F.lit(True)
    for old, new in names.items():
        condition = condition & F.col(old).eqNullSafe(F.col(new))
    return blocks.join(right, condition).drop(*names.values())


def with_position(
    df: DataFrame, order: Sequence[str | Column], keys: Sequence[str] = (), name: str = "position", total: str | None = None
) -> DataFrame:
    """Zero-based place of every row in ``order``, counted separately for each key."""
    blocks = ordered_blocks(df, order, keys)
    summary = block_summary(blocks, keys, F.lit(1))
    out = join_summary(blocks, summary, keys).withColumn(name, F.col("_b_before") + F.col(SEQ) - F.col("_b_first"))
    if total:
        out = out.withColumn(total, F.col("_b_total"))
    return out.drop(BLOCK, SEQ, "_b_first", "_b_before", "_b_weight", "_b_total")


def with_weight_below(
    df: DataFrame, order: Sequence[str | Column], weight: str, keys: Sequence[str] = (), name: str = "weight_below"
) -> DataFrame:
    """Sum of ``weight`` over the earlier rows of the same key, in ``order``."""
    blocks = ordered_blocks(df, order, keys)
    summary = block_summary(blocks, keys, F.col(weight))
    inside = Window.partitionBy(BLOCK, *keys).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, -1)
    out = join_summary(blocks, summary, keys).withColumn(
        name, F.col("_b_before") + F.coalesce(F.sum(weight).over(inside), F.lit(0))
    )
    return out.drop(BLOCK, SEQ, "_b_first", "_b_before", "_b_weight", "_b_total")


def with_weights_below(
    df: DataFrame, order: Sequence[str | Column], weights: Mapping[str, str], keys: Sequence[str] = (), totals: Mapping[str, str] | None = None,
    few: bool = False,
) -> DataFrame:
    """Several running sums along one order: for ``{weight: name}`` the sum of each weight over the earlier rows of the same key.

    ``totals`` (``{weight: name}``) adds the sum of a weight over all rows of the key.
    """
    if few:
        running, whole = _plain(keys, order).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*(keys or [F.lit(0)]))
        sums = {name: F.coalesce(F.sum(w).over(running), F.lit(0)) for w, name in weights.items()}
        return df.withColumns(sums | {name: F.sum(w).over(whole) for w, name in (totals or {}).items()})
    blocks = ordered_blocks(df, order, keys)
    spec = _key_window(keys)
    before, whole = spec.rowsBetween(Window.unboundedPreceding, -1), spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals or {}
    summed = blocks.groupBy(BLOCK, *keys).agg(*[F.sum(w).alias(f"_w{i}") for i, w in enumerate(weights)])
    summary = summed.select(
        BLOCK, *keys, *[F.coalesce(F.sum(f"_w{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(weights))],
        *[F.sum(f"_w{list(weights).index(w)}").over(whole).alias(name) for w, name in totals.items()],
    )
    inside = Window.partitionBy(BLOCK, *keys).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, -1)
    out = join_summary(blocks, summary, keys).withColumns(
        {name: F.col(f"_b{i}") + F.coalesce(F.sum(w).over(inside), F.lit(0)) for i, (w, name) in enumerate(weights.items())}
    )
    return out.drop(BLOCK, SEQ, *[f"_b{i}" for i in range(len(weights))])


def with_previous(
    df: DataFrame, order: Sequence[str | Column], value: str, keys: Sequence[str] = (), name: str = "previous", few: bool = False
) -> DataFrame:
    """``value`` of the row just before, in ``order`` and within the same key (null for the first)."""
    if few:
        return df.withColumn(name, F.lag(value).over(_plain(keys, order)))
    blocks = ordered_blocks(df, order, keys)
    summary = (
        blocks.groupBy(BLOCK, *keys)
        .agg(F.max_by(value, SEQ).alias("_last"))
        .withColumn("_carried", F.lag("_last").over(_key_window(keys)))
        .drop("_last")
    )
    inside = Window.partitionBy(BLOCK, *keys).orderBy(SEQ)
    out = join_summary(blocks, summary, keys).withColumn(
        name, F.coalesce(F.lag(value).over(inside), F.col("_carried"))
    )
    return out.drop(BLOCK, SEQ, "_carried")


def first_n(df: DataFrame, order: Sequence[str | Column], n: int, keys: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows per key for an ``n`` too large to sort in one task."""
    return with_position(df, order, keys, name="_pos").filter(F.col("_pos") < n).drop("_pos")
