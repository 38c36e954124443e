"""Contiguous ranges of an integer key whose borders depend on the data alone, not on the cluster."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.scratch import Scratch

SAMPLE_PER_SHARD = 20
MAX_SHARDS = 20_000


def borders(df: DataFrame, key: str, rows_per_shard: int) -> list[int]:
    """Ascending lower ends of all ranges but the first.

    Borders are quantiles of the keys with the smallest hashes: at most ``MAX_SHARDS * SAMPLE_PER_SHARD`` of them,
    the same ones whatever the partitioning. They only deal out rows; no result depends on how even they are.
    """
    rows = df.count()
    shards = min(MAX_SHARDS, math.ceil(rows / rows_per_shard))
    if shards < 2:
        return []
    h = F.xxhash64(F.col(key))
    sample = (
        df.select(F.col(key).alias("k"), h.alias("h")).filter("k IS NOT NULL").orderBy("h", "k").limit(shards * SAMPLE_PER_SHARD)
    )
    keys = np.unique(np.array([r.k for r in sample.collect()], dtype=np.int64))
    if len(keys) == 0:
        return []
    picks = keys[(np.arange(1, shards) * len(keys)) // shards]
    return [int(k) for k in np.unique(picks)]


def with_shard(df: DataFrame, key: str, lower_ends: list[int], name: str = "shard") -> DataFrame:
    """``df`` plus the number of the range of ``key`` (nulls: the first range)."""
    if not lower_ends:
        return df.withColumn(name, F.lit(0))
    ends = np.array(lower_ends, dtype=np.int64)

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        known = keys.notna().to_numpy()
        out = np.zeros(len(keys), dtype=np.int32)
        out[known] = np.searchsorted(ends, keys[known].to_numpy(dtype=np.int64), side="right")
        return pd.Series(out)

    return df.withColumn(name, place(F.col(key)))


def dealt(df: DataFrame, by: list[str], shard: str = "shard") -> DataFrame:
    """Each shard whole in one task, its rows sorted by ``by``; a task may hold several shards, one after the other."""
    return df.repartition(F.col(shard)).sortWithinPartitions(shard, *by)


_INNER_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def with_position(df: DataFrame, by: list[Column], scratch: Scratch, table: str) -> DataFrame:
    """``df`` written in the order of ``by``, plus ``pos``: the place of each row, from 0.

    Ranges are numbered apart and shifted by the counts before them, one row a range; no window holds the table.
    """
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    held = scratch.write(placed, table).withColumn("_range", F.shiftright("_id", _INNER_BITS))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = held.groupBy(F.col("_range").alias("_r")).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inner = F.col("_id").bitwiseAND(F.lit((1 << _INNER_BITS) - 1))
    return held.join(ranges, F.col("_range") == F.col("_r")).withColumn("pos", F.col("_before") + inner).drop("_id", "_range", "_r", "_n", "_before")
