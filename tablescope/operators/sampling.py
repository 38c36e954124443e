"""Representative samples, repeatable for a seed and independent of how the data is partitioned."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.clean import epoch_ms, is_temporal
from tablescope.operators.categorical import MISSING_LABEL, label, value_counts
from tablescope.plans.materialize import materialize, settled
from tablescope.plans.ordered import FEW_ROWS, first_n, with_position, with_weights_below
from tablescope.plans.small import small_table
from tablescope.plans.wide import quoted, row_hash

SEED = 42
MAX_FIELDS = 4


def mix(seed: int, *columns: str | Column) -> Column:
    """Well-spread 64-bit number of a row key."""
    return F.xxhash64(F.lit(seed), *[F.col(quoted(c)) if isinstance(c, str) else c for c in columns])


def uniform_sample(df: DataFrame, n: int, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """Exactly ``n`` rows (or all): those with the smallest hash of their key.

    A threshold on the hash first lets through slightly more than ``n`` rows; only these are put in order.
    """
    total = df.count()
    if total <= n:
        return df
    unit = (F.shiftrightunsigned(mix(seed, *key), 11) / F.lit(float(1 << 53))).cast("double")
    chosen = df.withColumn("_u", unit)
    generous = (n + 8.0 * math.sqrt(n) + 16.0) / total
    candidates = chosen.filter(F.col("_u") < generous)
    if generous < 1.0 and candidates.count() < n:  # practically never: keeps the size exact all the same
        candidates = chosen
    return first_n(candidates, ["_u", *[F.col(quoted(c)) for c in key]], n).drop("_u")


def allocate_shares(sizes: DataFrame, limit: int, size: str = "size", keys: Sequence[str] = ("stratum",)) -> DataFrame:
    """Largest-remainder split of ``limit`` places over strata, never more than a stratum holds.

    ``sizes`` has one row per stratum; remainders are ranked in place, so many strata are fine.
    """
    total = sizes.agg(F.sum(size)).first()[0] or 0  # one number
    exact = f"CAST({limit} AS DECIMAL(20,0)) * CAST(`{size}` AS DECIMAL(18,0))"
    base = sizes.withColumn("_base", F.expr(f"{exact} div {max(total, 1)}")).withColumn(
        "_rest", F.expr(f"{exact} % {max(total, 1)}")
    )
    left = limit - (base.agg(F.sum("_base")).first()[0] or 0)  # one number, below the number of strata
    ranked = with_position(base, [F.desc("_rest"), *keys], name="_order")
    grant = (F.col("_order") < left) & (F.col("_base") < F.col(size))
    return ranked.withColumn("share", F.col("_base") + grant.cast("long")).drop("_base", "_rest", "_order")


def choose_strata(unique_counts: Mapping[str, int], limit: int) -> list[str]:
    """Columns to stratify by: most values first, while the combinations stay below a fifth of the limit."""
    room, chosen, product = max(2, limit // 5), [], 1
    for column, count in sorted(((c, u) for c, u in unique_counts.items() if u > 1), key=lambda cu: -cu[1]):
        if product * count <= room:
            chosen.append(column)
            product *= count
    return chosen


_STRATUM = "_stratum"
BROADCAST_KEYS = 1_000_000


def _fixed_width(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def time_number(df: DataFrame, time_col: str) -> Column:
    c = F.col(quoted(time_col))
    return epoch_ms(c) if is_temporal(df.schema[time_col].dataType) else c.cast("double")


def representative_sample(
    df: DataFrame, limit: int, key: Sequence[str], time_col: str | None = None, strata: Sequence[str] = (), seed: int = SEED, repeats: bool = False
) -> DataFrame:
    """Proportional strata, and inside each stratum one row from every equal stretch of time.

    Up to ``limit`` rows everything is returned; without a time column the sample is uniform. Rows
    without a valid time are left out. ``key`` identifies a row. Where it may not (``repeats``), it orders rows of one time: of
    rows that share stratum, time and key as many are taken as were chosen, those with the smallest hashes of the whole row.
    """
    if time_col is None:
        return uniform_sample(df, limit, key, seed)
    if df.count() <= limit:
        return df
    names = [F.coalesce(label(s), F.lit(MISSING_LABEL)) for s in strata]
    stratum = F.concat_ws("\u0001", *names) if names else F.lit("")
    # Times keep their type here: only their order counts.
    temporal = is_temporal(df.schema[time_col].dataType)
    t = F.col(quoted(time_col)).cast("timestamp_ntz") if temporal else time_number(df, time_col)
    timed = df.withColumn("_t", t).withColumn(_STRATUM, stratum).filter(F.col("_t").isNotNull() if temporal else F.col("_t").isNotNull() & ~F.isnan("_t"))
    sizes = materialize(timed.groupBy(_STRATUM).agg(F.count("*").alias("_size")))
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    shares = allocate_shares(sizes, min(limit, total), "_size", [_STRATUM])
    # Only the key travels through the sort; whole rows are fetched for the chosen keys.
    keys = [f"_k{i}" for i in range(len(key))]
    narrow = timed.select(_STRATUM, "_t", *[F.col(quoted(k)).alias(a) for k, a in zip(key, keys, strict=True)])
    placed = with_position(narrow, ["_t", *keys], [_STRATUM], name="_rn", total="_size")
    # Whole numbers do where no product outgrows them.
    wide = total * limit >= 1 << 62
    segment = F.expr("CAST(_rn AS DECIMAL(18,0)) * CAST(share AS DECIMAL(18,0)) div _size" if wide else "_rn * share div _size")
    shares = settled(shares.select(F.col(_STRATUM).alias("_s"), "share").filter(F.col("share") > 0))
    spot = keys if not repeats else ["_t", *keys]
    picked = (
        placed.join(shares, F.col(_STRATUM) == F.col("_s"))
        .withColumn("_segment", segment)
        .groupBy(_STRATUM, "_segment")
        .agg(F.min_by(F.struct(*spot), F.struct(F.xxhash64(F.lit(seed), *keys), *spot)).alias("_pick"))
    )
    if repeats:
        known = [F.col(_STRATUM).alias("_s"), F.col("_pick._t").alias("_time"), *[F.col(f"_pick.{a}").alias(f"_p{a}") for a in keys]]
        picked = settled(picked.groupBy(*known).agg(F.count("*").alias("_wanted")))
    else:
        picked = picked.select(*[F.col(f"_pick.{a}").alias(f"_p{a}") for a in keys])
    condition = F.lit(True)
    for k, a in zip(key, keys, strict=True):
        condition = condition & F.col(quoted(k)).eqNullSafe(F.col(f"_p{a}"))
    # At most `limit` keys; wide keys and large limits leave the join to adaptive execution.
    narrow_key = all(_fixed_width(df.schema[k].dataType) for k in key)
    chosen = picked.select(*[f"_p{a}" for a in keys])
    chosen = F.broadcast(chosen) if limit <= BROADCAST_KEYS and narrow_key else chosen
    if not repeats:
        return df.join(chosen, condition, "left_semi")
    met = timed.join(chosen, condition, "left_semi")
    met = met.join(picked, condition & (F.col(_STRATUM) == F.col("_s")) & (F.col("_t") == F.col("_time")))
    met = met.withColumn("_row", F.struct(*row_hash(df)))
    alike = ["_s", "_time", *[f"_p{a}" for a in keys]]
    met = materialize(met.withColumn("_one", F.lit(1).cast("long")))
    ranked = with_weights_below(met, ["_row"], {"_one": "_before"}, alike, few=met.count() <= FEW_ROWS)
    return ranked.filter(F.col("_before") < F.col("_wanted")).select(*[quoted(c) for c in df.columns])


def evenly_spaced(df: DataFrame, limit: int, time_col: str, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """One row from each of ``limit`` equal stretches of the time order."""
    return representative_sample(df, limit, key, time_col, (), seed)


def identifier_counts(df: DataFrame, columns: Sequence[str], max_values: int | None = None) -> DataFrame:
    """Identifier values per column with the number of distinct values, null included; ``max_values`` keeps the most frequent."""
    counts = value_counts(df, columns, MISSING_LABEL)
    return _top_with_total(counts, "column_name", "category", max_values)


def _top_with_total(counts: DataFrame, key: str, value: str, max_values: int | None) -> DataFrame:
    if max_values is not None:
        counts = materialize(counts)
    totals = counts.groupBy(key).agg(F.count("*").alias("total_unique"))
    if max_values is not None and any(r["total_unique"] > max_values for r in totals.collect()):  # one row per column or combination
        counts = first_n(counts, [F.desc("count"), value], max_values, [key])
    return counts.join(F.broadcast(totals), key)


def identifier_combinations(
    df: DataFrame, columns: Sequence[str], max_values: int | None = None, max_fields: int = MAX_FIELDS
) -> DataFrame:
    """Counts of every combination of two to four identifiers; ``max_values`` keeps the most frequent of each."""
    chosen = [c for size in range(2, min(max_fields, len(columns)) + 1) for c in combinations(columns, size)]
    schema = "combination string, values array<string>, count long, total_unique long"
    if not chosen:
        return small_table(df.sparkSession, [], schema)
    entries = F.array(
        *[
            F.struct(
                F.lit("||".join(names)).alias("combination"),
                F.array(*[F.coalesce(label(n), F.lit(MISSING_LABEL)) for n in names]).alias("values"),
            )
            for names in chosen
        ]
    )
    counts = (
        df.select(F.explode(entries).alias("e")).select("e.*").groupBy("combination", "values").agg(F.count("*").alias("count"))
    )
    return _top_with_total(counts, "combination", "values", max_values).select(
        "combination", "values", "count", "total_unique"
    )


def time_filter(df: DataFrame, time_col: str) -> DataFrame:
    """First and last point of the time axis as a number (milliseconds for datetimes)."""
    kind = "datetime" if is_temporal(df.schema[time_col].dataType) else "time_index"
    # Numbers keep the order of times.
    t = F.col(quoted(time_col)).cast("timestamp_ntz") if kind == "datetime" else time_number(df, time_col)
    ends = df.agg(F.min(t).alias("low"), F.max(t).alias("high"))
    return ends.select(*[time_number(ends, c).alias(n) for c, n in (("low", "min"), ("high", "max"))]).select(
        F.col("min").isNotNull().alias("available"), F.lit(kind).alias("time_type"), F.lit(time_col).alias("time_column"),
        "min", "max",
    )
