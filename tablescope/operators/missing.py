"""Missingness: totals, per column, patterns of columns missing together, pairs."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.operators.quality import null_counts, ratio
from tablescope.operators.typing import missing_in_row
from tablescope.plans.materialize import settled
from tablescope.plans.small import small_table
from tablescope.plans.wide import MASK_BITS, null_masks, quoted

TOP_PATTERNS, TOP_PAIRS = 20, 30


def total_measures(columns: Sequence[str]) -> dict[str, Column]:
    """Aggregates behind the totals over ``columns``."""
    missing = missing_in_row(columns)
    with_any = F.lit(0)
    for c in columns:
        with_any = with_any + F.coalesce(F.max(F.col(quoted(c)).isNull().cast("int")), F.lit(0))
    return {
        "n": F.count(F.lit(1)), "total_missing": F.coalesce(F.sum(missing), F.lit(0)).cast("long"), "complete_rows": F.count_if(missing == 0),
        "columns_with_missing": (with_any if columns else F.lit(0)).cast("long"),
    }


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None, totals: DataFrame | None = None) -> DataFrame:
    """One row of totals over ``columns`` (all by default); ``totals`` is the row of ``total_measures`` where that is at hand."""
    columns = df.columns if columns is None else list(columns)
    k = len(columns)
    totals = df.agg(*[m.alias(name) for name, m in total_measures(columns).items()]) if totals is None else totals
    n = F.col("n")
    incomplete = n - F.col("complete_rows")
    return totals.select(
        (n * k).alias("total_cells"),
        "total_missing",
        ratio(F.col("total_missing"), n * k).alias("overall_missing_ratio"),
        "columns_with_missing",
        (F.lit(k) - F.col("columns_with_missing")).cast("long").alias("columns_without_missing"),
        "complete_rows",
        ratio(F.col("complete_rows"), n).alias("complete_row_ratio"),
        incomplete.alias("rows_with_missing"),
        ratio(incomplete, n).alias("rows_with_missing_ratio"),
    )


def missing_by_column(df: DataFrame, columns: Sequence[str] | None = None, base: DataFrame | None = None) -> DataFrame:
    """Missing and present counts per column, most missing first, ties in column order."""
    columns = df.columns if columns is None else [c for c in columns if c in df.columns]
    n, m = F.col("row_count"), F.col("missing_count")
    return (
        (null_counts(df, columns) if base is None else base)
        .select("column_name", "ordinal", "missing_count", (n - m).alias("non_missing_count"), ratio(m, n).alias("missing_ratio"))
        .orderBy(F.desc("missing_ratio"), F.desc("missing_count"), "ordinal")
    )


def pattern_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``pattern`` (indexes of the missing columns of a row) and how many rows have it, complete rows included."""
    masks = {f"_m{i}": m for i, m in enumerate(null_masks(columns))}
    counts = df.select(*[m.alias(k) for k, m in masks.items()]).groupBy(*masks).agg(F.count("*").alias("count"))
    bits = [F.when(F.col(f"_m{i // MASK_BITS}").bitwiseAND(F.lit(1 << i % MASK_BITS).cast("long")) != 0, F.lit(i)) for i in range(len(columns))]
    return counts.select((F.array_compact(F.array(*bits)) if bits else F.array().cast("array<int>")).alias("pattern"), "count")


def _names(indexes: Column, columns: Sequence[str]) -> Column:
    known = F.array(*[F.lit(c) for c in columns])
    return F.transform(indexes, lambda i: F.get(known, i))


def missing_patterns(
    df: DataFrame, columns: Sequence[str] | None = None, top_n: int = TOP_PATTERNS, counts: DataFrame | None = None
) -> DataFrame:
    """The most frequent sets of columns missing in the same row, with how many sets there are and whether any were left out.

    ``counts`` is a written table of ``pattern_counts`` where that is at hand.
    """
    columns = df.columns if columns is None else list(columns)
    if not columns:
        return small_table(df.sparkSession, [], "missing_columns array<string>, missing_count long, missing_ratio double, missing_variable_count int, total long, truncated boolean"
        )
    counts = settled(pattern_counts(df, columns)) if counts is None else counts
    known = counts.agg(F.sum("count").alias("n"), F.count_if(F.size("pattern") > 0).alias("kinds")).first()  # two numbers
    named = counts.filter(F.size("pattern") > 0).select(
        _names(F.col("pattern"), columns).alias("missing_columns"),
        F.col("count").alias("missing_count"),
        (F.col("count") / F.lit(max(known["n"] or 0, 1))).alias("missing_ratio"),
        F.size("pattern").alias("missing_variable_count"),
        F.lit(known["kinds"]).cast("long").alias("total"), F.lit(known["kinds"] > top_n).alias("truncated"),
    )
    return named.orderBy(F.desc("missing_count"), F.array_join("missing_columns", ",")).limit(top_n)


def _pair_counts(counts: DataFrame, among: Sequence[int]) -> DataFrame:
    """``i, j, both`` of the pairs among some columns that are ever missing together."""
    some = F.filter("pattern", lambda i: F.array_contains(F.array(*[F.lit(c) for c in among]), i)) if among else F.array().cast("array<int>")
    kept = counts.select(some.alias("pattern"), "count").filter(F.size("pattern") > 1)
    return (
        kept.select(F.posexplode("pattern").alias("place", "i"), "pattern", "count")
        .select("i", "count", F.explode(F.slice("pattern", F.col("place") + 2, F.size("pattern"))).alias("j"))
        .groupBy("i", "j")
        .agg(F.sum("count").alias("both"))
    )


def missing_pairs(df: DataFrame, columns: Sequence[str] | None = None, top_n: int = TOP_PAIRS, counts: DataFrame | None = None) -> DataFrame:
    """Pairs of columns by the number of rows in which both are missing; pairs that never are count 0.

    Rows are first folded into missing patterns. A pair is never missing more often than either of its columns, so pairs of
    the few columns that are missing most give a bound, and only columns that reach it are paired at all. Pairs that are never
    missing together fill up what is left of the list, in column order. Nothing of the size of all pairs is ever formed.
    """
    columns = df.columns if columns is None else list(columns)
    k, spark = len(columns), df.sparkSession
    every = k * (k - 1) // 2
    schema = "column_1 string, column_2 string, both_missing_count long, both_missing_ratio double, total long, truncated boolean"
    if not every or top_n < 1:
        return small_table(spark, [], schema)
    counts = settled(pattern_counts(df, columns)) if counts is None else counts
    order = [F.desc("both"), "i", "j"]
    # One row per column.
    single = {r["i"]: r["n"] for r in counts.select(F.explode("pattern").alias("i"), "count").groupBy("i").agg(F.sum("count").alias("n")).collect()}
    rows = counts.agg(F.sum("count")).first()[0] or 0
    ranked = sorted(single, key=lambda i: (-single[i], i))
    few = ranked[: 2 + math.isqrt(2 * top_n)]
    best = _pair_counts(counts, few).orderBy(*order).limit(top_n).collect()
    bound = best[top_n - 1]["both"] if len(best) == top_n else 1
    among = [i for i in ranked if single[i] >= bound]
    if len(among) > len(few):
        best = _pair_counts(counts, among).orderBy(*order).limit(top_n).collect()
    found = [(r["i"], r["j"], r["both"]) for r in best]
    never = ((i, j, 0) for i in range(k) for j in range(i + 1, k))
    if len(found) < min(top_n, every):
        have = {f[:2] for f in found}
        found += itertools.islice((p for p in never if p[:2] not in have), min(top_n, every) - len(found))
    shown = [(columns[i], columns[j], both, both / max(rows, 1), every, every > top_n) for i, j, both in found]
    return small_table(spark, shown, schema)
