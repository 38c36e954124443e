"""Frequencies of categorical columns and what follows from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.plans.wide import quoted, unpivot

MISSING_LABEL = "缺失"


def label(name: str) -> Column:
    return F.col(quoted(name)).cast("string")


def all_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, category, count``, missing values under a null category."""
    return unpivot(df, {c: label(c) for c in columns}, value="category").groupBy("column_name", "category").agg(F.count("*").alias("count"))


def value_counts(df: DataFrame, columns: Sequence[str], missing_label: str | None = None, counts: DataFrame | None = None) -> DataFrame:
    """``column_name, category, count``; nulls are dropped, or counted under ``missing_label``.

    ``counts`` are the ``all_counts`` of the columns where they are at hand.
    """
    if counts is not None and not missing_label:
        return counts.filter(F.col("category").isNotNull())
    cells = {c: F.coalesce(label(c), F.lit(missing_label)) if missing_label else label(c) for c in columns}
    long = unpivot(df, cells, value="category")
    if not missing_label:
        long = long.filter(F.col("category").isNotNull())
    return long.groupBy("column_name", "category").agg(F.count("*").alias("count"))


def with_share(counts: DataFrame, keys: Sequence[str] = ("column_name",), name: str = "ratio") -> DataFrame:
    """Share of ``count`` in its column; the totals, one row per column, are broadcast."""
    keys = list(keys)
    totals = counts.groupBy(*keys).agg(F.sum("count").alias("_all"))
    return counts.join(F.broadcast(totals), keys).withColumn(name, F.col("count") / F.col("_all")).drop("_all")


def frequency_table(df: DataFrame, columns: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """Every category with its count and its share of the non-null values."""
    return with_share(value_counts(df, columns, counts=counts))


def top_categories(
    df: DataFrame, columns: Sequence[str], n: int = 20, missing_label: str | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """The ``n`` most frequent categories per column (ties by name), with their rank.

    The limit inside the window reaches the map side, so each task passes on at most ``n`` rows a column.
    """
    by = Window.partitionBy("column_name").orderBy(F.desc("count"), F.asc("category"))
    return (
        value_counts(df, columns, missing_label, counts).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)
    )


def categorical_summary(df: DataFrame, columns: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """count, missing, unique, mode with count and ratio, entropy (bits) and normalised entropy."""
    counts = all_counts(df, columns) if counts is None else counts
    known = F.when(F.col("category").isNotNull(), F.col("count"))
    # Largest count first, then the smallest name: names are compared among the largest counts only.
    grouped = counts.groupBy("column_name").agg(
        F.coalesce(F.sum(known), F.lit(0)).alias("count"),
        F.coalesce(F.sum(F.when(F.col("category").isNull(), F.col("count"))), F.lit(0)).alias("missing"),
        F.count("category").alias("unique"),
        F.coalesce(F.max(known), F.lit(0)).alias("mode_count"),
        F.sum(known * F.log2(known)).alias("_clogc"),
    )
    mode = (
        counts.filter(F.col("category").isNotNull())
        .withColumn("rank", F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("count"), "category")))
        .filter("rank = 1")
        .select("column_name", F.col("category").alias("mode"))
    )
    n, unique = F.col("count"), F.col("unique")
    entropy = F.when(unique > 1, F.log2(n.cast("double")) - F.col("_clogc") / n).otherwise(0.0)
    return (
        grouped.join(mode, "column_name", "left")
        .withColumn("entropy", entropy)
        .select(
            "column_name", "count", "missing", "unique", "mode", "mode_count",
            F.coalesce(F.try_divide(F.col("mode_count"), n), F.lit(0.0)).alias("mode_ratio"),
            "entropy",
            F.when(unique > 1, F.col("entropy") / F.log2(unique.cast("double"))).otherwise(0.0).alias("normalized_entropy"),
        )
    )
