"""Data-quality checks: one table per check, levels and reasons as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.operators import statistics
from tablescope.plans.wide import distinct_counts, duplicate_rows, per_column, quoted

MISSING_WARNING, MISSING_CRITICAL = 0.05, 0.30
HIGH_CARDINALITY = 0.50
STRONG_SKEW, MODERATE_SKEW = 2.0, 1.0
COUNTS_PER_PASS = 400  # plain counts are cheap enough to take many at once


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, ordinal, row_count, missing_count``; one scan."""

    def build(name: str) -> dict[str, Column]:
        return {"row_count": F.count(F.lit(1)), "missing_count": F.count_if(F.col(quoted(name)).isNull())}

    return per_column(df, columns, build, "row_count long, missing_count long", COUNTS_PER_PASS)


def missing_values(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    share = F.col("missing_ratio")
    return (null_counts(df, df.columns) if base is None else base).withColumn("missing_ratio", ratio(F.col("missing_count"), F.col("row_count"))).select(
        "column_name", "ordinal", "missing_count", "missing_ratio",
        F.when(share >= MISSING_CRITICAL, "critical").when(share >= MISSING_WARNING, "warning").otherwise("ok").alias("level"),
    )


def duplicates(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    return (duplicate_rows(df) if counted is None else counted).select(
        F.col("duplicate_rows").alias("duplicate_count"),
        ratio(F.col("duplicate_rows"), F.col("row_count")).alias("duplicate_ratio"),
    )


def _with_unique(base: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if not columns:
        return base.withColumn("unique", F.lit(0).cast("long"))
    counts = distinct_counts(df, {c: F.col(quoted(c)) for c in columns})
    return base.join(counts, "column_name", "left").fillna(0, ["unique"])


def constant_columns(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Columns with at most one value, null counting as a value.

    A column is constant when all rows are null, or none is and its smallest value equals its largest.
    """

    def build(name: str) -> dict[str, Column]:
        c = F.col(quoted(name))
        return {
            "row_count": F.count(F.lit(1)),
            "non_null": F.count(c),
            "same": F.coalesce(F.min(c) == F.max(c), F.lit(True)),
        }

    table = per_column(df, df.columns, build, "row_count long, non_null long, same boolean") if base is None else base
    full = F.col("non_null") == F.col("row_count")
    return table.filter((F.col("non_null") == 0) | (full & F.col("same"))).select("column_name", "ordinal")


def high_cardinality(df: DataFrame, columns: Sequence[str], base: DataFrame | None = None) -> DataFrame:
    """``base`` has ``column_name, row_count, unique`` where they are at hand."""
    share = F.col("unique_ratio")
    return (
        (_with_unique(null_counts(df, columns), df, columns) if base is None else base)
        .withColumn("unique_ratio", ratio(F.col("unique"), F.col("row_count")))
        .select(
            "column_name", "unique", "unique_ratio",
            F.when(share >= HIGH_CARDINALITY, "high").otherwise("normal").alias("level"),
        )
    )


def outliers(df: DataFrame, columns: Sequence[str], table: DataFrame | None = None) -> DataFrame:
    """Fence outliers; constant columns are skipped without bounds, empty ones left out."""
    ok = F.col("status") == "ok"
    return (
        (statistics.outlier_table(df, columns) if table is None else table)
        .filter(~F.col("reason").eqNullSafe("no_valid_values"))
        .select(
            "column_name", "outlier_count", "outlier_ratio",
            F.when(ok, F.col("lower_bound")).alias("lower_bound"),
            F.when(ok, F.col("upper_bound")).alias("upper_bound"),
            "status", "reason",
        )
    )


def skewness(df: DataFrame, columns: Sequence[str], base: DataFrame | None = None) -> DataFrame:
    table = statistics.finite_moments(df, columns) if base is None else base
    few, flat = F.col("n") < 3, F.col("low") == F.col("high")
    size = F.abs("skewness")
    return table.withColumn(
        "skewness",
        F.when(few, F.lit(None)).when(flat, 0.0).otherwise(statistics.adjusted_skewness(F.col("n"), F.col("g1"))),
    ).select(
        "column_name", "skewness",
        F.when(few, "skipped").when(flat, "constant").when(size >= STRONG_SKEW, "strongly_skewed")
        .when(size >= MODERATE_SKEW, "moderately_skewed").otherwise("approximately_symmetric").alias("level"),
        F.when(few | flat, "skipped").otherwise("ok").alias("status"),
        F.when(few, "insufficient_samples").when(flat, "constant_variable").alias("reason"),
    )


def type_issues(types: DataFrame) -> DataFrame:
    """Columns whose type asks for a second look."""
    kind = F.col("detected_type")
    return types.select(
        "column_name", "dtype", "detected_type",
        F.when(kind == "text", "text_variable").when(kind == "identifier", "identifier_variable")
        .when(kind.isin("datetime", "time"), "temporal_variable")
        .when(F.col("dtype") == "string", "object_dtype_requires_review").alias("issue"),
    )
