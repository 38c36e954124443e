"""Descriptive statistics of numeric columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.clean import finite
from tablescope.functions.normality import shapiro_wilk
from tablescope.plans.selection import Quantiles, column_quantiles, column_spreads
from tablescope.plans.small import small_table
from tablescope.plans.wide import per_value, quoted, unpivot

QUANTILES = {
    "q01": 0.01, "q05": 0.05, "q10": 0.10, "q25": 0.25, "q50": 0.50, "q75": 0.75, "q90": 0.90, "q95": 0.95, "q99": 0.99,
}
FENCE = 1.5
SHAPIRO_LIMIT = 5000
JARQUE_BERA, SHAPIRO_WILK = "Jarque-Bera", "Shapiro-Wilk"


def number(name: str) -> Column:
    return F.col(quoted(name)).cast("double")


def adjusted_skewness(n: Column, population: Column) -> Column:
    """Bias-adjusted skewness from the population one (null below three values)."""
    return F.when(n >= 3, F.sqrt(n * (n - 1.0)) / (n - 2.0) * population)


def adjusted_kurtosis(n: Column, population: Column) -> Column:
    """Bias-adjusted excess kurtosis from the population one (null below four values)."""
    return F.when(n >= 4, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * population + 6.0))


def or_null(c: Column) -> Column:
    """Not-a-number and infinite results are shown as missing."""
    return finite(c)


def moments(df: DataFrame, columns: Sequence[str], base: DataFrame | None = None) -> DataFrame:
    """count, missing, mean, std, variance, min, max, range, cv, skewness, kurtosis; one scan, none if ``base`` has the sums."""
    v = F.col("value")
    table = base if base is not None else per_value(df, {c: number(c) for c in columns}, {
        "count": F.count(v), "missing": F.count_if(v.isNull()), "mean": F.avg(v), "std": F.stddev_samp(v),
        "min": F.min(v), "max": F.max(v), "g1": F.skewness(v), "g2": F.kurtosis(v),
    })
    n, std = F.col("count"), F.col("std")
    flat = F.col("min") == F.col("max")
    return table.filter(n > 0).select(
        "column_name", "ordinal", "count", "missing",
        or_null(F.col("mean")).alias("mean"), or_null(std).alias("std"),
        or_null(std * std).alias("variance"), or_null(F.col("min")).alias("min"),
        or_null(F.col("max")).alias("max"), or_null(F.col("max") - F.col("min")).alias("range"),
        F.when(F.col("mean") != 0, or_null(std / F.abs("mean"))).alias("coefficient_of_variation"),
        or_null(adjusted_skewness(n, F.when(flat, F.lit(0.0)).otherwise(F.col("g1")))).alias("skewness"),
        or_null(F.when(flat & (n >= 4), F.lit(0.0)).otherwise(adjusted_kurtosis(n, F.col("g2")))).alias("kurtosis"),
    )


def report_quantiles(df: DataFrame, columns: Sequence[str]) -> Quantiles:
    return column_quantiles(df, {c: number(c) for c in columns}, list(QUANTILES.values()))


def quantile_table(df: DataFrame, columns: Sequence[str], found: Quantiles | None = None) -> DataFrame:
    """The nine report quantiles and the inter-quartile range, exact."""
    found = report_quantiles(df, columns) if found is None else found
    rows = [(c, n, *values) for c, (n, values) in found.items()]
    schema = "column_name string, count long, " + ", ".join(f"{q} double" for q in QUANTILES)
    table = small_table(df.sparkSession, rows, schema)
    return table.select(
        "column_name", "count", *[or_null(F.col(q)).alias(q) for q in QUANTILES],
        or_null(F.col("q75") - F.col("q25")).alias("iqr"), or_null(F.col("q50")).alias("median"),
    )


def mad_table(df: DataFrame, columns: Sequence[str], found: Mapping[str, float] | None = None) -> DataFrame:
    """Median absolute deviation from the median, unscaled; ``found`` names it where it is known."""
    if found is None:
        found = column_spreads(df, {c: number(c) for c in columns}, [0.5])[1]
    return small_table(df.sparkSession, list(found.items()), "column_name string, mad double").select("column_name", or_null(F.col("mad")).alias("mad"))


Quartiles = Mapping[str, tuple[float, float]]


def quartiles(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """``{column: (q1, q3)}`` over finite values."""
    found = column_quantiles(df, {c: finite(F.col(quoted(c))) for c in columns}, [0.25, 0.75])
    return {c: (q1, q3) for c, (_, (q1, q3)) in found.items()}


def fences(df: DataFrame, columns: Sequence[str], reach: float = FENCE) -> dict[str, tuple[float, float]]:
    """``{column: (lower, upper)}``: so many quartile ranges beyond the quartiles."""
    return {c: (q1 - reach * (q3 - q1), q3 + reach * (q3 - q1)) for c, (q1, q3) in quartiles(df, columns).items()}


def outlier_measures(name: str, known: Quartiles, reach: float = FENCE) -> dict[str, Column]:
    """What a column's rows are looked at for once its quartiles are known."""
    c, outside = finite(F.col(quoted(name))), F.lit(False)
    if name in known:
        q1, q3 = known[name]
        outside = (c < q1 - reach * (q3 - q1)) | (c > q3 + reach * (q3 - q1))
    return {"value": c, "outside": outside}


def outlier_table(
    df: DataFrame, columns: Sequence[str], known: Quartiles | None = None, reach: float = FENCE, counted: DataFrame | None = None
) -> DataFrame:
    """Values outside the quartile fences: bounds, count and share of finite values; ``counted`` has the counts where they are at hand."""
    known = quartiles(df, columns) if known is None else known
    edges = [(c, q1, q3, q1 - reach * (q3 - q1), q3 + reach * (q3 - q1)) for c, (q1, q3) in known.items() if c in columns]
    v = F.col("value")
    if counted is None:
        counted = per_value(df, {c: outlier_measures(c, known, reach) for c in columns}, {
            "n": F.count(v), "lowest": F.min(v), "highest": F.max(v), "outside": F.count_if(F.col("outside"))})
    limits = small_table(df.sparkSession, edges, "column_name string, q1 double, q3 double, lower_bound double, upper_bound double")
    n, flat = F.coalesce(F.col("n"), F.lit(0)), F.coalesce(F.col("lowest") == F.col("highest"), F.lit(False))
    constant = lambda c: F.when(flat, F.col("lowest")).otherwise(F.col(c))
    return counted.join(limits, "column_name", "left").select(
        "column_name", "ordinal", constant("q1").alias("q1"), constant("q3").alias("q3"),
        (constant("q3") - constant("q1")).alias("iqr"), constant("lower_bound").alias("lower_bound"),
        constant("upper_bound").alias("upper_bound"), F.coalesce("outside", F.lit(0)).alias("outlier_count"),
        F.coalesce(F.try_divide(F.col("outside"), n), F.lit(0.0)).alias("outlier_ratio"),
        F.when((n == 0) | flat, "skipped").otherwise("ok").alias("status"),
        F.when(n == 0, "no_valid_values").when(flat, "constant_variable").alias("reason"),
    )


def finite_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, ordinal, n, low, high, mean, std, g1, g2`` of the finite values; one scan."""
    v = F.col("value")
    return per_value(df, {c: finite(F.col(quoted(c))) for c in columns}, {
        "n": F.count(v), "low": F.min(v), "high": F.max(v), "mean": F.avg(v), "std": F.stddev_samp(v), "g1": F.skewness(v), "g2": F.kurtosis(v),
    }).fillna(0, ["n"])


_SHAPIRO_SCHEMA = "column_name string, statistic double, p_value double"


def _shapiro_group(pdf: pd.DataFrame) -> pd.DataFrame:
    statistic, p_value = shapiro_wilk(pdf["value"].to_numpy())
    return pd.DataFrame([(pdf["column_name"].iloc[0], statistic, p_value)], columns=["column_name", "statistic", "p_value"])


def normality_table(df: DataFrame, columns: Sequence[str], test: str = JARQUE_BERA, base: DataFrame | None = None) -> DataFrame:
    """The test asked for, at every size: Jarque-Bera, or Shapiro-Wilk of columns with at most ``SHAPIRO_LIMIT`` values."""
    if test not in (JARQUE_BERA, SHAPIRO_WILK):
        raise ValueError(f"unknown test: {test}")
    base = finite_moments(df, columns) if base is None else base
    base = base.withColumn(
        "reason",
        F.when(F.col("n") < 3, "insufficient_samples").when(F.col("low") == F.col("high"), "constant_variable"),
    )
    tested = F.col("reason").isNull()
    base = base.withColumn("test", F.when(tested, test))
    if test == JARQUE_BERA:
        jb = F.col("n") / 6.0 * (F.pow("g1", F.lit(2.0)) + F.pow("g2", F.lit(2.0)) / 4.0)
        out = base.withColumn("statistic", F.when(tested, jb)).withColumn("p_value", F.exp(-F.col("statistic") / 2.0))
    else:
        plain = base.select("column_name", "n", "reason").collect()  # one row per column
        if too_many := [r["column_name"] for r in plain if r["reason"] is None and r["n"] > SHAPIRO_LIMIT]:
            raise ValueError(f"Shapiro-Wilk is defined here for at most {SHAPIRO_LIMIT} values: {', '.join(too_many)}")
        values = unpivot(df, {c: finite(F.col(quoted(c))) for c in columns}).filter(F.col("value").isNotNull())
        known = base.filter(tested).select(F.col("column_name").alias("_name"))
        groups = values.join(known, F.col("column_name") == F.col("_name"), "left_semi").groupBy("column_name")
        shapiro = groups.applyInPandas(_shapiro_group, _SHAPIRO_SCHEMA).withColumnRenamed("column_name", "_name")
        out = base.join(shapiro, F.col("column_name") == F.col("_name"), "left")
    usable = or_null(F.col("statistic")).isNotNull() & or_null(F.col("p_value")).isNotNull()
    return out.select(
        "column_name", "ordinal", "n", "test", or_null(F.col("statistic")).alias("statistic"),
        or_null(F.col("p_value")).alias("p_value"),
        F.when(tested & usable, "ok").otherwise("skipped").alias("status"),
        F.coalesce("reason", F.when(~usable, "non_finite_result")).alias("reason"),
    )


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Moments and quantiles side by side, one row per numeric column that has values."""
    return moments(df, columns).join(quantile_table(df, columns).drop("count"), "column_name")


def numeric_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Everything about numeric columns: summary, MAD, outliers and normality; quantiles and MAD are found in one search."""
    found, spread = column_spreads(df, {c: number(c) for c in columns}, list(QUANTILES.values()))
    names = list(QUANTILES)
    q25, q75 = names.index("q25"), names.index("q75")
    # Fences leave infinities out; where there are none the quartiles at hand will do.
    endless = [c for c, r in _infinite(df, columns).items() if r]
    known = {c: (v[q25], v[q75]) for c, (_, v) in found.items() if c not in endless}
    known |= quartiles(df, endless) if endless else {}
    return joined_report(df, columns, found, spread, moments(df, columns), outlier_table(df, columns, known), normality_table(df, columns))


def joined_report(
    df: DataFrame, columns: Sequence[str], found: Quantiles, spread: Mapping[str, float], summed: DataFrame, fenced: DataFrame, tested: DataFrame
) -> DataFrame:
    """The parts of the numeric report side by side."""
    outliers = fenced.select(
        "column_name", "lower_bound", "upper_bound", "outlier_count", "outlier_ratio",
        F.col("status").alias("outlier_status"), F.col("reason").alias("outlier_reason"),
    )
    normality = tested.select(
        "column_name", "test", "statistic", "p_value",
        F.col("status").alias("normality_status"), F.col("reason").alias("normality_reason"),
    )
    return (
        summed.join(quantile_table(df, columns, found).drop("count"), "column_name")
        .join(mad_table(df, columns, spread), "column_name", "left")
        .join(outliers, "column_name", "left")
        .join(normality, "column_name", "left")
    )


def _infinite(df: DataFrame, columns: Sequence[str]) -> dict[str, bool]:
    """Which columns hold infinities; whole-number columns cannot."""
    fields = [c for c in columns if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    if not fields:
        return {}
    row = df.agg(*[F.bool_or(F.abs(number(c)) == float("inf")).alias(f"f{i}") for i, c in enumerate(fields)]).first()
    return {c: bool(row[i]) for i, c in enumerate(fields)}
