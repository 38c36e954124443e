"""The tables behind the pictures: bins, boxes, bars, lines and cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.clean import finite
from tablescope.operators.categorical import top_categories
from tablescope.operators.correlation import column_pairs, pair_table
from tablescope.operators.series import irregular_series, resample
from tablescope.plans.selection import column_quantiles
from tablescope.plans.small import small_table
from tablescope.plans.wide import per_value, quoted, unpivot

BINS, BAR_CATEGORIES = 30, 15


def fin(name: str) -> Column:
    return finite(F.col(quoted(name)))


def bounds_of(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """``{column: (min, max, mean)}`` of columns whose finite values vary; one number set per column."""

    v = F.col("value")
    rows = per_value(df, {c: fin(c) for c in columns}, {"low": F.min(v), "high": F.max(v), "mean": F.avg(v)}).collect()
    return {r["column_name"]: (r["low"], r["high"], r["mean"]) for r in rows if r["low"] is not None and r["low"] < r["high"]}


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bin 0..bins-1; the last bin is closed on the right."""
    return F.least(F.lit(bins - 1), F.floor((value - low) / (high - low) * bins)).cast("int")


Bounds = dict[str, tuple[float, float, float]]


def histogram(df: DataFrame, columns: Sequence[str], bins: int = BINS, bounds: Bounds | None = None) -> DataFrame:
    """Counts of equal-width bins over [min, max]; constant and empty columns have none."""
    bounds = bounds_of(df, columns) if bounds is None else bounds
    spark = df.sparkSession
    if not bounds:
        return small_table(spark, [], "column_name string, bin int, bin_start double, bin_end double, count long")
    cells = unpivot(df, {c: bin_of(fin(c), low, high, bins) for c, (low, high, _) in bounds.items()}, value="bin")
    counts = cells.filter(F.col("bin").isNotNull()).groupBy("column_name", "bin").agg(F.count("*").alias("n"))
    rows = [(c, low, high) for c, (low, high, _) in bounds.items()]
    layout = small_table(spark, rows, "column_name string, low double, high double").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    step = (F.col("high") - F.col("low")) / bins
    return layout.join(counts, ["column_name", "bin"], "left").select(
        "column_name", "bin", (F.col("low") + step * F.col("bin")).alias("bin_start"),
        (F.col("low") + step * (F.col("bin") + 1)).alias("bin_end"), F.coalesce("n", F.lit(0)).alias("count"),
    )


def histogram_marks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and median lines of each histogram."""
    bounds = bounds_of(df, columns)
    middle = column_quantiles(df, {c: fin(c) for c in bounds}, [0.5]) if bounds else {}
    rows = [(c, mean, middle[c][1][0]) for c, (_, _, mean) in bounds.items()]
    return small_table(df.sparkSession, rows, "column_name string, mean double, median double")


def box_measures(name: str, q1: float, q3: float) -> dict[str, Column]:
    low, high, c = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1), fin(name)
    return {"value": c, "inside_low": F.when(c >= low, c), "inside_high": F.when(c <= high, c), "outside": (c < low) | (c > high)}


def box_plot(
    df: DataFrame, columns: Sequence[str], quartiles: Mapping[str, tuple[float, float, float]] | None = None, ends: DataFrame | None = None
) -> DataFrame:
    """Quartiles, mean, whiskers at the last values inside the fences, and how many lie outside.

    ``quartiles`` of the columns that vary and their ``ends`` are found unless they are at hand.
    """
    if quartiles is None:
        varied = list(bounds_of(df, columns))
        quartiles = {c: tuple(v) for c, (_, v) in column_quantiles(df, {c: fin(c) for c in varied}, [0.25, 0.5, 0.75]).items()} if varied else {}
    if ends is None:
        ends = per_value(df, {c: box_measures(c, q1, q3) for c, (q1, _, q3) in quartiles.items()}, {
            "mean": F.avg("value"), "lowest": F.min("inside_low"), "highest": F.max("inside_high"), "fliers": F.count_if(F.col("outside"))})
    boxes = small_table(df.sparkSession, [(c, *values) for c, values in quartiles.items()], "column_name string, q1 double, median double, q3 double")
    return boxes.join(ends, "column_name").select(
        "column_name", "q1", "median", "q3", "mean", F.least("q1", "lowest").alias("whisker_low"),
        F.greatest("q3", "highest").alias("whisker_high"), "fliers")


def box_fliers(df: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """The values outside the fences."""
    varied = list(bounds_of(df, columns))
    quartiles = column_quantiles(df, {c: fin(c) for c in varied}, [0.25, 0.75]) if varied else {}
    cells = {}
    for c, (_, (q1, q3)) in quartiles.items():
        reach = 1.5 * (q3 - q1)
        cells[c] = F.when((fin(c) < q1 - reach) | (fin(c) > q3 + reach), fin(c))
    if not cells:
        return df.select(*[quoted(k) for k in key], F.lit("").alias("column_name"), F.lit(0.0).alias("value")).limit(0)
    return unpivot(df, cells, key).filter(F.col("value").isNotNull())


def category_bars(df: DataFrame, columns: Sequence[str], n: int = BAR_CATEGORIES, counts: DataFrame | None = None) -> DataFrame:
    """Most frequent categories, smallest bar first."""
    return top_categories(df, columns, n, counts=counts).orderBy("column_name", F.asc("count"), F.desc("category"))


def scatter_fits(df: DataFrame, columns: Sequence[str], max_columns: int | None = None, measures: DataFrame | None = None) -> DataFrame:
    """Least-squares line and extent of every pair of numeric columns that vary; ``measures`` is their ``pair_table`` where that is at hand."""
    chosen = list(columns)[:max_columns]
    if measures is None:
        measures = pair_table(df.select(*[fin(c).alias(f"c{i}") for i, c in enumerate(chosen)]), column_pairs(chosen))
    slope = F.try_divide("cov", F.col("std_x") * F.col("std_x"))
    names = F.array(*[F.lit(c) for c in chosen])
    return measures.filter((F.col("n") >= 2) & (F.col("x_min") < F.col("x_max")) & (F.col("y_min") < F.col("y_max"))).select(
        "n", slope.alias("slope"), (F.col("mean_y") - slope * F.col("mean_x")).alias("intercept"), "x_min", "x_max", "y_min", "y_max",
        F.get(names, F.col("i")).alias("x"), F.get(names, F.col("j")).alias("y"),
    )


def heatmap(cells: DataFrame) -> DataFrame:
    """Correlation cells as printed, two decimals."""
    return cells.withColumn("value", F.round("value", 2))


def time_lines(
    df: DataFrame, time_col: str, columns: Sequence[str], frequency: str, tie: Sequence[str] = (), max_columns: int | None = None
) -> DataFrame:
    """Points of the time-series chart: bucket means, or raw values of an irregular series."""
    chosen = list(columns)[:max_columns]
    if frequency == "irregular":
        return irregular_series(df, time_col, chosen, tie)
    lines = resample(df, time_col, chosen, frequency).select(
        "column_name", F.col("bucket").alias("datetime"), F.col("mean").alias("value")
    )
    return lines.filter(F.col("value").isNotNull())


def line_means(lines: DataFrame) -> DataFrame:
    """The dashed overall-mean line of each time-series chart."""
    return lines.groupBy("column_name").agg(F.avg("value").alias("overall_mean"))
