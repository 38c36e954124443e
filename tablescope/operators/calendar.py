"""When things happen: range, gaps and calendar distributions of a datetime column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.clean import micros
from tablescope.operators.quality import ratio
from tablescope.plans.materialize import settled
from tablescope.plans.ordered import FEW_ROWS, counted, with_previous
from tablescope.plans.selection import weighted_quantiles
from tablescope.plans.small import small_table
from tablescope.plans.wide import quoted

TOP_INTERVALS, MAX_DAYS = 10, 100
SECOND = 1_000_000
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def when_of(time_col: str) -> Column:
    return F.col(quoted(time_col)).cast("timestamp_ntz")


def range_measures(time_col: str) -> dict[str, Column]:
    ts = when_of(time_col)
    return {"min_datetime": F.min(ts), "max_datetime": F.max(ts), "valid_count": F.count(ts), "missing_count": F.count_if(ts.isNull())}


def time_range(df: DataFrame, time_col: str, base: DataFrame | None = None) -> DataFrame:
    """``base`` is the one row of ``range_measures`` where that is at hand."""
    span = micros(F.col("max_datetime")) - micros(F.col("min_datetime"))
    empty = F.col("valid_count") == 0
    base = df.agg(*[m.alias(k) for k, m in range_measures(time_col).items()]) if base is None else base
    return base.select(
        F.lit(time_col).alias("column_name"), "min_datetime", "max_datetime",
        (span / SECOND).alias("span_seconds"), (span / SECOND / 86400).alias("span_days"), "valid_count", "missing_count",
        F.when(empty, "skipped").otherwise("ok").alias("status"),
        F.when(empty, "no_valid_datetime_values").alias("reason"),
    )


def gap_counts(df: DataFrame, time_col: str) -> DataFrame:
    """``gap`` (microseconds between neighbours in time order) and how often it occurs.

    Equal timestamps are folded first: one seen c times adds c - 1 gaps of zero. Only distinct
    timestamps are put in order.
    """
    times = (
        df.select(when_of(time_col).alias("ts"))
        .filter(F.col("ts").isNotNull())
        .groupBy("ts")
        .agg(F.count("*").alias("copies"))
        .select(micros(F.col("ts")).alias("us"), "copies")
    )
    times, few = counted(times)
    between = with_previous(times, ["us"], "us", few=few).select(
        F.inline(
            F.array(
                F.struct((F.col("us") - F.col("previous")).alias("gap"), F.lit(1).cast("long").alias("n")),
                F.struct(F.lit(0).cast("long").alias("gap"), (F.col("copies") - 1).alias("n")),
            )
        )
    )
    return between.filter(F.col("gap").isNotNull() & (F.col("n") > 0)).groupBy("gap").agg(F.sum("n").alias("weight"))


def gap_table(df: DataFrame, time_col: str) -> DataFrame:
    """The gaps and their counts, written once for all reports on them."""
    return settled(gap_counts(df, time_col))


def gap_summary(gaps: DataFrame) -> DataFrame:
    """total, mean, median, min, max in seconds of a written gap table.

    The median is found from the counts.
    """
    gap, weight = F.col("gap"), F.col("weight")
    row = gaps.agg(
        F.count("*").alias("gaps"), F.coalesce(F.sum(weight), F.lit(0)).alias("total"),
        (F.sum(gap.cast("decimal(38,0)") * weight).cast("double") / F.sum(weight) / SECOND).alias("mean"), F.min(gap).alias("low"), F.max(gap).alias("high"),
    ).first()
    middle = weighted_quantiles(gaps, [0.5], value="gap", few=row["gaps"] <= FEW_ROWS).first()["quantiles"][0] if row["gaps"] else None
    seconds = [None if x is None else x / SECOND for x in (middle, row["low"], row["high"])]
    return small_table(gaps.sparkSession, [(row["total"], row["mean"], *seconds)],
        "total_intervals long, mean_interval_seconds double, median_interval_seconds double, min_interval_seconds double, max_interval_seconds double")


def time_intervals(df: DataFrame, time_col: str, gaps: DataFrame | None = None) -> DataFrame:
    """Gaps between consecutive times, zero gaps included."""
    few = F.col("total_intervals") == 0
    return gap_summary(gap_table(df, time_col) if gaps is None else gaps).select(
        F.lit(time_col).alias("column_name"), "*",
        F.when(few, "skipped").otherwise("ok").alias("status"),
        F.when(few, "insufficient_datetime_values").alias("reason"),
    )


def top_intervals(df: DataFrame, time_col: str, top_n: int = TOP_INTERVALS, gaps: DataFrame | None = None) -> DataFrame:
    """The most frequent gaps, with the number of different ones and whether any were left out."""
    gaps = gap_table(df, time_col) if gaps is None else gaps
    known = gaps.agg(F.sum("weight").alias("n"), F.count("*").alias("kinds")).first()  # two numbers
    return gaps.orderBy(F.desc("weight"), "gap").limit(top_n).select(
        (F.col("gap") / SECOND).alias("interval_seconds"),
        (F.col("gap") / SECOND / 60).alias("interval_minutes"),
        (F.col("gap") / SECOND / 3600).alias("interval_hours"),
        F.col("weight").alias("count"),
        (F.col("weight") / F.lit(known["n"] or 1)).alias("ratio"),
        F.lit(known["kinds"]).cast("long").alias("total"), F.lit(known["kinds"] > top_n).alias("truncated"),
    )


def clock_counts(df: DataFrame, time_col: str) -> DataFrame:
    """``day, hour, n``: rows per hour of each day, from which hourly, daily and weekday counts follow."""
    ts = when_of(time_col)
    return df.select(F.to_date(ts).alias("day"), F.hour(ts).alias("hour")).filter(F.col("day").isNotNull()).groupBy("day", "hour").agg(F.count("*").alias("n"))


def _slots(hours: DataFrame, slot: Column, slots: int, name: str) -> DataFrame:
    counts = hours.groupBy(slot.alias("slot")).agg(F.sum("n").alias("n"))
    # Folds into one row of counts first: the number of slots is fixed.
    row = counts.agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"), F.sum("n").alias("total"))
    return row.filter(F.col("total") > 0).select(
        F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias(name), "m", "total"
    ).select(
        name,
        F.coalesce(F.try_element_at("m", F.col(name)), F.lit(0)).cast("long").alias("count"),
        ratio(F.coalesce(F.try_element_at("m", F.col(name)), F.lit(0)), F.col("total")).alias("ratio"),
    )


def hourly_distribution(df: DataFrame, time_col: str, hours: DataFrame | None = None) -> DataFrame:
    """All 24 hours with counts and shares; ``hours`` is the ``clock_counts`` where they are at hand."""
    return _slots(clock_counts(df, time_col) if hours is None else hours, F.col("hour"), 24, "hour")


def weekday_distribution(df: DataFrame, time_col: str, hours: DataFrame | None = None) -> DataFrame:
    """All seven weekdays, Monday first."""
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    out = _slots(clock_counts(df, time_col) if hours is None else hours, F.weekday("day"), 7, "weekday_index")
    return out.select(F.get(names, F.col("weekday_index")).alias("weekday"), "weekday_index", "count", "ratio")


def daily_counts(df: DataFrame, time_col: str) -> DataFrame:
    return (
        df.select(F.to_date(when_of(time_col)).alias("day"))
        .filter(F.col("day").isNotNull())
        .groupBy("day")
        .agg(F.count("*").alias("count"))
    )


def daily_distribution(df: DataFrame, time_col: str, max_results: int = MAX_DAYS, hours: DataFrame | None = None) -> DataFrame:
    """The last ``max_results`` days, with the number of days there are and whether any were left out."""
    days = daily_counts(df, time_col) if hours is None else hours.groupBy("day").agg(F.sum("n").alias("count"))
    total = days.count()
    return days.orderBy(F.desc("day")).limit(max_results).select(
        "day", "count", F.lit(total).cast("long").alias("unique_dates"), F.lit(total > max_results).alias("truncated")
    )
