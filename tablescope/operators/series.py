"""Time series: frequency, resampling, summaries, trends and anomalies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.clean import finite, from_micros, micros
from tablescope.functions.rolling import block_scores
from tablescope.functions.trend import block_fits
from tablescope.operators.calendar import SECOND, gap_summary, gap_table, when_of
from tablescope.operators.statistics import number
from tablescope.plans.materialize import settled
from tablescope.plans.ordered import BLOCK, SEQ, counted, ordered_blocks, with_weights_below
from tablescope.plans.selection import column_quantiles, weighted_quantiles
from tablescope.plans.small import small_table
from tablescope.plans.wide import per_value, quoted, unpivot
from tablescope.plans.workers import importable

MIN_OBSERVATIONS = 3
WINDOW, THRESHOLD = 7, 3.5
TOLERANCE = 0.20
BORDER_BYTES = 64_000_000  # border rows of a series, a few a block, that are broadcast; beyond that they are joined by a shuffle

# Seconds of the regular frequencies, in the order they are tried.
FREQUENCIES = {
    "minute": 60.0, "hourly": 3600.0, "daily": 86400.0, "weekly": 604800.0, "monthly": 30.4375 * 86400, "yearly": 365.25 * 86400,
}


def detect_frequency(df: DataFrame, time_col: str, tolerance: float = TOLERANCE, gaps: DataFrame | None = None) -> DataFrame:
    """Frequency from the median of the positive gaps."""
    gaps = gap_table(df, time_col) if gaps is None else gaps
    summary = gap_summary(gaps.filter(F.col("gap") > 0))
    median = F.col("median_interval_seconds")
    name = F.lit("irregular")
    for label, seconds in reversed(FREQUENCIES.items()):
        name = F.when(F.abs(median - seconds) / seconds <= tolerance, label).otherwise(name)
    none = F.col("total_intervals") == 0
    return summary.select(
        F.lit(time_col).alias("column_name"), F.when(~none, name).alias("detected"), "*",
        F.when(none, "skipped").otherwise("ok").alias("status"),
        F.when(none, "no_positive_time_intervals").alias("reason"),
    )


_STEPS = {"minute": 60, "hourly": 3600, "daily": 86400}


def bucket(ts: Column, frequency: str) -> Column:
    """Label of the bucket: start of the minute, hour or day; Sunday ending the week; last day of month or year."""
    if frequency in _STEPS and frequency != "daily":
        step = _STEPS[frequency] * SECOND
        return from_micros(F.floor(micros(ts) / step) * step)
    day = F.to_date(ts)
    if frequency == "daily":
        end = day
    elif frequency == "weekly":
        end = F.date_add(day, 6 - F.weekday(day))
    elif frequency == "monthly":
        end = F.last_day(day)
    elif frequency == "yearly":
        end = F.make_date(F.year(day), F.lit(12), F.lit(31))
    else:
        raise ValueError(f"not a regular frequency: {frequency}")
    return end.cast("timestamp_ntz")


def calendar_of(df: DataFrame, time_col: str, frequency: str) -> DataFrame:
    """Every bucket from the first to the last, generated on the executors from a range of numbers."""
    ts = when_of(time_col)
    # Buckets keep the order of times.
    ends = df.agg(F.min(ts).alias("low"), F.max(ts).alias("high")).select(*[bucket(F.col(c), frequency).alias(c) for c in ("low", "high")])
    if frequency in _STEPS or frequency == "weekly":
        step = _STEPS.get(frequency, 7 * 86400) * SECOND
        first, last = ends.select(micros(F.col("low")), micros(F.col("high"))).first()
        steps = 0 if first is None else (last - first) // step + 1
        return df.sparkSession.range(steps).select(from_micros(F.lit(first or 0) + F.col("id") * step).alias("bucket"))
    months = 1 if frequency == "monthly" else 12
    low, high = ends.select(F.date_format("low", "yyyy-MM-dd"), F.date_format("high", "yyyy-MM-dd")).first()
    if low is None:
        steps = 0
    else:
        steps = ((int(high[:4]) - int(low[:4])) * 12 + int(high[5:7]) - int(low[5:7])) // months + 1
    start = F.trunc(F.lit(low or "1970-01-01").cast("date"), "month")
    return df.sparkSession.range(steps).select(
        F.last_day(F.add_months(start, (F.col("id") * months).cast("int"))).cast("timestamp_ntz").alias("bucket")
    )


def resample(df: DataFrame, time_col: str, columns: Sequence[str], frequency: str) -> DataFrame:
    """mean, median, min, max and count per bucket and column; empty buckets stay, with count 0.

    Medians are exact and come from ranked (bucket, value) counts, so one crowded bucket is spread
    over many tasks.
    """
    cells = df.select(
        bucket(when_of(time_col), frequency).alias("bucket"), *[number(c).alias(f"v{i}") for i, c in enumerate(columns)]
    ).filter(F.col("bucket").isNotNull())
    # Columns go by their numbers until the end, and buckets come first: rows are then told apart by a number alone, for the most part.
    cells = cells.select("bucket", F.posexplode(F.array(*[F.col(f"v{i}") for i in range(len(columns))])).alias("c", "value")).filter("value IS NOT NULL")
    keys = ["bucket", "c"]
    plain = cells.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("count")
    )
    weights = cells.groupBy(*keys, "value").agg(F.count("*").alias("weight"))
    medians = weighted_quantiles(weights, [0.5], keys).select(*keys, F.col("quantiles")[0].alias("median"))
    names = F.array(*[F.lit(c) for c in columns])
    slots = calendar_of(df, time_col, frequency).select(F.posexplode(names).alias("c", "column_name"), "bucket")
    return (
        slots.join(plain, keys, "left")
        .join(medians, keys, "left")
        .select("column_name", "bucket", "mean", "median", "min", "max", F.coalesce("count", F.lit(0)).alias("count"))
    )


def irregular_series(df: DataFrame, time_col: str, columns: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """``(column, time, value)`` without nulls, in time order."""
    ts = when_of(time_col).alias("datetime")
    renamed = {t: f"_tie{i}" for i, t in enumerate(tie)}
    wide = df.select(ts, *[F.col(quoted(t)).alias(r) for t, r in renamed.items()], *[number(c).alias(f"v{i}") for i, c in enumerate(columns)])
    cells = unpivot(wide, {c: F.col(f"v{i}") for i, c in enumerate(columns)}, ["datetime", *renamed.values()])
    kept = cells.filter(F.col("datetime").isNotNull() & F.col("value").isNotNull())
    return kept.orderBy("column_name", "datetime", *renamed.values()).drop(*renamed.values())


def time_index_means(df: DataFrame, index_col: str, columns: Sequence[str]) -> DataFrame:
    """Mean of each column per value of an ordered index such as a week number."""
    cells = unpivot(
        df.select(number(index_col).alias("time_index"), *[number(c).alias(f"v{i}") for i, c in enumerate(columns) if c != index_col]),
        {c: F.col(f"v{i}") for i, c in enumerate(columns) if c != index_col},
        ["time_index"],
    )
    return (
        cells.filter(F.col("time_index").isNotNull())
        .groupBy("column_name", "time_index")
        .agg(F.avg("value").alias("mean"))
        .filter(F.col("mean").isNotNull())
    )


def _timed(df: DataFrame, time_col: str) -> DataFrame:
    return df.filter(when_of(time_col).isNotNull())


def series_summary(
    df: DataFrame, time_col: str, columns: Sequence[str], min_observations: int = MIN_OBSERVATIONS, base: DataFrame | None = None,
    middles: Mapping[str, float] | None = None,
) -> DataFrame:
    """count, missing, mean, median and std over rows with a valid time.

    ``base`` (``column_name, count, missing, mean, std``) and ``middles`` (medians) of these rows are found unless they are at hand.
    """
    timed = _timed(df, time_col)
    if middles is None:
        middles = {c: q[0] for c, (_, q) in column_quantiles(timed, {c: number(c) for c in columns}, [0.5]).items()}
    v = F.col("value")
    medians = small_table(df.sparkSession, [(c, m) for c, m in middles.items() if c in columns], "column_name string, median double")
    table = per_value(timed, {c: number(c) for c in columns}, {
        "count": F.count(v), "missing": F.count_if(v.isNull()), "mean": F.avg(v), "std": F.stddev_samp(v),
    }) if base is None else base.filter(F.col("column_name").isin(list(columns)))
    table = table.withColumns({"std": F.coalesce("std", F.lit(0.0)), "missing_count": F.col("missing")})
    table = table.join(medians, "column_name", "left").fillna(0, ["count"])
    few = F.col("count") < min_observations
    shown = [F.when(~few, F.col(c)).alias(c) for c in ("missing_count", "mean", "median", "std")]
    return table.select(
        "column_name", "count", *shown, F.when(few, "skipped").otherwise("ok").alias("status"),
        F.when(few, "insufficient_observations").alias("reason"),
    )


def timed_blocks(df: DataFrame, time_col: str, columns: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Rows with a valid time put in order once, over range blocks: ``datetime, _tie0, ..., _v0, ...`` with block and place."""
    values = [f"_v{i}" for i in range(len(columns))]
    renamed = {t: f"_tie{i}" for i, t in enumerate(tie)}
    narrow = df.select(
        when_of(time_col).alias("datetime"), *[F.col(quoted(t)).alias(r) for t, r in renamed.items()],
        *[number(c).alias(v) for c, v in zip(columns, values, strict=True)],
    ).filter(F.col("datetime").isNotNull())
    return ordered_blocks(narrow, ["datetime", *renamed.values(), *values])


_FIT = {
    "n": "long", "mean_x": "double", "mean_y": "double", "sxx": "double", "sxy": "double", "syy": "double", "low": "double", "high": "double",
    "first_value": "double", "last_value": "double",
}


def _fit_parts(blocks: DataFrame, columns: int, ties: int) -> DataFrame:
    """``c, _block, n`` and the other sums of each block and column (``side`` 1), and rows whose time and ties go on in a neighbouring block, perhaps.

    Rows of one time and equal ties take their places by value, column by column. Where such rows lie inside one block that is
    settled there; the first (``side`` 0) and the last (``side`` 2) ones of a block are handed on as they are.
    """
    importable(blocks.sparkSession)
    values = [f"_v{i}" for i in range(columns)]
    keys = ["datetime", *[f"_tie{i}" for i in range(ties)]]
    kept = [*keys, *values]
    kinds = {f.name: f.dataType for f in blocks.schema.fields}
    schema = T.StructType([T.StructField(BLOCK, T.LongType()), T.StructField("side", T.IntegerType()), T.StructField("c", T.IntegerType()), *[T.StructField(k, kinds[k]) for k in kept]])
    for name, kind in _FIT.items():
        schema = schema.add(name, kind)
    return blocks.select(BLOCK, *kept).mapInArrow(block_fits(BLOCK, keys, values, list(_FIT)), schema)


def _fitted(blocks: DataFrame, columns: Sequence[str], ties: int) -> DataFrame:
    """``column_name`` and what the line over places in time order is made of: ``count``, fit, average, extremes, first and last value."""
    values = [f"_v{i}" for i in range(len(columns))]
    renamed = [f"_tie{i}" for i in range(ties)]
    parts = settled(_fit_parts(blocks, len(columns), ties))
    numbers = {i: F.col(v) for i, v in enumerate(values)}
    entries = F.array(*[F.struct(F.lit(i).alias("c"), finite(v).alias("value")) for i, v in numbers.items()])
    loose, few = counted(parts.filter("side <> 1").select(BLOCK, "side", "datetime", *renamed, F.inline(entries)).filter("value IS NOT NULL"))
    loose = with_weights_below(loose.withColumn("_one", F.lit(1).cast("long")), ["datetime", *renamed, "value"], {"_one": "_q"}, ["c"], few=few)
    number_of = loose.groupBy("c", BLOCK).agg(F.count_if(F.col("side") == 0).alias("_s0"), F.count_if(F.col("side") == 2).alias("_s2"))
    # One row per block and column.
    before = Window.partitionBy("c").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.filter("side = 1").select("c", BLOCK, *_FIT).join(number_of, ["c", BLOCK], "left").fillna(0, ["_s0", "_s2"])
    sums = sums.withColumns({
        "_kept": F.coalesce(F.sum("n").over(before), F.lit(0)), "_base": F.coalesce(F.sum(F.col("n") + F.col("_s0") + F.col("_s2")).over(before), F.lit(0)) + F.col("_s0")})
    sums = settled(sums)
    inside = sums.filter("n > 0").select(
        "c", "n", (F.col("_base") + F.col("mean_x")).alias("mean_x"), "mean_y", "sxx", "sxy", "syy", "low", "high", F.col("_base").alias("x_first"), "first_value",
        (F.col("_base") + F.col("n") - 1).alias("x_last"), "last_value")
    spots = sums.select(F.col("c").alias("_c"), F.col(BLOCK).alias("_b"), F.col("_kept").alias("_kept_0"), (F.col("_kept") + F.col("n")).alias("_kept_2"))
    met = loose.join(spots, (F.col("c") == F.col("_c")) & (F.col(BLOCK) == F.col("_b")))
    place = F.col("_q") + F.when(F.col("side") == 0, F.col("_kept_0")).otherwise(F.col("_kept_2"))
    x, y, n = F.col("x"), F.col("value"), F.count("*")
    # Moments that are centred twice keep their digits where places are large.
    beside = met.withColumn("_place", place).withColumn("x", F.col("_place").cast("double")).groupBy("c").agg(
        n.alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), (F.var_pop(x) * n).alias("sxx"), (F.covar_pop(x, y) * n).alias("sxy"),
        (F.var_pop(y) * n).alias("syy"), F.min(y).alias("low"), F.max(y).alias("high"), F.min("_place").alias("x_first"), F.min_by(y, x).alias("first_value"),
        F.max("_place").alias("x_last"), F.max_by(y, x).alias("last_value"))
    whole = Window.partitionBy("c")
    both = inside.unionByName(beside)
    total = F.sum("n").over(whole)
    both = both.withColumns({k: F.sum(F.col("n") * F.col(m)).over(whole) / total for k, m in (("_mx", "mean_x"), ("_my", "mean_y"))})
    dx, dy, w = F.col("mean_x") - F.col("_mx"), F.col("mean_y") - F.col("_my"), F.col("n")
    summed = both.groupBy("c").agg(
        F.sum("n").alias("count"), F.max("_mx").alias("_mx"), F.max("_my").alias("average"), F.sum(F.col("sxx") + w * dx * dx).alias("_sxx"),
        F.sum(F.col("sxy") + w * dx * dy).alias("_sxy"), F.sum(F.col("syy") + w * dy * dy).alias("_syy"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min_by("first_value", "x_first").alias("first_value"), F.max_by("last_value", "x_last").alias("last_value"))
    slope = F.try_divide("_sxy", "_sxx")
    return summed.select(
        F.get(F.array(*[F.lit(c) for c in columns]), F.col("c")).alias("column_name"), "count", slope.alias("fit_slope"), (F.col("average") - slope * F.col("_mx")).alias("fit_intercept"),
        F.when(F.col("_syy") == 0, 1.0).otherwise(F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx") * F.col("_syy"))).alias("fit_r2"),
        "average", "low", "high", "first_value", "last_value")


def linear_trend(
    df: DataFrame, time_col: str, columns: Sequence[str], tie: Sequence[str] = (), min_observations: int = MIN_OBSERVATIONS, blocks: DataFrame | None = None
) -> DataFrame:
    """Least-squares line of the finite values over their place 0..n-1 in time order.

    All columns are put in order together; ``blocks`` are their ``timed_blocks`` where these are at hand.
    """
    blocks = timed_blocks(df, time_col, columns, tie) if blocks is None and columns else blocks
    fitted = _fitted(blocks, columns, len(tie)) if columns else small_table(df.sparkSession, [],
        "column_name string, count long, fit_slope double, fit_intercept double, fit_r2 double, average double, low double, high double, first_value double, last_value double")
    first, change = F.col("first_value"), F.col("last_value") - F.col("first_value")
    near = 1e-8 + 1e-5 * F.abs(first)
    flat = (F.abs(F.col("low") - first) <= near) & (F.abs(F.col("high") - first) <= near)
    few = F.col("count") < min_observations
    slope = F.when(flat, 0.0).otherwise(F.col("fit_slope"))
    still = F.greatest(F.abs("average"), F.lit(1.0)) * 1e-10
    shown = {
        "direction": F.when(slope > still, "increasing").when(slope < -still, "decreasing").otherwise("stable"),
        "slope": slope,
        "intercept": F.when(flat, first).otherwise(F.col("fit_intercept")),
        "r_squared": F.when(flat, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("fit_r2")))),
        "first_value": first,
        "last_value": F.col("last_value"),
        "change": F.when(flat, 0.0).otherwise(change),
        "change_percent": F.when(flat, 0.0).when(F.abs(first) > 1e-12, change / F.abs(first) * 100),
    }
    names = small_table(df.sparkSession, [(c,) for c in columns], "column_name string")
    return names.join(fitted, "column_name", "left").fillna(0, ["count"]).select(
        "column_name", "count", *[F.when(~few, c).alias(k) for k, c in shown.items()],
        F.when(few, "skipped").otherwise("ok").alias("status"),
        F.when(few, "insufficient_observations").alias("reason"),
    )


def rolling_scores(
    df: DataFrame, time_col: str, columns: Sequence[str], tie: Sequence[str] = (), window: int = WINDOW, blocks: DataFrame | None = None
) -> DataFrame:
    """Robust z-score of every value against its centred rolling median.

    Rows are put in order once, over range blocks (``blocks`` are the ``timed_blocks`` where these are at hand). Every block is then
    read where it lies: only the ``window`` - 1 rows on either side of a border are brought to the neighbours, so no row travels
    twice and no task sees the whole series.
    """
    spark = df.sparkSession
    values = [f"_v{i}" for i in range(len(columns))]
    renamed = {t: f"_tie{i}" for i, t in enumerate(tie)}
    blocks = timed_blocks(df, time_col, columns, tie) if blocks is None else blocks
    halo = max(1, 2 * (window // 2))
    borders = _borders(blocks, values, halo)
    if borders.count() * 2 * halo * len(columns) * 8 <= BORDER_BYTES:
        # Borders come with the first row of a block; the other rows meet nothing and nothing moves.
        joined = blocks.join(F.broadcast(borders), F.when(F.col(SEQ) == 0, F.col(BLOCK)) == F.col("_home"), "left")
    else:
        joined = blocks.join(borders, F.col(BLOCK) == F.col("_home")).sortWithinPartitions(BLOCK, SEQ)
    joined = joined.drop("_home", SEQ)
    kept = ["datetime", *renamed.values()]
    kinds = {f.name: f.dataType for f in blocks.schema.fields}
    schema = T.StructType([T.StructField("position", T.LongType()), *[T.StructField(k, kinds[k]) for k in kept]])
    for v in values:
        for part in ("", "_m", "_s"):
            schema = schema.add(f"{part}{v}", T.DoubleType())
    out = spark.createDataFrame([], schema) if not columns else joined.mapInArrow(block_scores(BLOCK, kept, values, window, halo), schema)
    entries = [
        F.struct(
            F.lit(c).alias("column_name"), F.col(v).alias("value"), F.col(f"_m{v}").alias("rolling_median"),
            F.when(F.col(f"_s{v}") != 0, 0.6745 * (F.col(v) - F.col(f"_m{v}")) / F.col(f"_s{v}")).alias("robust_z_score"),
        )
        for c, v in zip(columns, values, strict=True)
    ]
    return out.select("position", *kept, F.inline(F.array(*entries))).withColumnsRenamed({r: t for t, r in renamed.items()})


def _borders(blocks: DataFrame, values: Sequence[str], halo: int) -> DataFrame:
    """``_home, _first, _before, _after``: place of a block's first row and the values of up to ``halo`` rows on both sides of it.

    A few rows per block; where blocks are shorter than ``halo`` they come from several neighbours.
    """
    sizes = blocks.groupBy(BLOCK).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(F.lit(0)).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    spans = settled(sizes.withColumn("_first", F.coalesce(F.sum("_rows").over(before), F.lit(0))).withColumnRenamed(BLOCK, "_home"))
    near = blocks.join(spans, F.col(BLOCK) == F.col("_home")).filter((F.col(SEQ) < halo) | (F.col(SEQ) >= F.col("_rows") - halo))
    rows = settled(near.select((F.col("_first") + F.col(SEQ)).alias("_place"), F.array(*values).alias("_row")))
    last = F.col("_first") + F.col("_rows")
    # Neighbours are looked for in stretches of ``halo`` places: two lie before a block and two after it.
    asked = spans.withColumn("_last", last).withColumn(
        "_stretch",
        F.explode(F.array_distinct(F.array(*[F.floor(c / halo) for c in (F.col("_first") - halo, F.col("_first") - 1, last, last + halo - 1)]))),
    )
    met = asked.join(rows.withColumn("_cut", F.floor(F.col("_place") / halo)), F.col("_stretch") == F.col("_cut"))
    side = lambda low, high: F.transform(
        F.array_sort(F.collect_list(F.when((F.col("_place") >= low) & (F.col("_place") < high), F.struct("_place", "_row")))), lambda x: x["_row"]
    )
    found = met.groupBy("_home").agg(
        side(F.col("_first") - halo, F.col("_first")).alias("_before"), side(F.col("_last"), F.col("_last") + halo).alias("_after")
    )
    return settled(spans.select("_home", "_first").join(found.withColumnRenamed("_home", "_h"), F.col("_home") == F.col("_h"), "left").drop("_h"))


def anomalies(
    df: DataFrame, time_col: str, columns: Sequence[str], tie: Sequence[str] = (),
    window: int = WINDOW, threshold: float = THRESHOLD, counts: Mapping[str, int] | None = None, blocks: DataFrame | None = None,
) -> DataFrame:
    """Values whose score exceeds ``threshold``; columns with fewer than ``window`` values have none.

    ``blocks`` are the ``timed_blocks`` of all ``columns`` where these are at hand.

    ``counts`` of the values with a valid time are taken unless they are at hand. Where no column has enough values nothing is put in order.
    """
    if counts is None:
        row = _timed(df, time_col).agg(*[F.count(number(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
        counts = dict(zip(columns, row, strict=True))
    usable = [c for c in columns if counts[c] >= window]
    if not usable:
        fields = [F.lit(None).cast("long").alias("position"), when_of(time_col).alias("datetime"), *[F.col(quoted(t)) for t in tie]]
        empty = [F.lit(None).cast(k).alias(n) for n, k in (("column_name", "string"), ("value", "double"), ("rolling_median", "double"), ("robust_z_score", "double"))]
        return df.limit(0).select(*fields, *empty)
    shared = blocks if usable == list(columns) else None
    return rolling_scores(df, time_col, usable, tie, window, shared).filter(F.abs("robust_z_score") > threshold)
