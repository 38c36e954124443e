"""Interactive exploration: filters, time buckets, grouped and normalised series, thinning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.clean import finite, from_micros, micros
from tablescope.operators.calendar import SECOND, when_of
from tablescope.operators.categorical import MISSING_LABEL, label
from tablescope.operators.charts import BINS, bin_of, bounds_of
from tablescope.operators.sampling import mix, uniform_sample
from tablescope.operators.statistics import fences, number
from tablescope.plans.materialize import materialize, settled
from tablescope.plans.ordered import with_position
from tablescope.plans.selection import column_quantiles
from tablescope.plans.small import small_table
from tablescope.plans.wide import quoted, unpivot

OTHER = "其他"
PAGE, PIE_CATEGORIES, TOP_GROUPS = 15, 20, 15
MANY_TIMES = 5_000
SCATTER_POINTS, LINE_BINS = 20_000, 1_000
ENVELOPE_BINS, FEW_NEIGHBOURS, PROTECTED_SHARE = 96, 8, 0.01
FAR_REACH, FAR_SHARE = 3.0, 0.20
# Tail share left out of an axis, its margin, and how much longer the full range must be.
TAIL_SHARE, AXIS_MARGIN, LONG_TAIL = 0.005, 0.06, 1.6

STEPS = {"hour": 3600 * SECOND, "day": 86400 * SECOND}


def find_identifier(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose identifier contains ``text``, upper and lower case alike."""
    return df.filter(F.lower(label(column)).contains(text.lower()))


def find_combination(df: DataFrame, parts: Mapping[str, object] | DataFrame) -> DataFrame:
    """Rows matching up to four identifier fields, or any of a table of combinations (semi-join)."""
    if isinstance(parts, DataFrame):
        condition = F.lit(True)
        # In the types of df: the same number matches however the table of combinations stores it.
        told = F.lit(True)
        for i, c in enumerate(parts.columns):
            told = told & (F.col(quoted(c)).isNull() | F.col(quoted(c)).try_cast(df.schema[c].dataType).isNotNull())
            condition = condition & F.col(quoted(c)).eqNullSafe(F.col(f"_w{i}"))
        wanted = parts.filter(told).select(*[F.col(quoted(c)).try_cast(df.schema[c].dataType).alias(f"_w{i}") for i, c in enumerate(parts.columns)])
        return df.join(wanted, condition, "left_semi")
    for column, value in parts.items():
        df = df.filter(F.col(quoted(column)) == F.lit(value))
    return df


def keep_range(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    c = F.col(quoted(column))
    if low is not None:
        df = df.filter(c >= low)
    return df if high is None else df.filter(c <= high)


def keep_categories(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    return df.filter(F.col(quoted(column)).isin(list(values)))


def keep_time(df: DataFrame, time_col: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows inside a time range; compared on the stored column so that the filter reaches the scan."""
    c = F.col(quoted(time_col))
    if start is not None:
        df = df.filter(c >= F.lit(start).cast("timestamp_ntz"))
    return df if end is None else df.filter(c <= F.lit(end).cast("timestamp_ntz"))


def time_key(time_col: str, granularity: str) -> Column:
    """Bucket of a time: ``hour``, ``day`` or ``all`` (the time itself)."""
    ts = when_of(time_col)
    if granularity == "all":
        return ts
    step = STEPS[granularity]
    return from_micros(F.floor(micros(ts) / step) * step)


def bucketed_series(
    df: DataFrame, time_col: str, columns: Sequence[str], granularity: str = "all", how: str = "mean", group: str | None = None
) -> DataFrame:
    """Mean or sum of every column per time bucket and, if asked, per group."""
    agg = {"mean": F.avg, "sum": F.sum}[how]
    keep = df.select(
        time_key(time_col, granularity).alias("bucket"),
        *([F.coalesce(label(group), F.lit(MISSING_LABEL)).alias("group")] if group else []),
        # Numbered, so that a column called like a key is not taken for it.
        *[number(c).alias(f"v{i}") for i, c in enumerate(columns)],
    ).filter(F.col("bucket").isNotNull())
    keys = ["bucket", *(["group"] if group else [])]
    cells = unpivot(keep, {c: finite(F.col(f"v{i}")) for i, c in enumerate(columns)}, keys)
    return cells.filter(F.col("value").isNotNull()).groupBy("column_name", *keys).agg(agg("value").alias("value"))


def shared_times(df: DataFrame, time_col: str) -> DataFrame:
    """Rows, distinct times and whether several rows share a time."""
    ts = when_of(time_col)
    # Folding equal times first keeps a crowded time out of a single task.
    folded = df.select(ts.alias("t")).filter(F.col("t").isNotNull()).groupBy("t").agg(F.count("*").alias("n"))
    rows, times = F.coalesce(F.sum("n"), F.lit(0)), F.count("*")
    return folded.agg(rows.alias("rows"), times.alias("times"), (rows > times).alias("shared"))


def default_granularity(df: DataFrame, time_col: str, many: int = MANY_TIMES) -> DataFrame:
    """Whether hourly or daily buckets make sense, and the one to start with."""
    times = df.select(when_of(time_col).alias("t")).filter(F.col("t").isNotNull()).groupBy("t").agg(F.count("*").alias("n"))
    clock = F.coalesce(F.bool_or(micros(F.col("t")) % (86400 * SECOND) != 0), F.lit(False))
    return times.agg(F.count("*").alias("times"), clock.alias("offered")).select(
        "times", "offered", F.when(F.col("offered") & (F.col("times") > many), "hour").otherwise("all").alias("granularity")
    )


def normalised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns squeezed into 0..1 by their own extremes; constant columns become null."""
    bounds = bounds_of(df, columns)
    out = {}
    for c in columns:
        low, high, _ = bounds.get(c, (0.0, 0.0, 0.0))
        out[c] = (finite(F.col(quoted(c))) - low) / (high - low) if c in bounds else F.lit(None).cast("double")
    return df.withColumns(out)


def normalised_series(
    df: DataFrame, time_col: str, columns: Sequence[str], granularity: str = "all", how: str = "mean", group: str | None = None
) -> DataFrame:
    """Bucketed series in 0..1: means use the rows' extremes, sums the extremes of the summed series."""
    if how == "mean":
        return bucketed_series(normalised(df, columns), time_col, columns, granularity, how, group)
    series = materialize(bucketed_series(df, time_col, columns, granularity, how, group))
    extremes = series.groupBy("column_name").agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    scaled = F.try_divide(F.col("value") - F.col("_low"), F.col("_high") - F.col("_low"))
    return series.join(F.broadcast(extremes), "column_name").withColumn("value", scaled).drop("_low", "_high")


def grouped_histogram(df: DataFrame, column: str, group: str, bins: int = BINS) -> DataFrame:
    """Every group counted on one bin layout, with its share of the bin; larger groups come first."""
    bounds = bounds_of(df, [column])
    if not bounds:
        return small_table(df.sparkSession, [], "bin int, group string, group_rows long, count long, share double"
        )
    low, high, _ = bounds[column]
    counts = (
        df.select(
            bin_of(finite(F.col(quoted(column))), low, high, bins).alias("bin"),
            F.coalesce(label(group), F.lit(MISSING_LABEL)).alias("group"),
        )
        .filter(F.col("bin").isNotNull())
        .groupBy("bin", "group")
        .agg(F.count("*").alias("count"))
    )
    per_bin = counts.groupBy("bin").agg(F.sum("count").alias("_in_bin"))
    per_group = counts.groupBy("group").agg(F.sum("count").alias("group_rows"))
    return (
        counts.join(F.broadcast(per_bin), "bin")  # at most `bins` rows
        .join(settled(per_group), "group")
        .select("bin", "group", "group_rows", "count", (F.col("count") / F.col("_in_bin")).alias("share"))
        .orderBy(F.desc("group_rows"), "group", "bin")
    )


def numeric_by_category(
    df: DataFrame, category: str, columns: Sequence[str], how: str = "mean", page_size: int = PAGE
) -> DataFrame:
    """Mean or sum of several columns per category, largest category first, in pages."""
    agg = {"mean": "avg", "sum": "sum"}[how]
    rows = df.select(
        F.coalesce(label(category), F.lit(MISSING_LABEL)).alias("category"),
        *[finite(F.col(quoted(c))).alias(f"v{i}") for i, c in enumerate(columns)],
    )
    stats = rows.groupBy("category").agg(
        F.count("*").alias("rows"), *[F.expr(f"{agg}(v{i}) AS v{i}") for i in range(len(columns))]
    )
    placed = with_position(stats, [F.desc("rows"), "category"], name="rank")
    entries = ", ".join(f"struct({i} AS c, v{i} AS value)" for i in range(len(columns)))
    names = F.array(*[F.lit(c) for c in columns])
    return placed.select("category", "rows", "rank", F.expr(f"inline(array({entries}))")).select(
        F.get(names, F.col("c")).alias("column_name"), "category", "rows", F.col("rank"),
        F.floor(F.col("rank") / page_size).alias("page"), "value",
    )


def common_scale(table: DataFrame) -> DataFrame:
    """Smallest and largest value over all pages, per column."""
    return table.groupBy("column_name").agg(F.min("value").alias("scale_min"), F.max("value").alias("scale_max"))


def merged_groups(df: DataFrame, column: str, n: int = TOP_GROUPS, other: str = OTHER) -> DataFrame:
    """The ``n`` largest groups by name and the rest as one; counts and shares add up to the whole."""
    counts = df.select(F.coalesce(label(column), F.lit(MISSING_LABEL)).alias("category")).groupBy("category").agg(
        F.count("*").alias("count")
    )
    largest = counts.orderBy(F.desc("count"), "category").limit(n).select("category", F.lit(True).alias("_shown"))
    merged = (
        counts.join(F.broadcast(largest), "category", "left")  # n rows
        .select(F.when(F.col("_shown"), F.col("category")).otherwise(F.lit(other)).alias("category"), "count", "_shown")
        .groupBy("category")
        .agg(F.sum("count").alias("count"), F.count("*").alias("groups"))
    )
    everything = Window.partitionBy(F.lit(0))  # over at most n + 1 rows
    return merged.withColumn("share", F.col("count") / F.sum("count").over(everything))


def category_share(df: DataFrame, column: str, n: int = PIE_CATEGORIES) -> DataFrame:
    """Pie slices: the 20 largest categories and everything else."""
    return merged_groups(df, column, n)


def _scatter_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.withColumns({"_x": finite(F.col(quoted(x))), "_y": finite(F.col(quoted(y)))}).filter(
        F.col("_x").isNotNull() & F.col("_y").isNotNull()
    )


def drop_far_outliers(df: DataFrame, x: str, y: str, reach: float = FAR_REACH, share: float = FAR_SHARE) -> DataFrame:
    """Leave out points beyond three quartile ranges on either axis, unless that is over a fifth of them."""
    pairs = _scatter_pairs(df, x, y)
    limits = fences(pairs, ["_x", "_y"], reach)
    if len(limits) < 2:
        return pairs.drop("_x", "_y")
    inside = F.lit(True)
    for c, (low, high) in limits.items():
        inside = inside & F.col(c).between(low, high)
    total, kept = pairs.agg(F.count("*"), F.count_if(inside)).first()
    return (pairs if total - kept > share * total else pairs.filter(inside)).drop("_x", "_y")


def thin_scatter(
    df: DataFrame, x: str, y: str, key: Sequence[str], budget: int = SCATTER_POINTS, bins: int = ENVELOPE_BINS, seed: int = 42
) -> DataFrame:
    """At most ``budget`` points that keep the outline and the lonely points of the cloud.

    ``role`` says why a point stays: ``envelope`` (extreme of its column or row of bins), ``isolated``
    (few neighbours in the 3 x 3 cells around it, loneliest first) or ``uniform``.
    """
    points = _scatter_pairs(df, x, y)
    total, x0, x1, y0, y1 = points.agg(F.count("*"), F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
    if total <= budget:
        return points.drop("_x", "_y").withColumn("role", F.lit("all"))

    def cell(c: str, low: float, high: float) -> Column:
        return bin_of(F.col(c), low, high, bins) if low < high else F.lit(0)

    placed = points.withColumns({"_bx": cell("_x", x0, x1), "_by": cell("_y", y0, y1)})
    row_key = F.struct(*[F.col(quoted(k)).alias(f"k{i}") for i, k in enumerate(key)])

    def extremes(by: str, value: str) -> DataFrame:
        order = F.struct(F.col(value), row_key.alias("k"))
        reverse = F.struct((-F.col(value)).alias("v"), row_key.alias("k"))
        ends = placed.groupBy(by).agg(F.min_by(row_key, order).alias("a"), F.min_by(row_key, reverse).alias("b"))
        return ends.select(F.explode(F.array("a", "b")).alias("k"))

    envelope = extremes("_bx", "_y").unionByName(extremes("_by", "_x")).distinct().withColumn("role", F.lit("envelope"))
    cells = placed.groupBy("_bx", "_by").agg(F.count("*").alias("n"))
    around = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    crowd = (
        cells.select("_bx", "_by", "n", F.explode(around).alias("o"))
        .groupBy((F.col("_bx") + F.col("o.dx")).alias("_bx"), (F.col("_by") + F.col("o.dy")).alias("_by"))
        .agg(F.sum("n").alias("_crowd"))
        .filter(F.col("_crowd") - 1 <= FEW_NEIGHBOURS)
    )
    lonely = (
        placed.join(F.broadcast(crowd), ["_bx", "_by"])  # at most (bins + 2) squared rows
        .select(row_key.alias("k"), "_crowd")
        .orderBy("_crowd", F.xxhash64(F.lit(seed), "k"), "k")
        .limit(max(0, int(budget * PROTECTED_SHARE)))
        .select("k", F.lit("isolated").alias("role"))
    )
    protected = materialize(
        envelope.unionByName(lonely).groupBy("k").agg(F.min("role").alias("role"))  # below 4 * bins + 1 % of the budget
    )
    kept = protected.count()
    named = points.withColumn("_key", row_key)
    special = named.join(F.broadcast(protected), F.col("_key") == F.col("k")).drop("k")
    rest = named.join(F.broadcast(protected.select("k")), F.col("_key") == F.col("k"), "left_anti")
    filler = uniform_sample(rest, max(0, budget - kept), ["_key"], seed).withColumn("role", F.lit("uniform"))
    return special.unionByName(filler).drop("_x", "_y", "_key")


def thin_lines(lines: DataFrame, x: str, series: str, value: str, bins: int = LINE_BINS) -> DataFrame:
    """Per stretch of x and series only the lowest and the highest point, so spikes survive."""
    at = micros(F.col(quoted(x))) if lines.schema[x].dataType.typeName().startswith("timestamp") else number(x)
    known = lines.withColumn("_at", at).filter(F.col("_at").isNotNull() & F.col(quoted(value)).isNotNull())
    low, high = known.agg(F.min("_at").cast("double"), F.max("_at").cast("double")).first()
    stretch = bin_of(F.col("_at"), low, high, bins) if low is not None and low < high else F.lit(0)
    point = F.struct(*[quoted(c) for c in lines.columns])
    up = F.struct(F.col(quoted(value)).alias("v"), F.col("_at").alias("a"))
    down = F.struct((-F.col(quoted(value))).alias("v"), F.col("_at").alias("a"))
    ends = known.groupBy(quoted(series), stretch.alias("_stretch")).agg(
        F.min_by(point, up).alias("a"), F.min_by(point, down).alias("b")
    )
    return ends.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("p")).select("p.*")


def strip(
    df: DataFrame, column: str, group: str | None, key: Sequence[str], seed: int = 42, keep: Sequence[str] = ()
) -> DataFrame:
    """One-dimensional scatter: value, group, band (largest group first) and a repeatable offset in 0..1."""
    name = F.coalesce(label(group), F.lit(MISSING_LABEL)) if group else F.lit("")
    rows = df.select(
        *[quoted(c) for c in keep], finite(F.col(quoted(column))).alias("value"), name.alias("group"),
        (F.pmod(mix(seed, *key), F.lit(1_000_000)) / 1_000_000.0).alias("offset"),
    ).filter(F.col("value").isNotNull())
    bands = with_position(
        rows.groupBy("group").agg(F.count("*").alias("group_rows")), [F.desc("group_rows"), "group"], name="band"
    )
    return rows.join(settled(bands), "group").select(*[quoted(c) for c in keep], "value", "group", "band", "offset")


def axis_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, low, high, clipped``: the range to draw, without long tails, one row per column that has values."""
    found = column_quantiles(df, {c: finite(F.col(quoted(c))) for c in columns}, [0.0, TAIL_SHARE, 1 - TAIL_SHARE, 1.0])
    rows = []
    for name, (_, (lowest, low, high, highest)) in found.items():
        margin = AXIS_MARGIN * (high - low)
        clipped = low < high and highest - lowest > LONG_TAIL * (high - low + 2 * margin)
        rows.append((name, *((low - margin, high + margin) if clipped else (lowest, highest)), clipped))
    return small_table(df.sparkSession, rows, "column_name string, low double, high double, clipped boolean")
