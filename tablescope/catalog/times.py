"""Calendar and time-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.catalog.base import Catalogue, long_sql, same, table
from tablescope.operators import calendar, series

catalogue = Catalogue()
add = catalogue.add


def seconds(a: str, b: str) -> str:
    """Seconds from b to a, exact."""
    return f"((epoch_us({a}) - epoch_us({b})) / 1000000.0)"


@add("h2_time_range", same(
    f"SELECT 'ts' AS column_name, min(ts) AS min_datetime, max(ts) AS max_datetime, {seconds('max(ts)', 'min(ts)')} AS span_seconds, "
    f"{seconds('max(ts)', 'min(ts)')} / 86400 AS span_days, count(ts) AS valid_count, count(*) - count(ts) AS missing_count, "
    "'ok' AS status FROM events", "span_seconds span_days", "valid_count missing_count", "min_datetime max_datetime"))
def h2(spark, folder):
    return calendar.time_range(table(spark, folder, "events"), "ts").drop("reason")


def gaps(source: str, ts: str) -> str:
    return f"SELECT {seconds(ts, f'lag({ts}) OVER (ORDER BY {ts})')} AS g FROM {source} QUALIFY g IS NOT NULL"


INTERVALS = (
    "SELECT '{ts}' AS column_name, count(*) AS total_intervals, avg(g) AS mean_interval_seconds, median(g) AS "
    "median_interval_seconds, min(g) AS min_interval_seconds, max(g) AS max_interval_seconds, 'ok' AS status FROM ({gaps})"
)
INTERVAL_DOUBLES = "mean_interval_seconds median_interval_seconds min_interval_seconds max_interval_seconds"


@add("h3_time_intervals", same(
    INTERVALS.format(ts="ts", gaps=gaps("events", "ts")) + " UNION ALL "
    + INTERVALS.format(ts="l_shipdate", gaps=gaps("lineitem", "l_shipdate")), INTERVAL_DOUBLES, "total_intervals"))
def h3(spark, folder):
    events = calendar.time_intervals(table(spark, folder, "events"), "ts")
    return events.unionByName(calendar.time_intervals(table(spark, folder, "lineitem"), "l_shipdate")).drop("reason")


@add("h4_top_intervals", same(
    "SELECT g AS interval_seconds, g / 60 AS interval_minutes, g / 3600 AS interval_hours, count(*) AS count, "
    f"count(*) / CAST((SELECT count(*) - 1 FROM orders) AS DOUBLE) AS ratio, count(*) OVER () AS total, count(*) OVER () > 10 AS truncated FROM ({gaps('orders', 'o_orderdate')}) GROUP BY g "
    "ORDER BY 4 DESC, 1 LIMIT 10", "interval_seconds interval_minutes interval_hours ratio", "count total"))
def h4(spark, folder):
    return calendar.top_intervals(table(spark, folder, "orders"), "o_orderdate")


@add("h5_hourly_distribution", same(
    "SELECT h.range AS hour, count(e.ts) AS count, count(e.ts) / CAST((SELECT count(*) FROM events) AS DOUBLE) AS ratio "
    "FROM range(24) h LEFT JOIN events e ON hour(e.ts) = h.range GROUP BY h.range", "ratio", "hour count"))
def h5(spark, folder):
    return calendar.hourly_distribution(table(spark, folder, "events"), "ts")


@add("h6_daily_distribution", same(
    "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS count, (SELECT count(DISTINCT CAST(o_orderdate AS DATE)) FROM orders) "
    "AS unique_dates, (SELECT count(DISTINCT CAST(o_orderdate AS DATE)) > 100 FROM orders) AS truncated FROM orders GROUP BY 1 "
    "ORDER BY 1 DESC LIMIT 100", i="count unique_dates"))
def h6(spark, folder):
    return calendar.daily_distribution(table(spark, folder, "orders"), "o_orderdate")


@add("h7_weekday_distribution", same(
    "SELECT dayname(o_orderdate) AS weekday, isodow(o_orderdate) - 1 AS weekday_index, count(*) AS count, "
    "count(*) / CAST((SELECT count(*) FROM orders) AS DOUBLE) AS ratio FROM orders GROUP BY 1, 2", "ratio",
    "weekday_index count"))
def h7(spark, folder):
    return calendar.weekday_distribution(table(spark, folder, "orders"), "o_orderdate")


LADDER = "CASE " + " ".join(
    f"WHEN abs(m - {s}) / {s} <= 0.2 THEN '{name}'" for name, s in series.FREQUENCIES.items()) + " ELSE 'irregular' END"


def frequency_sql(source: str, ts: str) -> str:
    return (
        f"SELECT '{ts}' AS column_name, {LADDER} AS detected, total_intervals, mean_interval_seconds, m AS median_interval_seconds, "
        "min_interval_seconds, max_interval_seconds, 'ok' AS status FROM (SELECT count(*) AS total_intervals, avg(g) AS "
        "mean_interval_seconds, median(g) AS m, min(g) AS min_interval_seconds, max(g) AS max_interval_seconds FROM "
        f"({gaps(source, ts)}) WHERE g > 0)"
    )


@add("i2_frequency", same(
    frequency_sql("orders", "o_orderdate") + " UNION ALL " + frequency_sql("events", "ts"), INTERVAL_DOUBLES, "total_intervals"))
def i2(spark, folder):
    orders = series.detect_frequency(table(spark, folder, "orders"), "o_orderdate")
    return orders.unionByName(series.detect_frequency(table(spark, folder, "events"), "ts")).drop("reason")


LABELS = {
    "hourly": "date_trunc('hour', {ts})",
    "daily": "date_trunc('day', {ts})",
    "weekly": "date_trunc('week', {ts}) + INTERVAL 6 DAY",
    "monthly": "CAST(last_day({ts}) AS TIMESTAMP)",
    "yearly": "make_timestamp(year({ts}), 12, 31, 0, 0, 0.0)",
}
STEPS = {"hourly": "INTERVAL 1 HOUR", "daily": "INTERVAL 1 DAY", "weekly": "INTERVAL 7 DAY"}


def resample_sql(source: str, ts: str, columns: list[str], frequency: str) -> str:
    at = LABELS[frequency].format(ts=ts)
    if frequency in STEPS:
        slots = f"SELECT unnest(generate_series(a, b, {STEPS[frequency]})) AS bucket FROM ends"
    elif frequency == "monthly":
        slots = (
            "SELECT CAST(last_day(m) AS TIMESTAMP) AS bucket FROM (SELECT unnest(generate_series(date_trunc('month', a), b, "
            "INTERVAL 1 MONTH)) AS m FROM ends)"
        )
    else:
        slots = "SELECT make_timestamp(y, 12, 31, 0, 0, 0.0) AS bucket FROM (SELECT unnest(generate_series(year(a), year(b))) AS y FROM ends)"
    return (
        f"WITH cells AS ({long_sql(source, columns, keep=f'{at} AS bucket')}), ends AS (SELECT min({at}) AS a, max({at}) AS b "
        f"FROM {source}), names AS (SELECT DISTINCT column_name FROM cells), slots AS ({slots}) "
        "SELECT n.column_name, s.bucket, avg(v) AS mean, median(v) AS median, min(v) AS min, max(v) AS max, count(v) AS count "
        "FROM slots s CROSS JOIN names n LEFT JOIN cells c ON c.bucket = s.bucket AND c.column_name = n.column_name "
        "GROUP BY n.column_name, s.bucket"
    )


def _resample_query(frequency: str, source: str, ts: str, columns: list[str]) -> None:
    @add(f"i3_resample_{frequency}", same(
        resample_sql(source, ts, columns, frequency), "mean median min max", "count", "bucket"))
    def query(spark, folder):
        return series.resample(table(spark, folder, source), ts, columns, frequency)


for _frequency in ("daily", "weekly", "monthly", "yearly"):
    _resample_query(_frequency, "orders", "o_orderdate", ["o_totalprice", "o_custkey"])
_resample_query("hourly", "events", "ts", ["value"])


@add("i4_empty_buckets", same(
    f"SELECT column_name, bucket, count FROM ({resample_sql('orders', 'o_orderdate', ['o_totalprice'], 'daily')}) WHERE count = 0",
    "", "count", "bucket"))
def i4(spark, folder):
    out = series.resample(table(spark, folder, "orders"), "o_orderdate", ["o_totalprice"], "daily")
    return out.filter("count = 0").select("column_name", "bucket", "count")


@add("i5_irregular_series", same(
    "SELECT 'value' AS column_name, ts AS datetime, value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL", "value", "",
    "datetime"))
def i5(spark, folder):
    return series.irregular_series(table(spark, folder, "events"), "ts", ["value"], ["event_id"])


@add("i6_time_index_means", same(
    f"SELECT column_name, t AS time_index, avg(v) AS mean FROM ({long_sql('lineitem', ['l_quantity', 'l_extendedprice'], keep='week(l_shipdate) AS t')}) "
    "GROUP BY column_name, t", "time_index mean"))
def i6(spark, folder):
    frame = table(spark, folder, "lineitem").withColumn("week_number", F.weekofyear("l_shipdate"))
    return series.time_index_means(frame, "week_number", ["l_quantity", "l_extendedprice"])


@add("i7_series_summary", same(
    "SELECT column_name, count(v) AS count, count(*) - count(v) AS missing_count, avg(v) AS mean, median(v) AS median, "
    "COALESCE(stddev_samp(v), 0) AS std, 'ok' AS status FROM "
    f"({long_sql('orders', ['o_totalprice', 'o_custkey'])}) GROUP BY column_name", "mean median std", "count missing_count"))
def i7(spark, folder):
    return series.series_summary(table(spark, folder, "orders"), "o_orderdate", ["o_totalprice", "o_custkey"]).drop("reason")


@add("i8_linear_trend", same(
    "WITH p AS (SELECT value AS v, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS DOUBLE) AS x FROM events WHERE value IS NOT NULL), "
    "f AS (SELECT count(*) AS count, regr_slope(v, x) AS slope, regr_intercept(v, x) AS intercept, regr_r2(v, x) AS r_squared, "
    "avg(v) AS m, min_by(v, x) AS first_value, max_by(v, x) AS last_value FROM p) "
    "SELECT 'value' AS column_name, count, CASE WHEN slope > greatest(abs(m), 1) * 1e-10 THEN 'increasing' WHEN slope < "
    "-greatest(abs(m), 1) * 1e-10 THEN 'decreasing' ELSE 'stable' END AS direction, slope * 1000000 AS slope, intercept, r_squared, "
    "first_value, last_value, last_value - first_value AS change, (last_value - first_value) / abs(first_value) * 100 AS "
    "change_percent, 'ok' AS status FROM f", "slope intercept r_squared first_value last_value change change_percent", "count"))
def i8(spark, folder):
    out = series.linear_trend(table(spark, folder, "events"), "ts", ["value"], ["event_id"]).drop("reason")
    return out.withColumn("slope", F.col("slope") * 1_000_000)  # shown per million points


ROLLING = (
    "WITH p AS (SELECT event_id, ts, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS v, row_number() OVER (ORDER BY ts, "
    "event_id) - 1 AS position FROM events), a AS (SELECT *, CASE WHEN count(v) OVER w >= 3 THEN quantile_cont(v, 0.5) OVER w END "
    "AS m FROM p WINDOW w AS (ORDER BY position ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), d AS (SELECT *, abs(v - m) AS dev FROM a), "
    "s AS (SELECT *, CASE WHEN count(dev) OVER w >= 3 THEN quantile_cont(dev, 0.5) OVER w END AS spread FROM d WINDOW w AS "
    "(ORDER BY position ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) SELECT position, ts AS datetime, event_id, 'value' AS column_name, "
    "v AS value, m AS rolling_median, 0.6745 * (v - m) / nullif(spread, 0) AS robust_z_score FROM s WHERE "
    "abs(0.6745 * (v - m) / nullif(spread, 0)) > 3.5"
)


@add("i9_rolling_anomalies", same(ROLLING, "value rolling_median robust_z_score", "position event_id", "datetime"))
def i9(spark, folder):
    """With holes in the values: they keep their place in the window."""
    events = table(spark, folder, "events").withColumn("value", F.expr("CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END"))
    return series.anomalies(events, "ts", ["value"], ["event_id"])


@add("i10_series_time_range", same(
    f"SELECT 'o_orderdate' AS column_name, min(o_orderdate) AS min_datetime, max(o_orderdate) AS max_datetime, "
    f"{seconds('max(o_orderdate)', 'min(o_orderdate)')} AS span_seconds, {seconds('max(o_orderdate)', 'min(o_orderdate)')} / 86400 "
    "AS span_days, count(o_orderdate) AS valid_count, count(*) - count(o_orderdate) AS missing_count FROM orders",
    "span_seconds span_days", "valid_count missing_count", "min_datetime max_datetime"))
def i10(spark, folder):
    return calendar.time_range(table(spark, folder, "orders"), "o_orderdate").drop("status", "reason")
