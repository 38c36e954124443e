"""Chart-data and exploration queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tablescope.catalog.base import LINEITEM_NUMERIC, ORDERS_NUMERIC, PART_NUMERIC, Catalogue, long_sql, same, table
from tablescope.catalog.relate import PART_PAIRS
from tablescope.catalog.times import resample_sql
from tablescope.operators import calendar, charts, correlation, explore

catalogue = Catalogue()
add = catalogue.add


def bin_sql(v: str, lo: str, hi: str, bins: int = 30) -> str:
    return f"CAST(least({bins - 1}, floor(({v} - {lo}) / ({hi} - {lo}) * {bins})) AS BIGINT)"


NUMBERS = long_sql("lineitem", LINEITEM_NUMERIC)


@add("l1_histogram", same(
    f"WITH cells AS ({NUMBERS}), b AS (SELECT column_name, min(v) AS lo, max(v) AS hi FROM cells GROUP BY column_name), "
    f"k AS (SELECT c.column_name, {bin_sql('v', 'lo', 'hi')} AS bin, count(*) AS n FROM cells c JOIN b USING (column_name) GROUP BY 1, 2) "
    "SELECT b.column_name, r.range AS bin, lo + (hi - lo) / 30 * r.range AS bin_start, lo + (hi - lo) / 30 * (r.range + 1) AS bin_end, "
    "COALESCE(n, 0) AS count FROM b CROSS JOIN range(30) r LEFT JOIN k ON k.column_name = b.column_name AND k.bin = r.range",
    "bin_start bin_end", "bin count"))
def l1(spark, folder):
    return charts.histogram(table(spark, folder, "lineitem"), LINEITEM_NUMERIC)


@add("l1_histogram_marks", same(
    f"SELECT column_name, avg(v) AS mean, median(v) AS median FROM ({NUMBERS}) GROUP BY column_name", "mean median"))
def l1_marks(spark, folder):
    return charts.histogram_marks(table(spark, folder, "lineitem"), LINEITEM_NUMERIC)


BOX_CELLS = "SELECT 'value' AS column_name, value AS v FROM events"


@add("l2_box_plot", same(
    f"WITH cells AS ({BOX_CELLS}), b AS (SELECT quantile_cont(v, 0.25) AS q1, median(v) AS q2, quantile_cont(v, 0.75) AS q3 FROM cells) "
    "SELECT 'value' AS column_name, q1, q2 AS median, q3, avg(v) AS mean, least(q1, min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1))) AS "
    "whisker_low, greatest(q3, max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1))) AS whisker_high, count(*) FILTER (WHERE v < q1 - 1.5 * "
    "(q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS fliers FROM cells, b GROUP BY q1, q2, q3",
    "q1 median q3 mean whisker_low whisker_high", "fliers"))
def l2(spark, folder):
    return charts.box_plot(table(spark, folder, "events"), ["value"])


@add("l2_box_fliers", same(
    "WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) SELECT event_id, 'value' AS column_name, "
    "value FROM events, b WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)", "value", "event_id"))
def l2_fliers(spark, folder):
    return charts.box_fliers(table(spark, folder, "events"), ["value"], ["event_id"])


BAR_COLUMNS = ["p_name", "p_brand", "p_type"]


@add("l3_category_bars", same(
    "SELECT column_name, category, c AS count, rank FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY c DESC, category) AS "
    f"rank FROM (SELECT column_name, v AS category, count(*) AS c FROM ({long_sql('part', BAR_COLUMNS, '{c}')}) GROUP BY 1, 2)) "
    "WHERE rank <= 15", i="count rank"))
def l3(spark, folder):
    return charts.category_bars(table(spark, folder, "part"), BAR_COLUMNS)


@add("l4_scatter_fits", same(" UNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, count(*) AS n, regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept, min({x}) AS x_min, "
    f"max({x}) AS x_max, min({y}) AS y_min, max({y}) AS y_max FROM lineitem" for x, y in combinations(LINEITEM_NUMERIC, 2)),
    "slope intercept x_min x_max y_min y_max", "n"))
def l4(spark, folder):
    return charts.scatter_fits(table(spark, folder, "lineitem"), LINEITEM_NUMERIC)


@add("l5_heatmap", same(
    "SELECT 'pearson' AS method, list_position(" + str(PART_NUMERIC) + ", x) - 1 AS x_index, list_position(" + str(PART_NUMERIC)
    + f", y) - 1 AS y_index, round(r, 2) AS value FROM (SELECT x, y, r FROM ({PART_PAIRS}) UNION ALL SELECT y, x, r FROM ({PART_PAIRS}) "
    "UNION ALL SELECT c, c, 1.0 FROM (SELECT unnest(" + str(PART_NUMERIC) + ") AS c))", "value", "x_index y_index"))
def l5(spark, folder):
    part = table(spark, folder, "part")
    matrix = correlation.correlation_matrix(correlation.pearson(part, PART_NUMERIC), part, PART_NUMERIC)
    return charts.heatmap(correlation.correlation_cells(matrix, PART_NUMERIC))


@add("l6_calendar_charts", same(
    "SELECT 'hour' AS chart, CAST(hour(ts) AS VARCHAR) AS slot, count(*) AS count FROM events GROUP BY 2 UNION ALL "
    "SELECT 'weekday', dayname(ts), count(*) FROM events GROUP BY 2 UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d'), count(*) "
    "FROM events GROUP BY 2", i="count"))
def l6(spark, folder):
    events = table(spark, folder, "events")
    hours = calendar.hourly_distribution(events, "ts").select(F.lit("hour").alias("chart"), F.col("hour").cast("string").alias("slot"), "count")
    weekdays = calendar.weekday_distribution(events, "ts").select(F.lit("weekday"), "weekday", "count")
    days = calendar.daily_distribution(events, "ts").select(F.lit("day"), F.col("day").cast("string"), "count")
    return hours.union(weekdays).union(days).filter("count > 0")


@add("l7_time_lines", same(
    "SELECT column_name, bucket AS datetime, mean AS value FROM (" + resample_sql("orders", "o_orderdate", ["o_totalprice"], "weekly")
    + ") WHERE mean IS NOT NULL", "value", "", "datetime"))
def l7(spark, folder):
    return charts.time_lines(table(spark, folder, "orders"), "o_orderdate", ["o_totalprice"], "weekly")


@add("l7_line_means", same(
    "SELECT column_name, avg(mean) AS overall_mean FROM (" + resample_sql("orders", "o_orderdate", ORDERS_NUMERIC[1:], "monthly")
    + ") GROUP BY column_name", "overall_mean"))
def l7_means(spark, folder):
    return charts.line_means(charts.time_lines(table(spark, folder, "orders"), "o_orderdate", ORDERS_NUMERIC[1:], "monthly"))


@add("m1_identifier_lookup", same("SELECT url, page_id FROM pages WHERE lower(url) LIKE '%11%'", i="page_id"))
def m1(spark, folder):
    return explore.find_identifier(table(spark, folder, "pages"), "url", "11").select("url", "page_id")


@add("m2_identifier_combination", same(
    "SELECT conv_id, turn, role FROM conversations WHERE role = 'user' AND turn = 2", i="conv_id turn"))
def m2(spark, folder):
    return explore.find_combination(table(spark, folder, "conversations"), {"role": "user", "turn": 2}).select("conv_id", "turn", "role")


@add("m2_identifier_combination_list", same(
    "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = o_custkey)",
    i="o_orderkey o_custkey"))
def m2_list(spark, folder):
    wanted = table(spark, folder, "lineitem").selectExpr("l_orderkey AS o_orderkey", "l_suppkey AS o_custkey")
    return explore.find_combination(table(spark, folder, "orders"), wanted).select("o_orderkey", "o_custkey")


@add("m3_value_filters", same(
    "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_returnflag IN ('A', 'R')",
    "l_quantity", "l_orderkey l_linenumber"))
def m3(spark, folder):
    kept = explore.keep_range(table(spark, folder, "lineitem"), "l_quantity", 10, 12)
    return explore.keep_categories(kept, "l_returnflag", ["A", "R"]).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@add("m4_time_filter", same(
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31'", "",
    "o_orderkey", "o_orderdate"))
def m4(spark, folder):
    return explore.keep_time(table(spark, folder, "orders"), "o_orderdate", "1995-01-01", "1995-03-31").select("o_orderkey", "o_orderdate")


def series_sql(grain: str, agg: str, group: str = "") -> str:
    at = "ts" if grain == "all" else f"date_trunc('{grain}', ts)"
    more = f', {group} AS "group"' if group else ""
    return (
        f"SELECT 'value' AS column_name, {at} AS bucket{more}, {agg}(value) AS value FROM events GROUP BY ALL"
    )


@add("m5_time_buckets", same(series_sql("day", "avg"), "value", "", "bucket"))
def m5(spark, folder):
    return explore.bucketed_series(table(spark, folder, "events"), "ts", ["value"], "day")


@add("m5_all_points", same(series_sql("all", "avg"), "value", "", "bucket"))
def m5_all(spark, folder):
    return explore.bucketed_series(table(spark, folder, "events"), "ts", ["value"], "all")


@add("m6_summed_series_per_group", same(series_sql("hour", "sum", "event_type"), "value", "", "bucket"))
def m6(spark, folder):
    return explore.bucketed_series(table(spark, folder, "events"), "ts", ["value"], "hour", "sum", "event_type")


@add("m7_shared_times", same(
    "SELECT count(*) AS rows, count(DISTINCT o_orderdate) AS times, count(*) > count(DISTINCT o_orderdate) AS shared FROM orders",
    i="rows times"))
def m7(spark, folder):
    return explore.shared_times(table(spark, folder, "orders"), "o_orderdate")


@add("m8_default_granularity", same(
    "SELECT n AS times, c AS offered, CASE WHEN c AND n > 5000 THEN 'hour' ELSE 'all' END AS granularity FROM (SELECT count(DISTINCT ts) AS n, "
    "bool_or(ts <> date_trunc('day', ts)) AS c FROM events) UNION ALL SELECT n, c, CASE WHEN c AND n > 5000 THEN 'hour' ELSE 'all' END FROM "
    "(SELECT count(DISTINCT o_orderdate) AS n, bool_or(o_orderdate <> date_trunc('day', o_orderdate)) AS c FROM orders)", i="times"))
def m8(spark, folder):
    events = explore.default_granularity(table(spark, folder, "events"), "ts")
    return events.unionByName(explore.default_granularity(table(spark, folder, "orders"), "o_orderdate"))


@add("m9_normalised", same(
    "SELECT o_orderkey, (o_totalprice - lo) / (hi - lo) AS o_totalprice FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi "
    "FROM orders)", "o_totalprice", "o_orderkey"))
def m9(spark, folder):
    return explore.normalised(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])


@add("m9_normalised_sums", same(
    "SELECT column_name, bucket, (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS value FROM "
    f"({series_sql('day', 'sum')})", "value", "", "bucket"))
def m9_sum(spark, folder):
    return explore.normalised_series(table(spark, folder, "events"), "ts", ["value"], "day", "sum")


@add("m10_grouped_histogram", same(
    f"WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), k AS (SELECT {bin_sql('o_totalprice', 'lo', 'hi')} AS bin, "
    "o_orderpriority AS g, count(*) AS c FROM orders, b GROUP BY 1, 2) SELECT bin, g AS \"group\", sum(c) OVER (PARTITION BY g) AS group_rows, "
    "c AS count, c / CAST(sum(c) OVER (PARTITION BY bin) AS DOUBLE) AS share FROM k", "share", "bin group_rows count"))
def m10(spark, folder):
    return explore.grouped_histogram(table(spark, folder, "orders"), "o_totalprice", "o_orderpriority")


BY_BRAND = (
    "SELECT p_brand AS category, count(*) AS rows, row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS rank, "
    "{agg}(p_size) AS a, {agg}(p_retailprice) AS b FROM part GROUP BY p_brand"
)
MEASURES = (
    "SELECT 'p_size' AS column_name, category, rows, rank, rank // 15 AS page, a AS value FROM ({s}) UNION ALL "
    "SELECT 'p_retailprice', category, rows, rank, rank // 15, b FROM ({s})"
)


@add("m11_numeric_by_category", same(MEASURES.format(s=BY_BRAND.format(agg="avg")), "value", "rows rank page"))
def m11(spark, folder):
    return explore.numeric_by_category(table(spark, folder, "part"), "p_brand", ["p_size", "p_retailprice"])


@add("m11_common_scale", same(
    "SELECT column_name, min(value) AS scale_min, max(value) AS scale_max FROM (" + MEASURES.format(s=BY_BRAND.format(agg="sum"))
    + ") GROUP BY column_name", "scale_min scale_max"))
def m11_scale(spark, folder):
    return explore.common_scale(
        explore.numeric_by_category(table(spark, folder, "part"), "p_brand", ["p_size", "p_retailprice"], "sum"))


def merged_sql(source: str, column: str, n: int) -> str:
    return (
        f"SELECT CASE WHEN rk <= {n} THEN c ELSE '其他' END AS category, sum(k) AS count, count(*) AS groups, sum(k) / CAST((SELECT count(*) FROM "
        f"{source}) AS DOUBLE) AS share FROM (SELECT {column} AS c, count(*) AS k, row_number() OVER (ORDER BY count(*) DESC, {column}) AS rk "
        f"FROM {source} GROUP BY {column}) GROUP BY 1"
    )


@add("m12_category_share", same(merged_sql("part", "p_name", 20), "share", "count groups"))
def m12(spark, folder):
    return explore.category_share(table(spark, folder, "part"), "p_name")


@add("m13_merged_groups", same(merged_sql("documents", "source", 15), "share", "count groups"))
def m13(spark, folder):
    return explore.merged_groups(table(spark, folder, "documents"), "source")


@add("m14_thin_scatter")
def m14(spark, folder):
    return explore.thin_scatter(table(spark, folder, "lineitem"), "l_extendedprice", "l_quantity", ["l_orderkey", "l_linenumber", "l_partkey"])


@add("m14_thinned_points", same(
    "SELECT least(20000, (SELECT count(*) FROM orders)) AS points, max(o_totalprice) AS y_max, min(o_totalprice) AS y_min, "
    "max(o_custkey) AS x_max, min(o_custkey) AS x_min FROM orders", "y_max y_min", "points x_max x_min"))
def m14_points(spark, folder):
    """The cloud keeps its size budget and its extremes."""
    thin = explore.thin_scatter(table(spark, folder, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"])
    return thin.agg(
        F.count("*").alias("points"), F.max("o_totalprice").alias("y_max"), F.min("o_totalprice").alias("y_min"),
        F.max("o_custkey").alias("x_max"), F.min("o_custkey").alias("x_min"))


@add("m15_far_outliers", same(
    "WITH b AS (SELECT quantile_cont(event_id, 0.25) AS x1, quantile_cont(event_id, 0.75) AS x3, quantile_cont(value, 0.25) AS y1, "
    "quantile_cont(value, 0.75) AS y3 FROM events), f AS (SELECT event_id, value, event_id BETWEEN x1 - 3 * (x3 - x1) AND x3 + 3 * (x3 - x1) "
    "AND value BETWEEN y1 - 3 * (y3 - y1) AND y3 + 3 * (y3 - y1) AS near FROM events, b), s AS (SELECT count(*) FILTER (WHERE NOT near) > "
    "0.2 * count(*) AS wide FROM f) SELECT event_id, value FROM f, s WHERE near OR wide", "value", "event_id"))
def m15(spark, folder):
    return explore.drop_far_outliers(table(spark, folder, "events"), "event_id", "value").select("event_id", "value")


@add("m16_thin_lines", same(
    "WITH b AS (SELECT CAST(min(epoch_us(ts)) AS DOUBLE) AS lo, CAST(max(epoch_us(ts)) AS DOUBLE) AS hi FROM events), k AS (SELECT event_type, ts, "
    f"value, {bin_sql('epoch_us(ts)', 'lo', 'hi', 200)} AS bin FROM events, b), r AS (SELECT *, row_number() OVER (PARTITION BY event_type, bin "
    "ORDER BY value, ts) AS a, row_number() OVER (PARTITION BY event_type, bin ORDER BY value DESC, ts) AS z FROM k) "
    "SELECT event_type, ts, value FROM r WHERE a = 1 OR z = 1", "value", "", "ts"))
def m16(spark, folder):
    lines = table(spark, folder, "events").select("event_type", "ts", "value")
    return explore.thin_lines(lines, "ts", "event_type", "value", 200)


@add("m17_strip", same(
    "SELECT e.event_id, e.value, e.event_type AS \"group\", b.band FROM events e JOIN (SELECT event_type, row_number() OVER (ORDER BY count(*) "
    "DESC, event_type) - 1 AS band FROM events GROUP BY event_type) b ON e.event_type = b.event_type", "value", "event_id band"))
def m17(spark, folder):
    events = table(spark, folder, "events")
    strip = explore.strip(events, "value", "event_type", ["event_id"], keep=["event_id"])
    return strip.select("event_id", "value", "group", "band")


@add("m19_filtered_statistics", same(
    "SELECT l_returnflag AS category, count(*) AS rows, avg(l_extendedprice) AS value FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND "
    "l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1", "value", "rows"))
def m19(spark, folder):
    kept = explore.keep_time(table(spark, folder, "lineitem"), "l_shipdate", "1995-01-01")
    kept = explore.keep_range(kept, "l_quantity", 10, 20)
    return explore.numeric_by_category(kept, "l_returnflag", ["l_extendedprice"]).select("category", "rows", "value")


# Sixth powers have a long tail, the plain columns have none.
TAILED = "(SELECT l_quantity, l_discount, power(l_extendedprice, 6) AS tailed FROM lineitem)"
TAILED_COLUMNS = ["l_quantity", "l_discount", "tailed"]


@add("m20_axis_range", same(
    "SELECT column_name, CASE WHEN c THEN q1 - 0.06 * (q2 - q1) ELSE low END AS low, CASE WHEN c THEN q2 + 0.06 * (q2 - q1) ELSE high END AS high, "
    "c AS clipped FROM (SELECT *, q1 < q2 AND high - low > 1.6 * 1.12 * (q2 - q1) AS c FROM (SELECT column_name, min(v) AS low, max(v) AS high, "
    f"quantile_cont(v, 0.005) AS q1, quantile_cont(v, 0.995) AS q2 FROM ({long_sql(TAILED, TAILED_COLUMNS)}) GROUP BY column_name))", "low high"))
def m20(spark, folder):
    frame = table(spark, folder, "lineitem").select("l_quantity", "l_discount", F.pow("l_extendedprice", F.lit(6)).alias("tailed"))
    return explore.axis_range(frame, TAILED_COLUMNS)
