"""Descriptive statistics, frequencies, quality and missingness queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.catalog.basics import TYPED_TABLES, type_sql
from tablescope.catalog.base import (
    DOCS_LABELED, HOLES, LINEITEM_CATEGORICAL, LINEITEM_NUMERIC, ORDERS_NUMERIC, Catalogue, docs_labeled, lineitem_holes,
    long_sql, same, table,
)
from tablescope.operators import categorical, missing, quality, report, statistics, typing

catalogue = Catalogue()
add = catalogue.add

NUMBERS = long_sql("lineitem", LINEITEM_NUMERIC)
QUANTILE_SQL = ", ".join(f"quantile_cont(v, {p}) AS {q}" for q, p in statistics.QUANTILES.items())
QUANTILE_NAMES = " ".join(statistics.QUANTILES)

# pandas-style bias-adjusted moments; DuckDB's skewness and kurtosis are adjusted already.
MOMENTS = (
    "count(v) AS count, count(*) - count(v) AS missing, avg(v) AS mean, stddev_samp(v) AS std, var_samp(v) AS variance, "
    "min(v) AS min, max(v) AS max, max(v) - min(v) AS range, "
    "CASE WHEN avg(v) <> 0 THEN stddev_samp(v) / abs(avg(v)) END AS coefficient_of_variation, "
    "skewness(v) AS skewness, kurtosis(v) AS kurtosis"
)
MOMENT_NAMES = "mean std variance min max range coefficient_of_variation skewness kurtosis"


@add(
    "numeric_summary",
    same(
        f"SELECT column_name, ordinal, {MOMENTS}, {QUANTILE_SQL}, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, "
        f"median(v) AS median FROM ({NUMBERS}) GROUP BY column_name, ordinal "
        # What makes these columns numeric: more than ten values, or a name that speaks of a measure.
        "HAVING count(DISTINCT v) > 10 OR column_name = 'l_discount'",
        f"{MOMENT_NAMES} {QUANTILE_NAMES} iqr median", "ordinal count missing",
    ),
)
def numeric_summary(spark, folder):
    """Flagship: detect the types of lineitem, then summarise its numeric columns."""
    lineitem = table(spark, folder, "lineitem")
    kinds = typing.type_map(typing.detect_types(lineitem))
    out = statistics.numeric_summary(lineitem, typing.numeric_columns(kinds))
    places = F.create_map(*[x for i, c in enumerate(LINEITEM_NUMERIC) for x in (F.lit(c), F.lit(i))])
    return out.withColumn("ordinal", F.try_element_at(places, "column_name"))


def _columns(names: str):
    return lambda df: df.select("column_name", *names.split())


def _moment_query(name: str, picked: str, doubles: str, ints: str = "") -> None:
    @add(name, same(
        f"SELECT column_name, {picked} FROM (SELECT column_name, {MOMENTS} FROM ({NUMBERS}) GROUP BY column_name)",
        doubles, ints,
    ))
    def query(spark, folder):
        return statistics.moments(table(spark, folder, "lineitem"), LINEITEM_NUMERIC).select(
            "column_name", *[p.strip() for p in picked.split(",")]
        )


_moment_query("d1_count_mean_range", "count, missing, mean, min, max, range", "mean min max range", "count missing")
_moment_query("d4_std_variance", "std, variance", "std variance")
_moment_query("d6_skewness", "skewness", "skewness")
_moment_query("d7_kurtosis", "kurtosis", "kurtosis")
_moment_query("d9_coefficient_of_variation", "coefficient_of_variation", "coefficient_of_variation")


@add("d2_duplicate_rows", same(
    "SELECT count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text FROM documents)) AS duplicate_rows "
    "FROM documents", i="row_count duplicate_rows"))
def d2(spark, folder):
    from tablescope.plans.wide import duplicate_rows

    return duplicate_rows(table(spark, folder, "documents").select("text"))


@add("d3_quantiles", same(
    f"SELECT column_name, {QUANTILE_SQL}, median(v) AS median FROM ({NUMBERS}) GROUP BY column_name",
    f"{QUANTILE_NAMES} median"))
def d3(spark, folder):
    return statistics.quantile_table(table(spark, folder, "lineitem"), LINEITEM_NUMERIC).drop("count", "iqr")


@add("d5_interquartile_range", same(
    "SELECT column_name, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM "
    f"({long_sql('orders', ORDERS_NUMERIC)}) GROUP BY column_name", "iqr"))
def d5(spark, folder):
    return statistics.quantile_table(table(spark, folder, "orders"), ORDERS_NUMERIC).select("column_name", "iqr")


@add("d8_median_absolute_deviation", same(
    f"SELECT column_name, mad(v) AS mad FROM ({NUMBERS}) GROUP BY column_name", "mad"))
def d8(spark, folder):
    return statistics.mad_table(table(spark, folder, "lineitem"), LINEITEM_NUMERIC)


EVENT_VALUES = "SELECT 'value' AS column_name, value AS v FROM events"


def outlier_sql(source: str) -> str:
    return (
        f"WITH cells AS ({source}), b AS (SELECT column_name, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 "
        "FROM cells GROUP BY column_name) "
        "SELECT c.column_name, any_value(q1) AS q1, any_value(q3) AS q3, any_value(q3 - q1) AS iqr, "
        "any_value(q1 - 1.5 * (q3 - q1)) AS lower_bound, any_value(q3 + 1.5 * (q3 - q1)) AS upper_bound, "
        "count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outlier_count, "
        "count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) / CAST(count(v) AS DOUBLE) "
        "AS outlier_ratio, 'ok' AS status FROM cells c JOIN b ON c.column_name = b.column_name GROUP BY c.column_name"
    )


OUTLIER_CELLS = (
    f"SELECT column_name, v FROM ({long_sql('part', ['p_retailprice', 'p_size'])}) "
    "UNION ALL SELECT 'value' AS column_name, value AS v FROM events"
)


@add("d10_outliers", same(outlier_sql(OUTLIER_CELLS), "q1 q3 iqr lower_bound upper_bound outlier_ratio", "outlier_count"))
def d10(spark, folder):
    keep = ["column_name", "q1", "q3", "iqr", "lower_bound", "upper_bound", "outlier_count", "outlier_ratio", "status"]
    part = statistics.outlier_table(table(spark, folder, "part"), ["p_retailprice", "p_size"]).select(*keep)
    return part.unionByName(statistics.outlier_table(table(spark, folder, "events"), ["value"]).select(*keep))


JB = "count(v) / 6.0 * (power(g1, 2) + power(g2, 2) / 4.0)"


@add("d11_normality_jarque_bera", same(
    "WITH m AS (SELECT column_name, v, avg(v) OVER (PARTITION BY column_name) AS mu FROM "
    f"({NUMBERS})), s AS (SELECT column_name, count(*) AS n, avg(power(v - mu, 3)) / power(avg(power(v - mu, 2)), 1.5) AS g1, "
    "avg(power(v - mu, 4)) / power(avg(power(v - mu, 2)), 2) - 3 AS g2 FROM m GROUP BY column_name) "
    "SELECT column_name, n, 'Jarque-Bera' AS test, n / 6.0 * (g1 * g1 + g2 * g2 / 4.0) AS statistic, "
    "exp(-(n / 6.0 * (g1 * g1 + g2 * g2 / 4.0)) / 2.0) AS p_value, 'ok' AS status FROM s",
    "statistic p_value", "n"))
def d11(spark, folder):
    out = statistics.normality_table(table(spark, folder, "lineitem"), LINEITEM_NUMERIC)
    return out.select("column_name", "n", "test", "statistic", "p_value", "status")


@add("d11_normality_shapiro_wilk")
def d11_small(spark, folder):
    return statistics.normality_table(
        table(spark, folder, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("mean_balance"), F.count("*").alias("customers")),
        ["mean_balance", "customers"], statistics.SHAPIRO_WILK).drop("ordinal")


def report_sql(source: str, columns: list[str]) -> str:
    """Summary, spread, outliers and normality of columns without infinities, side by side."""
    cells = long_sql(source, columns)
    jb = "n / 6.0 * (g1 * g1 + g2 * g2 / 4.0)"
    return (
        f"WITH cells AS ({cells}), summary AS (SELECT column_name, {MOMENTS}, {QUANTILE_SQL}, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, "
        "median(v) AS median, mad(v) AS mad FROM cells GROUP BY column_name), "
        f"outside AS ({outlier_sql('SELECT column_name, v FROM cells')}), "
        "centred AS (SELECT column_name, v, avg(v) OVER (PARTITION BY column_name) AS mu FROM cells), "
        "shape AS (SELECT column_name, count(*) AS n, avg(power(v - mu, 3)) / power(avg(power(v - mu, 2)), 1.5) AS g1, "
        "avg(power(v - mu, 4)) / power(avg(power(v - mu, 2)), 2) - 3 AS g2 FROM centred GROUP BY column_name) "
        "SELECT summary.*, lower_bound, upper_bound, outlier_count, outlier_ratio, outside.status AS outlier_status, 'Jarque-Bera' AS test, "
        f"{jb} AS statistic, exp(-({jb}) / 2.0) AS p_value, 'ok' AS normality_status FROM summary JOIN outside USING (column_name) JOIN shape USING (column_name)"
    )


@add("d12_numeric_report", same(
    report_sql("orders", ORDERS_NUMERIC),
    f"{MOMENT_NAMES} {QUANTILE_NAMES} iqr median mad lower_bound upper_bound outlier_ratio statistic p_value", "count missing outlier_count"))
def d12(spark, folder):
    return statistics.numeric_report(table(spark, folder, "orders"), ORDERS_NUMERIC).drop("ordinal", "outlier_reason", "normality_reason")


def _analysed(spark, folder, source, columns, order):
    return report.analyse(table(spark, folder, source).select(*columns), [order])


ANALYSED_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ANALYSED_LINES = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_KINDS_OF_LINES = "(SELECT count(DISTINCT l_tax) + count(DISTINCT l_returnflag) + count(DISTINCT l_linestatus) FROM lineitem)"
_DAYS = "(SELECT DISTINCT CAST(l_shipdate AS TIMESTAMP) AS t FROM lineitem)"
ANALYSIS_SIZES = {
    "types": 8, "missing_values": 8, "missing_by_column": 8, "missing_pairs": 28, "duplicates": 1, "dataset": 1, "loading": 1, "preview": 10, "numeric": 4, "outliers": 4,
    "skewness": 4, "histogram": 120, "box_plot": 4, "categorical": 3, "high_cardinality": 3, "frequencies": _KINDS_OF_LINES, "category_bars": _KINDS_OF_LINES,
    "correlation": 18, "correlation_cells": 48, "scatter_fits": 6, "time_range__l_shipdate": 1, "time_intervals__l_shipdate": 1, "hourly__l_shipdate": 24,
    "weekday__l_shipdate": 7, "daily__l_shipdate": f"(SELECT least(100, count(DISTINCT CAST(t AS DATE))) FROM {_DAYS})",
    "top_intervals__l_shipdate": f"(SELECT least(10, count(DISTINCT g) + max(again)) FROM (SELECT t - lag(t) OVER (ORDER BY t) AS g FROM {_DAYS}), "
    "(SELECT CAST(count(*) > count(DISTINCT l_shipdate) AS BIGINT) AS again FROM lineitem))",
    "time_axis": 1, "frequency": 1, "series_summary": 4, "trend": 4, "row_payload": "(SELECT least(500000, count(*)) FROM lineitem)", "row_dictionary": _KINDS_OF_LINES,
    "data_scope": 1, "time_filter": 1,
}


@add("l9_analysis_tables", " UNION ALL ".join(f"SELECT '{name}' AS name, CAST({rows} AS BIGINT) AS rows" for name, rows in ANALYSIS_SIZES.items()))
def l9_tables(spark, folder):
    """The whole analysis of lineitem, each of its tables worked out and counted."""
    out = _analysed(spark, folder, "lineitem", ANALYSED_LINES, "l_orderkey")
    sizes = [out[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name in ANALYSIS_SIZES]
    return reduce(DataFrame.unionByName, sizes)


@add("l9_analysis_numeric", same(
    report_sql("orders", ORDERS_NUMERIC),
    f"{MOMENT_NAMES} {QUANTILE_NAMES} iqr median mad lower_bound upper_bound outlier_ratio statistic p_value", "count missing outlier_count"))
def l9_numeric(spark, folder):
    return _analysed(spark, folder, "orders", ANALYSED_ORDERS, "o_orderkey")["numeric"].drop("ordinal", "outlier_reason", "normality_reason")


@add("l9_analysis_series_and_loading", same(
    "SELECT column_name, count(v) AS count, count(*) - count(v) AS missing_count, avg(v) AS mean, median(v) AS median, stddev_samp(v) AS std, "
    "(SELECT count(*) FROM orders) AS rows, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS column_names "
    f"FROM ({long_sql('orders', ORDERS_NUMERIC)}) GROUP BY column_name", "mean median std", "count missing_count rows"))
def l9_series(spark, folder):
    out = _analysed(spark, folder, "orders", ANALYSED_ORDERS, "o_orderkey")
    known = out["loading"].first()  # one row
    return out["series_summary"].drop("status", "reason").withColumns({"rows": F.lit(known["rows"]), "column_names": F.lit(",".join(known["column_names"]))})


FREQ = (
    "SELECT column_name, v AS category, count(*) AS count FROM "
    f"({long_sql('lineitem', LINEITEM_CATEGORICAL, 'CAST({c} AS VARCHAR)')}) WHERE v IS NOT NULL GROUP BY column_name, v"
)


@add("e1_frequency_table", same(
    f"SELECT column_name, category, count, count / sum(count) OVER (PARTITION BY column_name) AS ratio FROM ({FREQ})",
    "ratio", "count"))
def e1(spark, folder):
    return categorical.frequency_table(table(spark, folder, "lineitem"), LINEITEM_CATEGORICAL)


DOC_CATS = ["lang", "source", "quality", "toxic"]
DOC_FREQ = (
    f"SELECT column_name, v AS category, count(*) AS c FROM ({long_sql(DOCS_LABELED, DOC_CATS, 'CAST({c} AS VARCHAR)')}) "
    "GROUP BY column_name, v"
)


@add("e2_distinct_and_missing", same(
    "SELECT column_name, COALESCE(sum(c) FILTER (WHERE category IS NOT NULL), 0) AS count, "
    "COALESCE(sum(c) FILTER (WHERE category IS NULL), 0) AS missing, count(category) AS \"unique\" "
    f"FROM ({DOC_FREQ}) GROUP BY column_name", i="count missing unique"))
def e2(spark, folder):
    return categorical.categorical_summary(docs_labeled(spark, folder), DOC_CATS).select("column_name", "count", "missing", "unique")


@add("e3_mode", same(
    "SELECT column_name, category AS mode, c AS mode_count, c / CAST(n AS DOUBLE) AS mode_ratio FROM (SELECT *, "
    "row_number() OVER (PARTITION BY column_name ORDER BY c DESC, category) AS rk, sum(c) OVER (PARTITION BY column_name) AS n "
    f"FROM ({DOC_FREQ}) WHERE category IS NOT NULL) WHERE rk = 1", "mode_ratio", "mode_count"))
def e3(spark, folder):
    return categorical.categorical_summary(docs_labeled(spark, folder), DOC_CATS).select(
        "column_name", "mode", "mode_count", "mode_ratio")


ENTROPY = (
    "SELECT column_name, -sum(p * log2(p)) AS entropy, count(*) AS k FROM (SELECT column_name, "
    f"c / CAST(sum(c) OVER (PARTITION BY column_name) AS DOUBLE) AS p FROM ({DOC_FREQ}) WHERE category IS NOT NULL) "
    "GROUP BY column_name"
)


@add("e4_entropy", same(f"SELECT column_name, entropy FROM ({ENTROPY})", "entropy"))
def e4(spark, folder):
    return categorical.categorical_summary(docs_labeled(spark, folder), DOC_CATS).select("column_name", "entropy")


@add("e5_normalized_entropy", same(
    f"SELECT column_name, CASE WHEN k > 1 THEN entropy / log2(k) ELSE 0 END AS normalized_entropy FROM ({ENTROPY})",
    "normalized_entropy"))
def e5(spark, folder):
    return categorical.categorical_summary(docs_labeled(spark, folder), DOC_CATS).select("column_name", "normalized_entropy")


TOP = (
    "SELECT column_name, category, c AS count, rank FROM (SELECT *, row_number() OVER (PARTITION BY column_name "
    "ORDER BY c DESC, category) AS rank FROM ({freq})) WHERE rank <= {n}"
)
LABELLED = DOC_FREQ.replace("v AS category", "COALESCE(v, '缺失') AS category")


@add("e6_top_categories_with_missing", same(TOP.format(freq=LABELLED, n=20), i="count rank"))
def e6(spark, folder):
    return categorical.top_categories(docs_labeled(spark, folder), DOC_CATS, 20, categorical.MISSING_LABEL)


PROPS_FREQ = "SELECT 'props' AS column_name, props AS category, count(*) AS c FROM events GROUP BY props"


@add("e6_top_categories_of_a_chart", same(TOP.format(freq=PROPS_FREQ, n=15), i="count rank"))
def e6_chart(spark, folder):
    return categorical.top_categories(table(spark, folder, "events"), ["props"], 15)


DOC_ALL = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
NULLS = (
    "SELECT column_name, ordinal, count(*) AS n, count(*) - count(v) AS m FROM "
    f"({long_sql(DOCS_LABELED, DOC_ALL, 'CAST({c} AS VARCHAR)')}) GROUP BY column_name, ordinal"
)


@add("f1_missing_levels", same(
    "SELECT column_name, ordinal, m AS missing_count, m / CAST(n AS DOUBLE) AS missing_ratio, CASE WHEN m / n >= 0.3 THEN "
    f"'critical' WHEN m / n >= 0.05 THEN 'warning' ELSE 'ok' END AS level FROM ({NULLS})", "missing_ratio",
    "ordinal missing_count"))
def f1(spark, folder):
    return quality.missing_values(docs_labeled(spark, folder))


@add("f2_duplicates", same(
    "SELECT n - k AS duplicate_count, (n - k) / CAST(n AS DOUBLE) AS duplicate_ratio FROM (SELECT count(*) AS n, "
    "(SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS k FROM documents)", "duplicate_ratio",
    "duplicate_count"))
def f2(spark, folder):
    return quality.duplicates(table(spark, folder, "documents").select("text", "lang"))


CONSTANTS = "(SELECT o_orderkey, 7 AS seven, CAST(NULL AS VARCHAR) AS nothing, " \
    "CASE WHEN o_orderkey % 2 = 0 THEN 'x' END AS sometimes, o_orderstatus FROM orders)"


@add("f3_constant_columns", same(
    "SELECT column_name, ordinal FROM (" + long_sql(
        CONSTANTS, ["o_orderkey", "seven", "nothing", "sometimes", "o_orderstatus"], "CAST({c} AS VARCHAR)")
    + ") GROUP BY column_name, ordinal HAVING count(DISTINCT v) + CAST(bool_or(v IS NULL) AS INT) <= 1", i="ordinal"))
def f3(spark, folder):
    frame = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "7 AS seven", "CAST(NULL AS STRING) AS nothing", "CASE WHEN o_orderkey % 2 = 0 THEN 'x' END AS sometimes",
        "o_orderstatus")
    return quality.constant_columns(frame)


@add("f4_high_cardinality", same(
    "SELECT column_name, count(DISTINCT v) AS \"unique\", count(DISTINCT v) / CAST(count(*) AS DOUBLE) AS unique_ratio, "
    "CASE WHEN count(DISTINCT v) / count(*) >= 0.5 THEN 'high' ELSE 'normal' END AS level FROM ("
    + long_sql("documents", ["text", "lang", "source"], "{c}") + ") GROUP BY column_name", "unique_ratio", "unique"))
def f4(spark, folder):
    return quality.high_cardinality(table(spark, folder, "documents"), ["text", "lang", "source"])


@add("f5_outlier_check", same(
    "SELECT column_name, outlier_count, outlier_ratio, lower_bound, upper_bound, status FROM ("
    + outlier_sql(long_sql("orders", ORDERS_NUMERIC)) + ")", "outlier_ratio lower_bound upper_bound", "outlier_count"))
def f5(spark, folder):
    return quality.outliers(table(spark, folder, "orders"), ORDERS_NUMERIC).drop("reason")


SKEW_SOURCE = "(SELECT *, power(o_totalprice, 3) AS cubed, 1.0 AS one FROM orders)"
SKEW_COLUMNS = [*ORDERS_NUMERIC, "cubed", "one"]


@add("f6_skewness_levels", same(
    "SELECT column_name, s AS skewness, CASE WHEN lo = hi THEN 'constant' WHEN abs(s) >= 2 THEN 'strongly_skewed' WHEN abs(s) >= 1 "
    "THEN 'moderately_skewed' ELSE 'approximately_symmetric' END AS level, CASE WHEN lo = hi THEN 'skipped' ELSE 'ok' END AS status "
    "FROM (SELECT column_name, CASE WHEN min(v) = max(v) THEN 0 ELSE skewness(v) END AS s, min(v) AS lo, max(v) AS hi "
    f"FROM ({long_sql(SKEW_SOURCE, SKEW_COLUMNS)}) GROUP BY column_name)", "skewness"))
def f6(spark, folder):
    frame = table(spark, folder, "orders").withColumns(
        {"cubed": F.expr("power(o_totalprice, 3)"), "one": F.lit(1.0)})
    return quality.skewness(frame, SKEW_COLUMNS).drop("reason")


DOC_TYPES = type_sql("documents", TYPED_TABLES["documents"])


@add("f7_type_issues", same(
    "SELECT column_name, dtype, detected_type, CASE WHEN detected_type = 'text' THEN 'text_variable' WHEN detected_type = 'identifier' THEN "
    "'identifier_variable' WHEN detected_type IN ('datetime', 'time') THEN 'temporal_variable' WHEN dtype = 'string' THEN "
    "'object_dtype_requires_review' END AS issue FROM (SELECT column_name, detected_type, CASE WHEN column_name IN ('doc_id', 'n_chars') THEN "
    f"'bigint' ELSE 'string' END AS dtype FROM ({DOC_TYPES}))"))
def f7(spark, folder):
    return quality.type_issues(typing.detect_types(table(spark, folder, "documents")))


COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in DOC_ALL)


@add("g1_missing_summary", same(
    f"WITH n AS ({NULLS}), t AS (SELECT sum(n) AS cells, sum(m) AS gone, count(*) FILTER (WHERE m > 0) AS holed, count(*) AS k FROM n), "
    f"r AS (SELECT count(*) AS rows, count(*) FILTER (WHERE {COMPLETE}) AS whole FROM {DOCS_LABELED}) "
    "SELECT cells AS total_cells, gone AS total_missing, gone / CAST(cells AS DOUBLE) AS overall_missing_ratio, "
    "holed AS columns_with_missing, k - holed AS columns_without_missing, whole AS complete_rows, "
    "whole / CAST(rows AS DOUBLE) AS complete_row_ratio, rows - whole AS rows_with_missing, "
    "(rows - whole) / CAST(rows AS DOUBLE) AS rows_with_missing_ratio FROM t, r",
    "overall_missing_ratio complete_row_ratio rows_with_missing_ratio",
    "total_cells total_missing columns_with_missing columns_without_missing complete_rows rows_with_missing"))
def g1(spark, folder):
    return missing.missing_summary(docs_labeled(spark, folder))


@add("g2_missing_by_column", same(
    "SELECT column_name, ordinal, m AS missing_count, n - m AS non_missing_count, m / CAST(n AS DOUBLE) AS missing_ratio "
    f"FROM ({NULLS})", "missing_ratio", "ordinal missing_count non_missing_count"))
def g2(spark, folder):
    return missing.missing_by_column(docs_labeled(spark, folder))


HOLE_COLUMNS = ["l_linenumber", "l_discount", "l_tax"]
PATTERN = "concat_ws(',', CASE WHEN l_discount IS NULL THEN 'l_discount' END, CASE WHEN l_tax IS NULL THEN 'l_tax' END)"


@add("g3_missing_patterns", same(
    f"SELECT p AS missing_columns, count(*) AS missing_count, count(*) / CAST((SELECT count(*) FROM lineitem) AS DOUBLE) "
    f"AS missing_ratio, len(string_split(p, ',')) AS missing_variable_count, count(*) OVER () AS total, count(*) OVER () > 20 AS truncated FROM (SELECT {PATTERN} AS p FROM {HOLES}) "
    "WHERE p <> '' GROUP BY p ORDER BY 2 DESC, 1 LIMIT 20", "missing_ratio", "missing_count missing_variable_count total"))
def g3(spark, folder):
    return missing.missing_patterns(lineitem_holes(spark, folder))


PAIR_COLUMNS = ["l_quantity", "l_discount", "l_tax"]


@add("g4_missing_pairs", same(
    " UNION ALL ".join(
        f"SELECT '{a}' AS column_1, '{b}' AS column_2, count(*) FILTER (WHERE {a} IS NULL AND {b} IS NULL) AS both_missing_count, "
        f"count(*) FILTER (WHERE {a} IS NULL AND {b} IS NULL) / CAST(count(*) AS DOUBLE) AS both_missing_ratio, 3 AS total, false AS truncated FROM {HOLES}"
        for k, a in enumerate(PAIR_COLUMNS) for b in PAIR_COLUMNS[k + 1:]),
    "both_missing_ratio", "both_missing_count total"))
def g4(spark, folder):
    return missing.missing_pairs(lineitem_holes(spark, folder), PAIR_COLUMNS)
