"""Correlation, sampling and dictionary queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tablescope.catalog.base import (
    DOCS_LABELED, HOLES, LINEITEM_NUMERIC, PART_NUMERIC, Catalogue, docs_labeled, lineitem_holes, long_sql, same, table,
)
from tablescope.operators import correlation, sampling, typing

catalogue = Catalogue()
add = catalogue.add

HOLE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
STATS = (
    "SELECT '{x}' AS x, '{y}' AS y, count(*) AS n, min({x}) = max({x}) AS flat_x, min({y}) = max({y}) AS flat_y, "
    "corr({x}, {y}) AS r FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL"
)
VERDICT = (
    "CASE WHEN n < 3 THEN 'insufficient_samples' WHEN flat_x THEN 'constant_variable_x' WHEN flat_y THEN 'constant_variable_y' END"
)


def pair_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(STATS.format(x=x, y=y, source=source) for x, y in combinations(columns, 2))


def pearson_sql(source: str, columns: list[str]) -> str:
    return f"SELECT 'pearson' AS method, x, y, r AS correlation, n AS sample_size, 'ok' AS status FROM ({pair_sql(source, columns)})"


FLAT = "(SELECT *, CAST(1 AS DOUBLE) AS one, CASE WHEN l_orderkey < 0 THEN l_tax END AS never FROM lineitem)"
FLAT_COLUMNS = ["l_quantity", "one", "never", "l_tax"]
SHOWN = ["method", "x", "y", "correlation", "sample_size", "status"]


@add("j1_pair_preparation", same(
    f"SELECT x, y, CASE WHEN why IS NULL THEN n ELSE 0 END AS sample_size, COALESCE(why, 'none') AS reason FROM "
    f"(SELECT x, y, n, {VERDICT} AS why FROM ({pair_sql(FLAT, FLAT_COLUMNS)}))", i="sample_size"))
def j1(spark, folder):
    frame = table(spark, folder, "lineitem").withColumns(
        {"one": F.lit(1.0), "never": F.expr("CASE WHEN l_orderkey < 0 THEN l_tax END")})
    return correlation.pearson(frame, FLAT_COLUMNS).select("x", "y", "sample_size", F.coalesce("reason", F.lit("none")).alias("reason"))


@add("j2_pearson", same(pearson_sql("lineitem", LINEITEM_NUMERIC), "correlation", "sample_size"))
def j2(spark, folder):
    return correlation.pearson(table(spark, folder, "lineitem"), LINEITEM_NUMERIC).select(*SHOWN)


@add("j2_pearson_with_missing", same(pearson_sql(HOLES, HOLE_NUMERIC), "correlation", "sample_size"))
def j2_missing(spark, folder):
    return correlation.pearson(lineitem_holes(spark, folder), HOLE_NUMERIC).select(*SHOWN)


@add("j2_pearson_p_values")
def j2_p(spark, folder):
    return correlation.pearson(table(spark, folder, "lineitem"), LINEITEM_NUMERIC).select("x", "y", "p_value")


def spearman_sql(source: str, columns: list[str]) -> str:
    ranked = (
        "SELECT '{x}' AS x, '{y}' AS y, rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rx, "
        "rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS ry FROM {source} "
        "WHERE {x} IS NOT NULL AND {y} IS NOT NULL"
    )
    cells = " UNION ALL ".join(ranked.format(x=x, y=y, source=source) for x, y in combinations(columns, 2))
    return (
        "SELECT 'spearman' AS method, x, y, corr(rx, ry) AS correlation, count(*) AS sample_size, 'ok' AS status FROM "
        f"({cells}) GROUP BY x, y"
    )


@add("j3_spearman", same(spearman_sql("lineitem", LINEITEM_NUMERIC), "correlation", "sample_size"))
def j3(spark, folder):
    return correlation.spearman(table(spark, folder, "lineitem"), LINEITEM_NUMERIC).select(*SHOWN)


@add("j3_spearman_with_missing", same(spearman_sql(HOLES, HOLE_NUMERIC), "correlation", "sample_size"))
def j3_missing(spark, folder):
    return correlation.spearman(lineitem_holes(spark, folder), HOLE_NUMERIC).select(*SHOWN)


def kendall_sql(source: str, columns: list[str]) -> str:
    one = (
        "SELECT 'kendall' AS method, '{x}' AS x, '{y}' AS y, CAST(sum(sign(a.{x} - b.{x}) * sign(a.{y} - b.{y})) AS DOUBLE) / "
        "sqrt(CAST(sum(abs(sign(a.{x} - b.{x}))) AS DOUBLE)) / sqrt(CAST(sum(abs(sign(a.{y} - b.{y}))) AS DOUBLE)) AS correlation, "
        "(SELECT count(*) FROM {source}) AS sample_size, 'ok' AS status FROM {source} a, {source} b"
    )
    return " UNION ALL ".join(one.format(x=x, y=y, source=source) for x, y in combinations(columns, 2))


@add("j4_kendall", same(kendall_sql("part", PART_NUMERIC), "correlation", "sample_size"))
def j4(spark, folder):
    return correlation.kendall(table(spark, folder, "part"), PART_NUMERIC).select(*SHOWN)


FOLDED = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def folded_kendall_sql(source: str, columns: list[str]) -> str:
    """Tau-b over counted combinations of few values, so that any number of rows can be checked."""
    one = (
        "SELECT 'kendall' AS method, '{x}' AS x, '{y}' AS y, sum(a.w * b.w * sign(a.x - b.x) * sign(a.y - b.y)) / "
        "sqrt(sum(a.w * b.w * abs(sign(a.x - b.x)))) / sqrt(sum(a.w * b.w * abs(sign(a.y - b.y)))) AS correlation, "
        "(SELECT count(*) FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) AS sample_size, 'ok' AS status "
        "FROM {cells} a, {cells} b"
    )
    cells = "(SELECT {x} AS x, {y} AS y, CAST(count(*) AS DOUBLE) AS w FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY ALL)"
    return " UNION ALL ".join(
        one.format(x=x, y=y, source=source, cells=cells.format(x=x, y=y, source=source)) for x, y in combinations(columns, 2))


@add("j4_kendall_of_lineitem", same(folded_kendall_sql(HOLES, FOLDED), "correlation", "sample_size"))
def j4_large(spark, folder):
    return correlation.kendall(lineitem_holes(spark, folder), FOLDED).select(*SHOWN)


PART_PAIRS = pair_sql("part", PART_NUMERIC)


@add("j5_correlation_matrix", same(
    f"SELECT 'pearson' AS method, x, y, r AS correlation, n AS sample_size FROM ({PART_PAIRS}) UNION ALL "
    f"SELECT 'pearson' AS method, y AS x, x AS y, r, n FROM ({PART_PAIRS}) UNION ALL SELECT 'pearson', column_name, column_name, "
    f"1.0, count(v) FROM ({long_sql('part', PART_NUMERIC)}) GROUP BY column_name", "correlation", "sample_size"))
def j5(spark, folder):
    part = table(spark, folder, "part")
    return correlation.correlation_matrix(correlation.pearson(part, PART_NUMERIC), part, PART_NUMERIC).drop("p_value")


ORDER_SOURCE = "(SELECT o_orderkey, o_totalprice, o_totalprice * 2 + o_custkey AS mixed, -o_totalprice AS negated FROM orders)"
ORDER_COLUMNS = ["o_orderkey", "o_totalprice", "mixed", "negated"]


@add("j6_important_pairs", same(
    "SELECT x AS variable_1, y AS variable_2, 'pearson' AS method, r AS correlation, n AS sample_size, CASE WHEN r > 0 THEN 'positive' "
    f"ELSE 'negative' END AS direction, 'strong' AS strength FROM ({pair_sql(ORDER_SOURCE, ORDER_COLUMNS)}) WHERE abs(r) >= 0.7",
    "correlation", "sample_size"))
def j6(spark, folder):
    frame = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "o_totalprice", "o_totalprice * 2 + o_custkey AS mixed", "-o_totalprice AS negated")
    return correlation.important_pairs(correlation.pearson(frame, ORDER_COLUMNS)).drop("p_value")


@add("j7_skipped_pairs", same(
    f"SELECT 'pearson' AS method, x AS variable_1, y AS variable_2, why AS reason, 0 AS sample_size FROM (SELECT x, y, {VERDICT} AS why "
    f"FROM ({pair_sql(FLAT, FLAT_COLUMNS)})) WHERE why IS NOT NULL", i="sample_size"))
def j7(spark, folder):
    frame = table(spark, folder, "lineitem").withColumns(
        {"one": F.lit(1.0), "never": F.expr("CASE WHEN l_orderkey < 0 THEN l_tax END")})
    return correlation.skipped_pairs(correlation.pearson(frame, FLAT_COLUMNS))


SAMPLE = 500


def share_sql(limit: int) -> str:
    return (
        "WITH s AS (SELECT event_type AS stratum, count(*) AS size FROM events GROUP BY 1), t AS (SELECT *, sum(size) OVER () AS total "
        f"FROM s), l AS (SELECT *, least({limit}, total) AS lim FROM t), e AS (SELECT *, CAST(lim * size // total AS BIGINT) AS base, "
        "lim * size % total AS rest FROM l), r AS (SELECT *, lim - sum(base) OVER () AS remaining, row_number() OVER (ORDER BY rest DESC, "
        "stratum) AS pos FROM e) SELECT stratum, size, base + CASE WHEN pos <= remaining AND base < size THEN 1 ELSE 0 END AS share FROM r"
    )


@add("k1_representative_sample", same(
    f"SELECT stratum AS event_type, share AS rows_kept FROM ({share_sql(SAMPLE)})", i="rows_kept"))
def k1(spark, folder):
    """Exact share of every stratum in a sample of the whole table."""
    sample = sampling.representative_sample(table(spark, folder, "events"), SAMPLE, ["event_id"], "ts", ["event_type"])
    return sample.groupBy("event_type").agg(F.count("*").alias("rows_kept"))


@add("k1_representative_rows")
def k1_rows(spark, folder):
    return sampling.representative_sample(table(spark, folder, "events"), SAMPLE, ["event_id"], "ts", ["event_type"])


@add("k2_evenly_spaced", same(
    f"SELECT (rn * least({SAMPLE}, n)) // n AS segment, 1 AS rows_kept FROM (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS rn, "
    "count(*) OVER () AS n FROM events) GROUP BY 1", i="segment rows_kept"))
def k2(spark, folder):
    """One row in each of the equal stretches of the time order."""
    from tablescope.plans.ordered import with_position

    events = table(spark, folder, "events")
    picked = sampling.evenly_spaced(events, SAMPLE, "ts", ["event_id"]).select("event_id")
    placed = with_position(events.select("ts", "event_id"), ["ts", "event_id"], name="rn", total="n")
    segment = F.expr(f"rn * least({SAMPLE}, n) div n")
    return placed.join(picked, "event_id", "left_semi").groupBy(segment.alias("segment")).agg(F.count("*").alias("rows_kept"))


@add("k3_largest_remainder_shares", same(share_sql(777), i="size share"))
def k3(spark, folder):
    sizes = table(spark, folder, "events").groupBy(F.col("event_type").alias("stratum")).agg(F.count("*").alias("size"))
    return sampling.allocate_shares(sizes, 777)


@add("k6_uniform_sample", same(f"SELECT least({SAMPLE}, count(*)) AS rows_kept, least({SAMPLE}, count(*)) AS distinct_rows FROM events",
                               i="rows_kept distinct_rows"))
def k6(spark, folder):
    out = sampling.uniform_sample(table(spark, folder, "events"), SAMPLE, ["event_id"])
    return out.agg(F.count("*").alias("rows_kept"), F.countDistinct("event_id").alias("distinct_rows"))


ID_COLUMNS = ["event_id", "user_id"]


@add("k7_identifier_counts", same(
    "SELECT column_name, category, c AS count, count(*) OVER (PARTITION BY column_name) AS total_unique FROM (SELECT column_name, v AS category, "
    f"count(*) AS c FROM ({long_sql('events', ID_COLUMNS, 'CAST({c} AS VARCHAR)')}) GROUP BY column_name, v)", i="count total_unique"))
def k7(spark, folder):
    return sampling.identifier_counts(table(spark, folder, "events"), ID_COLUMNS)


COMBOS = [c for size in (2, 3) for c in combinations(["doc_id", "lang", "quality"], size)]


@add("k8_identifier_combinations", same(
    "SELECT combination, \"values\", c AS count, count(*) OVER (PARTITION BY combination) AS total_unique FROM (" + " UNION ALL ".join(
        f"SELECT '{'||'.join(names)}' AS combination, concat_ws(',', "
        + ", ".join(f"COALESCE(CAST({n} AS VARCHAR), '缺失')" for n in names)
        + f") AS \"values\", count(*) AS c FROM {DOCS_LABELED} GROUP BY 1, 2" for names in COMBOS) + ")", i="count total_unique"))
def k8(spark, folder):
    return sampling.identifier_combinations(docs_labeled(spark, folder), ["doc_id", "lang", "quality"])


@add("k9_dataset_summary", same(
    "SELECT rows, columns, gone AS missing_values, gone / CAST(rows * columns AS DOUBLE) AS missing_rate, rows - k AS duplicate_rows, whole AS "
    "complete_rows FROM (SELECT count(*) AS rows, 4 AS columns, sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END + CASE WHEN toxic IS NULL "
    "THEN 1 ELSE 0 END) AS gone, count(*) FILTER (WHERE quality IS NOT NULL AND toxic IS NOT NULL) AS whole, (SELECT count(*) FROM (SELECT "
    f"DISTINCT text, lang, quality, toxic FROM {DOCS_LABELED})) AS k FROM {DOCS_LABELED})", "missing_rate",
    "rows columns missing_values duplicate_rows complete_rows"))
def k9(spark, folder):
    return typing.dataset_profile(docs_labeled(spark, folder).select("text", "lang", "quality", "toxic")).drop("data_bytes")


K10 = ["doc_id", "lang", "source", "quality"]


@add("k10_variable_summary", same(
    "SELECT column_name, count(*) - count(v) AS missing, (count(*) - count(v)) / CAST(count(*) AS DOUBLE) AS missing_ratio, "
    f"count(DISTINCT v) AS \"unique\" FROM ({long_sql(DOCS_LABELED, K10, 'CAST({c} AS VARCHAR)')}) GROUP BY column_name",
    "missing_ratio", "missing unique"))
def k10(spark, folder):
    out = typing.column_profile(docs_labeled(spark, folder).select(*K10))
    return out.select("column_name", "missing", "missing_ratio", "unique")


@add("k11_time_filter", same(
    "SELECT count(*) > 0 AS available, 'datetime' AS time_type, 'ts' AS time_column, epoch_us(min(ts)) / 1000.0 AS min, "
    "epoch_us(max(ts)) / 1000.0 AS max FROM events", "min max"))
def k11(spark, folder):
    return sampling.time_filter(table(spark, folder, "events"), "ts")


@add("k12_correlation_cells", same(
    "SELECT 'pearson' AS method, list_position(" + str(PART_NUMERIC) + ", x) - 1 AS x_index, list_position(" + str(PART_NUMERIC)
    + f", y) - 1 AS y_index, r AS value FROM (SELECT x, y, r FROM ({PART_PAIRS}) UNION ALL SELECT y, x, r FROM ({PART_PAIRS}) UNION ALL "
    "SELECT c, c, 1.0 FROM (SELECT unnest(" + str(PART_NUMERIC) + ") AS c)) WHERE r IS NOT NULL", "value", "x_index y_index"))
def k12(spark, folder):
    part = table(spark, folder, "part")
    matrix = correlation.correlation_matrix(correlation.pearson(part, PART_NUMERIC), part, PART_NUMERIC)
    return correlation.correlation_cells(matrix, PART_NUMERIC)
