"""Loading, cleaning and typing queries. Text inputs are derived from the tables inside each query."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.catalog.base import DOCS_LABELED, Catalogue, docs_labeled, long_sql, same, table
from tablescope.functions import clean
from tablescope.operators import prepare, report, typing
from tablescope.sources import csv

catalogue = Catalogue()
add = catalogue.add


def quoted_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# lineitem with its numbers written as text, some of them as one of the usual ways to say "missing".
TOKENS = (
    "CASE l_linenumber WHEN 3 THEN 'N/A' WHEN 4 THEN '' WHEN 5 THEN '-' WHEN 6 THEN 'null' WHEN 7 THEN 'abc' "
    "ELSE concat(' ', CAST(CAST(l_quantity AS INT) AS {text}), ' ') END"
)
LINE_TEXT = (
    f"(SELECT {TOKENS.format(text='VARCHAR')} AS quantity_text, CAST(l_orderkey AS VARCHAR) AS order_text, l_returnflag AS flag_text, "
    "CASE WHEN l_linenumber > 3 THEN 'True' ELSE 'False' END AS late_text, CASE WHEN l_linenumber = 2 THEN 'NA' ELSE "
    "CAST(l_discount AS VARCHAR) END AS discount_text, l_linenumber FROM lineitem)"
)


def line_text(spark, folder):
    return table(spark, folder, "lineitem").selectExpr(
        f"{TOKENS.format(text='STRING')} AS quantity_text", "CAST(l_orderkey AS STRING) AS order_text", "l_returnflag AS flag_text",
        "CASE WHEN l_linenumber > 3 THEN 'True' ELSE 'False' END AS late_text",
        "CASE WHEN l_linenumber = 2 THEN 'NA' ELSE CAST(l_discount AS STRING) END AS discount_text", "l_linenumber")


@add("a3_first_rows", same("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000", "o_totalprice", "o_orderkey"))
def a3(spark, folder):
    return report.table_preview(table(spark, folder, "orders"), ["o_orderkey"], 1000).select("o_orderkey", "o_totalprice")


@add("a4_missing_tokens", same(
    f"SELECT CASE WHEN quantity_text IN ({quoted_list(clean.CSV_MISSING_TOKENS)}) THEN 'missing' ELSE quantity_text END AS cell, "
    f"count(*) AS count FROM {LINE_TEXT} GROUP BY 1", i="count"))
def a4(spark, folder):
    cell = F.coalesce(csv.known(F.col("quantity_text")), F.lit("missing"))
    return line_text(spark, folder).groupBy(cell.alias("cell")).agg(F.count("*").alias("count"))


TEXT_COLUMNS = ["quantity_text", "order_text", "flag_text", "late_text", "discount_text"]
KNOWN = f"CASE WHEN {{c}} IN ({quoted_list(clean.CSV_MISSING_TOKENS)}) THEN NULL ELSE {{c}} END"


@add("a5_inferred_types", same(
    "SELECT column_name, ordinal, count(v) AS present, CASE WHEN count(v) = 0 THEN 'double' WHEN count(TRY_CAST(v AS BIGINT)) FILTER (WHERE "
    "NOT contains(v, '.')) = count(v) THEN 'bigint' WHEN count(TRY_CAST(v AS DOUBLE)) = count(v) THEN 'double' WHEN count(*) FILTER (WHERE v IN "
    f"('True', 'False')) = count(v) THEN 'boolean' ELSE 'string' END AS inferred FROM ({long_sql(LINE_TEXT, TEXT_COLUMNS, KNOWN)}) "
    "GROUP BY column_name, ordinal", i="ordinal present"))
def a5(spark, folder):
    cells = line_text(spark, folder).select(*[csv.known(F.col(c)).alias(c) for c in TEXT_COLUMNS])
    return csv.infer_types(cells, TEXT_COLUMNS)


@add("a7_empty_columns", "SELECT 'blank' AS column_name FROM documents HAVING count(CASE WHEN n_chars < 0 THEN lang END) = 0")
def a7(spark, folder):
    frame = table(spark, folder, "documents").withColumn("blank", F.expr("CASE WHEN n_chars < 0 THEN lang END"))
    return csv.empty_columns(frame, ["blank", "lang"])


@add("a8_loading_info", same(
    "SELECT count(*) AS rows, 3 AS columns, count(*) - count(quality) AS missing_values, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, "
    f"lang, quality FROM {DOCS_LABELED})) AS duplicate_rows FROM {DOCS_LABELED}", i="rows columns missing_values duplicate_rows"))
def a8(spark, folder):
    return csv.loading_info(docs_labeled(spark, folder).select("text", "lang", "quality"))


@add("a9_row_count", same("SELECT count(*) AS rows FROM lineitem", i="rows"))
def a9(spark, folder):
    return table(spark, folder, "lineitem").agg(F.count("*").alias("rows"))


JSON_ROW = (
    "'{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\",\"o_orderdate\":\"' || "
    "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '\",\"note\":' || CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE '\"\\u003cb\\u003e\"' END || '}'"
)


@add("a11_json_rows", f"SELECT {JSON_ROW} AS json FROM orders")
def a11(spark, folder):
    frame = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderdate", F.expr("CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE '<b>' END AS note"))
    return report.json_rows(frame)


EVENT_TYPES = {"event_type": "categorical", "value": "numeric", "user_id": "identifier", "ts": "datetime"}
CODE = "dense_rank() OVER (ORDER BY first_{c}) - 1 AS {c}_code"


@add("a12_row_payload", same(
    "SELECT value, dense_rank() OVER (ORDER BY first_type) - 1 AS event_type_code, dense_rank() OVER (ORDER BY first_user) - 1 AS user_id_code, "
    "epoch_us(ts) / 1000.0 AS time_value FROM (SELECT *, min(event_id) OVER (PARTITION BY event_type) AS first_type, min(event_id) OVER "
    "(PARTITION BY user_id) AS first_user FROM events)", "value time_value", "event_type_code user_id_code"))
def a12(spark, folder):
    return report.row_payload(table(spark, folder, "events"), EVENT_TYPES, ["event_id"], "ts")[0]


@add("a12_category_dictionary", same(
    "SELECT column_name, category, row_number() OVER (PARTITION BY column_name ORDER BY f) - 1 AS code FROM (SELECT column_name, v AS category, "
    f"min(event_id) AS f FROM ({long_sql('events', ['event_type', 'props', 'user_id'], 'CAST({c} AS VARCHAR)', 'event_id')}) GROUP BY 1, 2)", i="code"))
def a12_dictionary(spark, folder):
    return report.category_codes(table(spark, folder, "events"), ["event_type", "props", "user_id"], ["event_id"])


@add("a13_table_preview", same(
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 10",
    "o_totalprice", "o_orderkey o_custkey", "o_orderdate"))
def a13(spark, folder):
    return report.table_preview(table(spark, folder, "orders"), ["o_orderkey"])


B_TOKENS = quoted_list(clean.NUMERIC_MISSING_TOKENS)


@add("b1_numeric_missing_tokens", same(
    f"SELECT l_linenumber, count(*) AS rows, count(*) FILTER (WHERE trim(quantity_text) IN ({B_TOKENS})) AS tokens FROM {LINE_TEXT} "
    "GROUP BY l_linenumber", i="l_linenumber rows tokens"))
def b1(spark, folder):
    gone = clean.without_tokens(F.col("quantity_text")).isNull()
    return line_text(spark, folder).groupBy("l_linenumber").agg(F.count("*").alias("rows"), F.count_if(gone).alias("tokens"))


@add("b2_text_to_number", same(
    "SELECT l_linenumber, count(v) AS numbers, count(*) - count(v) AS missing, sum(v) AS total FROM (SELECT l_linenumber, "
    f"TRY_CAST(trim(quantity_text) AS DOUBLE) AS v FROM {LINE_TEXT}) GROUP BY l_linenumber", "total", "l_linenumber numbers missing"))
def b2(spark, folder):
    v = clean.to_number(F.col("quantity_text"))
    return line_text(spark, folder).groupBy("l_linenumber").agg(
        F.count(v).alias("numbers"), F.count_if(v.isNull()).alias("missing"), F.sum(v).alias("total"))


# orders with dates as Chinese text, as ISO text with some junk, and as compact whole numbers.
def order_dates(spark, folder):
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey", "date_format(o_orderdate, \"yyyy'年'M'月'd'日'\") AS cjk_date",
        "CASE WHEN o_orderkey % 10 = 0 THEN 'soon' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS iso_date",
        "CAST(date_format(o_orderdate, 'yyyyMMdd') AS BIGINT) AS compact_date", "o_totalprice",
        "CAST(o_orderkey % 24 * 100 + o_custkey % 70 AS BIGINT) AS clock_time")


PARSED = (
    "SELECT o_orderkey, o_orderdate AS cjk_date, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS iso_date, o_orderdate AS compact_date "
    "FROM orders"
)


@add("b3_datetime_parse", same(PARSED, "", "o_orderkey", "cjk_date iso_date compact_date"))
def b3(spark, folder):
    names = ["cjk_date", "iso_date", "compact_date"]
    return prepare.parse_datetimes(order_dates(spark, folder), names).select("o_orderkey", *names)


KINDS = {"iso_date": "datetime", "cjk_date": "datetime", "compact_date": "datetime", "o_totalprice": "numeric", "clock_time": "time"}
CLOCK = "(o_orderkey % 24 * 100 + o_custkey % 70)"
LOST_CLOCK = "count(*) FILTER (WHERE o_custkey % 70 > 59)"


@add("b4_datetime_columns", same(
    "SELECT 'datetime' AS kind, column_name, 'ok' AS status, 0 AS original_missing, count(*) - count(v) AS new_missing, count(*) - count(v) AS "
    f"newly_missing FROM ({long_sql(f'({PARSED})', ['iso_date', 'cjk_date', 'compact_date'], '{c}')}) GROUP BY column_name",
    i="original_missing new_missing newly_missing"))
def b4(spark, folder):
    steps = prepare.coerce(order_dates(spark, folder), KINDS)[1]
    return steps.filter("kind = 'datetime'").drop("reason")


@add("b5_time_of_day", same(
    "SELECT event_id, make_timestamp(1900, 1, 1, hour(ts), minute(ts), CAST(second(ts) AS DOUBLE)) AS from_clock, "
    "make_timestamp(1900, 1, 1, hour(ts), minute(ts), 0.0) AS from_short, make_timestamp(1900, 1, 1, hour(ts), minute(ts), 0.0) AS from_number, "
    "CASE WHEN event_id % 100 < 60 THEN make_timestamp(1900, 1, 1, 0, event_id % 100, 0.0) END AS from_text FROM events", "", "event_id",
    "from_clock from_short from_number from_text"))
def b5(spark, folder):
    frame = table(spark, folder, "events").selectExpr(
        "event_id", "date_format(ts, 'HH:mm:ss') AS clock", "date_format(ts, 'HH:mm') AS short", "hour(ts) * 100 + minute(ts) AS number",
        "CAST(event_id % 100 AS STRING) AS text")
    text, whole = T.StringType(), T.IntegerType()
    return frame.select(
        "event_id", clean.time_of_day(F.col("clock"), text).alias("from_clock"), clean.time_of_day(F.col("short"), text).alias("from_short"),
        clean.time_of_day(F.col("number"), whole).alias("from_number"), clean.time_of_day(F.col("text"), text).alias("from_text"))


@add("b6_combined_datetime", same(
    f"SELECT o_orderkey, CASE WHEN o_custkey % 70 <= 59 THEN o_orderdate + to_minutes(CAST({CLOCK} // 100 * 60 + {CLOCK} % 100 AS INT)) END AS "
    "\"DATETIME\" FROM orders", "", "o_orderkey", "DATETIME"))
def b6(spark, folder):
    frame = order_dates(spark, folder).select("o_orderkey", "cjk_date", "clock_time")
    return prepare.coerce(frame, {"cjk_date": "datetime", "clock_time": "time"})[0].select("o_orderkey", "DATETIME")


@add("b7_coerced_columns", same(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS iso_date, o_orderdate AS cjk_date, o_totalprice, CASE WHEN "
    f"o_custkey % 70 <= 59 THEN make_timestamp(1900, 1, 1, {CLOCK} // 100, {CLOCK} % 100, 0.0) END AS clock_time FROM orders", "o_totalprice",
    "o_orderkey", "iso_date cjk_date clock_time"))
def b7(spark, folder):
    return prepare.coerce(order_dates(spark, folder), KINDS)[0].select("o_orderkey", "iso_date", "cjk_date", "o_totalprice", "clock_time")


@add("b8_preprocessing_summary", same(
    "SELECT 'datetime' AS kind, 3 AS processed, 0 AS skipped, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS new_missing_values, '' AS "
    f"skipped_operations FROM orders UNION ALL SELECT 'time', 1, 0, {LOST_CLOCK}, '' FROM orders UNION ALL SELECT 'numeric', 1, 0, 0, '' UNION ALL "
    "SELECT 'combined_datetime', 0, 1, 0, 'DATETIME: datetime_time_pair_not_unique'", i="processed skipped new_missing_values"))
def b8(spark, folder):
    return prepare.summarize(prepare.coerce(order_dates(spark, folder), KINDS)[1])


@add("b9_refreshed_profile", same(
    f"SELECT count(*) AS rows, 3 AS columns, count(*) FILTER (WHERE o_orderkey % 10 = 0) + {LOST_CLOCK} AS missing_values, count(*) - (SELECT "
    f"count(*) FROM (SELECT DISTINCT CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END, CASE WHEN o_custkey % 70 <= 59 THEN {CLOCK} END, "
    "o_totalprice FROM orders)) AS duplicate_rows FROM orders", i="rows columns missing_values duplicate_rows"))
def b9(spark, folder):
    frame = order_dates(spark, folder).select("iso_date", "clock_time", "o_totalprice")
    coerced, _ = prepare.coerce(frame, {k: v for k, v in KINDS.items() if k in frame.columns}, combine=False)
    return prepare.refreshed_profile(coerced)[0].select("rows", "columns", "missing_values", "duplicate_rows")


@add("b11_infinity_to_missing", same(
    "SELECT o_orderstatus, count(*) AS rows, count(*) FILTER (WHERE o_orderkey % 7 <> 0) AS finite_rows, sum(o_totalprice) FILTER (WHERE o_orderkey "
    "% 7 <> 0) AS total FROM orders GROUP BY o_orderstatus", "total", "rows finite_rows"))
def b11(spark, folder):
    v = clean.finite(F.expr(
        "CASE o_orderkey % 7 WHEN 0 THEN CAST(CASE WHEN o_orderkey % 2 = 0 THEN '-Infinity' ELSE 'Infinity' END AS DOUBLE) ELSE o_totalprice END"))
    return table(spark, folder, "orders").groupBy("o_orderstatus").agg(
        F.count("*").alias("rows"), F.count(v).alias("finite_rows"), F.sum(v).alias("total"))


@add("b12_epoch_milliseconds", same("SELECT event_id, epoch_us(ts) AS microseconds FROM events", i="event_id microseconds"))
def b12(spark, folder):
    ms = clean.epoch_ms(F.col("ts"))
    return table(spark, folder, "events").select("event_id", F.round(ms * 1000).cast("long").alias("microseconds"))


# Text forms whose shares the type decision looks at.
FORMS = (
    "(SELECT strftime(o_orderdate, '%Y%m%d') AS compact_text, strftime(o_orderdate, '%Y年%m月%d日') AS cjk_text, CASE WHEN o_orderkey % 10 = 0 "
    "THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso_text, CASE WHEN o_orderkey % 4 = 0 THEN 'noon' ELSE printf('%02d:%02d', "
    "o_orderkey % 24, o_custkey % 60) END AS clock_text, o_orderpriority FROM orders)"
)
FORM_COLUMNS = ["compact_text", "cjk_text", "iso_text", "clock_text", "o_orderpriority"]


def forms(spark, folder):
    return table(spark, folder, "orders").selectExpr(
        "date_format(o_orderdate, 'yyyyMMdd') AS compact_text", "date_format(o_orderdate, \"yyyy'年'MM'月'dd'日'\") AS cjk_text",
        "CASE WHEN o_orderkey % 10 = 0 THEN 'soon' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS iso_text",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'noon' ELSE format_string('%02d:%02d', o_orderkey % 24, o_custkey % 60) END AS clock_text",
        "o_orderpriority")


def _share_query(name: str, shares: dict[str, str]) -> None:
    picked = ", ".join(f"avg(CASE WHEN {test} THEN 1.0 ELSE 0.0 END) AS {c}" for c, test in shares.items())

    @add(name, same(
        f"SELECT column_name, {picked} FROM ({long_sql(FORMS, FORM_COLUMNS, '{c}')}) GROUP BY column_name", " ".join(shares)))
    def query(spark, folder):
        return typing.column_features(forms(spark, folder)).select("column_name", *shares)


_share_query("c3_datetime_value_tests", {
    "compact_shape": "regexp_full_match(v, '\\d{8}')", "cjk": "regexp_full_match(v, '\\d{4}年\\d{1,2}月(\\d{1,2}日)?')",
    "separated": "regexp_matches(v, '[-/.:]')", "parsed": "try_strptime(v, ['%Y%m%d', '%Y-%m-%d']) IS NOT NULL"})
_share_query("c4_time_value_test", {"clock": "try_strptime(v, ['%H:%M:%S', '%H:%M']) IS NOT NULL"})
_share_query("c5_numeric_text_test", {"number": "TRY_CAST(v AS DOUBLE) IS NOT NULL"})

DOC_TEXT = ["text", "lang", "source"]


@add("c6_high_uniqueness_test", same(
    "SELECT column_name, count(DISTINCT v) / CAST(count(v) AS DOUBLE) AS uniqueness, count(DISTINCT v) / count(v) >= 0.95 AS looks_like_identifier "
    f"FROM ({long_sql('documents', [*DOC_TEXT, 'doc_id'], 'CAST({c} AS VARCHAR)')}) GROUP BY column_name", "uniqueness"))
def c6(spark, folder):
    features = typing.column_features(table(spark, folder, "documents").select(*DOC_TEXT, "doc_id"))
    share = F.col("unique") / F.col("non_null")
    return features.select(
        "column_name", share.alias("uniqueness"), (share >= typing.IDENTIFIER_UNIQUENESS).alias("looks_like_identifier"))


@add("c7_long_text_test", same(
    "SELECT column_name, avg(length(v)) AS mean_length, avg(length(v)) >= 50 OR (avg(length(v)) >= 20 AND count(DISTINCT v) / count(v) >= 0.5) AS "
    f"looks_like_text FROM ({long_sql('documents', DOC_TEXT, '{c}')}) GROUP BY column_name", "mean_length"))
def c7(spark, folder):
    features = typing.column_features(table(spark, folder, "documents").select(*DOC_TEXT))
    length, share = F.col("mean_length"), F.col("unique") / F.col("non_null")
    long = (length >= typing.LONG_TEXT) | ((length >= typing.MEDIUM_TEXT) & (share >= typing.MEDIUM_TEXT_UNIQUENESS))
    return features.select("column_name", "mean_length", long.alias("looks_like_text"))


def type_sql(source: str, kinds: dict[str, str]) -> str:
    """The type ladder for tables whose text columns hold neither numbers nor dates.

    ``kinds``: column to n (number), s (text) or t (timestamp).
    """
    stats = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {i} AS ordinal, '{k}' AS k, count(*) - count({c}) AS missing, count({c}) AS non_null, "
        f"count(DISTINCT {c}) AS u, avg(length(CAST({c} AS VARCHAR))) AS len FROM {source}" for i, (c, k) in enumerate(kinds.items()))
    name = "replace(lower(column_name), '_', ' ')"
    hint = "CASE " + " ".join(
        f"WHEN regexp_matches({name}, '{'|'.join(words)}') THEN '{kind}'" for kind, words in typing.HINTS.items()) + " END"
    return (
        "SELECT column_name, ordinal, CASE WHEN non_null = 0 THEN 'empty' WHEN regexp_matches(lower(column_name), '.id$') THEN 'identifier' WHEN "
        "k = 't' THEN 'datetime' WHEN k = 'n' AND hint = 'time_index' THEN 'time_index' WHEN k = 'n' AND hint IN ('duration', 'numeric') THEN "
        "'numeric' WHEN k = 'n' AND (hint = 'binary' OR u = 2) THEN 'binary' WHEN k = 'n' AND u <= 10 THEN 'categorical_numeric' WHEN k = 'n' THEN "
        "'numeric' WHEN hint = 'text' THEN 'text' WHEN u / non_null >= 0.95 THEN 'identifier' WHEN len >= 50 OR (len >= 20 AND u / non_null >= 0.5) "
        f"THEN 'text' ELSE 'categorical' END AS detected_type, missing, non_null, u AS \"unique\" FROM (SELECT *, {hint} AS hint FROM ({stats}))"
    )


LINEITEM_KINDS = dict(zip(
    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
     "l_linestatus", "l_shipdate"], "nnnnnnnnsst", strict=True))
TYPED_TABLES = {
    "lineitem": LINEITEM_KINDS,
    "orders": dict(o_orderkey="n", o_custkey="n", o_orderstatus="s", o_totalprice="n", o_orderdate="t", o_orderpriority="s"),
    "events": dict(event_id="n", ts="t", user_id="n", event_type="s", value="n", props="s"),
    "documents": dict(doc_id="n", text="s", lang="s", source="s", n_chars="n"),
    "conversations": dict(conv_id="n", turn="n", role="s", text="s"),
    "part": dict(p_partkey="n", p_name="s", p_brand="s", p_type="s", p_size="n", p_retailprice="n"),
}


def _type_query(source: str, kinds: dict[str, str]) -> None:
    @add(f"c8_types_of_{source}", same(type_sql(source, kinds), "", "ordinal missing non_null unique"))
    def query(spark, folder):
        return typing.detect_types(table(spark, folder, source)).drop("dtype", "reason")


for _source, _kinds in TYPED_TABLES.items():
    _type_query(_source, _kinds)


@add("c9_dataset_profile", same(
    "SELECT rows, 7 AS columns, m AS missing_values, m / CAST(rows * 7 AS DOUBLE) AS missing_rate, rows - k AS duplicate_rows, whole AS complete_rows "
    f"FROM (SELECT count(*) AS rows, 2 * (count(*) - count(quality)) AS m, count(quality) AS whole, (SELECT count(*) FROM (SELECT DISTINCT * FROM "
    f"{DOCS_LABELED})) AS k FROM {DOCS_LABELED})", "missing_rate", "rows columns missing_values duplicate_rows complete_rows"))
def c9(spark, folder):
    return typing.dataset_profile(docs_labeled(spark, folder)).drop("data_bytes")


@add("c9_type_counts", same(
    f"SELECT detected_type, count(*) AS columns FROM ({type_sql('lineitem', LINEITEM_KINDS)}) GROUP BY 1", i="columns"))
def c9_counts(spark, folder):
    return typing.type_counts(typing.detect_types(table(spark, folder, "lineitem")))


OVERRIDES = {"o_orderkey": "identifier", "o_orderdate": "temporal", "o_custkey": "temporal", "o_orderstatus": "nonsense", "absent": "numeric"}


@add("c10_type_overrides", same(
    "SELECT column_name, CASE column_name WHEN 'o_orderkey' THEN 'identifier' WHEN 'o_orderdate' THEN 'datetime' WHEN 'o_custkey' THEN 'time_index' "
    "ELSE detected_type END AS detected_type, detected_type AS auto_detected_type, CASE WHEN column_name IN ('o_orderkey', 'o_orderdate', "
    f"'o_custkey') THEN 'user' ELSE 'automatic' END AS type_source FROM ({type_sql('orders', TYPED_TABLES['orders'])})"))
def c10(spark, folder):
    types = typing.override_types(typing.detect_types(table(spark, folder, "orders")), OVERRIDES)
    return types.select("column_name", "detected_type", "auto_detected_type", "type_source")


@add("c11_data_bytes", same(
    "SELECT sum(strlen(text) + strlen(lang) + strlen(source) + 16) AS data_bytes "
    "FROM documents", i="data_bytes"))
def c11(spark, folder):
    return typing.dataset_profile(table(spark, folder, "documents")).select("data_bytes")
