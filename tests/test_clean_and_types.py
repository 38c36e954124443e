import re

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions import clean
from tablescope.operators import prepare, typing

D = dt.datetime


def values(spark, cells, expr, schema="a string"):
    frame = spark.createDataFrame([(c,) for c in cells], schema)
    return [r[0] for r in frame.select(expr).collect()]


def test_numeric_text(spark):
    cells = [" 1.5 ", "-", "N/A", ".", "1e3", "1d", "abc", "--", "+2", "inf"]
    assert values(spark, cells, clean.to_number(F.col("a"))) == [1.5, None, None, None, 1000.0, None, None, None, 2.0, float("inf")]


def test_times_of_day(spark):
    cells = ["14:30", "14:30:15", "1430", "2460", "-", "25:00"]
    got = values(spark, cells, clean.time_of_day(F.col("a"), T.StringType()))
    assert got == [D(1900, 1, 1, 14, 30), D(1900, 1, 1, 14, 30, 15), D(1900, 1, 1, 14, 30), None, None, None]
    assert values(spark, [930, 2400], clean.time_of_day(F.col("a"), T.LongType()), "a long") == [D(1900, 1, 1, 9, 30), None]


def test_micros_do_not_depend_on_the_session_zone(spark):
    frame = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00.000001' AS t")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # this hour does not exist there
        row = frame.select(clean.micros(F.col("t")).alias("us"), clean.from_micros(clean.micros(F.col("t"))).alias("t")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert row.us == 1710037800000001 and row.t == D(2024, 3, 10, 2, 30, 0, 1)


def test_chinese_dates_choose_one_format_per_column(spark):
    frame = spark.createDataFrame(
        [("2023年1月3日", "2023年1月", "2023年1月3日 04:05", "2023-01-03"), ("2023年12月30日", "2023年2月", "2023年1月3日 14:05", None)],
        "a string, b string, c string, d string")
    got = prepare.parse_datetimes(frame, ["a", "b", "c", "d"]).collect()
    assert list(got[0]) == [D(2023, 1, 3), D(2023, 1, 1), D(2023, 1, 3, 4, 5), D(2023, 1, 3)]
    assert list(got[1]) == [D(2023, 12, 30), D(2023, 2, 1), D(2023, 1, 3, 14, 5), None]


def test_nan_is_missing(spark):
    frame = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    assert clean.tidy(frame).filter("x IS NULL").count() == 2


def kinds_of(spark, columns):
    """``{name: (values, type)}`` to ``{name: detected type}``."""
    names = list(columns)
    rows = list(zip(*[columns[n][0] for n in names], strict=True))
    frame = spark.createDataFrame(rows, ", ".join(f"`{n}` {columns[n][1]}" for n in names))
    return typing.type_map(typing.detect_types(clean.tidy(frame)))


def test_type_ladder(spark):
    n = 40
    columns = {
        "nothing": ([None] * n, "string"),
        "yes": ([i % 2 == 0 for i in range(n)], "boolean"),
        "two": ([i % 2 for i in range(n)], "int"),
        "ten": ([i % 10 for i in range(n)], "int"),
        "eleven": ([i % 11 for i in range(n)], "int"),
        "week_no": (list(range(n)), "int"),
        "minutes": ([i % 3 for i in range(n)], "int"),
        "remark": ([f"r{i}" for i in range(n)], "string"),
        "story": (["lorem ipsum " * 5 + str(i % 9) for i in range(n)], "string"),
        "code": ([f"c{i}" for i in range(n)], "string"),
        "paid": ([i % 2 for i in range(n)], "int"),
        "word": ([f"w{i % 5}" for i in range(n)], "string"),
        "status": ([i % 7 for i in range(n)], "int"),
        "l_discount": ([i % 3 for i in range(n)], "int"),
        "numbers": ([str(i * 1.5) for i in range(n)], "string"),
        "two_text": ([str(i % 2) for i in range(n)], "string"),
        "few_text": ([str(i % 4) for i in range(n)], "string"),
        "clock": (["12:30"] * n, "string"),
        "time": ([930 + i % 20 for i in range(n)], "int"),
        "cjk": (["2023年1月3日"] * n, "string"),
        "date": ([20230105] * n, "long"),
        "x": ([20230105 + i for i in range(n)], "long"),
        "iso": ([f"2023-01-{i % 28 + 1:02d}" for i in range(n)], "string"),
        "user-id": (list(range(n)), "int"),
        "编号": (["a"] * n, "string"),
    }
    want = {
        "nothing": "empty", "yes": "boolean", "two": "binary", "ten": "categorical_numeric", "eleven": "numeric",
        "week_no": "time_index", "minutes": "numeric", "remark": "text", "story": "text", "code": "identifier",
        "paid": "identifier", "word": "categorical", "status": "binary", "l_discount": "numeric", "numbers": "numeric",
        "two_text": "binary", "few_text": "categorical_numeric", "clock": "time", "time": "time", "cjk": "datetime",
        "date": "datetime", "x": "numeric", "iso": "datetime", "user-id": "identifier", "编号": "identifier",
    }
    assert kinds_of(spark, columns) == want


def test_overrides(spark):
    types = typing.detect_types(spark.createDataFrame([(1, "2023-01-01")], "a int, d string"))
    out = typing.override_types(types, {"a": "temporal", "d": "temporal", "zzz": "numeric"})
    got = {r.column_name: (r.detected_type, r.reason, r.type_source) for r in out.collect()}
    assert got["a"] == ("time_index", "user_override_temporal", "user")
    assert got["d"] == ("datetime", "user_override_temporal", "user")
    plain = typing.override_types(types, {"a": "nonsense"}).filter("type_source = 'user'")
    assert plain.count() == 0


def test_time_axis_choice():
    assert typing.time_axis({"a": "numeric"}) == ("skipped", None, "no_datetime_or_time_index_variable")
    assert typing.time_axis({"w": "time_index"}) == ("ok", "w", "time_index")
    assert typing.time_axis({"a": "datetime", "b": "datetime"}) == ("skipped", None, "multiple_datetime_columns")
    assert typing.time_axis({"a": "datetime", "DATETIME": "datetime"})[1] == "DATETIME"
    assert typing.time_axis({"a": "datetime"}, "b")[2] == "invalid_datetime_column"


def test_date_plus_time(spark):
    frame = spark.createDataFrame([("2023-01-05", 930), ("2023-01-06", 2400)], "d string, t int")
    out, steps = prepare.coerce(frame, {"d": "datetime", "t": "time"})
    assert [r.DATETIME for r in out.orderBy("d").collect()] == [D(2023, 1, 5, 9, 30), None]
    made = steps.filter("kind = 'combined_datetime'").first()
    assert (made.status, made.new_missing) == ("ok", 1)
    twice = frame.withColumn("e", F.col("d"))
    _, steps = prepare.coerce(twice, {"d": "datetime", "e": "datetime", "t": "time", "gone": "numeric"})
    reasons = {r.column_name: r.reason for r in steps.filter("status = 'skipped'").collect()}
    assert reasons == {"DATETIME": "datetime_time_pair_not_unique", "gone": "column_not_found"}


@pytest.mark.parametrize(("text", "want"), [
    ("2024-01-05T10:00:00Z", "2024-01-05 10:00:00"), ("2024-01-05 10:00:00+08:00", "2024-01-05 02:00:00"), ("05-Jan-2024", "2024-01-05 00:00:00"),
    ("2024-01-05 10:00:00.123456789", "2024-01-05 10:00:00.123456"), ("January 5, 2024", "2024-01-05 00:00:00"), ("5 Jan 2024", "2024-01-05 00:00:00"),
    ("1/5/2024 3:07 PM", "2024-01-05 15:07:00"), ("20240105 10:07", "2024-01-05 10:07:00"), ("13/01/2024", "2024-01-13 00:00:00"),
    ("\t2024-01-05\u3000", "2024-01-05 00:00:00"), ("May be 5, or 6", None), ("5 apples", None),
])
def test_dates_people_write(spark, text, want):
    got = spark.createDataFrame([(text,)], "x string").select(clean.parse_general("x").cast("string").alias("d")).first().d
    assert got == want


def test_every_date_format_reads_what_it_writes(spark):
    plain = [p for _, p in clean.GENERAL_FORMATS if "[" not in p]
    when = F.lit("2023-05-25 22:41:07").cast("timestamp_ntz")
    written = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(p).alias("pattern"), F.date_format(when, p).alias("x")) for p in plain])))
    rows = written.withColumn("d", clean.parse_general("x").cast("string")).collect()
    for r in rows:
        day = "2023-05-25" if "d" in r.pattern else "2023-05-01"
        clock = "00:00:00" if not re.search("[Hh]", r.pattern) else "22:41:07" if "ss" in r.pattern else "22:41:00"
        assert r.d == f"{day} {clock}", r
    assert len(rows) == len(plain)


def test_a_text_without_its_digits_names_its_formats():
    found = clean._by_skeleton()
    assert sorted({i for formats in found.values() for i in formats}) == list(range(len(clean.GENERAL_FORMATS)))
    assert max(map(len, found.values())) <= 3
