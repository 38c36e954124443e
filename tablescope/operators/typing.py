"""Semantic types: what each column means, from its name and all of its values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions import clean
from tablescope.plans.small import small_table
from tablescope.plans.wide import distinct_counts, duplicate_rows, per_value, quoted

PASS_SHARE = 0.80
IDENTIFIER_UNIQUENESS = 0.95
LONG_TEXT, MEDIUM_TEXT, MEDIUM_TEXT_UNIQUENESS = 50, 20, 0.50
FEW_VALUES = 10

# Words looked for inside a normalised column name.
HINTS = {
    "datetime": ["date", "日期", "datetime", "timestamp", "时间戳"],
    "time_index": ["week", "weeks", "wk", "week number", "周", "周数", "星期", "period", "period number"],
    "duration": [
        "duration", "minute", "minutes", "mintue", "mintues", "hour", "hours", "second", "seconds", "day", "days",
        "playtime", "play time", "total time", "session time", "session duration", "elapsed time",
    ],
    "time": ["time", "时间", "timestamp", "datetime", "时刻"],
    "text": ["remark", "remarks", "comment", "comments", "description", "note", "notes"],
    "binary": ["pump duty", "switch", "status", "flag", "binary", "on/off", "yes/no"],
    "numeric": [
        "level", "flow", "ntu", "ph", "clr", "cl2", "alum", "pressure", "temperature", "temp", "speed", "amount",
        "value", "rate", "concentration", "height", "weight", "distance", "volume", "count",
    ],
}

# Whole names and endings that mark an identifier.
IDENTIFIER_NAMES = ["id", "uid", "uuid", "identifier", "标识符", "编号", "用户id", "玩家id"]
IDENTIFIER_COMPACT_NAMES = [
    "id", "uid", "uuid", "identifier", "playeruid", "playerid", "userid", "deviceid", "customerid", "accountid",
    "sessionid", "orderid", "itemid", "recordid",
]
IDENTIFIER_ENDINGS = (" id", " uid", " uuid", " identifier", " 编号")

CATEGORICAL_TYPES = ("categorical", "categorical_numeric", "binary", "boolean")
OVERRIDE_TYPES = ("numeric", "categorical", "identifier", "temporal")

_FEATURES = (
    "column_name string, ordinal int, dtype string, kind string, hint string, named_identifier boolean, row_count long, "
    "non_null long, integer_like boolean, low double, high double, compact_shape double, compact_parsed double, cjk double, "
    "separated double, parsed double, clock double, number double, mean_length double, unique long, number_unique long"
)
_NUMBER_SUFFIX = "\u0001number"


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if clean.is_numeric(dtype):
        return "number"
    if clean.is_temporal(dtype):
        return "timestamp"
    return "text" if isinstance(dtype, T.StringType) else "other"


def _normal(name: str) -> str:
    return name.strip().lower().replace("_", " ").replace("-", " ")


def name_hint(name: str) -> str | None:
    """First hint whose words occur in the normalised name."""
    normal = _normal(name)
    return next((kind for kind, words in HINTS.items() if any(w in normal for w in words)), None)


def identifier_name(name: str) -> bool:
    raw, normal = name.strip().lower(), _normal(name)
    return (
        (len(raw) > 2 and raw.endswith("id"))
        or normal in IDENTIFIER_NAMES
        or normal.replace(" ", "") in IDENTIFIER_COMPACT_NAMES
        or normal.endswith(IDENTIFIER_ENDINGS)
    )


_TEXT_TESTS = ("compact_shape", "cjk", "separated", "clock", "number")
_PARSE_TESTS = ("compact_parsed", "parsed")


def _text_tests(name: str) -> dict[str, Column]:
    c = F.col(quoted(name))
    text = clean.strip(c)
    first = F.substring(text, 1, 1)
    # Most text fails on its first character, long before a pattern is tried.
    digit = first.between("0", "9")
    return {
        "value": c.isNotNull(),
        "compact_shape": F.when(digit, text.rlike(r"^\d{8}$")),
        "cjk": F.when(digit, text.rlike(r"^\d{4}年\d{1,2}月(\d{1,2}日)?$")),
        "separated": text.rlike(r"[-/.:]"),
        "clock": F.when(digit, clean.is_clock_text(c)),
        "number": F.when(digit | first.isin("+", "-", ".", "i", "I"), clean.to_number(c).isNotNull()),
        "size": F.length(c),
    }


def _parse_tests(name: str) -> dict[str, Column]:
    c = F.col(quoted(name))
    return {
        "value": c.isNotNull(), "compact_parsed": clean.parse_compact(c).isNotNull(),
        "parsed": clean.parse_general(name).isNotNull(),
    }


def _digit_tests(name: str) -> dict[str, Column]:
    d = F.col(quoted(name)).cast("double")
    text = F.rint(d).try_cast("long").cast("string")
    return {
        "value": d.isNotNull(),
        "whole": F.abs(d - F.rint(d)) <= 1e-8 + 1e-5 * F.abs(F.rint(d)),
        "number": d,
        "compact_shape": text.rlike(r"^\d{8}$"),
        "compact_parsed": clean.parse_compact(text).isNotNull(),
    }


def _share(test: str) -> Column:
    return F.avg(F.when(F.col("value"), F.coalesce(F.col(test), F.lit(False)).cast("double")))


def _tested_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Shares of the present values that pass each test, and their mean length; one pass for all columns."""
    aggregates = {t: _share(t) for t in _TEXT_TESTS} | {"mean_length": F.avg("size")}
    return per_value(df, {c: _text_tests(c) for c in columns}, aggregates)


def _parsed_text(df: DataFrame, columns: list[str]) -> DataFrame:
    return per_value(df, {c: _parse_tests(c) for c in columns}, {t: _share(t) for t in _PARSE_TESTS})


def _tested_digits(df: DataFrame, columns: list[str]) -> DataFrame:
    return per_value(df, {c: _digit_tests(c) for c in columns}, {
        "integer_like": F.coalesce(F.bool_and("whole"), F.lit(False)), "low": F.min("number"), "high": F.max("number"),
        "compact_shape": _share("compact_shape"), "compact_parsed": _share("compact_parsed"),
    })


def column_features(df: DataFrame) -> DataFrame:
    """One row per column with everything the type decision looks at.

    Values are tested over all rows. The tests a column gets depend on its kind, and for numbers on its
    name: only names that speak of dates or times make digits tell time.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    features = {
        name: {
            "column_name": name, "ordinal": i, "dtype": dtype.simpleString(), "kind": _kind(dtype), "hint": name_hint(name),
            "named_identifier": identifier_name(name), "integer_like": False, "unique": 0, "number_unique": 0,
        }
        for i, (name, dtype) in enumerate(fields.items())
    }
    present = df.agg(F.count(F.lit(1)), *[F.count(F.col(quoted(c))) for c in fields]).first()
    for name, count in zip(fields, present[1:], strict=True):
        features[name] |= {"row_count": present[0], "non_null": count}
    texts = [c for c, f in features.items() if f["kind"] == "text"]
    digits = [c for c, f in features.items() if f["kind"] == "number" and f["hint"] in ("datetime", "time")]
    counted = [c for c, t in fields.items() if clean.is_supported(t)]
    # Each of these has one row per column.
    def note(table: DataFrame) -> None:
        for row in table.collect():
            features[row["column_name"]] |= {k: v for k, v in row.asDict().items() if k != "ordinal"}

    if texts:
        note(_tested_text(df, texts))
    if digits:
        note(_tested_digits(df, digits))
    # Parsing is costly and matters only where the shape of the text allows a date; elsewhere nothing counts as parsed.
    dated = [c for c in texts if max(features[c][t] or 0 for t in ("compact_shape", "cjk", "separated")) >= PASS_SHARE]
    for c in texts:
        features[c] |= {t: 0.0 for t in _PARSE_TESTS}
    if dated:
        note(_parsed_text(df, dated))
    numbers = [c for c in texts if (features[c]["number"] or 0) >= PASS_SHARE]
    for row in _hashed_counts(df, counted, numbers).collect() if counted else ():
        features[row["name"]]["number_unique" if row["as_number"] else "unique"] = row["unique"]
    names = [f.split()[0] for f in _FEATURES.split(", ")]
    return small_table(df.sparkSession, [tuple(f.get(n) for n in names) for f in features.values()], _FEATURES)


def _hashed_counts(df: DataFrame, columns: list[str], texts: list[str]) -> DataFrame:
    """``name, as_number, unique``: distinct values, and for text also distinct numbers written in it."""
    cells = {c: F.col(quoted(c)) for c in columns}
    numbers = {c + _NUMBER_SUFFIX: clean.to_number(F.col(quoted(c))) for c in texts}
    return distinct_counts(df, {**cells, **numbers}).select(
        F.split("column_name", _NUMBER_SUFFIX)[0].alias("name"),
        F.col("column_name").endswith(_NUMBER_SUFFIX).alias("as_number"),
        "unique",
    )


def decide_types(features: DataFrame) -> DataFrame:
    """``column_name, ordinal, dtype, detected_type, reason, missing, non_null, unique``."""
    f = F.col
    hint, kind = f("hint"), f("kind")
    passes = lambda c: f(c) >= PASS_SHARE
    compact = passes("compact_shape") & passes("compact_parsed")
    text_is_date = (kind == "text") & (compact | passes("cjk") | (passes("separated") & passes("parsed")))
    is_date = (kind == "timestamp") | text_is_date
    named_date = is_date | ((kind == "number") & f("integer_like") & compact)
    is_clock = (kind == "text") & passes("clock")
    is_number = (kind == "number") | ((kind == "text") & passes("number"))
    hhmm = (kind == "number") & f("integer_like") & (f("low") >= 0) & (f("high") <= clean.HHMM_LIMIT)
    values = F.when(kind == "number", f("unique")).otherwise(f("number_unique"))
    as_text = F.when(kind == "text", F.lit("_stored_as_text")).otherwise(F.lit(""))
    uniqueness = f("unique") / f("non_null")
    long_text = (f("mean_length") >= LONG_TEXT) | (
        (f("mean_length") >= MEDIUM_TEXT) & (uniqueness >= MEDIUM_TEXT_UNIQUENESS)
    )
    measured = F.when(kind == "text", "numeric_values_and_measurement_name").otherwise(
        "numeric_dtype_and_measurement_name"
    )
    plain_number = F.when(kind == "text", "numeric_values_stored_as_text").otherwise("numeric_dtype")
    two_values = F.when(kind == "text", "numeric_binary_stored_as_text").otherwise("numeric_binary_variable")

    ladder: list[tuple[Column, str, str | Column]] = [
        (kind == "other", "skipped", "unsupported_type"),
        (f("non_null") == 0, "empty", "no_valid_values"),
        (f("named_identifier"), "identifier", "identifier_column_name"),
        (kind == "boolean", "boolean", "boolean_dtype"),
        ((hint == "datetime") & named_date, "datetime", "datetime_column_name_and_values"),
        ((hint == "time_index") & is_number, "time_index", "time_index_column_name_and_numeric_values"),
        ((hint == "duration") & is_number, "numeric", "duration_column_name"),
        ((hint == "time") & is_clock, "time", "time_column_name_and_values"),
        ((hint == "time") & hhmm, "time", "numeric_time_column"),
        (is_date, "datetime", "datetime_pattern_detected"),
        (is_clock, "time", "time_pattern_detected"),
        (is_number & (hint == "numeric"), "numeric", measured),
        (is_number & (hint == "binary"), "binary", "binary_column_name"),
        (is_number & (values == 2), "binary", two_values),
        (is_number & (values <= FEW_VALUES), "categorical_numeric", F.concat(F.lit("low_cardinality_numeric"), as_text)),
        (is_number, "numeric", plain_number),
        (hint == "text", "text", "text_column_name"),
        (uniqueness >= IDENTIFIER_UNIQUENESS, "identifier", "very_high_uniqueness"),
        (long_text, "text", "long_text_detected"),
        (F.lit(True), "categorical", "categorical_or_string_variable"),
    ]
    verdict = F.coalesce(
        *[
            F.when(
                test,
                F.struct(
                    F.lit(kind_name).alias("detected_type"),
                    (F.lit(why) if isinstance(why, str) else why).alias("reason"),
                ),
            )
            for test, kind_name, why in ladder
        ]
    )
    return features.withColumn("verdict", verdict).select(
        "column_name", "ordinal", "dtype", "verdict.detected_type", "verdict.reason",
        (f("row_count") - f("non_null")).alias("missing"), "non_null", "unique",
    )


def detect_types(df: DataFrame) -> DataFrame:
    return decide_types(column_features(df))


def override_types(types: DataFrame, overrides: Mapping[str, str] | DataFrame) -> DataFrame:
    """Apply user choices ``{column: numeric | categorical | identifier | temporal}``; others are ignored."""
    if isinstance(overrides, DataFrame):
        chosen = overrides.select(F.col("column_name").alias("_name"), F.col("selected_type").alias("_selected"))
    else:
        chosen = small_table(types.sparkSession, list(overrides.items()), "_name string, _selected string")
    chosen = chosen.filter(F.col("_selected").isin(*OVERRIDE_TYPES))
    auto = F.col("detected_type")
    actual = F.when(
        F.col("_selected") == "temporal", F.when(auto == "datetime", "datetime").otherwise("time_index")
    ).otherwise(F.col("_selected"))
    joined = types.join(chosen, types["column_name"] == chosen["_name"], "left")
    return joined.select(
        "column_name", "ordinal", "dtype",
        F.coalesce(actual, auto).alias("detected_type"),
        F.coalesce(F.concat(F.lit("user_override_"), F.col("_selected")), F.col("reason")).alias("reason"),
        F.when(F.col("_selected").isNotNull(), "user").otherwise("automatic").alias("type_source"),
        auto.alias("auto_detected_type"), F.col("reason").alias("auto_detected_reason"),
        "missing", "non_null", "unique",
    )


def type_counts(types: DataFrame) -> DataFrame:
    return types.groupBy("detected_type").agg(F.count("*").alias("columns"))


def type_map(types: DataFrame) -> dict[str, str]:
    """``{column: detected_type}`` in column order, to plan further work (one entry per column)."""
    return {r["column_name"]: r["detected_type"] for r in sorted(types.collect(), key=lambda r: r["ordinal"])}


def pick(types: Mapping[str, str], *kinds: str) -> list[str]:
    return [c for c, t in types.items() if t in kinds]


def numeric_columns(types: Mapping[str, str]) -> list[str]:
    return pick(types, "numeric")


def categorical_columns(types: Mapping[str, str]) -> list[str]:
    return pick(types, *CATEGORICAL_TYPES)


def time_axis(types: Mapping[str, str], requested: str | None = None) -> tuple[str, str | None, str]:
    """(status, column, reason) of the axis for time-series work."""
    dates = pick(types, "datetime")
    if not dates:
        indexes = pick(types, "time_index")
        if indexes:
            return "ok", indexes[0], "time_index"
        return "skipped", None, "no_datetime_or_time_index_variable"
    if requested is not None:
        return ("ok", requested, "user_selected") if requested in dates else ("skipped", None, "invalid_datetime_column")
    if "DATETIME" in dates:
        return "ok", "DATETIME", "combined_datetime"
    if len(dates) == 1:
        return "ok", dates[0], "single_datetime_variable"
    return "skipped", None, "multiple_datetime_columns"


_WIDTHS = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}


def row_bytes(df: DataFrame) -> Column:
    """Bytes of the values of a row: string lengths plus the width of fixed types."""
    total = F.lit(0).cast("long")
    for field in df.schema.fields:
        c = F.col(quoted(field.name))
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(c)
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = F.octet_length(F.to_json(F.struct(c)))
        else:
            size = F.when(c.isNotNull(), _WIDTHS.get(type(field.dataType), 8))
        total = total + F.coalesce(size, F.lit(0))
    return total


def missing_in_row(columns: list[str]) -> Column:
    missing = F.lit(0)
    for c in columns:
        missing = missing + F.col(quoted(c)).isNull().cast("int")
    return missing


def profile_measures(df: DataFrame) -> dict[str, Column]:
    missing = missing_in_row(df.columns)
    return {"missing_values": missing, "complete_rows": (missing == 0).cast("int"), "data_bytes": row_bytes(df)}


def dataset_profile(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """One row: rows, columns, missing cells and rate, duplicate and complete rows, bytes of data.

    ``counted`` is ``duplicate_rows`` with the ``profile_measures`` where that is at hand.
    """
    width = len(df.columns)
    rows = F.col("row_count")
    return (duplicate_rows(df, profile_measures(df)) if counted is None else counted).select(
        rows.alias("rows"),
        F.lit(width).cast("long").alias("columns"),
        "missing_values",
        F.coalesce(F.try_divide(F.col("missing_values"), rows * width), F.lit(0.0)).alias("missing_rate"),
        "duplicate_rows",
        "complete_rows",
        "data_bytes",
    )


def column_profile(df: DataFrame) -> DataFrame:
    """The type table with missing ratios."""
    total = F.col("missing") + F.col("non_null")
    return detect_types(df).withColumn(
        "missing_ratio", F.coalesce(F.try_divide(F.col("missing"), total), F.lit(0.0))
    )
