"""Coercing columns to their detected types, with a record of what each step did."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions import clean
from tablescope.operators.typing import column_profile, dataset_profile, pick
from tablescope.plans.small import small_table
from tablescope.plans.wide import quoted

COMBINED = "DATETIME"
DATETIME_PASS = 0.80

_RECORD = (
    "kind string, column_name string, status string, reason string, original_missing long, new_missing long, "
    "newly_missing long"
)


def datetime_candidates(name: str, dtype: T.DataType) -> list[Column]:
    """The general parse and its whole-column alternatives, in the order they are tried."""
    c = F.col(quoted(name))
    if clean.is_temporal(dtype):
        return [c.cast("timestamp_ntz")]
    if clean.is_numeric(dtype):
        return [clean.parse_compact(F.rint(c.cast("double")).cast("long"))]
    return [clean.parse_general(name), *[clean.parse_format(name, shape, f) for shape, f in clean.CJK_FORMATS]]


def choose_datetime_parse(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Which candidate each column uses: the first that reads 80 % of all rows, else the best; one scan."""
    tests = {
        (c, i): F.avg(candidate.isNotNull().cast("double"))
        for c in columns
        for i, candidate in enumerate(datetime_candidates(c, df.schema[c].dataType))
    }
    if not tests:
        return {}
    row = df.agg(*[t.alias(f"t{k}") for k, t in enumerate(tests.values())]).first()
    chosen: dict[str, int] = {}
    best: dict[str, float] = {}
    for (c, i), share in zip(tests, row, strict=True):
        share = share or 0.0
        if c not in chosen or (best[c] < DATETIME_PASS and share > best[c]):
            chosen[c], best[c] = i, share
    return chosen


def parse_datetimes(df: DataFrame, columns: list[str]) -> DataFrame:
    chosen = choose_datetime_parse(df, columns)
    return df.withColumns(
        {c: datetime_candidates(c, df.schema[c].dataType)[i] for c, i in chosen.items()}
    )


def to_numeric(c: Column, dtype: T.DataType) -> Column:
    if clean.is_numeric(dtype):
        return c
    return clean.to_number(c) if isinstance(dtype, T.StringType) else c.cast("double")


def coerce(df: DataFrame, types: Mapping[str, str], combine: bool = True) -> tuple[DataFrame, DataFrame]:
    """(frame with typed columns, table of transformations)."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    parses = choose_datetime_parse(df, [c for c in pick(types, "datetime") if c in fields])
    exprs: dict[str, tuple[str, Column]] = {}
    for c in (c for c in pick(types, "numeric") if c in fields):
        exprs[c] = ("numeric", to_numeric(F.col(quoted(c)), fields[c]))
    for c, i in parses.items():
        exprs[c] = ("datetime", datetime_candidates(c, fields[c])[i])
    for c in (c for c in pick(types, "time") if c in fields):
        exprs[c] = ("time", clean.time_of_day(F.col(quoted(c)), fields[c]))
    out = df.withColumns({c: e for c, (_, e) in exprs.items()})
    dates, times = ([c for c, (k, _) in exprs.items() if k == kind] for kind in ("datetime", "time"))
    pair = len(dates) == 1 and len(times) == 1
    combined = clean.combine_date_time(exprs[dates[0]][1], exprs[times[0]][1]) if combine and pair else None
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(quoted(c)).isNull()).alias(f"o{i}") for i, c in enumerate(exprs)],
        *[F.count_if(e.isNull()).alias(f"n{i}") for i, (_, e) in enumerate(exprs.values())],
        (F.count(combined) if combined is not None else F.lit(0)).alias("combined"),
    ).first()
    records = [
        (kind, c, "ok", None, counts[f"o{i}"], counts[f"n{i}"], max(0, counts[f"n{i}"] - counts[f"o{i}"]))
        for i, (c, (kind, _)) in enumerate(exprs.items())
    ]
    absent = [c for c in pick(types, "numeric", "datetime", "time") if c not in fields]
    records += [(types[c], c, "skipped", "column_not_found", None, None, None) for c in absent]
    if combine:
        reason = None
        if not pair:
            reason = "datetime_time_pair_not_unique"
        elif counts["combined"] == 0:
            reason = "unable_to_combine_date_and_time"
        else:
            out = out.withColumn(COMBINED, clean.combine_date_time(F.col(quoted(dates[0])), F.col(quoted(times[0]))))
        missing = counts["n"] - counts["combined"] if reason is None else None
        records.append(("combined_datetime", COMBINED, "skipped" if reason else "ok", reason, None, missing, None))
    return out, small_table(df.sparkSession, records, _RECORD)


def summarize(transformations: DataFrame) -> DataFrame:
    """Per kind: columns processed, columns skipped, values lost."""
    ok = F.col("status") == "ok"
    return transformations.groupBy("kind").agg(
        F.count_if(ok).alias("processed"), F.count_if(~ok).alias("skipped"),
        F.coalesce(F.sum("newly_missing"), F.lit(0)).alias("new_missing_values"),
        F.array_sort(F.collect_set(F.when(~ok, F.concat_ws(": ", "column_name", "reason")))).alias("skipped_operations"),
    )


def refreshed_profile(coerced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dataset and column profile after coercion."""
    return dataset_profile(coerced), column_profile(coerced)
