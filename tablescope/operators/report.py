"""All analyses of one table, and the bundle of result tables they are written to."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions import clean
from tablescope.operators import (
    calendar, categorical, charts, correlation, missing, prepare, quality, sampling, series, statistics, typing,
)
from tablescope.operators.categorical import MISSING_LABEL, label
from tablescope.plans.materialize import materialize, settled
from tablescope.plans.ordered import with_position
from tablescope.plans.selection import Quantiles, column_quantiles, column_spreads
from tablescope.plans.small import OnePass, at_hand, small_table
from tablescope.plans.wide import duplicate_rows, quoted, unpivot

SCHEMA_VERSION = "1.0"
PREVIEW_ROWS = 10


def table_preview(df: DataFrame, order_by: Sequence[str] = (), rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows, of ``order_by`` when given."""
    return (df.orderBy(*[F.col(quoted(c)) for c in order_by]) if order_by else df).limit(rows)


def _safe(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(F.abs(c) < float("inf"), c)
    if clean.is_temporal(dtype):
        return F.date_format(c.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda e: _safe(e, dtype.elementType))
    return c


def json_safe(df: DataFrame) -> DataFrame:
    """Infinite and not-a-number become null, times ISO text."""
    return df.select(*[_safe(F.col(quoted(f.name)), f.dataType).alias(f.name) for f in df.schema.fields])


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row, markup characters escaped so that it can sit inside a page."""
    text = F.to_json(F.struct(*[F.col(quoted(c)) for c in df.columns]), {"ignoreNullFields": "false"})  # of the safe frame
    for raw, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return json_safe(df).select(text.alias("json"))


def category_codes(df: DataFrame, columns: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Dictionary ``column_name, category, code``: codes count up in order of first appearance."""
    order = F.struct(*[F.col(quoted(c)) for c in order_by])
    cells = unpivot(
        df.withColumn("_order", order), {c: F.coalesce(label(c), F.lit(MISSING_LABEL)) for c in columns}, ["_order"],
        value="category",
    )
    first = cells.groupBy("column_name", "category").agg(F.min("_order").alias("_first"))
    return with_position(first, ["_first", "category"], ["column_name"], name="code").drop("_first")


def row_payload(
    df: DataFrame, types: Mapping[str, str], order_by: Sequence[str], time_col: str | None = None,
    limit: int | None = None, strata: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, dictionary, scope) of the exploration table.

    Numbers without infinities, categories and identifiers as codes into the dictionary, time as
    milliseconds. With ``limit`` the rows are a representative sample.
    """
    source = df.count()
    sampled = sampling.representative_sample(df, limit, order_by, time_col, strata, repeats=True) if limit else df
    truncated = bool(limit and source > limit)
    if truncated:
        sampled = materialize(sampled)
    numbers = typing.numeric_columns(types)
    coded = [*typing.categorical_columns(types), *typing.pick(types, "identifier")]
    dictionary = materialize(category_codes(sampled, coded, order_by)) if coded else None
    rows = sampled.select(
        *[F.col(quoted(k)).alias(f"_o{i}") for i, k in enumerate(order_by)],
        *[clean.finite(F.col(quoted(c))).alias(f"n{i}") for i, c in enumerate(numbers)],
        *[F.coalesce(label(c), F.lit(MISSING_LABEL)).alias(f"l{i}") for i, c in enumerate(coded)],
        *([sampling.time_number(sampled, time_col).alias("time_value")] if time_col else []),
    )
    for i, c in enumerate(coded):
        side = dictionary.filter(F.col("column_name") == c).select(
            F.col("category").alias(f"l{i}"), F.col("code").alias(f"code{i}")
        )
        rows = rows.join(settled(side), f"l{i}")
    rows = rows.select(
        *[F.col(f"n{i}").alias(c) for i, c in enumerate(numbers)],
        *[F.col(f"code{i}").alias(f"{c}_code") for i, c in enumerate(coded)],
        *(["time_value"] if time_col else []),
    )
    kept = sampled.count() if truncated else source
    scope = small_table(df.sparkSession, [(source, kept, limit, truncated)],
        "source_row_count long, row_count long, sample_limit long, truncated boolean",
    )
    return rows, dictionary, scope


FULL_EXPORT_ROWS = 500_000  # fixed value: rows of the exploration table beyond which it is a sample
IDENTIFIER_LIMIT = 500


class _Facts:
    """What one pass over a typed table says about each of its columns, and the tables reports start from."""

    def __init__(self, df: DataFrame, plain: Sequence[str], numbers: Sequence[str], dates: Sequence[str], kinds: Mapping[str, str]):
        self.df, self.spark, self.numbers, self.dates = df, df.sparkSession, list(numbers), list(dates)
        self.listed = [c for c in kinds if c in df.columns]
        # Only floating columns can hold infinities, which some reports leave out.
        self.open_ended = [c for c in numbers if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
        ask = OnePass(df)
        ask.ask({("total", k): m for k, m in missing.total_measures(self.listed).items()})
        ask.ask({("present", c): F.count(F.col(quoted(c))) for c in df.columns})
        ask.ask({("same", c): F.coalesce(F.min(quoted(c)) == F.max(quoted(c)), F.lit(True)) for c in plain})
        for c in numbers:
            ask.ask({(k, c): m for k, m in self._moments(statistics.number(c)).items()})
        for c in self.open_ended:
            ask.ask({(f"finite_{k}", c): m for k, m in self._moments(clean.finite(F.col(quoted(c)))).items()})
        for c in dates:
            ask.ask({(k, c): m for k, m in calendar.range_measures(c).items()})
        self.found = ask.answer()
        self.rows = self.found["total", "n"]

    @staticmethod
    def _moments(v: Column) -> dict[str, Column]:
        return {"n": F.count(v), "mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v), "max": F.max(v), "g1": F.skewness(v), "g2": F.kurtosis(v)}

    def _finite(self, k: str, c: str):
        return self.found[f"finite_{k}" if c in self.open_ended else k, c]

    def endless(self) -> list[str]:
        """Columns that hold infinities."""
        return [c for c in self.open_ended if self.found["n", c] != self.found["finite_n", c]]

    def nulls(self, columns: Sequence[str]) -> DataFrame:
        rows = [(c, i, self.rows, self.rows - self.found["present", c]) for i, c in enumerate(columns)]
        return small_table(self.spark, rows, "column_name string, ordinal int, row_count long, missing_count long")

    def constants(self, columns: Sequence[str]) -> DataFrame:
        rows = [(c, i, self.rows, self.found["present", c], self.found["same", c]) for i, c in enumerate(columns)]
        return small_table(self.spark, rows, "column_name string, ordinal int, row_count long, non_null long, same boolean")

    def totals(self) -> DataFrame:
        keys = ("n", "total_missing", "complete_rows", "columns_with_missing")
        return small_table(self.spark, [[self.found["total", k] for k in keys]], ", ".join(f"{k} long" for k in keys))

    def moments(self) -> DataFrame:
        f = self.found
        rows = [(c, i, f["n", c], self.rows - f["n", c], *[f[k, c] for k in ("mean", "std", "min", "max", "g1", "g2")]) for i, c in enumerate(self.numbers)]
        return small_table(self.spark, rows, "column_name string, ordinal int, count long, missing long, mean double, std double, min double, max double, g1 double, g2 double")

    def finite_moments(self) -> DataFrame:
        rows = [(c, i, *[self._finite(k, c) for k in ("n", "min", "max", "mean", "std", "g1", "g2")]) for i, c in enumerate(self.numbers)]
        return small_table(self.spark, rows, "column_name string, ordinal int, n long, low double, high double, mean double, std double, g1 double, g2 double")

    def bounds(self) -> dict[str, tuple[float, float, float]]:
        """Of the columns whose finite values vary."""
        found = {c: tuple(self._finite(k, c) for k in ("min", "max", "mean")) for c in self.numbers}
        return {c: b for c, b in found.items() if b[0] is not None and b[0] < b[1]}

    def time_range(self, c: str) -> DataFrame:
        row = [self.found[k, c] for k in ("min_datetime", "max_datetime", "valid_count", "missing_count")]
        return self.spark.createDataFrame([row], "min_datetime timestamp_ntz, max_datetime timestamp_ntz, valid_count long, missing_count long")


def analyse(
    df: DataFrame, order_by: Sequence[str], overrides: Mapping[str, str] | None = None, time_col: str | None = None,
    sample_limit: int | None = FULL_EXPORT_ROWS,
) -> dict[str, DataFrame]:
    """Type, coerce and analyse a table: ``{name: result table}``. ``order_by`` breaks ties of time.

    Scans are shared: one pass for counts, moments and ranges of all columns, one quantile search with the median distances,
    one pass for fences and boxes, one for all pairs of numbers, one table of counts each for categories, missing patterns,
    duplicate rows, and per date for its gaps and its hours; every report is derived from these. ``time_col`` chooses the
    time axis among several dates. The dashboard's tables come along: ``row_payload`` (at most ``sample_limit`` rows, spread
    over strata and time that are chosen by themselves; None for all rows), its ``row_dictionary`` and ``data_scope``,
    ``identifier_counts``, ``identifier_combinations``, ``time_filter`` and ``correlation_cells``.
    """
    spark, tidy = df.sparkSession, clean.tidy(df)
    types = at_hand(typing.override_types(typing.detect_types(tidy), overrides or {}))
    kinds = typing.type_map(types)
    ready, steps = prepare.coerce(tidy, kinds)
    changed = [c for c in tidy.columns if ready.schema[c].dataType != tidy.schema[c].dataType]
    # Parsed text is written once, not parsed again by every pass.
    ready = settled(ready) if changed else ready
    numbers, categories = typing.numeric_columns(kinds), typing.categorical_columns(kinds)
    plain = [c for c, k in kinds.items() if k != "skipped"]
    dates = [*typing.pick(kinds, "datetime"), *([prepare.COMBINED] if prepare.COMBINED in ready.columns else [])]
    facts = _Facts(ready, plain, numbers, dates, kinds)
    counted = at_hand(duplicate_rows(ready, typing.profile_measures(ready)))
    listed = facts.listed
    patterns = settled(missing.pattern_counts(ready, listed))
    dataset = typing.dataset_profile(ready, counted)
    out = {
        "types": types, "type_counts": typing.type_counts(types), "dataset": dataset, "loading": loading(df, dataset),
        "preprocessing": steps, "preprocessing_summary": prepare.summarize(steps),
        "missing_values": quality.missing_values(ready, facts.nulls(ready.columns)), "duplicates": quality.duplicates(ready, counted),
        "constant_columns": quality.constant_columns(ready, facts.constants(plain)),
        "type_issues": quality.type_issues(types), "missing_summary": missing.missing_summary(ready, listed, facts.totals()),
        "missing_by_column": missing.missing_by_column(ready, listed, facts.nulls(listed)),
        "missing_patterns": missing.missing_patterns(ready, listed, counts=patterns),
        "missing_pairs": missing.missing_pairs(ready, listed, counts=patterns),
        "preview": table_preview(tidy, order_by),
    }
    found, measures = {}, None
    if numbers:
        found = numeric_tables(ready, facts, out)
    if categories:
        counts = settled(categorical.all_counts(ready, categories))
        unique = small_table(spark, [(r["column_name"], facts.rows, r["unique"]) for r in types.collect() if r["column_name"] in categories],
            "column_name string, row_count long, unique long")
        out |= {
            "categorical": categorical.categorical_summary(ready, categories, counts),
            "frequencies": categorical.frequency_table(ready, categories, counts),
            "category_bars": charts.category_bars(ready, categories, counts=counts),
            "high_cardinality": quality.high_cardinality(ready, categories, unique),
        }
    if len(numbers) >= 2:
        measures = correlation.pair_table(ready.select(*[clean.finite(F.col(quoted(c))).alias(f"c{i}") for i, c in enumerate(numbers)]), correlation.column_pairs(numbers))
        out["correlation"] = at_hand(correlation.correlation_report(ready, numbers, measures))
        out["important_pairs"] = correlation.important_pairs(out["correlation"])
        out["scatter_fits"] = charts.scatter_fits(ready, numbers, measures=measures)
        varied = [c for c in numbers if c in facts.bounds()]
        matrix = correlation.matrix_of(out["correlation"], {c: (facts._finite("n", c), c in varied) for c in numbers})
        out["correlation_cells"] = correlation.correlation_cells(matrix, numbers)
    else:
        out["correlation"] = correlation.correlation_report(ready, numbers)
    gaps = {}
    for c in dates:
        gaps[c], clock = calendar.gap_table(ready, c), settled(calendar.clock_counts(ready, c))
        out |= {
            f"time_range__{c}": calendar.time_range(ready, c, facts.time_range(c)),
            f"time_intervals__{c}": calendar.time_intervals(ready, c, gaps[c]), f"top_intervals__{c}": calendar.top_intervals(ready, c, gaps=gaps[c]),
            f"hourly__{c}": calendar.hourly_distribution(ready, c, clock), f"daily__{c}": calendar.daily_distribution(ready, c, hours=clock),
            f"weekday__{c}": calendar.weekday_distribution(ready, c, clock),
        }
    status, axis, reason = typing.time_axis({**{c: "datetime" for c in dates}, **kinds}, time_col)
    out |= time_series(ready, (status, axis, reason), numbers, order_by, facts, found, gaps.get(axis))
    return out | dashboard_tables(ready, kinds, order_by, axis if status == "ok" else None, sample_limit, types)


def loading(df: DataFrame, profile: DataFrame) -> DataFrame:
    """One row on the table as it came: rows, columns, missing values, duplicate rows, names and types of the columns."""
    names, kinds = ([F.lit(x) for x in xs] for xs in (df.columns, [f.dataType.simpleString() for f in df.schema.fields]))
    return profile.select("rows", "columns", "missing_values", "duplicate_rows", F.array(*names).alias("column_names"), F.array(*kinds).alias("column_types"))


def numeric_tables(df: DataFrame, facts: _Facts, out: dict[str, DataFrame]) -> Quantiles:
    """Reports on numeric columns into ``out``; returns their quantiles."""
    numbers, names = facts.numbers, list(statistics.QUANTILES)
    found, spread = column_spreads(df, {c: statistics.number(c) for c in numbers}, list(statistics.QUANTILES.values()))
    q25, q50, q75 = (names.index(q) for q in ("q25", "q50", "q75"))
    boxed = {c: tuple(v[q] for q in (q25, q50, q75)) for c, (_, v) in found.items()}
    if endless := facts.endless():
        # Fences and boxes leave infinities out.
        boxed |= {c: tuple(v) for c, (_, v) in column_quantiles(df, {c: charts.fin(c) for c in endless}, [0.25, 0.5, 0.75]).items()}
    bounds = facts.bounds()
    fences = {c: (q1, q3) for c, (q1, _, q3) in boxed.items()}
    ask = OnePass(df)
    for c in fences:
        m = statistics.outlier_measures(c, fences)
        ask.ask({("outside", c): F.count_if(m["outside"])})
        if c in bounds:
            box = charts.box_measures(c, *fences[c])
            ask.ask({("lowest", c): F.min(box["inside_low"]), ("highest", c): F.max(box["inside_high"])})
    seen = ask.answer() if fences else {}
    outside = [(c, i, *[facts._finite(k, c) for k in ("n", "min", "max")], seen.get(("outside", c), 0)) for i, c in enumerate(numbers)]
    fenced = statistics.outlier_table(df, numbers, fences, counted=small_table(df.sparkSession, outside,
        "column_name string, ordinal int, n long, lowest double, highest double, outside long"))
    ends = small_table(df.sparkSession, [(c, bounds[c][2], seen["lowest", c], seen["highest", c], seen["outside", c]) for c in bounds],
        "column_name string, mean double, lowest double, highest double, fliers long")
    finite = facts.finite_moments()
    out |= {
        "numeric": statistics.joined_report(df, numbers, found, spread, statistics.moments(df, numbers, facts.moments()), fenced,
            statistics.normality_table(df, numbers, base=finite)),
        "outliers": quality.outliers(df, numbers, fenced), "skewness": quality.skewness(df, numbers, finite),
        "histogram": charts.histogram(df, numbers, bounds=bounds), "box_plot": charts.box_plot(df, numbers, {c: boxed[c] for c in bounds}, ends),
    }
    return found


def time_series(
    df: DataFrame, chosen: tuple[str, str | None, str], numbers: Sequence[str], tie: Sequence[str], facts: _Facts, found: Quantiles, gaps: DataFrame | None
) -> dict[str, DataFrame]:
    """Frequency, aggregated or raw series, summaries, trends and anomalies on the chosen time axis."""
    status, axis, reason = chosen
    numbers = [c for c in numbers if c != axis]
    if status == "ok" and not numbers:
        status, reason = "skipped", "no_numeric_variables"
    out = {
        "time_axis": small_table(df.sparkSession, [(status, axis, reason)], "status string, time_column string, reason string")
    }
    if status != "ok":
        return out
    if reason == "time_index":
        return out | {"time_index_means": series.time_index_means(df, axis, numbers)}
    frequency = at_hand(series.detect_frequency(df, axis, gaps=gaps))
    detected = frequency.first()["detected"]
    # Where every row has a time, what is known of all rows holds for the series.
    whole = facts.found["missing_count", axis] == 0
    middle = list(statistics.QUANTILES).index("q50")
    known = {"base": facts.moments(), "middles": {c: found[c][1][middle] for c in numbers if c in found}} if whole else {}
    counts = {c: facts.found["n", c] for c in numbers} if whole else None
    blocks = series.timed_blocks(df, axis, numbers, tie)
    out |= {
        "frequency": frequency, "series_summary": series.series_summary(df, axis, numbers, **known),
        "trend": series.linear_trend(df, axis, numbers, tie, blocks=blocks), "anomalies": series.anomalies(df, axis, numbers, tie, counts=counts, blocks=blocks),
    }
    if detected == "irregular":
        out["series"] = series.irregular_series(df, axis, numbers, tie)
    elif detected:
        out["series"] = series.resample(df, axis, numbers, detected)
    return out


def dashboard_tables(
    df: DataFrame, kinds: Mapping[str, str], order_by: Sequence[str], axis: str | None, limit: int | None, types: DataFrame
) -> dict[str, DataFrame]:
    """Rows to explore with their dictionary and scope, identifier lookups, and the ends of the time axis."""
    unique = {r["column_name"]: r["unique"] for r in types.collect()}
    strata = sampling.choose_strata({c: unique[c] for c in typing.categorical_columns(kinds)}, limit) if limit else []
    rows, dictionary, scope = row_payload(df, kinds, order_by, axis, limit, strata)
    out = {"row_payload": rows, "data_scope": scope}
    if dictionary is not None:
        out["row_dictionary"] = dictionary
    if identifiers := typing.pick(kinds, "identifier"):
        out["identifier_counts"] = sampling.identifier_counts(df, identifiers, IDENTIFIER_LIMIT)
        if len(identifiers) > 1:
            out["identifier_combinations"] = sampling.identifier_combinations(df, identifiers, max_values=IDENTIFIER_LIMIT)
    if axis:
        out["time_filter"] = sampling.time_filter(df, axis)
    return out


def metadata(results: Mapping[str, DataFrame], source: str | None = None, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """One row about a bundle: version, where the data came from, the user's type choices, and the names of its tables."""
    spark = next(iter(results.values())).sparkSession
    chosen = [f"{c}={k}" for c, k in (overrides or {}).items()]
    return small_table(spark, [(SCHEMA_VERSION, "completed", source, chosen, list(results))],
        "schema_version string, status string, source string, user_overrides array<string>, tables array<string>")


def write_bundle(
    results: Mapping[str, DataFrame], folder: str, fmt: str = "parquet", source: str | None = None, overrides: Mapping[str, str] | None = None
) -> DataFrame:
    """Write every result table below ``folder``, a metadata row and a manifest that names the tables; returns the manifest."""
    entries = []
    for name, table in results.items():
        target = f"{folder}/{name}"
        shown = json_safe(table) if fmt == "json" else table
        shown.write.mode("overwrite").format(fmt).save(target)
        entries.append((SCHEMA_VERSION, name, target, fmt, ",".join(table.columns)))
    spark = next(iter(results.values())).sparkSession
    metadata(results, source, overrides).coalesce(1).write.mode("overwrite").json(f"{folder}/metadata")
    manifest = small_table(spark, entries, "schema_version string, name string, path string, format string, columns string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return manifest


def bundle_rows(results: Mapping[str, DataFrame]) -> DataFrame:
    """Every result row as JSON, tagged with its table, for readers that take one file."""
    parts = [json_rows(table).select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(name).alias("table"), "json") for name, table in results.items()]
    return reduce(DataFrame.unionByName, parts)
