"""CSV scan: encoding probe, header clean-up, missing tokens and type inference, all on executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.clean import CSV_MISSING_TOKENS, NUMBER, strip
from tablescope.operators.quality import null_counts
from tablescope.operators.typing import dataset_profile
from tablescope.plans.wide import per_value, quoted
from tablescope.sources.records import records

PREVIEW_ROWS = 1000
BOM = "﻿"
ENCODINGS = ("UTF-8", "GB18030", "GBK")
_REPLACEMENT = "�"
_EXTRA = "_beyond_header"
_DIALECT = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
_LEGACY_CHARSETS = "spark.sql.legacy.javaCharsets"

# What counts as a boolean cell.
TRUE_WORDS, FALSE_WORDS = ["True", "TRUE", "true"], ["False", "FALSE", "false"]


def header_names(raw: Sequence[str | None]) -> tuple[list[str], set[int]]:
    """Stripped names before they are made unique, and the positions whose header was blank.

    Exact repeats get ``.1``, ``.2`` as the usual CSV readers do; names equal only after stripping are
    left to ``unique_names``.
    """
    blank = {i for i, h in enumerate(raw) if h is None or not str(h).strip()}
    taken, names = {h for h in raw if h}, []
    seen: dict[str, int] = {}
    for i, h in enumerate(raw):
        name = "Unnamed" if i in blank else str(h)
        if i not in blank:
            count = seen.get(name, 0)
            seen[name] = count + 1
            while count and f"{h}.{count}" in taken:
                count += 1
            name = f"{h}.{count}" if count else name
            taken.add(name)
        names.append(name.strip())
    return names, blank


def unique_names(names: Sequence[str]) -> list[str]:
    """Repeats become ``name__2``, ``name__3`` ..."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}__{seen[name]}")
    return out


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") == 0).alias("head"),
        F.monotonically_increasing_id().alias("place"),
    )


def _probe(spark: SparkSession, path: str) -> tuple[bool, dict[tuple[str, bool], list[str]]]:
    """(all content is UTF-8, {(header line, a quoted field spans lines): files}).

    One scan looks at every line; a second one fetches the first line of each file. The driver sees one row per file.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = _lines(spark, path)
    files = lines.groupBy("file").agg(
        F.count_if(F.length("value") > 0).alias("lines"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.bool_or(quotes % 2 == 1).alias("spans"), F.min(F.when(F.col("head"), F.col("place"))).alias("first"),
    ).collect()
    files = [f for f in files if f["lines"]]
    if not files:
        raise ValueError("The CSV file is empty.")
    first = {f["first"] for f in files}
    heads = {r["file"]: r["value"] for r in lines.filter(F.col("head") & F.col("place").isin(list(first))).collect()} if len(files) > 1 else {}
    groups: dict[tuple[str, bool], list[str]] = {}
    for f in sorted(files, key=lambda f: f["file"]):
        groups.setdefault((heads.get(f["file"], ""), bool(f["spans"])), []).append(f["file"])
    return all(f["utf8"] for f in files), groups


def _scan(spark: SparkSession, files: str | Sequence[str], encoding: str, names: Sequence[str] | None) -> DataFrame:
    """Cells of files without line breaks in quotes, as c0, c1, ... and one more to notice rows that are too long; the first row without ``names``."""
    reader = spark.read.options(**_DIALECT).option("encoding", encoding).option("header", names is not None).option("enforceSchema", True)
    return (reader if names is None else reader.schema(_fields(len(names)))).csv(files)


def _fields(n: int) -> str:
    return ", ".join(f"{f} string" for f in [*(f"c{i}" for i in range(n)), _EXTRA])


def _spanning(spark: SparkSession, files: Sequence[str], encoding: str) -> tuple[list[str | None], DataFrame]:
    """Header and cells of files in which quoted fields hold line breaks; every file is read split by split."""
    rows = records(spark, list(files), encoding)
    head = rows.filter("top").select("record").first()["record"]  # all files here have one header
    # One row, parsed by the same reader; an array of as many fields as the line can have at most.
    line = spark.range(1).select(F.from_csv(F.lit(head), _fields(head.count(",") + 1), {**_DIALECT, "multiLine": "true"}).alias("r")).select("r.*").first()
    raw = list(line)[: -1]
    width = _width(head)
    cells = rows.filter(~F.col("top")).select(F.from_csv("record", _fields(width), {**_DIALECT, "multiLine": "true"}).alias("r")).select("r.*")
    return raw[:width], cells


def _width(line: str) -> int:
    """Number of fields of a record: commas outside quoted fields, and one."""
    n, at, end = 1, 0, len(line)
    while at < end:
        if line[at] == '"':
            at += 1
            while at < end and not (line[at] == '"' and line[at : at + 2] != '""'):
                at += 2 if line[at] == '"' else 1
        comma = line.find(",", at)
        if comma < 0:
            break
        n, at = n + 1, comma + 1
    return n


def _part(spark: SparkSession, files: Sequence[str], encoding: str, spans: bool, strict: bool) -> tuple[DataFrame, list[str], set[int]] | None:
    """Cells, header names and blank positions of files with one header; None if the encoding does not fit."""
    head, cells = _spanning(spark, files, encoding) if spans else (_scan(spark, files[0], encoding, None).first(), None)
    raw = [h.removeprefix(BOM) if i == 0 and h else h for i, h in enumerate(head)]
    names, blank = header_names(raw)
    cells = _scan(spark, files, encoding, names) if cells is None else cells
    broken = [F.bool_or(F.coalesce(F.col(c).contains(_REPLACEMENT), F.lit(False))) for c in cells.columns]
    checks = cells.agg(F.count(_EXTRA).alias("long"), *([] if strict else broken)).first()
    if checks["long"]:
        raise ValueError("Unable to parse CSV file: a row has more fields than the header")
    if not strict and (any(checks[1:]) or any(_REPLACEMENT in n for n in names)):
        return None
    return cells.drop(_EXTRA), names, blank


def _together(parts: Sequence[tuple[DataFrame, list[str], set[int]]]) -> tuple[DataFrame, list[str], set[int]]:
    """Files with different headers, matched by column name in the order of the first."""
    cells, names, blank = parts[0]
    order = unique_names(names)
    for other, other_names, other_blank in parts[1:]:
        place = {n: i for i, n in enumerate(unique_names(other_names))}
        if set(place) != set(order):
            odd = sorted(set(place) ^ set(order))
            raise ValueError(f"The CSV files have different columns: {', '.join(odd)}")
        cells = cells.unionAll(other.select(*[F.col(f"c{place[n]}").alias(f"c{i}") for i, n in enumerate(order)]))
        blank = blank & {i for i, n in enumerate(order) if place[n] in other_blank}
    return cells, names, blank


def _text_frame(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], set[int]]:
    """All cells as text with missing tokens removed, columns named c0, c1, ..., header names, blank positions."""
    utf8, groups = _probe(spark, path)
    if not utf8:
        # Lets Spark read GB18030 and GBK. It is looked at whenever the frame runs, so it stays set.
        spark.conf.set(_LEGACY_CHARSETS, "true")
    for encoding in ENCODINGS[:1] if utf8 else ENCODINGS[1:]:
        parts = [_part(spark, files, encoding, spans, utf8) for (_, spans), files in groups.items()]
        if all(p is not None for p in parts):
            break
    else:
        raise ValueError(f"Unable to decode the CSV file. Tried: {', '.join(ENCODINGS)}")
    cells, names, blank = _together(parts)
    return cells.select(*[known(F.col(c)).alias(c) for c in cells.columns]), names, blank


def known(c: Column) -> Column:
    """A text cell, or null where it holds one of the missing tokens."""
    return F.when(~c.isin(CSV_MISSING_TOKENS), c)


def infer_types(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, ordinal, inferred`` of text columns: bigint, double, boolean or string; one scan."""

    tests = {}
    for name in columns:
        c = F.col(quoted(name))
        text = strip(c)
        tests[name] = {
            "value": c.isNotNull(),
            "whole": text.rlike(r"^[+-]?\d+$") & text.try_cast("bigint").isNotNull(),
            "number": text.rlike(NUMBER) & text.try_cast("double").isNotNull(),
            "truth": c.isin(TRUE_WORDS + FALSE_WORDS),
        }
    # Text is parsed again by every pass, so all columns share one.
    table = per_value(cells, tests, {
        "present": F.count_if(F.col("value")), "whole": F.count_if(F.col("whole")), "number": F.count_if(F.col("number")),
        "truth": F.count_if(F.col("truth")),
    }).fillna(0, ["present"])
    all_of = lambda c: (F.col("present") > 0) & (F.col(c) == F.col("present"))
    inferred = (
        F.when(F.col("present") == 0, "double").when(all_of("whole"), "bigint").when(all_of("number"), "double")
        .when(all_of("truth"), "boolean").otherwise("string")
    )
    return table.select("column_name", "ordinal", "present", inferred.alias("inferred"))


def _typed(c: Column, kind: str) -> Column:
    return c if kind == "string" else strip(c).try_cast(kind)


def _typed_frame(cells: DataFrame, names: Sequence[str], kinds: dict[str, str]) -> DataFrame:
    return cells.select(
        *[_typed(F.col(c), kinds[c]).alias(n) for c, n in zip(cells.columns, unique_names(names), strict=True)]
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file, folder or glob as a typed frame; blank-headed columns without values are dropped."""
    cells, names, blank = _text_frame(spark, path)
    table = {r["column_name"]: r for r in infer_types(cells, cells.columns).collect()}  # one row per column
    kept = [i for i, c in enumerate(cells.columns) if not (i in blank and table[c]["present"] == 0)]
    kinds = {c: r["inferred"] for c, r in table.items()}
    return _typed_frame(cells.select(*[f"c{i}" for i in kept]), [names[i] for i in kept], kinds)


def preview_csv(spark: SparkSession, path: str, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows, with every column kept."""
    cells, names, _ = _text_frame(spark, path)
    head = cells.limit(rows)
    kinds = {r["column_name"]: r["inferred"] for r in infer_types(head, head.columns).collect()}
    return _typed_frame(head, names, kinds)


def loading_info(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing values, duplicate rows."""
    return dataset_profile(df).select("rows", "columns", "missing_values", "duplicate_rows")


def empty_columns(df: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Those candidates in which every value is missing."""
    return null_counts(df, candidates).filter(F.col("missing_count") == F.col("row_count")).select("column_name")


def count_rows(spark: SparkSession, path: str) -> int:
    cells, _, _ = _text_frame(spark, path)
    return cells.count()
