"""Aggregates over many columns at once, and the unpivoted views of a frame.

``per_column`` suits columns of different types: a pass without a grouping key computes a limited
number of aggregates (more would fall out of generated code), and its single row becomes one row per
column. Passes read disjoint columns, so splitting costs no extra input in a columnar format.
``per_value`` suits columns that all become numbers: one pass over the unpivoted cells, grouped by
column, whatever the number of columns; map-side aggregation leaves one row per task and column.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.plans.small import small_table

NESTED = (T.ArrayType, T.MapType, T.StructType)
AGGREGATES_PER_PASS = 30


def per_column(
    df: DataFrame, columns: Sequence[str], build: Callable[[str], Mapping[str, Column]], schema: str,
    at_once: int = AGGREGATES_PER_PASS,
) -> DataFrame:
    """``column_name, ordinal`` plus the aggregates of ``build(name)``, one row per column."""
    spark = df.sparkSession
    if not columns:
        return small_table(spark, [], f"column_name string, ordinal int, {schema}")
    parts = []
    step = max(1, at_once // len(build(columns[0])))
    for start in range(0, len(columns), step):
        batch = columns[start : start + step]
        row = df.agg(
            *[
                F.struct(*[a.alias(k) for k, a in build(c).items()]).alias(f"s{i}")
                for i, c in enumerate(batch)
            ]
        )
        entries = [
            F.struct(
                F.lit(c).alias("column_name"), F.lit(start + i).alias("ordinal"), F.col(f"s{i}").alias("s")
            )
            for i, c in enumerate(batch)
        ]
        parts.append(row.select(F.explode(F.array(*entries)).alias("e")).select("e.column_name", "e.ordinal", "e.s.*"))
    return reduce(DataFrame.unionByName, parts)


def unpivot_fields(df: DataFrame, cells: Mapping[str, Mapping[str, Column]], keep: Sequence[str] = ()) -> DataFrame:
    """Long view: ``keep``, ``column_name`` and several fields per input row and column."""
    # Fields are columns first: generated code then works out once what several of them have in common.
    flat = df.select(
        *[F.col(quoted(k)).alias(f"_k{i}") for i, k in enumerate(keep)],
        *[c.alias(f"_f{i}_{j}") for i, fields in enumerate(cells.values()) for j, c in enumerate(fields.values())],
    )
    entries = F.array(
        *[F.struct(F.lit(n).alias("column_name"), *[F.col(f"_f{i}_{j}").alias(k) for j, k in enumerate(fields)]) for i, (n, fields) in enumerate(cells.items())]
    )
    return flat.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)], F.inline(entries))


def unpivot(df: DataFrame, cells: Mapping[str, Column], keep: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Long view with a single field."""
    return unpivot_fields(df, {n: {value: c} for n, c in cells.items()}, keep)


def per_value(
    df: DataFrame, cells: Mapping[str, Column | Mapping[str, Column]], aggregates: Mapping[str, Column]
) -> DataFrame:
    """``column_name, ordinal`` and ``aggregates`` over the cells of each column (their field is ``value``).

    Columns of a frame without rows are listed too, with null aggregates.
    """
    fields = {n: c if isinstance(c, Mapping) else {"value": c} for n, c in cells.items()}
    names = small_table(df.sparkSession, [(n, i) for i, n in enumerate(fields)], "column_name string, ordinal int")
    if not fields:
        return names
    found = unpivot_fields(df, fields).groupBy("column_name").agg(*[a.alias(k) for k, a in aggregates.items()])
    return names.join(found, "column_name", "left")


def cell_hash(column: Column, dtype: T.DataType) -> list[Column]:
    """What tells the values of a column apart in 16 bytes.

    For values of up to eight bytes one 64-bit hash is a one-to-one map and the second half stays
    zero; longer ones get two independent hashes, equal for different values with odds of about
    2**-128 a pair.
    """
    if isinstance(dtype, (T.StringType, T.BinaryType, T.DecimalType, *NESTED)):
        return [F.xxhash64(column), F.xxhash64(F.lit(0x5DEECE66D), column)]
    return [F.xxhash64(column), F.lit(0).cast("long")]


def row_hash(df: DataFrame) -> list[Column]:
    """128-bit hash of a whole row; the null mask is part of it because xxhash64 skips nulls."""
    columns = [
        F.to_json(F.struct(quoted(f.name))) if isinstance(f.dataType, NESTED) else F.col(quoted(f.name))
        for f in df.schema.fields
    ]
    mask = null_masks(df.columns)
    return [F.xxhash64(*mask, *columns), F.xxhash64(F.lit(0x5DEECE66D), *mask, *columns)]


MASK_BITS = 60


def null_masks(columns: Sequence[str]) -> list[Column]:
    """Which of the columns are null in a row, as the bits of a whole number for every ``MASK_BITS`` of them."""
    masks = []
    for start in range(0, len(columns), MASK_BITS):
        bits = [F.when(F.col(quoted(c)).isNull(), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(columns[start : start + MASK_BITS])]
        masks.append(reduce(Column.bitwiseOR, bits))
    return masks


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def distinct_counts(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``column_name, unique`` without nulls: 16-byte hashes are shuffled, never long values."""
    values = df.select(*[c.alias(f"v{i}") for i, c in enumerate(columns.values())])
    entries = []
    for i, field in enumerate(values.schema.fields):
        h1, h2 = cell_hash(F.col(field.name), field.dataType)
        present = F.col(field.name).isNotNull().alias("present")
        entries.append(F.struct(F.lit(i).alias("c"), present, h1.alias("h1"), h2.alias("h2")))
    cells = values.select(F.inline(F.array(*entries))).filter("present")
    counts = cells.groupBy("c", "h1", "h2").agg(F.lit(1).alias("one")).groupBy("c").agg(F.count("*").alias("unique"))
    names = F.array(*[F.lit(n) for n in columns])
    return counts.select(F.get(names, F.col("c")).alias("column_name"), "unique")


def duplicate_rows(df: DataFrame, measures: Mapping[str, Column] | None = None) -> DataFrame:
    """One row: ``row_count, duplicate_rows`` (later copies of a row, nulls equal) and ``measures``, whole numbers computed from one row, summed over all rows."""
    measures = measures or {}
    h1, h2 = row_hash(df)
    # Hashes alone are shuffled: what rows add up to needs no copies told apart.
    sums = df.agg(F.count(F.lit(1)).alias("row_count"), *[F.coalesce(F.sum(m.cast("long")), F.lit(0)).alias(k) for k, m in measures.items()])
    kinds = df.select(h1.alias("h1"), h2.alias("h2")).groupBy("h1", "h2").agg(F.lit(1).alias("one")).agg(F.count("*").alias("_kinds"))
    return sums.crossJoin(F.broadcast(kinds)).select("row_count", (F.col("row_count") - F.col("_kinds")).alias("duplicate_rows"), *measures)
