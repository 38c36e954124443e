"""Small driver-side tables, such as one row per column, handed to Catalyst as local relations.

Their size is known to the planner, so joins with them are broadcast without a job of their own.
"""

from __future__ import annotations

from collections.abc import Hashable, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

_ARROW = {
    "string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(),
    "array<string>": pa.list_(pa.string()),
}


def small_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """``rows`` as a DataFrame; ``schema`` lists ``name type`` pairs as in DDL."""
    fields = [part.split() for part in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    arrays = [pa.array(list(values), _ARROW[kind]) for values, (_, kind) in zip(columns, fields, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, [name for name, _ in fields]))


def at_hand(df: DataFrame) -> DataFrame:
    """A table of one row per column or pair of columns, worked out once and kept as a local relation."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


AGGREGATES_AT_ONCE = 20  # more of them, moments above all, outgrow what the JVM compiles and run several times slower


class OnePass:
    """What several reports want to know of one frame, found together.

    Reports hand in aggregates by name; ``answer`` reads the frame once for every ``AGGREGATES_AT_ONCE`` of them and gives
    their values. Equal names are one question. The answers follow the schema in size, not the data.
    """

    def __init__(self, df: DataFrame):
        self.df, self.asked = df, {}

    def ask(self, aggregates: Mapping[Hashable, Column]) -> None:
        self.asked |= aggregates

    def answer(self) -> dict[Hashable, Any]:
        out, names = {}, list(self.asked)
        for start in range(0, len(names), AGGREGATES_AT_ONCE):
            batch = names[start : start + AGGREGATES_AT_ONCE]
            row = self.df.agg(*[self.asked[n].alias(f"a{i}") for i, n in enumerate(batch)]).first()
            out |= dict(zip(batch, row, strict=True))
        return out
