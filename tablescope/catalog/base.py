"""Helpers of the query catalogue: reading tables, showing results and writing matching SQL.

Both sides show numbers alike: doubles to nine significant digits (six decimals below one), whole
numbers as 64-bit, times as text. A nudge far below the last digit keeps exact halves from being
rounded differently by the two engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.clean import tidy
from tablescope.plans.wide import quoted

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tidy(spark.read.parquet(f"{folder}/{name}.parquet"))


def _round(c: str) -> str:
    scale = f"power(CAST(10 AS DOUBLE), floor(log10(abs({c}))))"
    return (
        f"CASE WHEN abs({c}) >= 1 THEN round({c} / {scale} + CAST(1.3E-10 AS DOUBLE), 8) * {scale} "
        f"ELSE round({c} + CAST(1.3E-9 AS DOUBLE), 6) + CAST(0 AS DOUBLE) END"
    )


def shown(df: DataFrame) -> DataFrame:
    out = []
    for field in df.schema.fields:
        c, kind = quoted(field.name), field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            out.append(F.expr(_round(f"CAST({c} AS DOUBLE)")).alias(field.name))
        elif isinstance(kind, T.IntegralType):
            out.append(F.col(c).cast("long").alias(field.name))
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(field.name))
        elif isinstance(kind, T.DateType):
            out.append(F.col(c).cast("string").alias(field.name))
        elif isinstance(kind, T.ArrayType):
            out.append(F.array_join(c, ",").alias(field.name))
        else:
            out.append(F.col(c))
    return df.select(*out)


def same(inner: str, d: str = "", i: str = "", t: str = "") -> str:
    """``inner`` with its double (d), whole-number (i) and time (t) columns shown as ``shown`` shows them."""
    changes = [f"""{_round(f'CAST("{c}" AS DOUBLE)')} AS "{c}\"""" for c in d.split()]
    changes += [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in i.split()]
    changes += [f"""strftime("{c}", '%Y-%m-%d %H:%M:%S.%f') AS "{c}\"""" for c in t.split()]
    star = f"* REPLACE ({', '.join(changes)})" if changes else "*"
    return f"SELECT {star} FROM ({inner}) AS answer"


def long_sql(source: str, columns: list[str], value: str = "CAST({c} AS DOUBLE)", keep: str = "") -> str:
    """Unpivot in plain SQL: one SELECT per column."""
    keep = f", {keep}" if keep else ""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {i} AS ordinal, {value.format(c=c)} AS v{keep} FROM {source}"
        for i, c in enumerate(columns)
    )


class Catalogue:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(run: Query) -> Query:
            def query(spark: SparkSession, folder: str) -> DataFrame:
                return shown(run(spark, folder))

            self.queries[name] = query
            if sql:
                self.sql[name] = sql
            return run

        return register


# Derived inputs, built the same way on both sides.
DOCS_LABELED = "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
HOLES = (
    "(SELECT * REPLACE (CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END AS l_tax, "
    "CASE WHEN l_quantity > 45 THEN NULL ELSE l_discount END AS l_discount) FROM lineitem)"
)


def docs_labeled(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")


def lineitem_holes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").withColumns(
        {
            "l_tax": F.expr("CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END"),
            "l_discount": F.expr("CASE WHEN l_quantity > 45 THEN NULL ELSE l_discount END"),
        }
    )


LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"]
LINEITEM_CATEGORICAL = ["l_linenumber", "l_tax", "l_returnflag", "l_linestatus"]
ORDERS_NUMERIC = ["o_orderkey", "o_custkey", "o_totalprice"]
PART_NUMERIC = ["p_partkey", "p_size", "p_retailprice"]
