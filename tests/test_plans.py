"""The ordering and selection building blocks against brute force, with hot keys and hot values."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablescope.plans import selection
from tablescope.plans.ordered import first_n, with_position, with_previous, with_weight_below
from tablescope.plans.materialize import settled
from tablescope.plans.selection import column_quantiles, weighted_quantiles
from tablescope.plans.wide import distinct_counts, duplicate_rows


@pytest.fixture(scope="module")
def rows(spark):
    # One key holds well over a third of the rows.
    return spark.range(5000).select(
        F.col("id"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 7).alias("k"),
        (F.xxhash64("id") % 1000).alias("v"), F.lit(2).cast("long").alias("w"),
    )


def test_position_and_total(rows):
    w = Window.partitionBy("k").orderBy("v", "id")
    out = with_position(rows, ["v", "id"], ["k"], total="n")
    bad = out.withColumn("want", F.row_number().over(w) - 1).withColumn("size", F.count("*").over(Window.partitionBy("k")))
    assert bad.filter("want <> position OR size <> n").count() == 0
    assert out.count() == 5000


def test_weight_below_and_previous(rows):
    w = Window.partitionBy("k").orderBy("v", "id")
    below = with_weight_below(rows, ["v", "id"], "w", ["k"]).withColumn("want", F.sum("w").over(w) - F.col("w"))
    assert below.filter("want <> weight_below").count() == 0
    previous = with_previous(rows, ["v", "id"], "id", ["k"]).withColumn("want", F.lag("id").over(w))
    assert previous.filter("NOT (want <=> previous)").count() == 0


def test_null_keys_are_a_key(spark):
    frame = spark.createDataFrame([(None, 1), (None, 2), ("a", 5)], "k string, v int")
    got = {(r.k, r.v): r.position for r in with_position(frame, ["v"], ["k"]).collect()}
    assert got == {(None, 1): 0, (None, 2): 1, ("a", 5): 0}


def test_first_n(rows):
    assert [r.id for r in first_n(rows, [F.desc("id")], 3).orderBy("id").collect()] == [4997, 4998, 4999]


def test_position_does_not_depend_on_partitions(rows):
    a = with_position(rows.repartition(3), ["v", "id"]).orderBy("id").collect()
    b = with_position(rows.repartition(11), ["v", "id"]).orderBy("id").collect()
    assert a == b


PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def test_quantiles_with_brackets_are_exact(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW_DISTINCT", 100)
    rng = np.random.default_rng(1)
    values = np.r_[rng.normal(size=20000), np.zeros(10000)]  # a third of the rows share one value
    frame = spark.createDataFrame([(float(v),) for v in values], "x double")
    n, got = column_quantiles(frame, {"x": F.col("x")}, PROBS)["x"]
    assert n == 30000
    assert np.allclose(got, np.quantile(values, PROBS), atol=1e-12)


def test_a_sketch_out_of_bounds_is_noticed(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW_DISTINCT", 10)
    monkeypatch.setattr(selection, "_brackets", lambda points: [(-5.0, -4.0), (1e6, 2e6)])
    frame = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    assert column_quantiles(frame, {"x": F.col("x")}, [0.5])["x"] == (1000, [499.5])


def test_quantiles_of_nulls_and_infinities(spark):
    frame = spark.createDataFrame([(None, 1.0), (None, math.inf), (None, 3.0)], "a double, b double")
    got = column_quantiles(frame, {"a": F.col("a"), "b": F.col("b")}, [0.5])
    assert got == {"b": (3, [3.0])}


def test_generated_code_for_brackets_is_small_enough_to_be_compiled(spark, capsys):
    names = [f"v{i}" for i in range(12)]
    frame = spark.range(10).select(*[F.col("id").cast("double").alias(n) for n in names])
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        selection._counted(frame, names, {n: [(10.0 * i, 10.0 * i + 1) for i in range(9)] for n in names}).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000  # the JVM interprets larger methods


def test_values_between_brackets_are_folded_at_the_end_below(spark):
    nan, inf = math.nan, math.inf
    values = [None, -inf, -1.0, 0.0, 1.0, 1.5, 2.0, 3.0, 9.0, 9.5, inf, nan]
    frame = spark.createDataFrame([(v, v, v) for v in values], "x double, y double, z double")
    brackets = {"x": [(0.0, 1.0), (2.0, 2.0), (3.0, 9.0)], "y": [(-inf, -1.0), (9.5, nan)]}
    got = {(r.c, str(r.value), r.folded): r.weight for r in selection._counted(frame, ["x", "y", "z"], brackets).collect()}
    x = {("-inf", 1): 2, ("0.0", 0): 1, ("1.0", 0): 1, ("1.0", 1): 1, ("2.0", 0): 1, ("3.0", 0): 1, ("9.0", 0): 1, ("9.0", 1): 3}
    y = {("-inf", 0): 1, ("-1.0", 0): 1, ("-1.0", 1): 6, ("9.5", 0): 1, ("inf", 0): 1, ("nan", 0): 1}
    z = {(str(v), 0): 1 for v in values[1:]}
    assert got == {(c, *k): n for c, part in enumerate((x, y, z)) for k, n in part.items()}


def test_weighted_quantiles_per_key(spark):
    freq = spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 1), ("b", 2.0, 1), ("b", 4.0, 1)], "k string, value double, weight long")
    got = {r.k: (r.n, r.quantiles) for r in weighted_quantiles(freq, [0.5, 0.9], ["k"]).collect()}
    assert got["a"][0] == 4 and np.allclose(got["a"][1], np.quantile([1, 1, 1, 5], [0.5, 0.9]))
    assert np.allclose(got["b"][1], [3.0, 3.8])


def test_duplicates_tell_nulls_apart(spark):
    frame = spark.createDataFrame([("x", None), (None, "x"), ("x", None), (None, None)], "a string, b string")
    assert duplicate_rows(frame).first().asDict() == {"row_count": 4, "duplicate_rows": 1}
    assert duplicate_rows(frame.limit(0)).first().asDict() == {"row_count": 0, "duplicate_rows": 0}


def test_distinct_counts_skip_nulls(spark):
    frame = spark.createDataFrame([("x", 1), (None, 1), ("y", 1)], "a string, b int")
    got = {r.column_name: r.unique for r in distinct_counts(frame, {"a": F.col("a"), "b": F.col("b")}).collect()}
    assert got == {"a": 2, "b": 1}


def test_summaries_are_written_where_executors_see_them(spark):
    frame = spark.range(50).select("id", F.col("id").cast("string").alias("s"))
    written = settled(frame)
    assert sorted(written.collect()) == sorted(frame.collect()) and written.dtypes == frame.dtypes
    assert spark.conf.get("spark.checkpoint.dir") in written.inputFiles()[0]
