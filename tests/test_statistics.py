import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.functions.clean import tidy
from tablescope.functions.normality import shapiro_wilk
from tablescope.functions.pvalues import correlation_p
from tablescope.operators import correlation, missing, quality, statistics


def column(spark, values, name="x"):
    return tidy(spark.createDataFrame([(v,) for v in values], f"{name} double"))


def test_nan_null_and_infinity(spark):
    df = column(spark, [1.0, 2.0, 3.0, math.nan, math.inf, None])
    m = statistics.moments(df, ["x"]).first()
    assert (m["count"], m["missing"], m["mean"], m["max"], m["min"]) == (4, 2, None, None, 1.0)
    o = statistics.outlier_table(df, ["x"]).first()
    assert (o.q1, o.q3, o.status, o.outlier_count) == (1.5, 2.5, "ok", 0)
    assert quality.skewness(df, ["x"]).first().skewness == 0.0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9])
def test_small_samples_match_pandas(spark, n):
    values = [1.0, 2.0, 4.0, 8.0, 9.0, 9.0, 30.0, 31.0, 5.0][:n]
    rows = statistics.moments(column(spark, values), ["x"]).collect()
    if n == 0:
        assert rows == []
        return
    s = pd.Series(values)
    for name, want in (("std", s.std()), ("variance", s.var()), ("skewness", s.skew()), ("kurtosis", s.kurt())):
        got = rows[0][name]
        assert (got is None and math.isnan(want)) or got == pytest.approx(want)
    skew = quality.skewness(column(spark, values), ["x"]).first()
    assert skew.reason == ("insufficient_samples" if n < 3 else None)


def test_constant_column(spark):
    df = column(spark, [5.0] * 6)
    m = statistics.moments(df, ["x"]).first()
    assert (m.skewness, m.kurtosis, m["range"]) == (0.0, 0.0, 0.0)
    o = statistics.outlier_table(df, ["x"]).first()
    assert (o.lower_bound, o.upper_bound, o.reason) == (5.0, 5.0, "constant_variable")
    assert quality.outliers(df, ["x"]).first().lower_bound is None
    assert quality.skewness(df, ["x"]).first().level == "constant"
    assert statistics.normality_table(df, ["x"]).first().reason == "constant_variable"


def test_shapiro_wilk_published_example():
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    w, p = shapiro_wilk(np.array(weights, dtype=float))
    assert w == pytest.approx(0.7888, abs=1e-4) and p == pytest.approx(0.0067, abs=1e-4)


def test_mad(spark):
    values = [1.0, 2.0, 2.0, 4.0, 40.0]
    got = statistics.mad_table(column(spark, values), ["x"]).first().mad
    assert got == np.median(np.abs(np.array(values) - 2.0))


def brute_tau(x, y):
    c = tx = ty = 0
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            c, tx, ty = c + a * b, tx + abs(a), ty + abs(b)
    return c / math.sqrt(tx) / math.sqrt(ty)


def test_tau_with_ties(spark):
    rng = np.random.default_rng(3)
    for size in (6, 40, 150):
        x, y = rng.integers(0, size // 2, size).astype(float), rng.integers(0, 5, size).astype(float)
        row = correlation.kendall(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), ["x", "y"]).first()
        assert row.correlation == pytest.approx(brute_tau(x, y)) and 0 <= row.p_value <= 1


def test_kendall_of_many_rows(spark):
    """Against the counts of a table of few values, far above what could be compared row by row."""
    frame = spark.range(60_000).select(F.expr("id % 7").alias("x"), F.expr("(id * id) % 11").alias("y"))
    cells = [(r.x, r.y, r["count"]) for r in frame.groupBy("x", "y").count().collect()]
    sign = lambda d: (d > 0) - (d < 0)
    score = sum(a * b * sign(x - u) * sign(y - v) for x, y, a in cells for u, v, b in cells)
    size_x = sum(a * b * abs(sign(x - u)) for x, _, a in cells for u, _, b in cells)
    size_y = sum(a * b * abs(sign(y - v)) for _, y, a in cells for _, v, b in cells)
    row = correlation.kendall(frame, ["x", "y"]).first()
    assert row.sample_size == 60_000 and row.correlation == pytest.approx(score / math.sqrt(size_x) / math.sqrt(size_y))


def test_correlation_p_values():
    assert correlation_p(0.5, 10) == pytest.approx(0.14111, abs=1e-5)  # two-sided t table
    assert correlation_p(0.0, 30) == pytest.approx(1.0)
    assert correlation_p(1.0, 30) == 0.0
    assert correlation_p(0.02, 10_002) == pytest.approx(correlation_p(0.02, 10_003), rel=1e-3)


def test_pairwise_deletion_and_reasons(spark):
    rows = [(1.0, 2.0, 5.0, None), (2.0, 1.0, 5.0, None), (3.0, None, 5.0, 1.0), (4.0, 4.0, 5.0, 2.0), (float("inf"), 9.0, 5.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    pdf = pd.DataFrame(rows, columns=list("abcd")).replace([np.inf], np.nan)
    for run, method in ((correlation.pearson, "pearson"), (correlation.spearman, "spearman"), (correlation.kendall, "kendall")):
        got = {(r.x, r.y): r for r in run(df, list("abcd")).collect()}
        pair = pdf[["a", "b"]].dropna()
        want = brute_tau(pair.a.values, pair.b.values) if method == "kendall" else pair.rank().corr().iloc[0, 1] if method == "spearman" else pair.corr().iloc[0, 1]
        assert got["a", "b"].correlation == pytest.approx(want) and got["a", "b"].sample_size == 3
        assert got["a", "c"].reason == "constant_variable_y" and got["c", "d"].reason == "constant_variable_x"
        assert got["a", "d"].reason == "insufficient_samples"
        assert len(got) == 6


def test_spearman_p_uses_ranks(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") * F.col("id")).cast("double").alias("b"))
    row = correlation.spearman(df, ["a", "b"]).first()
    assert row.correlation == pytest.approx(1.0) and row.p_value == 0.0


def test_too_few_columns(spark):
    out = correlation.correlation_report(spark.range(3).select(F.col("id").alias("a")), ["a"])
    assert {r.reason for r in out.collect()} == {"insufficient_numeric_variables"}


def test_missing_with_zero_rows_and_zero_columns(spark):
    df = spark.createDataFrame([], "a int, b int")
    s = missing.missing_summary(df).first()
    assert (s.total_cells, s.overall_missing_ratio, s.complete_rows, s.columns_without_missing) == (0, 0.0, 0, 2)
    s = missing.missing_summary(spark.range(3).toDF("a"), []).first()
    assert (s.total_cells, s.complete_rows, s.complete_row_ratio, s.rows_with_missing) == (0, 3, 1.0, 0)
    assert missing.missing_patterns(df).count() == 0
    pairs = missing.missing_pairs(df).first()
    assert (pairs.both_missing_count, pairs.both_missing_ratio) == (0, 0.0)
