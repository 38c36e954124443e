import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.operators import calendar, series

D = dt.datetime


def frame(spark, times, values):
    rows = [(t, i, None if v is None else float(v)) for i, (t, v) in enumerate(zip(times, values, strict=True))]
    return spark.createDataFrame(rows, "ts timestamp_ntz, i int, v double")


def test_labels_match_pandas(spark):
    times = [D(2024, 1, 7, 10), D(2024, 1, 8), D(2024, 2, 1)]
    df = frame(spark, times, [1, 2, 3])
    s = pd.Series([1.0, 2, 3], index=pd.DatetimeIndex(times))
    for name, rule in (("weekly", "W"), ("monthly", "ME"), ("yearly", "YE"), ("daily", "D"), ("hourly", "h")):
        got = [(r.bucket, r["count"], r["mean"]) for r in series.resample(df, "ts", ["v"], name).orderBy("bucket").collect()]
        want = s.resample(rule)
        assert [g[0] for g in got] == list(want.count().index.to_pydatetime())
        assert [g[1] for g in got] == list(want.count())
        assert [g[2] for g in got] == [None if np.isnan(m) else m for m in want.mean()]


def test_resampling_a_crowded_bucket(spark):
    df = spark.range(9001).select(
        F.expr("CASE WHEN id % 3 < 2 THEN TIMESTAMP_NTZ'2024-01-01 00:00:00' ELSE TIMESTAMP_NTZ'2024-01-03 00:00:00' END").alias("ts"),
        F.col("id").cast("double").alias("v"))
    got = {r.bucket.day: (r["count"], r["median"]) for r in series.resample(df, "ts", ["v"], "daily").collect()}
    low = [i for i in range(9001) if i % 3 < 2]
    assert got[1] == (len(low), float(np.median(low))) and got[2] == (0, None)


def reference_scores(values, window):
    s = pd.Series(values, dtype="float64")
    least = max(3, window // 2)
    m = s.rolling(window, center=True, min_periods=least).median()
    mad = (s - m).abs().rolling(window, center=True, min_periods=least).median()
    return 0.6745 * (s - m) / mad.replace(0, np.nan)


@pytest.mark.parametrize(("window", "broadcast", "batch"), [(7, True, 10_000), (7, False, 3), (6, True, 2), (3, True, 4), (25, True, 10_000), (25, False, 5)])
def test_rolling_scores_match_pandas(spark, monkeypatch, window, broadcast, batch):
    """Blocks of about eight rows, shorter than the widest window, and batches shorter than a block."""
    if not broadcast:
        monkeypatch.setattr(series, "BORDER_BYTES", 0)
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        _rolling_scores_match_pandas(spark, window)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _rolling_scores_match_pandas(spark, window):
    rng = np.random.default_rng(5)
    values = [float(v) for v in 0.3 * np.arange(64) + rng.normal(size=64)]
    values[20] += 40.0
    values[8] = values[33] = None
    values[40:52] = [1.0] * 12  # no spread, no score
    times = [D(2024, 1, 1) + dt.timedelta(hours=i) for i in range(64)]
    got = [r.robust_z_score for r in series.rolling_scores(frame(spark, times, values), "ts", ["v"], ["i"], window).orderBy("position").collect()]
    want = reference_scores(values, window)
    assert len(got) == 64
    for g, w in zip(got, want, strict=True):
        assert (g is None and np.isnan(w)) or g == pytest.approx(w)
    spikes = series.anomalies(frame(spark, times, values), "ts", ["v"], ["i"], window, 3.5).collect()
    if window == 7:
        assert 20 in {r.position for r in spikes}
    assert len(spikes) == int((want.abs() > 3.5).sum())


def test_anomalies_need_a_full_window(spark):
    times = [D(2024, 1, 1 + i) for i in range(5)]
    assert series.anomalies(frame(spark, times, [1, 2, 99, 3, 4]), "ts", ["v"], ["i"]).count() == 0


@pytest.mark.parametrize(("values", "direction", "percent"), [
    ([5, 5, 5, 5], "stable", 0.0), ([1, 2, 3, 5], "increasing", 400.0), ([4, 3, 2], "decreasing", -50.0), ([0, 1, 2], "increasing", None),
])
def test_trend_directions(spark, values, direction, percent):
    times = [D(2024, 1, 1 + i) for i in range(len(values))]
    row = series.linear_trend(frame(spark, times, values), "ts", ["v"], ["i"]).first()
    assert row.direction == direction and row["count"] == len(values)
    assert row.change_percent == (None if percent is None else pytest.approx(percent))
    slope, intercept = np.polyfit(range(len(values)), values, 1)
    assert row.slope == pytest.approx(slope, abs=1e-9) and row.intercept == pytest.approx(intercept, abs=1e-9)


def test_trend_skips_and_orders_by_time(spark):
    times = [D(2024, 1, 3), D(2024, 1, 1), D(2024, 1, 2), None]
    row = series.linear_trend(frame(spark, times, [30, 10, 20, 99]), "ts", ["v"], ["i"]).first()
    assert (row.first_value, row.last_value, row.slope) == (10.0, 30.0, 10.0)
    few = series.linear_trend(frame(spark, times, [None, 10, None, 1]), "ts", ["v"], ["i"]).first()
    assert (few.status, few.reason, few["count"]) == ("skipped", "insufficient_observations", 1)


def test_gaps_count_repeats(spark):
    times = [D(2024, 1, 1), D(2024, 1, 1), D(2024, 1, 1), D(2024, 1, 2), D(2024, 1, 4), None]
    df = frame(spark, times, range(6))
    gaps = {r.gap // 1_000_000: r.weight for r in calendar.gap_counts(df, "ts").collect()}
    assert gaps == {0: 2, 86400: 1, 172800: 1}
    row = calendar.time_intervals(df, "ts").first()
    s = pd.Series(pd.to_datetime([t for t in times if t])).sort_values().diff().dropna().dt.total_seconds()
    assert (row.total_intervals, row.median_interval_seconds, row.mean_interval_seconds) == (4, s.median(), s.mean())
    assert series.detect_frequency(df, "ts").first().median_interval_seconds == 129600.0


def test_no_times(spark):
    df = frame(spark, [None, None], [1, 2])
    assert calendar.time_range(df, "ts").first().reason == "no_valid_datetime_values"
    assert calendar.time_intervals(df, "ts").first().reason == "insufficient_datetime_values"
    assert series.detect_frequency(df, "ts").first().reason == "no_positive_time_intervals"
    assert calendar.hourly_distribution(df, "ts").count() == 0
    assert series.resample(df, "ts", ["v"], "daily").count() == 0


@pytest.mark.parametrize("batch", [3, 10_000])
@pytest.mark.parametrize("ties", [0, 1])
def test_trend_where_times_repeat_across_blocks(spark, ties, batch):
    """Rows of one time take their places by value, column by column, wherever blocks end."""
    rng = np.random.default_rng(ties)
    n = 900
    day = np.where(rng.random(n) < 0.4, 5, rng.integers(0, 12, n))  # one day has a third of all rows
    tie = np.where(rng.random(n) < 0.1, -1, rng.integers(0, 4, n))
    data = {"a": rng.normal(size=n) + 1e6 * day, "b": rng.integers(0, 5, n).astype(float), "c": np.where(rng.random(n) < 0.3, np.nan, rng.random(n)), "d": np.full(n, np.nan)}
    data["b"][rng.random(n) < 0.1] = np.inf
    rows = [(int(d), None if t < 0 else int(t), *[None if np.isnan(v[i]) else float(v[i]) for v in data.values()]) for i, (d, t) in enumerate(zip(day, tie))]
    df = spark.createDataFrame(rows, "day int, tie int, a double, b double, c double, d double").withColumn(
        "ts", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(day)")).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {r.column_name: r for r in series.linear_trend(df, "ts", list(data), ["tie"] * ties).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (got["d"]["count"], got["d"].status) == (0, "skipped")
    for c in "abc":
        ok = np.isfinite(data[c])
        y = data[c][ok][np.lexsort((data[c][ok], tie[ok] if ties else np.zeros(ok.sum()), day[ok]))]
        slope, intercept = np.polyfit(np.arange(len(y)), y, 1)
        r = got[c]
        assert (r["count"], r.first_value, r.last_value) == (len(y), y[0], y[-1])
        assert r.slope == pytest.approx(slope, rel=1e-9) and r.intercept == pytest.approx(intercept, rel=1e-9)
        assert r.r_squared == pytest.approx(np.corrcoef(np.arange(len(y)), y)[0, 1] ** 2, rel=1e-9)
