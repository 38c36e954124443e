"""The one-call analysis and what its reports share."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.operators import missing, report, statistics
from tablescope.plans import selection
from tablescope.plans.small import OnePass


def jobs(spark):
    return int(str(spark.sparkContext._jsc.sc().dagScheduler().nextJobId()))


def median_distance(values):
    return float(np.median(np.abs(values - np.median(values))))


@pytest.mark.parametrize("shape", ["normal", "tied", "skewed", "two_sided", "infinite"])
def test_median_distances_in_one_search(spark, monkeypatch, shape):
    monkeypatch.setattr(selection, "FEW_DISTINCT", 10)  # values are folded, as in a large column
    rng = np.random.default_rng(2)
    n = 20_001
    values = {
        "normal": rng.normal(size=n), "tied": np.round(rng.normal(size=n), 1), "skewed": rng.lognormal(sigma=3, size=n),
        "two_sided": np.where(rng.random(n) < 0.5, -1000, 1000) + rng.normal(size=n), "infinite": np.where(rng.random(n) < 0.05, np.inf, rng.normal(size=n)),
    }[shape]
    df = spark.createDataFrame([(float(v), float(-3 * v)) for v in values], "x double, y double").repartition(4)
    found, spread = selection.column_spreads(df, {c: F.col(c) for c in ("x", "y")}, [0.25, 0.5, 0.75])
    assert np.allclose(found["x"][1], np.quantile(values, [0.25, 0.5, 0.75]), rtol=1e-14)
    assert spread["x"] == pytest.approx(median_distance(values), rel=1e-14) and spread["y"] == pytest.approx(3 * median_distance(values), rel=1e-14)


def test_one_question_is_asked_once(spark):
    ask = OnePass(spark.range(10))
    ask.ask({"n": F.count("*"), ("max", "id"): F.max("id")})
    ask.ask({"n": F.count("*")})
    assert ask.answer() == {"n": 10, ("max", "id"): 9} and len(ask.asked) == 2


@pytest.fixture(scope="module")
def sales(spark):
    rows = [
        (i, f"c{i % 40}", "north" if i % 3 else "south", float(i % 97) if i % 11 else None, float((i * 37) % 89), f"2024-{1 + i % 12:02d}-{1 + i % 28:02d}", f"2023-01-{1 + i % 28:02d}")
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "order_id long, customer_id string, region string, amount double, score double, sold string, made string")
    return df.withColumn("score", F.when(F.col("order_id") == 5, float("inf")).otherwise(F.col("score")))


def test_analysis_agrees_with_its_reports(spark, sales):
    before = jobs(spark)
    out = report.analyse(sales, ["order_id"], time_col="sold", sample_limit=100)
    assert jobs(spark) - before < 250  # two dates, missing values and infinities; every report on its own took more than twice as many
    ready = sales.select(*[F.col(c) for c in ("amount", "score")])

    def rows(df):
        return {r["column_name"]: r.asDict() for r in df.collect()}

    alone = rows(statistics.numeric_report(ready, ["amount", "score"]).drop("ordinal"))
    for c, r in rows(out["numeric"].drop("ordinal")).items():
        for k, v in r.items():
            assert v == pytest.approx(alone[c][k], rel=1e-12) if isinstance(v, float) else v == alone[c][k], (c, k)
    assert out["time_axis"].first().asDict() == {"status": "ok", "time_column": "sold", "reason": "user_selected"}
    scope = out["data_scope"].first()
    assert (scope.source_row_count, scope.row_count, scope.truncated) == (600, 100, True)
    payload = out["row_payload"].collect()
    assert len(payload) == 100 and {"amount", "score", "region_code", "order_id_code", "customer_id_code", "time_value"} <= set(out["row_payload"].columns)
    assert {r.category for r in out["row_dictionary"].filter("column_name = 'region'").collect()} == {"north", "south"}
    assert {"identifier_counts", "identifier_combinations", "time_filter", "correlation_cells"} <= set(out)
    assert out["loading"].first().column_types == [t for _, t in sales.dtypes]
    invalid = report.analyse(sales, ["order_id"], time_col="region", sample_limit=None)
    assert invalid["time_axis"].first().reason == "invalid_datetime_column" and invalid["row_payload"].count() == 600


def test_bundle(spark, sales, tmp_path):
    out = {"preview": report.table_preview(sales, ["order_id"], 3), "one": spark.range(1)}
    report.write_bundle(out, str(tmp_path / "b"), "json", source="sales.csv", overrides={"amount": "numeric"})
    told = spark.read.json(str(tmp_path / "b" / "metadata")).first()
    assert (told.source, told.user_overrides, told.tables) == ("sales.csv", ["amount=numeric"], ["preview", "one"])
    assert {(r.table, r.schema_version) for r in report.bundle_rows(out).collect()} == {("preview", "1.0"), ("one", "1.0")}
    assert report.bundle_rows(out).count() == 4


def test_missing_pairs_of_many_columns(spark):
    k = 3000
    masks = {i: {0, 7} for i in range(5)} | {i: {7, 2999, 1500} for i in range(5, 8)} | {8: set(range(0, k, 30)), 9: set()}
    columns = [f"c{j}" for j in range(k)]
    df = spark.createDataFrame([(i, sorted(m)) for i, m in masks.items()], "i int, m array<int>")
    counts = df.select(F.col("m").alias("pattern"), F.lit(1).cast("long").alias("count"))
    want = {}
    for m in masks.values():
        for a in m:
            for b in m:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    best = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:30]
    got = [tuple(r) for r in missing.missing_pairs(spark.range(0).select(F.lit(None).alias("c0")), columns, counts=counts).collect()]
    assert [r[:3] for r in got] == [(f"c{a}", f"c{b}", n) for (a, b), n in best]
    assert got[0][3:] == (0.5, k * (k - 1) // 2, True)


def test_pairs_that_are_never_missing_fill_up(spark):
    df = spark.createDataFrame([(None, None, 1, 2), (1, 2, 3, 4)], "a int, b int, c int, d int")
    rows = [tuple(r)[:3] for r in missing.missing_pairs(df, top_n=4).collect()]
    assert rows == [("a", "b", 1), ("a", "c", 0), ("a", "d", 0), ("b", "c", 0)]
