import math

import pytest
from pyspark.sql import functions as F

from tablescope.operators import charts, explore, sampling


@pytest.fixture(scope="module")
def events(spark):
    # Two thirds of the rows fall into one group.
    return spark.range(6000).select(
        F.col("id"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id div 2 AS INT), 0)").alias("ts"),
        F.when(F.col("id") % 3 < 2, "big").when(F.col("id") % 300 == 2, "rare").otherwise("mid").alias("g"),
        ((F.col("id") * 37) % 1009).cast("double").alias("v"),
    )


def test_allocation(spark):
    sizes = spark.createDataFrame([("a", 7), ("b", 2), ("c", 1)], "stratum string, size long")
    assert {r.stratum: r.share for r in sampling.allocate_shares(sizes, 5).collect()} == {"a": 4, "b": 1, "c": 0}
    sizes = spark.createDataFrame([("a", 10**12), ("b", 10**12 - 1)], "stratum string, size long")
    assert sum(r.share for r in sampling.allocate_shares(sizes, 500_001).collect()) == 500_001


def test_representative_sample(events):
    out = sampling.representative_sample(events, 601, ["id"], "ts", ["g"])
    counts = {r.g: r["count"] for r in out.groupBy("g").count().collect()}
    sizes = {r.g: r["count"] for r in events.groupBy("g").count().collect()}
    assert sum(counts.values()) == 601
    for g, n in sizes.items():
        assert math.floor(601 * n / 6000) <= counts[g] <= math.ceil(601 * n / 6000)
    # One row from every equal stretch of the group's own time order.
    ids = [r.id for r in events.filter("g = 'big'").orderBy("ts", "id").select("id").collect()]
    place = {i: k for k, i in enumerate(ids)}
    taken = sorted(place[r.id] * counts["big"] // len(ids) for r in out.filter("g = 'big'").collect())
    assert taken == list(range(counts["big"]))


def test_samples_do_not_depend_on_partitions(events):
    a = sampling.representative_sample(events.repartition(3), 300, ["id"], "ts", ["g"]).orderBy("id").collect()
    b = sampling.representative_sample(events.repartition(7), 300, ["id"], "ts", ["g"]).orderBy("id").collect()
    assert a == b and len(a) == 300
    a = sampling.uniform_sample(events.repartition(3), 200, ["id"]).orderBy("id").collect()
    b = sampling.uniform_sample(events.repartition(7), 200, ["id"]).orderBy("id").collect()
    assert a == b and len(a) == 200
    assert a != sampling.uniform_sample(events, 200, ["id"], seed=7).orderBy("id").collect()
    assert sampling.representative_sample(events, 10_000, ["id"], "ts", ["g"]).count() == 6000


def test_strata_choice():
    assert sampling.choose_strata({"city": 30, "channel": 4, "one": 1}, 1000) == ["city", "channel"]
    assert sampling.choose_strata({"city": 300, "channel": 4}, 1000) == ["channel"]


def test_identifier_cut_keeps_the_total(events):
    out = sampling.identifier_counts(events.withColumn("v", F.col("v").cast("int")), ["v", "g"], 5).collect()
    assert {r.column_name: r.total_unique for r in out} == {"v": 1009, "g": 3}
    assert len(out) == 8


def test_thirty_groups_are_conserved(spark):
    df = spark.range(900).select((F.col("id") % 30).alias("c"), F.col("id").cast("double").alias("v"))
    assert explore.grouped_histogram(df, "v", "c").agg(F.sum("count")).first()[0] == 900
    pie = explore.merged_groups(df, "c", 15).collect()
    assert len(pie) == 16 and sum(r["count"] for r in pie) == 900
    pages = explore.numeric_by_category(df, "c", ["v"])
    assert {r.page: r["count"] for r in pages.groupBy("page").count().collect()} == {0: 15, 1: 15}
    assert explore.strip(df, "v", "c", ["v"]).count() == 900


def test_far_outliers(spark):
    def kept(far):
        rows = [(float(i), 1000.0 * (1 if k % 2 else -1) if k < far else float(i % 10)) for k, i in enumerate(range(100))]
        return explore.drop_far_outliers(spark.createDataFrame(rows, "x double, y double"), "x", "y").count()

    assert kept(5) == 95
    assert kept(22) == 100


def test_thinning_keeps_the_outline_and_lonely_points(spark):
    cloud = spark.range(30_000).select(
        F.col("id"), (F.rand(1) + F.rand(2)).alias("x"), (F.rand(3) + F.rand(4)).alias("y"))
    far = spark.range(80).select(
        (F.col("id") + 1_000_000).alias("id"), (F.lit(50.0) + F.col("id") % 9 * 4).alias("x"), (F.lit(50.0) + F.col("id") % 11 * 3).alias("y"))
    df = cloud.union(far).cache()
    out = explore.thin_scatter(df, "x", "y", ["id"], 20_000).cache()
    assert out.count() == 20_000 and out.select("id").distinct().count() == 20_000
    assert out.filter("id >= 1000000").count() == 80
    for c in ("x", "y"):
        assert out.agg(F.min(c), F.max(c)).first() == df.agg(F.min(c), F.max(c)).first()
    assert out.filter("role = 'isolated'").count() <= 200
    assert explore.thin_scatter(df.limit(50), "x", "y", ["id"]).count() == 50


def test_thin_lines_keep_spikes(spark):
    df = spark.range(5000).select(
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id AS INT), 0)").alias("t"), F.lit("s").alias("s"),
        F.when(F.col("id") == 1234, 999.0).otherwise(F.col("id") % 10).cast("double").alias("v"))
    thin = explore.thin_lines(df, "t", "s", "v", 100)
    assert thin.count() <= 200 and thin.filter("v = 999").count() == 1


def test_shared_times_and_granularity(events, spark):
    row = explore.shared_times(events, "ts").first()
    assert (row["rows"], row.times, row.shared) == (6000, 3000, True)
    assert explore.default_granularity(events, "ts").first().granularity == "all"
    assert explore.default_granularity(events, "ts", many=100).first().granularity == "hour"
    days = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts")
    assert explore.default_granularity(days, "ts", many=0).first().granularity == "all"


def test_filters_reach_the_scan(spark, folder):
    df = explore.keep_range(spark.read.parquet(f"{folder}/lineitem.parquet"), "l_quantity", 10, 12).select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,10.0), LessThanOrEqual(l_quantity,12.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_histogram_of_flat_columns(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (1.0, None, 5.0)], "a double, b double, c double")
    out = charts.histogram(df, ["a", "b", "c"]).collect()
    assert {r.column_name for r in out} == {"c"} and len(out) == 30
    assert {r.bin: r["count"] for r in out if r["count"]} == {0: 1, 29: 1}


def test_columns_called_like_keys(spark):
    from tablescope.operators import series

    rows = [(100.0, 5, "2024-01-01", 1.0), (300.0, 5, "2024-01-01", 2.0)]
    df = spark.createDataFrame(rows, "`group` double, g int, d string, bucket double").withColumn("d", F.to_date("d").cast("timestamp_ntz"))
    got = {r.column_name: r.value for r in explore.bucketed_series(df, "d", ["group", "bucket"], "day", group="g").collect()}
    assert got == {"group": 200.0, "bucket": 1.5}
    daily = {r.column_name: r["mean"] for r in series.resample(df, "d", ["bucket", "group"], "daily").collect()}
    assert daily == {"group": 200.0, "bucket": 1.5}
    named = df.withColumnRenamed("bucket", "time_index").withColumnRenamed("group", "datetime")
    assert series.irregular_series(named, "d", ["datetime", "time_index"]).count() == 4
    assert {r.column_name for r in series.time_index_means(named, "g", ["datetime", "time_index"]).collect()} == {"datetime", "time_index"}


def test_combinations_match_by_value(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, s string")
    wanted = spark.createDataFrame([(1.0, "a"), (2.0, None), (9.0, "x")], "k double, s string")
    assert explore.find_combination(df, wanted).count() == 2


def test_nothing_is_cut_unless_asked_for(spark):
    wide = spark.range(5).select("id", *[F.lit(i).alias(f"c{i}") for i in range(6)])
    combos = sampling.identifier_combinations(wide, [f"c{i}" for i in range(6)])
    assert combos.select("combination").distinct().count() == 50
    assert sampling.identifier_counts(wide, ["id"], max_values=2).count() == 2
    many = spark.range(8).select(*[(F.col("id") * (i + 1) % 7).alias(f"x{i}") for i in range(31)])
    varying = [c for c in many.columns if c not in ("x6", "x13", "x20", "x27")]  # multiples of seven are constant
    assert charts.scatter_fits(many, many.columns).count() == len(varying) * (len(varying) - 1) // 2


def test_axis_without_its_tail(spark):
    df = spark.range(1001).select(F.when(F.col("id") == 1000, 1e6).otherwise(F.col("id").cast("double")).alias("x"), F.col("id").cast("double").alias("y"))
    got = {r.column_name: r for r in explore.axis_range(df, ["x", "y"]).collect()}
    assert got["x"].clipped and got["x"].low == pytest.approx(5 - 0.06 * 990) and got["x"].high == pytest.approx(995 + 0.06 * 990)
    assert not got["y"].clipped and (got["y"].low, got["y"].high) == (0.0, 1000.0)
    assert explore.axis_range(df.filter("x IS NULL"), ["x"]).count() == 0


def test_sample_has_its_size_where_keys_repeat(spark):
    """Rows that share time, stratum and key are taken as often as they are chosen, not all at once."""
    rows = [(i % 7, "x" if i % 3 else "y", None if i % 5 == 0 else i // 40, i % 4) for i in range(6000)]
    df = spark.createDataFrame(rows, "day int, g string, k int, v int").withColumn("ts", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(day)"))
    a = sampling.representative_sample(df.repartition(3), 500, ["k"], "ts", ["g"], repeats=True).collect()
    b = sampling.representative_sample(df.repartition(7), 500, ["k"], "ts", ["g"], repeats=True).collect()
    assert len(a) == 500 and sorted(map(str, a)) == sorted(map(str, b))
    assert sum(r.g == "y" for r in a) in (166, 167)
    whole = {}
    for r in df.collect():
        whole[str(r)] = whole.get(str(r), 0) + 1
    assert all(sum(str(x) == str(r) for x in a) <= whole[str(r)] for r in a)
