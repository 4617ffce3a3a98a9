import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators import buckets, kpis

D = dt.date


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(*columns[:-1]).collect()]


@pytest.fixture
def week_edges(spark):
    rows = [(D(2023, 1, 1), 1.0), (D(2023, 1, 2), 2.0), (D(2023, 1, 3), 3.0), (D(2023, 1, 9), 4.0), (D(2023, 1, 24), 5.0)]
    return spark.createDataFrame(rows, "date date, v double")


def test_weekly_buckets_close_on_monday(week_edges):
    expected = [(D(2023, 1, 2), 3.0), (D(2023, 1, 9), 7.0), (D(2023, 1, 16), 0.0), (D(2023, 1, 23), 0.0), (D(2023, 1, 30), 5.0)]
    assert values(buckets.bucket(week_edges, "date", "weekly", "v"), "period", "v") == expected
    assert values(buckets.bucket(week_edges, "date", "fortnightly", "v"), "period", "v") == expected


def test_daily_and_monthly_gaps_are_zero(spark, week_edges):
    daily = buckets.bucket(week_edges, "date", "daily", "v")
    assert daily.count() == 24 and daily.filter("v = 0").count() == 19
    late = spark.createDataFrame([(D(2023, 4, 30), 2.0)], "date date, v double")
    monthly = values(buckets.bucket(week_edges.unionByName(late), "date", "monthly", "v"), "period", "v")
    assert monthly == [(D(2023, 1, 1), 15.0), (D(2023, 2, 1), 0.0), (D(2023, 3, 1), 0.0), (D(2023, 4, 1), 2.0)]


def test_bucket_of_nothing_is_nothing(week_edges):
    assert buckets.bucket(week_edges.limit(0), "date", "weekly", "v").count() == 0


def test_trend_counts_a_missing_side_as_zero(spark, week_edges):
    online = week_edges.withColumnRenamed("v", "revenue")
    offline = spark.createDataFrame([(D(2023, 2, 7), 10.0)], "week_start date, total_revenue double")
    trend = values(kpis.kpi_trend(online, offline, "monthly"), "period", "online_revenue", "offline_revenue", "total_revenue")
    assert trend == [(D(2023, 1, 1), 15.0, 0.0, 15.0), (D(2023, 2, 1), 0.0, 10.0, 10.0)]


def test_month_spine_starts_after_the_close_and_is_capped(spark):
    deals = spark.createDataFrame([("a", D(2024, 1, 31)), ("b", D(2024, 12, 1)), ("c", D(2020, 5, 1))], "id string, close date")
    spine = buckets.month_spine(deals, "close", D(2024, 12, 31), 24)
    found = {r["id"]: (r["n"], r["lo"], r["hi"]) for r in spine.groupBy("id").agg(F.max("months_since_close").alias("n"), F.min("month").alias("lo"), F.max("month").alias("hi")).collect()}
    assert found == {"a": (11, D(2024, 2, 1), D(2024, 12, 1)), "c": (24, D(2020, 6, 1), D(2022, 5, 1))}
    assert buckets.month_spine(deals, "close", D(2024, 12, 31)).filter("id = 'c'").count() == 55


def test_week_spine_holds_mondays(spark):
    bounds = spark.createDataFrame([("a", D(2023, 1, 1), D(2023, 1, 16)), ("b", D(2023, 1, 3), D(2023, 1, 4))], "k string, lo date, hi date")
    assert values(buckets.week_spine(bounds, "lo", "hi"), "k", "week_start") == [("a", D(2023, 1, 2)), ("a", D(2023, 1, 9)), ("a", D(2023, 1, 16))]


def test_split_is_by_range_and_complete(spark):
    df = spark.range(200).select(F.date_add(F.lit(D(2023, 1, 1)), F.col("id").cast("int")).alias("date"))
    marked = buckets.chrono_split(df, "date")
    assert marked.groupBy("split").count().count() == 3 and marked.count() == 200
    ends = marked.agg(F.max(F.when(F.col("split") == "train", F.col("date"))), F.min(F.when(F.col("split") == "test", F.col("date")))).first()
    assert tuple(ends) == (D(2023, 1, 1) + dt.timedelta(139), D(2023, 1, 1) + dt.timedelta(170))
    with pytest.raises(ValueError):
        buckets.chrono_split(df, "date", 0.8, 0.2)


def test_split_has_no_cross_join_of_rows(spark):
    df = spark.range(10).select(F.date_add(F.lit(D(2023, 1, 1)), F.col("id").cast("int")).alias("date"))
    plan = buckets.chrono_split(df, "date")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_promotion_lifts(spark):
    days = [D(2023, 2, 1), D(2023, 3, 1), D(2023, 12, 5), D(2023, 11, 10), D(2023, 7, 31)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    online = [round(r[0], 4) for r in df.select(dates.window_lift(F.col("d"))).collect()]
    assert online == [1.2, 1.0, round(1.45 * 1.1, 4), 1.55, 1.15]
    assert [r[0] for r in df.select(dates.month_lift(F.col("d"))).collect()] == [1.12, 1.0, 1.35, 1.4, 1.1]


def test_months_between(spark):
    df = spark.createDataFrame([(D(2024, 12, 31), D(2024, 12, 1)), (D(2024, 12, 31), D(2024, 11, 15))], "a date, b date")
    assert [r[0] for r in df.select(dates.months_between_30(F.col("a"), F.col("b"))).collect()] == [1, 2]


def test_mom_change(spark):
    rows = [(D(2023, 1, 5), 100.0), (D(2023, 3, 5), 150.0), (D(2023, 3, 6), 30.0)]
    df = spark.createDataFrame(rows, "date date, revenue double")
    assert kpis.mom_change(df).first()["mom_change_pct"] == 80.0
    assert kpis.mom_change(df.limit(1)).first()["mom_change_pct"] is None
