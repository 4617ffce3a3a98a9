import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.operators import ranks, series as S


def frame(spark, values, key="a"):
    rows = [(key, i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, i int, x double")


def column(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_rolling_and_change_from_zero(spark):
    df = frame(spark, [0.0, 0.0, 1.0, 4.0])
    assert column(df, S.rolling_mean("x", "i", ["k"])) == [None, 0.0, pytest.approx(1 / 3), 1.25]
    rolled = df.withColumn("x", S.rolling_mean("x", "i", ["k"]))
    assert column(rolled.withColumn("c", S.pct_change("x", "i", ["k"])), "c") == [None, None, math.inf, pytest.approx(2.75)]


def test_change_from_zero_to_zero_is_null(spark):
    assert column(frame(spark, [0.0, 0.0]), S.pct_change("x", "i", ["k"])) == [None, None]


def test_zscore_of_a_constant_series_is_null(spark):
    assert column(frame(spark, [5.0, 5.0, 5.0]), S.zscore("x", ["k"])) == [None] * 3


def test_ffill_keeps_leading_nulls(spark):
    assert column(frame(spark, [None, 1.0, None, 2.0]), S.ffill("x", "i", ["k"])) == [None, 1.0, 1.0, 2.0]


@pytest.mark.parametrize("decay", [0.0, 0.4, 0.99])
def test_adstock_follows_the_recursion(spark, decay):
    """A large spend, then a channel that stays dark: nothing is cut off."""
    x = [1e6] + [0.0] * 99 + [float(v) for v in np.random.default_rng(1).uniform(0, 1e6, 200)] + [None]
    expected, carried = [], 0.0
    for v in x:
        carried = (v or 0.0) + decay * carried
        expected.append(carried)
    found = S.with_adstock(frame(spark, x), {"a": "x"}, "i", decay, ["k"])
    assert column(found, F.col("a")) == pytest.approx(expected, rel=1e-12)
    with pytest.raises(ValueError):
        S.with_adstock(found, {"b": "x"}, "i", 1.0)


@pytest.mark.parametrize("decay", [0.4, 0.99, 1e-6])
def test_adstock_across_blocks_of_the_calendar(spark, decay):
    """Series of decades with holes, repeated dates and a null key: the recursion, from blocks in many tasks."""
    rng, rows = np.random.default_rng(2), []
    for key, n, gaps in (("a", 2500, (0, 1, 1, 7, 30)), ("b", 300, (1,)), (None, 200, (1, 400))):
        day = dt.date(1950, 1, 1)
        for i in range(n):
            day += dt.timedelta(int(rng.choice(gaps)))
            rows.append((key, i, day + dt.timedelta(0), None if i % 11 == 0 else float(rng.uniform(-10, 1e6)), dt.datetime.combine(day, dt.time(i % 24, i % 60))))
    df = spark.createDataFrame(rows, "k string, i int, d date, x double, at timestamp")
    carried, want = {}, {}
    for key, i, _, x, _ in rows:
        carried[key] = (x or 0.0) + decay * carried.get(key, 0.0)
        want[key, i] = carried[key]
    found = S.with_adstock(df, {"a.b": "x", "twice": "x"}, "i", decay, ["k"])
    got = {(r["k"], r["i"]): r for r in found.collect()}
    assert got.keys() == want.keys()
    for place, value in want.items():
        assert got[place]["a.b"] == got[place]["twice"] == pytest.approx(value, rel=1e-12, abs=1e-9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_adstock_by_date_without_keys(spark):
    days = [dt.date(2020, 1, 6) + dt.timedelta(7 * i) for i in range(200)]
    df = spark.createDataFrame([(d, 1.0 + i % 5, "kept") for i, d in enumerate(days)], "d date, x double, _all string")
    found = S.with_adstock(df, {"a": "x"}, "d", 0.5).orderBy("d").collect()
    want = 0.0
    for i, r in enumerate(found):
        want = 1.0 + i % 5 + 0.5 * want
        assert r["a"] == pytest.approx(want, rel=1e-12) and r["_all"] == "kept"
    with pytest.raises(ValueError):
        S.with_adstock(df, {"a": "x"}, "_all", 0.5)


def test_shares_sum_to_one_per_period(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("week"), (F.col("id") + 1).cast("double").alias("x"))
    sums = S.share_of_total(df, "x", "week", 12).groupBy("week").agg(F.sum("share").alias("s")).collect()
    assert [r["s"] for r in sums] == pytest.approx([1, 1, 1])


def test_scaling_meets_the_target(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "week string, x double")
    target = spark.createDataFrame([("a", 100.0), ("b", 10.0)], "week string, t double")
    found = {(r["week"], r["x"]) for r in S.scale_to_total(df, "x", "week", target, "t").collect()}
    assert found == {("a", 25.0), ("a", 75.0), ("b", 10.0)}


def test_percentile_of_ties_and_nulls(spark):
    df = frame(spark, [1.0, 2.0, 2.0, None, 3.0])
    assert column(ranks.pct_rank_avg(df, "x", "k"), "pct_rank") == [0.25, 0.625, 0.625, None, 1.0]


def test_range_partitioned_ranks_agree_with_pandas_on_a_hot_group(spark):
    rng = np.random.default_rng(3)
    data = pd.DataFrame({"k": np.where(rng.random(5000) < 0.6, "hot", "cold"), "x": rng.normal(0, 1, 5000).round(2), "i": np.arange(5000)})
    data.loc[::50, "x"] = np.nan
    df = spark.createDataFrame(data).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    expected = data.groupby("k")["x"].rank(pct=True)
    found = ranks.pct_rank_avg(df, "x", "k").toPandas().set_index("i")["pct_rank"].sort_index()
    pd.testing.assert_series_equal(found, expected, check_names=False)


def test_a_hot_group_is_ranked_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = spark.range(20_000).select(F.lit("hot").alias("k"), (F.col("id") * 7 % 20_000).alias("x"))
        cold = spark.range(100).select(F.lit("cold").alias("k"), F.col("id").alias("x"))
        df = hot.unionByName(cold)
        assert df.repartitionByRange("k", "x").select(F.spark_partition_id()).distinct().count() == 8
        counted = ranks.running_counts(df, "x", ["k"])
        size = F.when(F.col("k") == "hot", 20_000).otherwise(100)
        assert counted.count() == 20_100
        assert counted.filter((F.col("below") != F.col("x")) | (F.col("total") != size)).count() == 0
        median = ranks.exact_quantiles(df, "x", (0.5,), ["k"]).collect()
        assert {r["k"]: r["quantile"] for r in median} == {"hot": 9999.5, "cold": 49.5}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=40))
def test_quantiles_equal_numpy(spark, numbers):
    df = spark.createDataFrame([(float(n),) for n in numbers], "x double")
    found = {r["prob"]: r["quantile"] for r in ranks.exact_quantiles(df, "x", (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
    assert found == {p: pytest.approx(np.quantile(numbers, p)) for p in (0.0, 0.25, 0.5, 0.9, 1.0)}


def test_describe_equals_pandas(spark):
    values = pd.Series(np.random.default_rng(5).lognormal(10, 1, 999))
    found = {r["statistic"]: r["value"] for r in ranks.describe(spark.createDataFrame(values.to_frame("x")), "x").collect()}
    assert found == {k: pytest.approx(v) for k, v in values.describe().items()}
