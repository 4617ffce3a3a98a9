import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecast, metrics, mix

D = dt.date


@pytest.fixture(scope="module")
def kkt():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 6)) * [1, 10, 100, 1, 5, 2] + [0, 5, -50, 1, 0, 3]
    y = x @ np.array([3.0, -2.0, 0.5, -4.0, 1.0, 0.2]) + 20 + rng.normal(size=300)
    return x, y


def test_nonneg_ridge_meets_the_optimality_conditions(spark, kkt):
    x, y = kkt
    names = [f"f{i}" for i in range(6)]
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=[*names, "y"]))
    fit = mix.nonneg_ridge(df, names, "y", alpha=1.0)
    w = np.array([fit.weights[n] for n in names])
    scaled, centred = (x - x.mean(0)) / x.std(0), y - y.mean()
    slope = scaled.T @ (scaled @ w - centred) + w
    assert (w >= 0).all() and (w[[1, 3]] == 0).all()
    assert np.allclose(slope[w > 0], 0, atol=1e-6) and (slope[w == 0] >= -1e-6).all()
    assert fit.raw_intercept == pytest.approx(y.mean() - (w / x.std(0)) @ x.mean(0))


def media_and_sales(spark, weeks=60):
    rows = [(D(2023, 1, 2) + dt.timedelta(7 * i), c, 1000.0 + 400 * math.sin(i * s) ** 2) for i in range(weeks) for c, s in (("Email", 0.7), ("Display", 1.3))
            if not (c == "Display" and i % 10 == 3)]
    media = spark.createDataFrame(rows, "week_start date, channel string, spend double")
    sales = media.groupBy("week_start").agg((F.sum("spend") * 3 + 500).alias("total_revenue"))
    return media, sales


def test_missing_channels_and_cells_are_zero(spark):
    media, sales = media_and_sales(spark)
    found = mix.mix_features(media, sales).toPandas()
    assert len(found) == 60 and not found.isna().any().any()
    assert (found["TikTok_transformed"] == 0).all()
    assert found["trend"].min() == 0 and found["trend"].max() == pytest.approx(59 / 60)


def test_decomposition_adds_up_and_shares_follow(spark):
    media, sales = media_and_sales(spark)
    result = mix.run_mix(media, sales)
    parts = result.decomposition.toPandas()
    assert np.allclose(parts.base_sales + parts.calendar_sales + parts.media_sales, parts.total_predicted)
    by_channel = result.channel_contributions.toPandas().set_index("channel")
    assert len(by_channel) == 8 and (by_channel.contribution_pct >= 0).all()
    assert by_channel.loc["TikTok", ["incremental_revenue", "total_spend", "incremental_roi"]].tolist() == [0, 0, 0]
    assert by_channel.total_spend.sum() == pytest.approx(media.agg(F.sum("spend")).first()[0], abs=2)
    assert by_channel.contribution_pct.is_monotonic_decreasing
    row = result.metrics.first()
    assert row["mape"] < 25


def test_standardize_leaves_a_constant_at_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert sorted(tuple(r) for r in mix.standardize(df, ["a", "b"]).collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_metrics_skip_zero_actuals(spark):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 9.0), (20.0, 22.0)], "a double, p double")
    row = metrics.regression_metrics(df, "a", "p").first()
    assert row["mape"] == 10.0 and row["rmse"] == round(math.sqrt(30 / 3), 2)
    assert row["r2"] == round(1 - 30 / 200, 4)


def test_metric_rows(spark):
    df = spark.createDataFrame([(21.0, 5.0, 0.4)], "mape double, rmse double, r2 double")
    rows = {r["metric_name"]: (r["threshold"], r["passed"]) for r in metrics.model_metric_rows(df, "m", "1", 20, 0.5).collect()}
    assert rows == {"mape": (20.0, False), "rmse": (None, True), "r2": (0.5, False)}


@pytest.fixture(scope="module")
def daily(spark):
    rng = np.random.default_rng(1)
    rows = []
    for key, level in (("a", 10_000.0), ("b", 300.0)):
        for i in range(900):
            season = 1 + 0.2 * math.sin(2 * math.pi * i / 7)
            rows.append((key, D(2023, 1, 1) + dt.timedelta(i), max(level * season + rng.normal(0, level * 0.01), 0)))
    return spark.createDataFrame(rows, "k string, day date, revenue double")


def check(result, horizon, step, last, series):
    ahead = result.forecast.toPandas()
    assert len(ahead) == horizon * series and (ahead.yhat_lower <= ahead.yhat).all() and (ahead.yhat <= ahead.yhat_upper).all()
    assert ahead.date.min() == last + dt.timedelta(step) and ahead.date.max() == last + dt.timedelta(step * horizon)
    assert set(result.actual_vs_predicted.columns) >= {"date", "actual", "predicted"}
    assert set(result.metrics.columns) >= {"mape", "rmse", "r2", "warning"}
    assert result.metrics.count() == result.validation_metrics.count() == series


def test_seasonal_forecast_of_many_series(daily):
    result = forecast.run_forecast(daily, "day", "revenue", "seasonal", 14, keys=["k"])
    check(result, 14, 1, D(2023, 1, 1) + dt.timedelta(899), 2)
    assert all(r["mape"] < 5 and r["r2"] > 0.9 for r in result.metrics.collect())


def test_tree_forecast(daily):
    result = forecast.run_forecast(daily, "day", "revenue", "xgboost", 7, keys=["k"], rounds=5)
    about = result.metrics.select("model", "target", "horizon", F.col("train_end").isNotNull()).distinct().collect()
    assert [tuple(r) for r in about] == [("xgboost", "revenue", 7, True)]
    check(result, 7, 1, D(2023, 1, 1) + dt.timedelta(899), 2)
    assert result.actual_vs_predicted.groupBy("k").count().count() == 2


def test_single_weekly_series_with_a_regressor(spark):
    rows = [(D(2023, 1, 2) + dt.timedelta(7 * i), 100.0 + 50 * (i % 2), float(i % 2)) for i in range(80)]
    df = spark.createDataFrame(rows, "week date, y double, promo double")
    result = forecast.run_forecast(df, "week", "y", "prophet", 4, regressors=["promo"], step_days=7)
    check(result, 4, 7, D(2023, 1, 2) + dt.timedelta(7 * 79), 1)
    assert result.metrics.first()["mape"] < 5


def test_unknown_model_is_an_error(daily):
    with pytest.raises(ValueError, match="unknown model"):
        forecast.run_forecast(daily, "day", "revenue", "arima")
