import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import filters
from tidemark.operators.filters import FilterParams


def days(spark, n, start=dt.date(2023, 1, 1)):
    return spark.range(n).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("date"), F.lit("DTC").alias("channel"))


def warning(df, context=""):
    return filters.reliability_warning(df, context).first()["warning"]


def test_date_bounds_are_inclusive_and_optional(spark):
    df = days(spark, 10)
    assert filters.date_filter(df, "date", "2023-01-03", dt.date(2023, 1, 5)).count() == 3
    assert filters.date_filter(df, "date", None, "").count() == 10


def test_unknown_columns_are_ignored_and_names_are_mapped(spark):
    df = days(spark, 3).withColumn("lead_source", F.lit("Web"))
    params = FilterParams(channel="Web", region="North")
    assert filters.apply_filters(df, "date", params, {"channel": "lead_source"}).count() == 3
    assert filters.apply_filters(df, "date", params).count() == 0


def test_filter_reaches_the_parquet_scan(spark, tmp_path):
    days(spark, 10).write.parquet(str(tmp_path / "t.parquet"))
    df = filters.apply_filters(spark.read.parquet(str(tmp_path / "t.parquet")), "date", FilterParams("2023-01-05", channel="DTC"))
    plan = df.select("date")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,2023-01-05)" in plan and "EqualTo(channel,DTC)" in plan


@pytest.mark.parametrize("n, start", [(0, "No data matches"), (1, "Only 1 rows"), (29, "Only 29 rows")])
def test_warning_below_thirty_rows(spark, n, start):
    assert warning(days(spark, n)).startswith(start)


def test_warning_names_its_context_and_ends_at_thirty(spark):
    assert warning(days(spark, 0), "media spend") == "No data matches the selected filters (media spend)."
    assert warning(days(spark, 30)) is None
    assert warning(days(spark, 500)) is None


def test_model_needs_sixty_points(spark):
    assert filters.require_points(days(spark, 60)).count() == 60
    with pytest.raises(ValueError, match="59 points"):
        filters.require_points(days(spark, 59))


def test_long_enough_judges_each_series(spark):
    df = days(spark, 60).unionByName(days(spark, 59).withColumn("channel", F.lit("Retail")))
    assert [r["channel"] for r in filters.long_enough(df, ["channel"]).select("channel").distinct().collect()] == ["DTC"]


def test_ratio_clip_and_rounding(spark):
    row = spark.range(1).select(
        scalars.safe_ratio(F.lit(5), F.lit(0)).alias("zero"),
        scalars.safe_ratio(F.lit(5), F.lit(2)).alias("half"),
        scalars.clip(F.lit(-0.9), -0.5, 1.0).alias("low"),
        scalars.clip(F.lit(None).cast("double"), -0.5, 1.0).alias("none"),
        scalars.round_to(F.lit(0.125), 2).alias("even"),
        scalars.round_to(F.lit(-0.001), 2).alias("zero_sign"),
    ).first()
    assert (row["zero"], row["half"], row["low"], row["none"], row["even"]) == (5.0, 2.5, -0.5, None, 0.12)
    assert str(row["zero_sign"]) == "0.0"


def test_bands(spark):
    df = spark.createDataFrame([(19_999.99,), (20_000.0,), (60_000.0,), (60_000.01,)], "v double")
    assert [r[0] for r in df.select(scalars.deal_size_band(F.col("v"))).collect()] == ["Small", "Mid", "Mid", "Large"]
    roas = spark.createDataFrame([(2.5,), (1.9,), (1.89,)], "v double")
    assert [r[0] for r in roas.select(scalars.roas_band(F.col("v"))).collect()] == ["green", "amber", "red"]
