"""Revenue, spend and trend figures."""

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tidemark import constants as C
from tidemark.functions import scalars
from tidemark.functions.dates import as_date, month_period
from tidemark.functions.scalars import percent_of, round_to, safe_ratio, sum_or_zero, whole_money
from tidemark.operators.buckets import bucket
from tidemark.operators.filters import FilterParams, apply_filters, warning_text


def _one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row aggregates with different columns side by side, without a cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def kpi_summary(online: DataFrame, offline: DataFrame, media: DataFrame, crm: DataFrame, start=None, end=None) -> DataFrame:
    """One row of top-level figures for a date range."""
    params = FilterParams(start, end)
    online, crm = apply_filters(online, "date", params), apply_filters(crm, "lead_date", params)
    offline = apply_filters(offline, "week_start", params)
    media = apply_filters(media, "week_start", params)
    won = F.col("outcome") == C.CLOSED_WON
    sums = _one_row(
        online.agg(
            sum_or_zero("revenue").alias("online"), sum_or_zero("orders").alias("orders"), F.count("*").alias("rows")
        ),
        offline.agg(sum_or_zero("total_revenue").alias("offline")),
        media.agg(sum_or_zero("spend").alias("spend"), sum_or_zero("incremental_revenue").alias("incremental")),
        crm.agg(
            F.count("*").alias("leads"), F.count_if(won).alias("won"),
            sum_or_zero(F.when(won, F.col("deal_value"))).alias("pipeline"),
        ),
    )
    total = F.col("online") + F.col("offline")
    return sums.select(
        round_to(total, 2).alias("total_revenue"),
        round_to("online", 2).alias("online_revenue"),
        round_to("offline", 2).alias("offline_revenue"),
        percent_of(F.col("online"), total).alias("online_share_pct"),
        F.col("orders").cast("long").alias("total_orders_online"),
        round_to("spend", 2).alias("total_media_spend"),
        round_to(safe_ratio(F.col("incremental"), F.col("spend")), 2).alias("blended_roas"),
        F.col("leads").alias("total_leads"),
        round_to("pipeline", 2).alias("pipeline_closed_won"),
        percent_of(F.col("won"), F.col("leads")).alias("win_rate_pct"),
        warning_text(F.col("rows"), "online sales").alias("warning"),
    )


def trend_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str) -> DataFrame:
    """Two bucketed series side by side with their sum; a period that one lacks counts 0."""
    a, b = F.coalesce(F.col(left_value), F.lit(0.0)), F.coalesce(F.col(right_value), F.lit(0.0))
    return left.join(right, "period", "full_outer").select(
        "period", a.alias(left_value), b.alias(right_value), (a + b).alias("total_revenue")
    )


def kpi_trend(online: DataFrame, offline: DataFrame, granularity: str = "weekly", start=None, end=None) -> DataFrame:
    """Online, offline and total revenue per period."""
    params = FilterParams(start, end)
    web = bucket(apply_filters(online, "date", params), "date", granularity, "revenue")
    shop = bucket(apply_filters(offline, "week_start", params), "week_start", granularity, "total_revenue")
    return trend_join(
        web.withColumnRenamed("revenue", "online_revenue"),
        shop.withColumnRenamed("total_revenue", "offline_revenue"),
        "online_revenue", "offline_revenue",
    )


def spend_efficiency(media: DataFrame) -> DataFrame:
    """Totals and mean row ratios by channel."""
    counts = [F.sum(c).alias(f"total_{c}") for c in ("impressions", "clicks", "conversions")]
    means = [round_to(F.avg(c), 3).alias(f"avg_{c}") for c in ("roas", "cpm", "ctr", "cpa")]
    by_channel = media.filter(F.col("channel").isNotNull()).groupBy("channel")
    return by_channel.agg(round_to(F.sum("spend"), 3).alias("total_spend"), *counts, *means)


def revenue_by(df: DataFrame, dim: str, value: str = "revenue") -> DataFrame:
    """Sum by a dimension in whole units, largest first."""
    totals = df.filter(F.col(dim).isNotNull()).groupBy(dim).agg(whole_money(sum_or_zero(value)).alias(value))
    return totals.orderBy(F.desc(value), dim)


def roas_by_channel(media: DataFrame) -> DataFrame:
    means = media.filter(F.col("channel").isNotNull()).groupBy("channel").agg(round_to(F.avg("roas"), 3).alias("roas"))
    return means.orderBy(F.desc("roas"), "channel")


def spend_by_channel(media: DataFrame) -> DataFrame:
    return revenue_by(media, "channel", "spend")


def blended_roas(media: DataFrame) -> DataFrame:
    ratio = safe_ratio(sum_or_zero("incremental_revenue"), sum_or_zero("spend"))
    return media.agg(round_to(ratio, 2).alias("blended_roas"))


def mom_change(df: DataFrame, date_col: str = "date", value: str = "revenue") -> DataFrame:
    """Change in % between the last two months that have rows; null with fewer than two."""
    months = df.groupBy(month_period(F.col(date_col)).alias("month")).agg(sum_or_zero(value).alias("curr"))
    before = F.lag("curr").over(Window.partitionBy().orderBy("month"))
    last = months.withColumn("prev", before).agg(
        F.max("month").alias("month"), F.max_by("curr", "month").alias("curr"), F.max_by("prev", "month").alias("prev")
    )
    change = round_to(safe_ratio(F.col("curr") - F.col("prev"), F.col("prev")) * 100, 2)
    return last.select("month", F.when(F.col("prev").isNotNull(), change).alias("mom_change_pct"))


def period_bounds(df: DataFrame, date_col: str = "date", start=None, end=None) -> DataFrame:
    """First and last date, each replaced by the argument when one is given."""
    return df.agg(
        F.coalesce(F.lit(as_date(start)).cast("date"), F.min(date_col)).alias("period_start"),
        F.coalesce(F.lit(as_date(end)).cast("date"), F.max(date_col)).alias("period_end"),
    )


def weekly_range(df: DataFrame, week_col: str = "week_start", value: str = "total_revenue") -> DataFrame:
    """Smallest and largest weekly sum."""
    weeks = df.groupBy(week_col).agg(F.sum(value).alias("week_total"))
    return weeks.agg(
        round_to(F.min("week_total"), 2).alias("min_week"), round_to(F.max("week_total"), 2).alias("max_week")
    )


def with_roas_band(by_channel: DataFrame) -> DataFrame:
    return by_channel.withColumn("band", scalars.roas_band(F.col("roas")))


def budget_shift(by_channel: DataFrame, deltas: DataFrame, margin: float) -> DataFrame:
    """Effect of moving spend between channels.

    `by_channel` has channel, spend, revenue; `deltas` has channel, delta. The gain is the
    delta at the channel's ROAS, reduced to the margin.
    """
    moved = by_channel.join(deltas, "channel", "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
    roas = safe_ratio(F.col("revenue"), F.col("spend"))
    sums = moved.agg(
        F.sum("spend").alias("spend"), F.sum("revenue").alias("revenue"),
        F.sum(F.greatest("delta", F.lit(0.0))).alias("reallocated"),
        F.sum(F.col("delta") * roas * F.lit(margin)).alias("gain"),
        F.sum(F.col("spend") + F.col("delta")).alias("new_spend"),
    )
    return sums.select(
        round_to("reallocated", 2).alias("reallocated"),
        round_to("gain", 2).alias("revenue_gain"),
        round_to(safe_ratio(F.col("revenue"), F.col("spend")), 4).alias("roas_before"),
        round_to(safe_ratio(F.col("revenue") + F.col("gain"), F.col("new_spend")), 4).alias("roas_after"),
    )
