"""Period buckets, calendar spines and chronological splits.

A series here holds one row per period, so its length is bounded by the calendar whatever the
size of the source. The windows below run over such series only.
"""

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions import dates

_STEPS = {"daily": "interval 1 day", "weekly": "interval 7 days", "monthly": "interval 1 month"}


def _step(granularity: str):
    return F.expr(_STEPS.get(granularity, _STEPS["weekly"]))


def period_totals(df: DataFrame, date_col: str, targets, keys=()) -> DataFrame:
    """Sums by date (and series key)."""
    targets = [targets] if isinstance(targets, str) else list(targets)
    return (
        df.filter(F.col(date_col).isNotNull())
        .groupBy(*keys, date_col)
        .agg(*[F.coalesce(F.sum(t), F.lit(0.0)).alias(t) for t in targets])
    )


def fill_gaps(series: DataFrame, period: str, values, granularity: str, keys=()) -> DataFrame:
    """Add the missing periods between the first and the last of each series, at 0.

    Each row spans the periods up to the next row, so no second read of the source is needed.
    """
    step = _step(granularity)
    following = F.lead(period).over(Window.partitionBy(*keys).orderBy(period))
    span = F.sequence(F.col(period), F.coalesce(F.col("_next"), F.col(period)), step)
    spread = (
        series.withColumn("_next", following)
        .select("*", F.posexplode(span).alias("_at", "_period"))
        .filter((F.col("_at") == 0) | (F.col("_period") < F.col("_next")))
    )
    return spread.select(
        *keys,
        F.col("_period").alias(period),
        *[F.when(F.col("_at") == 0, F.col(v)).otherwise(F.lit(0)).alias(v) for v in values],
    )


def bucket(df: DataFrame, date_col: str, granularity: str, value: str, keys=()) -> DataFrame:
    """Sum per period, with empty periods at 0. Weekly periods run Tuesday to Monday."""
    labelled = df.filter(F.col(date_col).isNotNull()).select(
        *keys, dates.bucket_label(F.col(date_col), granularity).alias("period"), value
    )
    totals = labelled.groupBy(*keys, "period").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))
    return fill_gaps(totals, "period", [value], granularity, keys)


def month_spine(df: DataFrame, close_col: str, end: dt.date, cap: int | None = None) -> DataFrame:
    """One row per month start after the close up to `end`, numbered from 1; `cap` limits the months."""
    first = F.add_months(F.trunc(close_col, "MM"), 1)
    months = F.sequence(first, F.lit(end), F.expr("interval 1 month"))
    if cap is not None:
        months = F.slice(months, 1, cap)
    return (
        df.filter(first <= F.lit(end))
        .select("*", F.posexplode(months).alias("_at", "month"))
        .withColumn("months_since_close", (F.col("_at") + 1).cast("long"))
        .drop("_at")
    )


def week_spine(bounds: DataFrame, start_col: str, end_col: str) -> DataFrame:
    """The Mondays from start to end, both included, for each row of bounds."""
    first = F.next_day(F.date_sub(start_col, 1), "Mon")
    weeks = F.explode(F.sequence(first, F.col(end_col), F.expr("interval 7 days")))
    rest = [c for c in bounds.columns if c not in (start_col, end_col)]
    return bounds.filter(first <= F.col(end_col)).select(*rest, weeks.alias("week_start"))


def reindex_spine(series: DataFrame, spine: DataFrame, on, values) -> DataFrame:
    """The series on the dates of the spine; dates it lacks are 0, other dates fall away."""
    return spine.join(series, on, "left").fillna(0, list(values))


def horizon_spine(last: DataFrame, last_col: str, horizon: int, step_days: int = 1) -> DataFrame:
    """The next `horizon` dates after each row's last date."""
    ahead = F.sequence(F.lit(1), F.lit(horizon))
    return (
        last.select("*", F.explode(ahead).alias("_at"))
        .withColumn("date", F.date_add(last_col, F.col("_at") * step_days))
        .drop("_at", last_col)
    )


def chrono_split(df: DataFrame, date_col: str, train: float = 0.70, validation: float = 0.15, keys=()) -> DataFrame:
    """Label rows train, validation or test by their place in the date range (not the row count).

    Adds `train_end` and `validation_end`. With keys each series is split on its own range.
    """
    if train + validation >= 1.0:
        raise ValueError("the train and validation fractions must leave room for a test slice")
    bounds = df.groupBy(*keys).agg(F.min(date_col).alias("_first"), F.max(date_col).alias("_last"))
    days = F.date_diff("_last", "_first")

    def cut(share):
        return F.date_add("_first", F.floor(days * F.lit(float(share))).cast("int"))

    bounds = bounds.select(
        *keys, cut(train).alias("train_end"), cut(train + validation).alias("validation_end")
    )
    if keys:
        marked = df.join(bounds, list(keys))
    else:
        marked = df.withColumns(
            {c: bounds.select(c).scalar() for c in ("train_end", "validation_end")}
        )
    day = F.col(date_col)
    label = (
        F.when(day <= F.col("train_end"), "train")
        .when(day <= F.col("validation_end"), "validation")
        .when(day.isNotNull(), "test")
    )
    return marked.withColumn("split", label)


def split_summary(df: DataFrame, date_col: str, keys=()) -> DataFrame:
    """Rows and date bounds per slice of a split table."""
    return df.groupBy(*keys, "split").agg(
        F.count("*").alias("rows"), F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date")
    )
