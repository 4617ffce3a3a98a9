"""Anomaly alerts on series.

The columns to check are unpivoted, so one shuffle serves every column, check and series. Means,
deviations and quartiles are aggregates that join back. Only what goes by order uses windows, over
series with one row per date: bounded by the calendar.
"""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import constants as C
from tidemark.functions.scalars import round_to, severity_rank
from tidemark.operators import series as S
from tidemark.operators.ranks import exact_quantiles
from tidemark.session import broadcast_if_small, pin


def _range(low: Column, high: Column) -> Column:
    return F.struct(low.cast("double").alias("lo"), high.cast("double").alias("hi"))


def _alert(table: str, column: Column, when: Column, value: Column, span: Column, severity: Column, hint: Column, kind: str) -> Column:
    return F.struct(
        F.lit(table).alias("table_name"), column.alias("column_name"), when.alias("date"),
        round_to(value.cast("double"), 4).alias("value"), span.alias("expected_range"),
        severity.alias("severity"), hint.alias("root_cause_hint"), F.lit(kind).alias("check_type"),
    )


def _raised(df: DataFrame, keys, *alerts: tuple[Column, Column]) -> DataFrame:
    """The alerts, given as (condition, alert), that hold on each row."""
    held = F.array_compact(F.array(*[F.when(condition, alert) for condition, alert in alerts]))
    return df.select(*keys, F.explode(held).alias("_alert")).select(*keys, "_alert.*")


def null_rates(df: DataFrame, exclude=()) -> DataFrame:
    """Share of nulls per column, in one pass over the table."""
    names = [c for c in df.columns if c not in exclude]
    rates = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in names])
    return rates.unpivot([], names, "column_name", "null_rate")


def null_spike_alerts(df: DataFrame, table: str, exclude=(), threshold: float = C.NULL_WARN) -> DataFrame:
    """Columns with too many nulls."""
    rate, name = F.col("null_rate"), F.col("column_name")
    severity = F.when(rate > C.NULL_CRITICAL, "critical").otherwise("warning")
    hint = F.format_string(C.NULL_HINT, round_to(rate * 100, 1), name)
    span = _range(F.lit(0.0), F.lit(threshold))
    alert = _alert(table, name, F.lit("overall"), rate, span, severity, hint, "null_spike")
    return _raised(null_rates(df, exclude), (), (rate > threshold, alert))


def _long(df: DataFrame, date_col: str, columns, keys=()) -> DataFrame:
    """(keys, date, column_name, x): the checked columns as doubles, one below another."""
    typed = df.select(*keys, F.col(date_col).alias("date"), *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot([*keys, "date"], list(columns), "column_name", "x")


def _one_decimal(number: Column) -> Column:
    return F.when(number == float("inf"), "inf").otherwise(F.format_string("%.1f", round_to(number, 1)))


def _iso(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def _attach(long: DataFrame, figures: DataFrame, group) -> DataFrame:
    """Put each series' figures next to its rows; a null key is a series of its own."""
    renamed = pin(figures.withColumnsRenamed({c: f"_of_{c}" for c in group}))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group]
    return long.join(broadcast_if_small(renamed), reduce(and_, same)).drop(*renamed.columns[: len(group)])


def _with_zscore(long: DataFrame, keys) -> DataFrame:
    """Mean and deviation by a partial aggregate, so a raw table is never gathered per column."""
    group = [*keys, "column_name"]
    figures = long.groupBy(*group).agg(
        F.avg("x").alias("_mean"), F.stddev_samp("x").alias("_std"), F.stddev_pop("x").alias("_spread")
    )
    z = F.when(F.col("_spread") > 0, F.abs(F.col("x") - F.col("_mean")) / F.col("_spread"))
    return _attach(long, figures, group).withColumn("_z", z).drop("_spread")


def _one_per_date(long: DataFrame, keys) -> DataFrame:
    """The series as they are, pinned; two rows of a series on one date are an error, as their order is open."""
    group = [*keys, "column_name", "date"]
    twice = F.raise_error(F.concat(F.lit("several rows of one series on "), F.coalesce(F.col("date").cast("string"), F.lit("null"))))
    rows = long.groupBy(*group).agg(F.first("x").alias("x"), F.count("*").alias("_n"))
    return pin(rows.withColumn("x", F.when(F.col("_n") > 1, twice.cast("double")).otherwise(F.col("x"))).drop("_n"))


def _zscore_alert(table: str, threshold: float) -> tuple[Column, Column]:
    z, mean, half = F.col("_z"), F.col("_mean"), F.col("_std") * threshold
    severity = F.when(z > C.Z_CRITICAL, "critical").otherwise("warning")
    span = _range(round_to(mean - half, 4), round_to(mean + half, 4))
    hint = F.format_string(C.Z_HINT, _one_decimal(z))
    return z > threshold, _alert(table, F.col("column_name"), _iso("date"), F.col("x"), span, severity, hint, "zscore")


def _with_shift(long: DataFrame, window: int, keys) -> DataFrame:
    group = [*keys, "column_name"]
    rolled = long.withColumn("_rolled", S.rolling_mean("x", "date", group, window))
    return rolled.withColumn("_moved", F.abs(S.pct_change("_rolled", "date", group)))


def _shift_alert(table: str, threshold: float) -> tuple[Column, Column]:
    moved, name = F.col("_moved"), F.col("column_name")
    hint = F.format_string(C.SHIFT_HINT, _one_decimal(moved * 100), name)
    span = _range(F.lit(0.0), F.lit(threshold))
    return moved > threshold, _alert(table, name, _iso("date"), moved, span, F.lit("warning"), hint, "level_shift")


def zscore_alerts(df: DataFrame, date_col: str, columns, table: str, threshold: float = C.Z_WARN, keys=()) -> DataFrame:
    """Values too far from the mean of their series. Nulls are passed over."""
    return _raised(_with_zscore(_long(df, date_col, columns, keys), keys), keys, _zscore_alert(table, threshold))


def level_shift_alerts(df: DataFrame, date_col: str, columns, table: str, window: int = C.SHIFT_WINDOW, threshold: float = C.SHIFT_WARN, keys=()) -> DataFrame:
    """Dates where the rolling mean jumps against the row before. A series has one row per date."""
    series = _one_per_date(_long(df, date_col, columns, keys), keys)
    return _raised(_with_shift(series, window, keys), keys, _shift_alert(table, threshold))


def iqr_alerts(df: DataFrame, date_col: str, columns, table: str, fence: float = C.IQR_FENCE, keys=()) -> DataFrame:
    """Values outside the interquartile fences of their series (an extension)."""
    group, long = [*keys, "column_name"], _long(df, date_col, columns, keys)
    found = exact_quantiles(long, "x", (0.25, 0.75), group).groupBy(*group).agg(F.sort_array(F.collect_list("quantile")).alias("_q"))
    known = _attach(long, found, group)
    q1, q3, x, name = F.col("_q")[0], F.col("_q")[1], F.col("x"), F.col("column_name")
    low, high = q1 - (q3 - q1) * fence, q3 + (q3 - q1) * fence
    span = _range(round_to(low, 4), round_to(high, 4))
    alert = _alert(table, name, _iso("date"), x, span, F.lit("warning"), F.format_string(C.IQR_HINT, name), "iqr")
    return _raised(known, keys, ((x < low) | (x > high), alert))


def detect_anomalies(
    df: DataFrame, date_col: str, columns, table: str, z_threshold: float = C.Z_WARN,
    shift_threshold: float = C.SHIFT_WARN, keys=(), ordered: bool = True,
) -> DataFrame:
    """Null spikes on every column as loaded; z-scores and level shifts on the listed ones that
    exist, after carrying the last value over nulls. Critical alerts come first.

    The null rates are one pass over the table; the series, with one row per date, are pinned.
    """
    present = [c for c in columns if c in df.columns]
    alerts = null_spike_alerts(df, table, (date_col, *keys))
    alerts = alerts.select(*[F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys], *alerts.columns)
    if present:
        filled = S.ffill("x", "date", [*keys, "column_name"])
        long = pin(_one_per_date(_long(df, date_col, present, keys), keys).withColumn("x", filled))
        judged = _with_zscore(_with_shift(long, C.SHIFT_WINDOW, keys), keys)
        odd = _raised(judged, keys, _zscore_alert(table, z_threshold), _shift_alert(table, shift_threshold))
        alerts = alerts.unionByName(odd)
    return by_severity(alerts, "severity", (*keys, "table_name", "column_name", "date", "check_type")) if ordered else alerts


def by_severity(df: DataFrame, severity: str, ties=()) -> DataFrame:
    """Critical, warning, then the rest; ties in a fixed order."""
    return df.orderBy(severity_rank(F.col(severity)), *ties)
