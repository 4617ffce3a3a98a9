"""Alerts of both kinds in one shape, and their way into the quality table."""

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.anomaly import by_severity


def combine_alerts(checks: DataFrame, anomalies: DataFrame, checked_at: dt.datetime | None = None) -> DataFrame:
    """One table with a `type`; a field that a kind does not have is null."""
    at = F.current_timestamp() if checked_at is None else F.lit(checked_at)
    watched = checks.select(
        F.lit("pipeline_monitor").alias("type"), F.col("status").alias("severity"), F.col("table_name").alias("table"),
        "check", "detail", "root_cause_hint", at.alias("checked_at"), "metric_value", "threshold",
    )
    odd = anomalies.select(
        F.lit("anomaly").alias("type"), "severity", F.col("table_name").alias("table"), F.col("column_name").alias("column"),
        "date", "value", "expected_range", "root_cause_hint", "check_type",
    )
    return watched.unionByName(odd, allowMissingColumns=True)


def format_alerts(combined: DataFrame) -> DataFrame:
    """The payload of each alert as JSON, with the fields of its kind only."""
    hidden = ("metric_value", "threshold")
    fields = [c for c in combined.columns if c not in hidden]
    return combined.select("type", "severity", "table", F.to_json(F.struct(*fields)).alias("payload"))


def alert_counts(combined: DataFrame) -> DataFrame:
    return combined.agg(
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )


def top_alerts(combined: DataFrame, n: int = 5) -> DataFrame:
    """The first alerts for a message: critical before warning, no others."""
    urgent = combined.filter(F.col("severity").isin("critical", "warning"))
    lines = urgent.withColumn(
        "line",
        F.concat(
            F.lit("*["), F.upper("severity"), F.lit("]* `"), F.coalesce("table", F.lit("")), F.lit("` — "),
            F.coalesce("detail", "root_cause_hint", F.lit("")),
        ),
    )
    return by_severity(lines, "severity", ("table", "type", "check", "column", "date", "check_type")).limit(n)


def quality_rows(combined: DataFrame, checked_at: dt.datetime | None = None) -> DataFrame:
    """Alerts in the shape of `monitoring.data_quality`."""
    at = F.current_timestamp() if checked_at is None else F.lit(checked_at)
    fine = F.col("severity").isin("ok", "info")
    return combined.select(
        F.expr("uuid()").alias("check_id"), F.coalesce("checked_at", at).alias("checked_at"),
        F.col("table").alias("table_name"), F.coalesce("check_type", "check").alias("check_type"),
        F.col("column").alias("column_name"), F.coalesce("value", "metric_value").alias("metric_value"),
        F.coalesce("threshold", F.col("expected_range.hi")).alias("threshold"), fine.alias("passed"),
        F.when(fine, "info").otherwise(F.col("severity")).alias("severity"), "root_cause_hint",
    )


def write_alerts(combined: DataFrame, table: str = "monitoring.data_quality", checked_at: dt.datetime | None = None) -> None:
    """Append all alerts to the quality table."""
    names = combined.sparkSession.table(table).columns
    quality_rows(combined, checked_at).select(*names).write.insertInto(table)
