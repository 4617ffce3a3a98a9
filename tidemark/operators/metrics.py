"""Model quality figures and their rows for the metrics table."""

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.scalars import round_to


def regression_metrics(df: DataFrame, actual: str, predicted: str, keys=()) -> DataFrame:
    """mape (over non-zero actuals), rmse and r2 per series, in one aggregate."""
    a, p = F.col(actual), F.col(predicted)
    sums = df.groupBy(*keys).agg(
        (F.avg(F.when(a != 0, F.abs((a - p) / a))) * 100).alias("mape"),
        F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"),
        F.avg((a - p) * (a - p)).alias("_error"),
        F.var_pop(a).alias("_spread"),
    )
    constant = F.when(F.col("_error") == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.col("_spread") == 0, constant).otherwise(1 - F.try_divide("_error", "_spread"))
    return sums.select(
        *keys, round_to("mape", 3).alias("mape"), round_to("rmse", 2).alias("rmse"), round_to(r2, 4).alias("r2")
    )


def model_metric_rows(metrics: DataFrame, model: str, version: str, mape_limit: float, r2_limit: float, moment: dt.datetime | None = None) -> DataFrame:
    """Long rows in the shape of `monitoring.model_metrics`. A metric without a limit passes."""
    at = F.current_timestamp() if moment is None else F.lit(moment)
    mape, r2 = F.col("mape"), F.col("r2")
    checks = [
        ("mape", mape, F.lit(float(mape_limit)), mape <= mape_limit),
        ("rmse", F.col("rmse"), F.lit(None).cast("double"), F.lit(True)),
        ("r2", r2, F.lit(float(r2_limit)), r2 >= r2_limit),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("metric_name"), v.alias("metric_value"), t.alias("threshold"), ok.alias("passed"))
            for n, v, t, ok in checks
        ]
    )
    return metrics.select(F.inline(rows)).select(
        F.expr("uuid()").alias("metric_id"), at.alias("recorded_at"), F.lit(model).alias("model_name"),
        F.lit(version).alias("model_version"), "metric_name", "metric_value", "threshold", "passed",
    )


def write_model_metrics(rows: DataFrame, table: str = "monitoring.model_metrics") -> None:
    """Append rows of model_metric_rows() to the metrics table."""
    names = rows.sparkSession.table(table).columns
    rows.select(*names).write.insertInto(table)
