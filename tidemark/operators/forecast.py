"""Sales forecasts for many series at once.

Raw sales are first summed to one row per series and date. Both backends take such series, so a
group is as long as the calendar and no longer.
"""

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidemark import constants as C
from tidemark.functions.dates import calendar_features
from tidemark.functions.scalars import forecast_warning
from tidemark.operators import trees
from tidemark.operators.accounts import packed
from tidemark.operators.buckets import chrono_split, horizon_spine
from tidemark.operators.metrics import regression_metrics
from tidemark.session import lookup_join, pin


def prediction_interval(df: DataFrame, actual: str = "actual", predicted: str = "yhat", keys=()) -> DataFrame:
    """Add yhat_lower and yhat_upper: ± 1.645 population deviations of the train residuals."""
    residual = F.when(F.col("split") == "train", F.col(actual) - F.col(predicted))
    half = F.stddev_pop(residual).over(Window.partitionBy(*keys)) * C.INTERVAL_Z
    return df.withColumns({"yhat_lower": F.col(predicted) - half, "yhat_upper": F.col(predicted) + half})


def _with_future(series: DataFrame, keys, horizon: int, step_days: int, regressors) -> DataFrame:
    """Labelled rows plus the horizon after the last date, with the regressors at 0 there."""
    ends = series.groupBy(*keys).agg(F.max("date").alias("_end"))
    ahead = horizon_spine(ends, "_end", horizon, step_days).withColumns(
        {"split": F.lit("future"), "actual": F.lit(None).cast("double"), **{r: F.lit(0.0) for r in regressors}}
    )
    return series.unionByName(ahead)


_TREND_KNOTS = 25
_YEARLY_TERMS, _WEEKLY_TERMS = 10, 3


def _design(days: np.ndarray, start: float, span: float) -> tuple[np.ndarray, np.ndarray]:
    """Additive model columns (Taylor and Letham 2018) and the prior precision of each."""
    t = (days - start) / span
    knots = np.linspace(0, 0.8, _TREND_KNOTS + 1)[1:]
    columns = [np.ones_like(t), t, *np.maximum(t[:, None] - knots, 0).T]
    for period, terms in ((365.25, _YEARLY_TERMS), (7.0, _WEEKLY_TERMS)):
        angles = 2 * math.pi * np.outer(days, np.arange(1, terms + 1)) / period
        columns += [*np.sin(angles).T, *np.cos(angles).T]
    seasonal = 2 * (_YEARLY_TERMS + _WEEKLY_TERMS)
    precision = np.concatenate([[0.0, 1 / 25], np.full(_TREND_KNOTS, 1 / 0.05**2), np.full(seasonal, 1 / 100)])
    return np.stack(columns, axis=1), precision


def _fit_seasonal(regressors):
    """Penalised least squares for one series; its length is bounded by the calendar."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        days = pd.to_datetime(rows["date"]).to_numpy().astype("datetime64[D]").astype(float)
        train = (rows["split"] == "train").to_numpy() & rows["actual"].notna().to_numpy()
        if not train.any():
            return rows.assign(yhat=np.nan)
        y = rows["actual"].to_numpy(dtype=float)
        scale = max(float(np.abs(y[train]).max(initial=0.0)), 1e-12)
        start, span = days[train].min(), max(float(np.ptp(days[train])), 1.0)
        x, precision = _design(days, start, span)
        extra = rows[list(regressors)].fillna(0.0).to_numpy(dtype=float)
        x, precision = np.hstack([x, extra]), np.concatenate([precision, np.full(extra.shape[1], 1 / 100)])
        xt, yt = x[train], y[train] / scale
        noise = 0.05**2
        weights = np.linalg.lstsq(xt.T @ xt + noise * np.diag(precision), xt.T @ yt, rcond=None)[0]
        return rows.assign(yhat=x @ weights * scale)

    return fit


def forecast_seasonal(series: DataFrame, horizon: int, keys=(), regressors=(), step_days: int = 1) -> DataFrame:
    """Trend with bends, yearly and weekly season and regressors, one small solve per series.

    `series` has date, actual and split. Returns those rows and the horizon with yhat and its band.
    """
    rows = _with_future(series, keys, horizon, step_days, regressors)
    groups = rows.groupBy(*keys) if keys else rows.withColumn("_all", F.lit(0)).groupBy("_all")
    schema = T.StructType(list(rows.schema.fields if keys else rows.withColumn("_all", F.lit(0)).schema.fields))
    schema = schema.add("yhat", T.DoubleType())
    fitted = groups.applyInPandas(_fit_seasonal(tuple(regressors)), schema)
    return prediction_interval(fitted.drop("_all"), keys=keys)


def forecast_trees(
    series: DataFrame, horizon: int, keys=(), regressors=(), step_days: int = 1,
    rounds: int = 300, rate: float = 0.05, depth: int = 5, sample: float = 0.8, seed: int = 42,
    model: trees.TreeModel | None = None, library: bool = False,
) -> DataFrame:
    """Boosted trees on calendar features over all series in one distributed fit.

    The mean of a series' train rows stands for its key, so no key list reaches the driver. The fitted trees become a
    table (see `forecast_model`), and rows are scored from it; a saved `model` is scored without a fit.
    `library` adds what Spark's own model predicts, for comparison.
    """
    ready, names = _tree_features(series, horizon, keys, regressors, step_days)
    ready = pin(ready)
    fitted = None
    if model is None:
        fitted, model = _fit_trees(ready, names, rounds, rate, depth, sample, seed)
    predicted = trees.score(ready, model, depth, "yhat")
    if library and fitted is not None:
        predicted = fitted.transform(VectorAssembler(inputCols=names, outputCol="features").transform(predicted)).drop("features")
    plain = [c for c in predicted.columns if c not in names or c in regressors]
    return prediction_interval(predicted.select(*plain), keys=keys)


def _tree_features(series: DataFrame, horizon: int, keys, regressors, step_days: int) -> tuple[DataFrame, list[str]]:
    rows = _with_future(series, keys, horizon, step_days, regressors)
    level = F.avg(F.when(F.col("split") == "train", F.col("actual"))).over(Window.partitionBy(*keys))
    calendar = calendar_features(F.col("date"))
    names = [*calendar, "series_level", *regressors]
    return rows.withColumns({**calendar, "series_level": level}).fillna(0, names), names


def _fit_trees(ready: DataFrame, names: list[str], rounds: int, rate: float, depth: int, sample: float, seed: int):
    """The library's model and the same as tables."""
    known = ready.filter((F.col("split") == "train") & F.col("actual").isNotNull())
    train = packed(VectorAssembler(inputCols=names, outputCol="features").transform(known).select("features", "actual"))
    fitted = GBTRegressor(
        cacheNodeIds=True, checkpointInterval=50, labelCol="actual", predictionCol="library_yhat", maxIter=rounds, stepSize=rate,
        maxDepth=depth, subsamplingRate=sample, featureSubsetStrategy=str(sample), seed=seed,
    ).fit(train)
    spark = ready.sparkSession
    return fitted, trees.TreeModel(trees.feature_table(spark, [(n, None) for n in names]), trees.fitted_nodes(spark, fitted))


def forecast_model(
    series: DataFrame, keys=(), regressors=(), rounds: int = 300, rate: float = 0.05, depth: int = 5, sample: float = 0.8, seed: int = 42
) -> trees.TreeModel:
    """The trees of forecast_trees as tables, to be saved and used again."""
    ready, names = _tree_features(series, 1, keys, regressors, 1)
    return _fit_trees(pin(ready), names, rounds, rate, depth, sample, seed)[1]


_BACKENDS = {
    "seasonal": forecast_seasonal, "prophet": forecast_seasonal,
    "trees": forecast_trees, "xgboost": forecast_trees,
}


def actual_vs_predicted(predicted: DataFrame, keys=()) -> DataFrame:
    """Dates of the test slice with actual and prediction."""
    return predicted.filter(F.col("split") == "test").select(*keys, "date", "actual", F.col("yhat").alias("predicted"))


@dataclass(frozen=True)
class ForecastResult:
    """`metrics` has a row per series: its figures on the test slice, model, target, train_end and horizon."""

    forecast: DataFrame
    actual_vs_predicted: DataFrame
    metrics: DataFrame
    validation_metrics: DataFrame


def run_forecast(
    df: DataFrame, date_col: str, target_col: str, model: str = "seasonal", horizon: int = 90,
    regressors=(), keys=(), train: float = 0.70, validation: float = 0.15, step_days: int = 1, **options,
) -> ForecastResult:
    """Split each series by date, fit on train, measure on test, and predict past the last date."""
    if model not in _BACKENDS:
        raise ValueError(f"unknown model {model!r}: choose one of {sorted(_BACKENDS)}")
    series = pin(df.select(*keys, F.col(date_col).alias("date"), F.col(target_col).cast("double").alias("actual"), *regressors))
    marked = chrono_split(series, "date", train, validation, keys)
    ends = marked.groupBy(*keys).agg(F.max("train_end").alias("train_end"))
    marked = marked.drop("train_end", "validation_end")
    predicted = pin(_BACKENDS[model](marked, horizon, keys, regressors, step_days, **options))
    tested = actual_vs_predicted(predicted, keys)
    metrics = regression_metrics(tested, "actual", "predicted", keys).withColumns(
        {"model": F.lit(model), "target": F.lit(target_col), "horizon": F.lit(horizon)}
    )
    metrics = lookup_join(metrics, ends, list(keys)) if keys else metrics.withColumn("train_end", ends.select("train_end").scalar())
    checked = regression_metrics(predicted.filter(F.col("split") == "validation"), "actual", "yhat", keys)
    return ForecastResult(
        predicted.filter(F.col("split") == "future").select(*keys, "date", "yhat", "yhat_lower", "yhat_upper"),
        tested,
        metrics.withColumn("warning", forecast_warning(F.col("mape"), F.col("r2"))),
        checked,
    )
