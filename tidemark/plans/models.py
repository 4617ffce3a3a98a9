"""Queries on the mix model, forecasts and their quality figures."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import scalars
from tidemark.functions.scalars import round_to
from tidemark.operators import buckets, forecast, metrics, mix
from tidemark.operators.series import mean_of_previous
from tidemark.plans.registry import query
from tidemark.plans.views import over
from tidemark.session import pin
from tidemark.sources import bridge

# The last channel has no rows, as a channel without spend.
_CHANNELS = (*bridge.CHANNELS, "Email")
_TURN = repr(2 * math.pi)


def _sales(spark, folder):
    return bridge.offline_sales(spark, folder, ())


def _media_and_sales(spark, folder):
    sales, media = bridge.offline_and_media(spark, folder)
    return media, sales


def _pivot_sql(extra=""):
    cells = ", ".join(f"round_even(sum(spend) FILTER (WHERE channel = '{c}'), 2) AS \"{c}\"" for c in _CHANNELS)
    return f"SELECT week_start, {cells}{extra} FROM media_spend"


@query("pivot_spend", over("media_spend", _pivot_sql() + " GROUP BY week_start"))
def _(spark, folder):
    wide = mix.pivot_spend(bridge.media_spend(spark, folder), _CHANNELS)
    return wide.withColumns({c: round_to(c, 2) for c in _CHANNELS})


@query("mix_input", over("media_spend offline_sales", f"SELECT * FROM ({_pivot_sql()} GROUP BY week_start) JOIN (SELECT week_start, round_even(sum(total_revenue), 2) AS total_revenue FROM offline_sales GROUP BY 1) USING (week_start)"))
def _(spark, folder):
    wide = mix.mix_input(*_media_and_sales(spark, folder), _CHANNELS)
    return wide.withColumns({c: round_to(c, 2) for c in (*_CHANNELS, "total_revenue")})


def _feature_views():
    channels = ", ".join(f"('{c}')" for c in _CHANNELS)
    return {
        "weeks": """SELECT week_start, row_number() OVER (ORDER BY week_start) AS i, count(*) OVER () AS n, y FROM
                    (SELECT DISTINCT week_start FROM media_spend) JOIN (SELECT week_start, sum(total_revenue) AS y FROM offline_sales GROUP BY 1) USING (week_start)""",
        "cells": f"""SELECT w.*, channel, coalesce(spend, 0) AS x FROM weeks w, (VALUES {channels}) c(channel)
                     LEFT JOIN media_spend m USING (week_start, channel)""".replace("FROM weeks w, (VALUES", "FROM weeks w CROSS JOIN (VALUES"),
        "walk": """SELECT week_start, i, channel, x AS a FROM cells WHERE i = 1 UNION ALL
                   SELECT c.week_start, c.i, c.channel, c.x + 0.4::DOUBLE * walk.a FROM walk JOIN cells c ON c.channel = walk.channel AND c.i = walk.i + 1""",
        "features": "SELECT week_start, y AS total_revenue, "
        + ", ".join(f"max(a / (1 + 5e-5 * a)) FILTER (WHERE channel = '{c}') AS \"{c}_transformed\"" for c in _CHANNELS)
        + f""", sin(weekofyear(week_start) * {_TURN}::DOUBLE / 52) AS sin_week, cos(weekofyear(week_start) * {_TURN}::DOUBLE / 52) AS cos_week,
               (any_value(w.i) - 1) / any_value(n) AS trend FROM weeks w JOIN walk USING (week_start) GROUP BY week_start, y""",
    }


_COLUMNS = mix.feature_columns(_CHANNELS)


def _mix_sql(body, **extra):
    return over("media_spend offline_sales", body, **_feature_views(), **extra).replace("WITH ", "WITH RECURSIVE ", 1)


def _features(spark, folder):
    return mix.mix_features(*_media_and_sales(spark, folder), _CHANNELS)


@query(
    "mix_features",
    _mix_sql("SELECT week_start, round_even(total_revenue, 2) AS total_revenue, " + ", ".join(f'round_even("{c}", 6) + 0.0 AS "{c}"' for c in _COLUMNS) + " FROM features"),
)
def _(spark, folder):
    found = _features(spark, folder)
    return found.withColumns({c: round_to(c, 6) for c in _COLUMNS} | {"total_revenue": round_to("total_revenue", 2)})


_TRAIN_END = "(SELECT min(week_start) + CAST(floor((max(week_start) - min(week_start)) * 0.7::DOUBLE) AS INT) FROM features)"


@query(
    "standardize",
    _mix_sql(
        "SELECT week_start, " + ", ".join(
            f'round_even(("{c}" - (SELECT avg("{c}") FROM train)) / coalesce(nullif((SELECT stddev_pop("{c}") FROM train), 0), 1), 6) + 0.0 AS "{c}"' for c in _COLUMNS
        ) + " FROM features",
        train=f"SELECT * FROM features WHERE week_start <= {_TRAIN_END}",
    ),
)
def _(spark, folder):
    marked = buckets.chrono_split(pin(_features(spark, folder)), "week_start")
    scaled = mix.standardize(marked, _COLUMNS, F.col("split") == "train")
    return scaled.select("week_start", *[round_to(c, 6).alias(c) for c in _COLUMNS])


_PAIRS = [(a, b) for i, a in enumerate([*_COLUMNS, "total_revenue"]) for b in [*_COLUMNS, "total_revenue"][i:]]


@query(
    "feature_gram",
    _mix_sql(
        "SELECT a, b, n, round_even(mean_a, 4) + 0.0 AS mean_a, round_even(mean_b, 4) + 0.0 AS mean_b, round_even(c / (sqrt(va * vb) + 1), 8) + 0.0 AS correlation FROM pairs",
        pairs=" UNION ALL ".join(
            f"""SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, avg("{a}") AS mean_a, avg("{b}") AS mean_b, covar_pop("{a}", "{b}") AS c,
                var_pop("{a}") AS va, var_pop("{b}") AS vb FROM features""" for a, b in _PAIRS
        ),
    ),
)
def _(spark, folder):
    gram = pin(mix.feature_gram(_features(spark, folder), _COLUMNS, "total_revenue"))
    spread = gram.filter(F.col("a") == F.col("b"))
    va = spread.select("a", (F.col("cross") / F.col("n")).alias("va"))
    vb = spread.select("b", (F.col("cross") / F.col("n")).alias("vb"))
    together = gram.join(va, "a").join(vb, "b")
    scale = F.sqrt(F.col("va") * F.col("vb")) + 1
    return together.select(
        "a", "b", "n", round_to("mean_a", 4).alias("mean_a"), round_to("mean_b", 4).alias("mean_b"),
        round_to(F.col("cross") / F.col("n") / scale, 8).alias("correlation"),
    )


def _fitted(spark, folder):
    return mix.run_mix(*_media_and_sales(spark, folder), _CHANNELS)


@query("run_mix_metrics")
def _(spark, folder):
    return _fitted(spark, folder).metrics


@query("channel_contribution")
def _(spark, folder):
    return _fitted(spark, folder).channel_contributions


@query("decompose")
def _(spark, folder):
    return _fitted(spark, folder).decomposition


@query("mix_weights")
def _(spark, folder):
    marked = buckets.chrono_split(pin(_features(spark, folder)), "week_start")
    train = marked.filter(F.col("split") == "train")
    fit = mix.nonneg_ridge(train, _COLUMNS, "total_revenue")
    values = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(w).alias("weight")) for c, w in fit.weights.items()])
    return train.agg(F.count("*").alias("weeks")).select("weeks", F.inline(values))


@query("mix_weights_optimal", " UNION ALL ".join(f"SELECT '{c}' AS feature, true AS optimal" for c in _COLUMNS))
def _(spark, folder):
    """The fitted weights meet the conditions of the optimum, each from sums over the train weeks."""
    train = pin(buckets.chrono_split(pin(_features(spark, folder)), "week_start").filter(F.col("split") == "train"))
    fit = mix.nonneg_ridge(train, _COLUMNS, "total_revenue")
    return mix.is_optimal(mix.optimality(train, fit, "total_revenue"))


# Weights that both sides are given, so that the explanation can be compared.
_GIVEN = {c: 40.0 + 7.5 * i for i, c in enumerate(_COLUMNS)} | {"sin_week": -1500.5, "cos_week": 0.0, "trend": 12345.25}
_INTERCEPT = 250000.0


def _sum_sql(columns):
    return " + ".join(f'{_GIVEN[c]}::DOUBLE * "{c}"' for c in columns)


_TERMS = _COLUMNS[: len(_CHANNELS)]
_EXPLAINED = {
    "predicted": f"""SELECT *, {_INTERCEPT}::DOUBLE + {_sum_sql(_COLUMNS)} AS p, {_sum_sql(_TERMS)} AS media, {_sum_sql(_COLUMNS[len(_CHANNELS):])} AS calendar FROM features""",
}


@query(
    "decompose_given",
    _mix_sql(
        f"""SELECT week_start, {_INTERCEPT}::DOUBLE AS base_sales, round_even(calendar, 2) AS calendar_sales, round_even(media, 2) AS media_sales,
                   round_even(p, 2) AS total_predicted, round_even(total_revenue, 2) AS actual_sales FROM predicted""",
        **_EXPLAINED,
    ),
)
def _(spark, folder):
    found = mix.decompose(_features(spark, folder), mix.given_fit(_GIVEN, _INTERCEPT), _CHANNELS)
    return found.withColumns({c: round_to(c, 2) for c in found.columns[1:]})


@query(
    "channel_contribution_given",
    _mix_sql(
        """SELECT channel, round_even(gain / greatest(mean_predicted, 1) * 100, 2) AS contribution_pct, round_even(gain * weeks, 0) AS incremental_revenue,
                  round_even(round_even(coalesce(spend, 0), 2), 0) AS total_spend, round_even(gain * weeks / greatest(coalesce(spend, 0), 1), 3) AS incremental_roi
           FROM gains LEFT JOIN (SELECT channel, sum(spend) AS spend FROM media_spend GROUP BY 1) USING (channel)""",
        **_EXPLAINED,
        gains=" UNION ALL ".join(
            f"""SELECT '{c}' AS channel, avg({_GIVEN[t]}::DOUBLE * "{t}") AS gain, count(*) AS weeks, avg(p) AS mean_predicted FROM predicted"""
            for c, t in zip(_CHANNELS, _TERMS)
        ),
    ),
)
def _(spark, folder):
    media, sales = _media_and_sales(spark, folder)
    features = pin(mix.mix_features(media, sales, _CHANNELS))
    return mix.channel_contribution(features, mix.given_fit(_GIVEN, _INTERCEPT), media, _CHANNELS)


@query(
    "mix_metrics_given",
    _mix_sql(
        f"""SELECT mape, rmse, r2, CASE WHEN mape > {C.MIX_MAPE_LIMIT} THEN printf('{C.MIX_MAPE_TEXT}', round_even(mape, 1))
                   WHEN r2 < {C.R2_LIMIT} THEN printf('{C.MIX_R2_TEXT}', round_even(r2, 2)) END AS warning FROM (
            SELECT round_even(avg(abs((total_revenue - p) / total_revenue)) FILTER (WHERE total_revenue <> 0) * 100, 3) AS mape,
                   round_even(sqrt(avg((total_revenue - p) * (total_revenue - p))), 2) AS rmse,
                   round_even(1 - avg((total_revenue - p) * (total_revenue - p)) / var_pop(total_revenue), 4) AS r2
            FROM predicted WHERE week_start > {_TRAIN_END} AND week_start <= {_TRAIN_END.replace("0.7", "0.85")})""",
        **_EXPLAINED,
    ),
)
def _(spark, folder):
    marked = buckets.chrono_split(pin(_features(spark, folder)), "week_start")
    return mix.mix_metrics(marked.filter(F.col("split") == "validation"), mix.given_fit(_GIVEN, _INTERCEPT))


# A model that can be written in SQL: the mean of the four weeks before.
_NAIVE = """SELECT category, week_start, split, x, p FROM (
    SELECT *, avg(x) OVER (PARTITION BY category ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS p FROM marked) WHERE p IS NOT NULL"""
_MARKED = """SELECT category, week_start, x, CASE WHEN week_start <= lo + CAST(floor((hi - lo) * 0.7::DOUBLE) AS INT) THEN 'train'
    WHEN week_start <= lo + CAST(floor((hi - lo) * 0.85::DOUBLE) AS INT) THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT *, min(week_start) OVER (PARTITION BY category) AS lo, max(week_start) OVER (PARTITION BY category) AS hi FROM
          (SELECT category, week_start, sum(total_revenue) AS x FROM offline_sales GROUP BY 1, 2))"""
_QUALITY = """SELECT category, round_even(avg(abs((x - p) / x)) FILTER (WHERE x <> 0) * 100, 3) AS mape,
    round_even(sqrt(avg((x - p) * (x - p))), 2) AS rmse, round_even(1 - avg((x - p) * (x - p)) / var_pop(x), 4) AS r2 FROM naive WHERE split = 'test' GROUP BY category"""
_VIEWS = dict(marked=_MARKED, naive=_NAIVE, quality=_QUALITY)


def _naive(spark, folder):
    weeks = bridge.offline_sales(spark, folder, ("category",)).withColumnRenamed("total_revenue", "x")
    marked = buckets.chrono_split(weeks, "week_start", keys=["category"])
    return marked.withColumn("p", mean_of_previous("x", "week_start", 4, ["category"])).filter(F.col("p").isNotNull())


def _quality(spark, folder):
    return metrics.regression_metrics(_naive(spark, folder).filter(F.col("split") == "test"), "x", "p", ["category"])


@query("regression_metrics", over("offline_sales", "SELECT * FROM quality", **_VIEWS))
def _(spark, folder):
    return _quality(spark, folder)


def _warning_sql(limit, mape_text, r2_text):
    return f"""SELECT category, CASE WHEN mape > {limit} THEN printf('{mape_text}', round_even(mape, 1)) WHEN r2 < 0.5 THEN printf('{r2_text}', round_even(r2, 2)) END AS warning
               FROM (SELECT category, mape, r2 FROM quality UNION ALL SELECT category || ' x 10', mape * 10, r2 FROM quality)"""


def _graded(spark, folder, warning):
    found = pin(_quality(spark, folder))
    worse = found.select(F.concat("category", F.lit(" x 10")).alias("category"), (F.col("mape") * 10).alias("mape"), "rmse", "r2")
    return found.unionByName(worse).select("category", warning(F.col("mape"), F.col("r2")).alias("warning"))


@query("forecast_warning", over("offline_sales", _warning_sql(20, C.FORECAST_MAPE_TEXT, C.FORECAST_R2_TEXT), **_VIEWS))
def _(spark, folder):
    return _graded(spark, folder, scalars.forecast_warning)


@query("mix_warning", over("offline_sales", _warning_sql(25, C.MIX_MAPE_TEXT, C.MIX_R2_TEXT), **_VIEWS))
def _(spark, folder):
    return _graded(spark, folder, scalars.mix_warning)


@query(
    "model_metric_rows",
    over(
        "offline_sales",
        """SELECT TIMESTAMP '2024-01-01' AS recorded_at, 'naive' AS model_name, '1' AS model_version, metric_name, metric_value, threshold, passed
           FROM quality, LATERAL (VALUES ('mape', mape, 20.0::DOUBLE, mape <= 20), ('rmse', rmse, NULL, true), ('r2', r2, 0.5::DOUBLE, r2 >= 0.5)) v(metric_name, metric_value, threshold, passed)""",
        **_VIEWS,
    ),
)
def _(spark, folder):
    found = metrics.model_metric_rows(
        _quality(spark, folder), "naive", "1", C.FORECAST_MAPE_LIMIT, C.R2_LIMIT, dt.datetime(2024, 1, 1)
    )
    return found.drop("metric_id")


@query(
    "prediction_interval",
    over(
        "offline_sales",
        """SELECT category, week_start, round_even(p - 1.645::DOUBLE * s, 2) AS yhat_lower, round_even(p + 1.645::DOUBLE * s, 2) AS yhat_upper
           FROM naive JOIN (SELECT category, stddev_pop(x - p) AS s FROM naive WHERE split = 'train' GROUP BY 1) USING (category)""",
        **_VIEWS,
    ),
)
def _(spark, folder):
    found = forecast.prediction_interval(_naive(spark, folder), "x", "p", ["category"])
    return found.select("category", "week_start", *[round_to(c, 2).alias(c) for c in ("yhat_lower", "yhat_upper")])


def _daily(spark, folder):
    return bridge.online_sales(spark, folder, ("channel",))


def _seasonal(spark, folder):
    return forecast.run_forecast(_daily(spark, folder), "date", "revenue", "seasonal", 90, keys=["channel"])


def _trees(spark, folder):
    return forecast.run_forecast(
        _daily(spark, folder), "date", "revenue", "trees", 90, keys=["channel"]
    )


@query("forecast_seasonal")
def _(spark, folder):
    return _seasonal(spark, folder).forecast


@query("forecast_seasonal_metrics")
def _(spark, folder):
    return _seasonal(spark, folder).metrics


@query(
    "actual_vs_predicted",
    over(
        "offline_sales",
        """SELECT category, week_start AS date, round_even(x, 2) AS actual, round_even(p, 4) AS predicted FROM naive WHERE split = 'test'""",
        **_VIEWS,
    ),
)
def _(spark, folder):
    """The test slice of a model that SQL can state."""
    named = _naive(spark, folder).select("category", F.col("week_start").alias("date"), "split", F.col("x").alias("actual"), F.col("p").alias("yhat"))
    tested = forecast.actual_vs_predicted(named, ["category"])
    return tested.select("category", "date", round_to("actual", 2).alias("actual"), round_to("predicted", 4).alias("predicted"))


@query(
    "forecast_rows",
    over(
        "online_sales",
        """SELECT channel, CAST(hi + CAST(i AS INT) AS DATE) AS date, true AS ordered FROM (SELECT channel, max(date) AS hi FROM online_sales GROUP BY 1),
           unnest(range(1, 91)) t(i)""",
    ),
)
def _(spark, folder):
    """The rows of a fitted forecast: every series, every date of the horizon, and a band around each value."""
    ordered = (F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))
    return _seasonal(spark, folder).forecast.select("channel", "date", ordered.alias("ordered"))


@query(
    "forecast_seasonal_balanced",
    over(
        "online_sales",
        """SELECT channel, split, count(*) AS days, CASE WHEN split = 'train' THEN true END AS balanced FROM (
             SELECT channel, date, CASE WHEN date <= lo + CAST(floor((hi - lo) * 0.7::DOUBLE) AS INT) THEN 'train'
                    WHEN date <= lo + CAST(floor((hi - lo) * 0.85::DOUBLE) AS INT) THEN 'validation' ELSE 'test' END AS split
             FROM (SELECT DISTINCT channel, date, min(date) OVER (PARTITION BY channel) AS lo, max(date) OVER (PARTITION BY channel) AS hi FROM online_sales)
             UNION ALL SELECT channel, NULL, 'future' FROM (SELECT DISTINCT channel FROM online_sales), unnest(range(90)))
           GROUP BY 1, 2""",
    ),
)
def _(spark, folder):
    """What holds at the optimum of the seasonal fit: its intercept is free, so the train residuals add up to nothing."""
    marked = buckets.chrono_split(
        pin(_daily(spark, folder).select("channel", "date", F.col("revenue").cast("double").alias("actual"))), "date", keys=["channel"]
    ).drop("train_end", "validation_end")
    found = forecast.forecast_seasonal(marked, 90, ["channel"])
    level = F.abs(F.avg(F.col("actual") - F.col("yhat"))) <= 1e-6 * F.avg(F.abs("actual"))
    return found.groupBy("channel", "split").agg(
        F.count("*").alias("days"), F.when(F.first("split") == "train", level).alias("balanced")
    )


@query("forecast_weekly_single")
def _(spark, folder):
    """One weekly series, with weekly steps past its end."""
    return forecast.run_forecast(_sales(spark, folder), "week_start", "total_revenue", "prophet", 12, step_days=7).forecast


@query("forecast_trees")
def _(spark, folder):
    return _trees(spark, folder).forecast


@query(
    "forecast_trees_agree",
    over(
        "online_sales",
        """SELECT channel, date, true AS agrees FROM (SELECT DISTINCT channel, date FROM online_sales) UNION ALL
           SELECT channel, CAST(hi + CAST(i AS INT) AS DATE), true FROM (SELECT channel, max(date) AS hi FROM online_sales GROUP BY 1), unnest(range(1, 91)) t(i)""",
    ),
)
def _(spark, folder):
    """The trees' table predicts every date, known and to come, as the library's own model does."""
    marked = buckets.chrono_split(
        pin(_daily(spark, folder).select("channel", "date", F.col("revenue").cast("double").alias("actual"))), "date", keys=["channel"]
    ).drop("train_end", "validation_end")
    found = forecast.forecast_trees(marked, 90, ["channel"], rounds=40, library=True)
    near = F.abs(F.col("yhat") - F.col("library_yhat")) <= 1e-9 * F.abs("yhat")
    return found.select("channel", "date", near.alias("agrees"))
