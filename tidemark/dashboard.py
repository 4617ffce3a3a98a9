"""The dashboard questions, asked of a folder of business tables.

Each method loads, filters and computes and gives the answer with its warnings: a table of texts that is
empty when there is nothing to warn about. Questions that fit a model, or that read a table more than
once, run jobs when they are asked; the others when the answer is read.
"""

import datetime as dt

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import constants as C
from tidemark.operators import accounts, alerts, anomaly, checks, context, filters, forecast, funnel, kpis, mix
from tidemark.operators.buckets import period_totals
from tidemark.operators.filters import FilterParams, apply_filters, reliability_warning
from tidemark.operators.trees import TreeModel
from tidemark.session import pin
from tidemark.sources import tables


@dataclass(frozen=True)
class Answer:
    data: DataFrame
    warnings: DataFrame


def _texts(*frames: DataFrame) -> DataFrame:
    texts = reduce(DataFrame.unionByName, [f.select("warning") for f in frames])
    return texts.filter(F.col("warning").isNotNull())


@dataclass(frozen=True)
class AccountsAnswer:
    """Scored accounts, the portfolio's figures, and the accounts to look at first."""

    scored: DataFrame
    portfolio: DataFrame
    churn_risk: DataFrame
    growth: DataFrame


@dataclass(frozen=True)
class WatchAnswer:
    """All checks and anomalies in one table, their counts, and the lines of a message."""

    alerts: DataFrame
    counts: DataFrame
    top: DataFrame


# Date column and checked columns of each table; the money columns are searched for anomalies.
_WATCHED = {
    "online_sales": ("date", ("date", "channel", "category", "revenue", "orders"), ("revenue", "orders")),
    "offline_sales": ("week_start", ("week_start", "region", "total_revenue"), ("total_revenue",)),
    "media_spend": ("week_start", ("week_start", "channel", "spend"), ("spend",)),
    "crm_funnel": ("lead_date", ("contact_id", "lead_date", "outcome"), ()),
}


@dataclass(frozen=True)
class Dashboard:
    spark: SparkSession
    folder: str

    def _online(self, params: FilterParams) -> DataFrame:
        return apply_filters(tables.load_online_sales(self.spark, self.folder), "date", params)

    def _offline(self, params: FilterParams) -> DataFrame:
        return apply_filters(tables.load_offline_sales(self.spark, self.folder), "week_start", params)

    def _media(self, params: FilterParams) -> DataFrame:
        return apply_filters(tables.load_media_spend(self.spark, self.folder), "week_start", params)

    def _crm(self, params: FilterParams) -> DataFrame:
        return apply_filters(tables.load_crm_funnel(self.spark, self.folder), "lead_date", params)

    def kpi_summary(self, start=None, end=None) -> Answer:
        period = FilterParams(start, end)
        found = kpis.kpi_summary(self._online(period), self._offline(period), self._media(period), self._crm(period))
        return Answer(found.drop("warning"), _texts(found))

    def kpi_trend(self, start=None, end=None, granularity: str = "weekly") -> Answer:
        period = FilterParams(start, end)
        trend = pin(kpis.kpi_trend(self._online(period), self._offline(period), granularity))
        return Answer(trend, _texts(reliability_warning(trend, "trend")))

    def funnel(self, start=None, end=None, lead_source=None, industry=None) -> Answer:
        crm = self._crm(FilterParams(start, end, lead_source=lead_source, industry=industry))
        return Answer(funnel.funnel_summary(crm), _texts(reliability_warning(crm, "CRM funnel")))

    def funnel_by_source(self, start=None, end=None) -> Answer:
        crm = self._crm(FilterParams(start, end))
        return Answer(funnel.funnel_by_source(crm), _texts(reliability_warning(crm, "CRM by source")))

    def spend_efficiency(self, start=None, end=None) -> Answer:
        media = self._media(FilterParams(start, end))
        return Answer(kpis.spend_efficiency(media), _texts(reliability_warning(media, "media spend")))

    def channel_contribution(self, start=None, end=None, channels=C.MEDIA_CHANNELS) -> tuple[mix.MixResult, DataFrame]:
        """The fitted mix model and its warnings."""
        period = FilterParams(start, end)
        media = self._media(period)
        found = mix.run_mix(media, self._offline(period), channels)
        return found, _texts(reliability_warning(media, "media spend"), found.metrics)

    def forecast_sales(
        self, source: str = "online", channel=None, region=None, start=None, end=None, model: str = "prophet",
        horizon_days: int = 90, by=(), **options,
    ) -> tuple[forecast.ForecastResult, DataFrame]:
        """The forecast of the filtered sales, or of each series in `by`, and its warnings.

        A single series must have 60 points; of several, those with fewer are left out. Offline
        sales are weekly, so their horizon takes weekly steps.
        """
        if not 7 <= horizon_days <= 365:
            raise ValueError("the horizon must be 7 to 365 days")
        params = FilterParams(start, end, channel=channel, region=region)
        if source == "online":
            rows, day, target, step = self._online(params), "date", "revenue", 1
        else:
            rows, day, target, step = self._offline(params), "week_start", "total_revenue", 7
        series = pin(period_totals(rows, day, target, by))
        series = filters.long_enough(series, by) if by else filters.require_points(series)
        found = forecast.run_forecast(
            series, day, target, model, -(-horizon_days // step), keys=by, step_days=step, **options
        )
        return found, _texts(reliability_warning(series, f"{source} sales"), found.metrics)

    def insight_context(self, start=None, end=None) -> DataFrame:
        """The figures for a written report as one document."""
        period = FilterParams(start, end)
        metrics = context.context_metrics(
            self._online(period), self._offline(period), self._media(period), self._crm(period), start, end
        )
        return context.build_context(metrics)

    def accounts(self, model: TreeModel | None = None, path: str | None = None, cutoff: dt.date = C.CHURN_TRAIN_BEFORE, n: int = 10) -> AccountsAnswer:
        """Churn, growth and actions of the accounts; with a saved `model` nothing is fitted."""
        summary = tables.read_account_summary(self.spark, self.folder, path)
        scored = pin(accounts.score_accounts(summary, cutoff, model=model))
        return AccountsAnswer(scored, accounts.portfolio_kpis(scored), accounts.top_churn_risk(scored, n), accounts.top_growth(scored, n))

    def watch(self, now: dt.datetime, names=tuple(_WATCHED)) -> WatchAnswer:
        """Freshness, volume and schema of the tables, and anomalies of their daily or weekly sums."""
        loads = {
            "online_sales": tables.load_online_sales, "offline_sales": tables.load_offline_sales,
            "media_spend": tables.load_media_spend, "crm_funnel": tables.load_crm_funnel,
        }
        found = {name: loads[name](self.spark, self.folder) for name in names}
        checked = checks.run_all_checks({n: (df, _WATCHED[n][0], list(_WATCHED[n][1])) for n, df in found.items()}, now)
        odd = [
            anomaly.detect_anomalies(period_totals(df, _WATCHED[n][0], _WATCHED[n][2]), _WATCHED[n][0], list(_WATCHED[n][2]), n)
            for n, df in found.items() if _WATCHED[n][2]
        ]
        if not odd:
            raise ValueError("name at least one table with a money column")
        both = pin(alerts.combine_alerts(checked, reduce(DataFrame.unionByName, odd), now))
        return WatchAnswer(both, alerts.alert_counts(both), alerts.top_alerts(both))
