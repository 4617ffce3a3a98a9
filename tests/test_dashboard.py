import datetime as dt
import json
import math

import pytest

from tidemark.dashboard import Dashboard
from tidemark.operators import accounts, trees
from tidemark.sources import bridge, sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def board(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("marts"))
    sinks.write_tables(
        folder, online_sales=bridge.online_sales(spark, SF), offline_sales=bridge.offline_sales(spark, SF),
        media_spend=bridge.media_spend(spark, SF), crm_funnel=bridge.crm_funnel(spark, SF),
    )
    return Dashboard(spark, folder)


def texts(warnings):
    return [r["warning"] for r in warnings.collect()]


def test_summary_adds_up(board):
    row = board.kpi_summary().data.first()
    assert row["total_revenue"] == pytest.approx(row["online_revenue"] + row["offline_revenue"])
    assert 0 <= row["online_share_pct"] <= 100 and row["blended_roas"] > 0
    assert texts(board.kpi_summary().warnings) == []


def test_narrow_range_warns(board):
    found = board.kpi_trend("1998-01-01", "1998-01-20", "daily")
    assert len(texts(found.warnings)) == 1 and "(trend)" in texts(found.warnings)[0]
    assert texts(board.funnel("2030-01-01").warnings) == ["No data matches the selected filters (CRM funnel)."]
    assert board.funnel("2030-01-01").data.first()["total_leads"] == 0


@pytest.mark.parametrize("granularity", ["daily", "weekly", "monthly"])
def test_trend(board, granularity):
    rows = board.kpi_trend(granularity=granularity).data.collect()
    assert all(r["total_revenue"] == pytest.approx(r["online_revenue"] + r["offline_revenue"]) for r in rows)


def test_funnel_is_monotone_and_sources_partition_it(board):
    row = board.funnel().data.first()
    assert row["closed_won"] <= row["opportunities"] <= row["sqls"] <= row["mqls"] <= row["total_leads"]
    sources = board.funnel_by_source().data.collect()
    assert sum(r["total_leads"] for r in sources) == row["total_leads"]
    one = board.funnel(lead_source=sources[0]["lead_source"]).data.first()
    assert one["total_leads"] == sources[0]["total_leads"]


def test_spend_efficiency(board):
    assert all(r["avg_roas"] > 0 for r in board.spend_efficiency().data.collect())


def test_contribution(board):
    found, warnings = board.channel_contribution(channels=bridge.CHANNELS)
    assert found.channel_contributions.count() == 6 and found.decomposition.count() > 300
    assert len(texts(warnings)) <= 1


def test_forecast(board):
    found, _ = board.forecast_sales("offline", horizon_days=30)
    assert found.forecast.count() == 5
    with pytest.raises(ValueError, match="points"):
        board.forecast_sales(start="2001-07-15")
    with pytest.raises(ValueError, match="horizon"):
        board.forecast_sales(horizon_days=3)
    several, _ = board.forecast_sales("online", by=["channel"], horizon_days=7)
    assert several.forecast.count() == 35


def test_context_document(board):
    found = json.loads(board.insight_context("1996-01-01").first()["context"])
    assert found["period"]["start"] == "1996-01-01" and set(found) == {"period", "revenue", "media", "crm"}
    ranked = list(found["revenue"]["by_channel"].values())
    assert ranked == sorted(ranked, reverse=True) and len(ranked) == 5
    assert sum(ranked) == pytest.approx(found["revenue"]["online_total"], abs=5)


def test_accounts_are_scored_from_a_saved_model(board, spark, tmp_path):
    """Every account is scored, nothing is fitted, and the lists follow the scores."""
    deals, monthly, as_of = bridge.account_books(spark, SF)
    sinks.write_tables(board.folder, account_summary=accounts.account_summary(monthly, deals, as_of))
    nodes = [(0, 0, 0, 12.0, 1, 2, 0.0, 1.0), (0, 1, -1, None, -1, -1, 0.4, 1.0), (0, 2, -1, None, -1, -1, -0.6, 1.0)]
    trees.TreeModel(trees.feature_table(spark, [("months_since_close", None)]), spark.createDataFrame(nodes, trees.NODES)).save(str(tmp_path))
    found = board.accounts(trees.load_model(spark, str(tmp_path)), n=3)
    rows = found.scored.collect()
    assert len(rows) == deals.count()
    for r in rows:
        want = 1.0 if r["is_churned"] else 1 / (1 + math.exp(-2 * (0.4 if r["months_since_close"] <= 12 else -0.6)))
        assert r["churn_probability"] == pytest.approx(want, abs=1e-4)
    assert found.portfolio.first()["total_accounts"] == len(rows)
    top = [r["churn_probability"] for r in found.churn_risk.collect()]
    assert top == sorted((r["churn_probability"] for r in rows if not r["is_churned"]), reverse=True)[:3]
    assert found.growth.count() == 3


def test_watch(board):
    found = board.watch(dt.datetime(2030, 1, 1))
    rows = found.alerts.filter("type = 'pipeline_monitor'").collect()
    assert {(r["table"], r["check"]) for r in rows} == {
        (t, c) for t in ("online_sales", "offline_sales", "media_spend", "crm_funnel") for c in ("freshness", "row_count", "schema_drift")
    }
    assert all(r["severity"] == "critical" for r in rows if r["check"] == "freshness")
    assert found.counts.first()["critical"] >= 4 and 0 < found.top.count() <= 5
