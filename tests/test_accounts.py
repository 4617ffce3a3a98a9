import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import scalars
from tidemark.operators import accounts, funnel

D = dt.date
AS_OF = D(2024, 12, 31)
MONTHS = [D(2024, m, 1) for m in range(7, 13)]


def summary(spark, revenue_by_account):
    deals = spark.createDataFrame(
        [(a, "Grocery", "Web", "Mid", D(2024, 6, 15), 50_000.0) for a in revenue_by_account],
        "account_id string, industry string, lead_source string, deal_size_band string, close_date date, deal_value double",
    )
    rows = [(a, m, float(v)) for a, values in revenue_by_account.items() for m, v in zip(MONTHS[-len(values):], values)]
    monthly = spark.createDataFrame(rows, "account_id string, month date, monthly_revenue double")
    return {r["account_id"]: r.asDict() for r in accounts.account_summary(monthly, deals, AS_OF).collect()}


def test_churn_needs_three_silent_months(spark):
    found = summary(spark, {"gone": [5, 5, 5, 0, 0, 0], "alive": [5, 5, 5, 0, 0, 1], "new": [0, 0]})
    assert {a: r["is_churned"] for a, r in found.items()} == {"gone": 1, "alive": 0, "new": 0}


def test_account_figures(spark):
    values = [100, 200, 0, 150, 250, 350]
    row = summary(spark, {"a": values})["a"]
    active = [v for v in values if v]
    assert row["months_active"] == 5 and row["total_revenue"] == 1050.0
    assert row["avg_monthly_revenue"] == 210.0 and row["last_3m_avg"] == 250.0 and row["prev_3m_avg"] == 100.0
    assert row["revenue_trend_slope"] == pytest.approx(np.polyfit(range(6), values, 1)[0], abs=1e-4)
    assert row["mom_growth_3m"] == 1.0
    assert row["revenue_volatility"] == round(float(np.std(active, ddof=1)), 2)
    assert row["months_since_last_order"] == 1 and row["months_since_close"] == 7


def test_short_and_silent_accounts_have_zero_figures(spark):
    row = summary(spark, {"one": [80], "never": [0, 0, 0, 0, 0, 0]})
    assert row["one"]["revenue_trend_slope"] == 0.0 and row["one"]["revenue_volatility"] == 0.0
    assert row["one"]["mom_growth_3m"] == 0.0
    assert row["never"]["avg_monthly_revenue"] == 0.0 and row["never"]["months_since_last_order"] == 6


def test_first_deal_is_attached(spark):
    deals = spark.createDataFrame([("a", D(2024, 2, 1), 2.0), ("a", D(2024, 1, 1), 9.0), ("b", D(2024, 1, 1), 3.0)], "account_id string, close_date date, deal_value double")
    rows = spark.createDataFrame([("a",), ("b",)], "account_id string")
    assert {tuple(r) for r in accounts.attach_deal_value(rows, deals).collect()} == {("a", 9.0), ("b", 3.0)}


def test_tier_edges(spark):
    p = spark.createDataFrame([(0.2999,), (0.30,), (0.5999,), (0.60,)], "p double")
    assert [r[0] for r in p.select(scalars.risk_tier(F.col("p"))).collect()] == ["Low", "Medium", "Medium", "High"]
    s = spark.createDataFrame([(39.9,), (40.0,), (74.9,), (75.0,), (None,)], "s double")
    assert [r[0] for r in s.select(scalars.growth_tier(F.col("s"))).collect()] == [
        "Stable/Declining", "Moderate", "Moderate", "High Potential", "Stable/Declining"]


def test_first_matching_action(spark):
    rows = [
        (1, "High", "High Potential"), (0, "High", "Moderate"), (0, "Medium", "High Potential"), (0, "Medium", "Moderate"),
        (0, "Low", "High Potential"), (0, "Low", "Moderate"), (0, "Medium", "Stable/Declining"),
    ]
    df = spark.createDataFrame(rows, "is_churned int, risk_tier string, growth_tier string")
    assert [r["recommended_action"] for r in accounts.with_action(df).collect()] == [
        C.ACTION_CHURNED, C.ACTION_HIGH_RISK, C.ACTION_MEDIUM_HIGH, C.ACTION_MEDIUM_MODERATE, C.ACTION_LOW_HIGH, C.ACTION_OTHER, C.ACTION_OTHER]


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(0)
    n = 240
    trend = rng.normal(0, 100, n)
    data = pd.DataFrame(
        {
            "account_id": [f"A{i:03d}" for i in range(n)], "industry": rng.choice(["Grocery", "Drug"], n),
            "deal_size_band": rng.choice(["Small", "Mid", "Large"], n), "close_date": [D(2023, 1 + i % 12, 1) for i in range(n)],
            "deal_value": rng.uniform(1e4, 9e4, n), "months_active": 12, "avg_monthly_revenue": rng.uniform(1e2, 9e3, n),
            "last_3m_avg": 100.0, "revenue_trend_slope": trend, "mom_growth_3m": rng.uniform(-0.5, 1, n).round(4),
            "revenue_volatility": rng.uniform(0, 10, n), "is_churned": (trend < -60).astype(int), "months_since_close": 14,
        }
    )
    df = spark.createDataFrame(data)
    return accounts.score_accounts(df, D(2023, 11, 1), rounds=8).toPandas()


def test_scores_keep_every_account_and_separate_the_classes(scored):
    assert len(scored) == 240 and scored["churn_probability"].between(0, 1).all()
    assert (scored.loc[scored.is_churned == 1, "churn_probability"] == 1).all()
    active = scored[scored.is_churned == 0]
    assert active["churn_probability"].mean() < 0.4
    expected = scored.groupby("industry")["mom_growth_3m"].rank(pct=True) * 100
    assert np.allclose(scored["growth_score"], expected.round(1), atol=0.051)


def test_portfolio(spark, scored):
    row = accounts.portfolio_kpis(spark.createDataFrame(scored)).first()
    active = scored[scored.is_churned == 0]
    assert row["total_accounts"] == 240 and row["churned_accounts"] == int(scored.is_churned.sum())
    assert row["total_arr"] == pytest.approx(len(active) * 1200)
    assert row["pct_at_risk"] == pytest.approx(active["risk_tier"].isin(["High", "Medium"]).mean(), abs=1e-4)
    top = accounts.top_churn_risk(spark.createDataFrame(scored)).collect()
    assert [r["churn_probability"] for r in top] == sorted(active["churn_probability"], reverse=True)[:10]


def test_portfolio_without_active_accounts(spark, scored):
    row = accounts.portfolio_kpis(spark.createDataFrame(scored[scored.is_churned == 1])).first()
    assert row["pct_at_risk"] == 0.0 and row["total_arr"] == 0.0


def test_class_weight(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "is_churned int")
    assert accounts.class_weight(df).first()[0] == 3.0
    assert accounts.class_weight(df.filter("is_churned = 0")).first()[0] == 1.0


def test_funnel_of_nothing_won_has_zero_means(spark):
    crm = spark.createDataFrame(
        [("1", "Web", "Lead Only", None, None, 0, 0, 0, 0)] * 3,
        "contact_id string, lead_source string, outcome string, deal_value double, days_to_close int, reached_mql int, reached_sql int, reached_opp int, reached_close int",
    )
    row = funnel.funnel_summary(crm).first()
    assert (row["total_leads"], row["avg_deal_value"], row["avg_days_to_close"], row["overall_win_rate"]) == (3, 0.0, 0.0, 0.0)
    assert funnel.funnel_summary(crm.limit(0)).first()["total_leads"] == 0


def test_best_and_worst_with_ties(spark):
    df = spark.createDataFrame([("c", 5.0), ("a", 5.0), ("b", 1.0), ("d", 1.0)], "name string, score double")
    assert tuple(funnel.best_and_worst(df, "name", "score").first()) == ("a", "d")


def test_training_table_fills_the_cores_and_whole_waves(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector

    cores = spark.sparkContext.defaultParallelism
    vectors = spark.range(0, 4000, 1, 2).select(array_to_vector(F.array(F.col("id") * 1.0, F.lit(1.0))).alias("features"))
    assert accounts.packed(vectors).rdd.getNumPartitions() == 1
    monkeypatch.setattr(accounts, "_TRAIN_LEAST", 64)
    wide = accounts.packed(vectors)
    assert wide.rdd.getNumPartitions() == cores and wide.count() == 4000
    monkeypatch.setattr(accounts, "_TRAIN_BYTES", 64000 // cores - 1)
    assert accounts.packed(vectors).rdd.getNumPartitions() == 2 * cores


def test_slope_over_months_with_gaps_and_months_spread_after_the_join(spark):
    from tidemark.sources import bridge

    monthly = spark.createDataFrame(
        [("a", D(2023, m, 1), v) for m, v in ((1, 9.0), (2, 1.0), (7, 1.0), (9, 3.0), (10, 8.0))] + [("b", D(2023, 1, 1), 4.0), ("c", D(2023, 12, 1), 4.0)],
        "account_id string, month date, monthly_revenue double",
    )
    deals = spark.createDataFrame(
        [(k, "i", "l", "s", D(2022, 12, 5), 1.0) for k in "abc"],
        "account_id string, industry string, lead_source string, deal_size_band string, close_date date, deal_value double",
    )
    found = accounts.account_summary(monthly, deals, D(2023, 12, 31))
    assert {r["account_id"]: r["revenue_trend_slope"] for r in found.collect()} == {"a": 3.5, "b": 0.0, "c": 0.0}
    months = spark.createDataFrame([(1, D(2023, 2, 1), 5.4), (1, None, 7.0), (2, D(2023, 2, 1), None)], "o_custkey long, month date, revenue double")
    own = deals.limit(1).drop("account_id").crossJoin(spark.range(1, 4).select(F.col("id").cast("string").alias("account_id")))
    spread = bridge.account_revenue(own.select(deals.columns), months, D(2023, 3, 31))
    assert spread.columns == ["account_id", "month", "industry", "lead_source", "deal_size_band", "close_date", "months_since_close", "monthly_revenue"]
    assert sorted((r["account_id"], r["month"].month, r["monthly_revenue"]) for r in spread.collect()) == [
        (k, m, 5.0 if (k, m) == ("1", 2) else 0.0) for k in "123" for m in (1, 2, 3)]
    plan = spread._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join LeftOuter") and plan.count("Join LeftOuter") == 1


def test_scored_questions_build_the_summary_once(spark, scored, monkeypatch):
    from tidemark.plans import books

    own = spark.createDataFrame(scored).drop("churn_probability", "risk_tier", "growth_score", "growth_tier", "recommended_action")
    calls, fit = [], accounts.churn_model
    monkeypatch.setattr(books, "summary", lambda *a: calls.append(a) or own)
    monkeypatch.setattr(accounts, "churn_model", lambda rows, cutoff: fit(rows, D(2023, 11, 1), 2))
    monkeypatch.setattr(books, "_MODELS", {})
    assert books._really_scored(spark, "own").count() == 240
    assert len(calls) == 1
