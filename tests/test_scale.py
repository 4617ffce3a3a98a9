"""Plans and results when nothing is small enough to broadcast and one key holds most rows."""

import pytest
from pyspark.sql import functions as F

import tidemark.session as session
from tidemark.operators import series as S
from tidemark.plans import ORACLES, QUERIES
from oracle_compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_BYTES", -1)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize(
    "name", ["scale_to_total", "share_of_total", "pct_rank_avg", "account_summary", "kpi_summary", "split_summary", "run_all_checks"]
)
def test_same_results_without_broadcasts(spark, no_broadcast, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == []


def test_large_lookup_is_not_broadcast(spark, no_broadcast):
    df = spark.range(100).select((F.col("id") % 5).alias("week"), F.lit(1.0).alias("x"))
    plan = S.share_of_total(df, "x", "week")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_small_lookup_leaves_the_big_side_unshuffled(spark):
    df = spark.range(100).select((F.col("id") % 5).alias("week"), F.lit(1.0).alias("x"))
    plan = S.share_of_total(df, "x", "week")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_a_hot_period_is_aggregated_before_it_moves(spark):
    df = spark.range(50_000).select(F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id")).alias("week"), F.lit(2.0).alias("x"))
    found = S.share_of_total(df, "x", "week", 8).filter("week = 0").agg(F.sum("share"), F.count("*")).first()
    assert found[1] == 35_000 and found[0] == pytest.approx(1.0, abs=1e-3)


def test_a_wide_lookup_is_measured_by_its_bytes(spark):
    wide = session.pin(spark.range(200).select("id", F.repeat(F.lit("x"), 100_000).alias("note")))
    assert session.pinned_bytes(wide) > 20_000_000
    assert session.broadcast_if_small(wide) is wide
    small = session.pin(spark.range(5))
    assert session.broadcast_if_small(small) is not small


def test_pinned_tables_are_removed(spark):
    assert spark.conf.get("spark.cleaner.referenceTracking.cleanCheckpoints") == "true"
