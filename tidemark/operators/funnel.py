"""CRM funnel figures."""

from pyspark.sql import DataFrame, functions as F

from tidemark import constants as C
from tidemark.functions.scalars import percent_of, round_to, sum_or_zero

_FLAGS = ("reached_mql", "reached_sql", "reached_opp", "reached_close")


def _stage_sums(crm: DataFrame) -> DataFrame:
    won = F.col("outcome") == C.CLOSED_WON
    return crm.agg(
        F.count("*").alias("total_leads"),
        *[sum_or_zero(f).cast("long").alias(n) for f, n in zip(_FLAGS, ("mqls", "sqls", "opportunities", "closed_won"))],
        sum_or_zero(F.when(won, F.col("deal_value"))).alias("pipeline"),
        F.coalesce(F.avg(F.when(won, F.col("deal_value"))), F.lit(0.0)).alias("deal"),
        F.coalesce(F.avg("days_to_close"), F.lit(0.0)).alias("days"),
    )


def funnel_summary(crm: DataFrame) -> DataFrame:
    """Stage counts, conversion rates and won deals as one row."""
    leads, mqls, sqls, opps, won = (F.col(c) for c in ("total_leads", "mqls", "sqls", "opportunities", "closed_won"))
    return _stage_sums(crm).select(
        "total_leads", "mqls", "sqls", "opportunities", "closed_won",
        percent_of(mqls, leads).alias("lead_to_mql_rate"),
        percent_of(sqls, mqls).alias("mql_to_sql_rate"),
        percent_of(opps, sqls).alias("sql_to_opp_rate"),
        percent_of(won, opps).alias("opp_win_rate"),
        percent_of(won, leads).alias("overall_win_rate"),
        round_to("pipeline", 2).alias("pipeline_closed_won"),
        round_to("deal", 2).alias("avg_deal_value"),
        round_to("days", 1).alias("avg_days_to_close"),
    )


def funnel_by_source(crm: DataFrame) -> DataFrame:
    """Stage counts by lead source. The pipeline takes the deals of all outcomes."""
    by_source = crm.filter(F.col("lead_source").isNotNull()).groupBy("lead_source").agg(
        F.count("contact_id").alias("total_leads"),
        *[sum_or_zero(f).cast("long").alias(n) for f, n in zip(_FLAGS, ("mqls", "sqls", "opps", "won"))],
        round_to(sum_or_zero("deal_value"), 2).alias("pipeline_value"),
    )
    return by_source.withColumn("win_rate_pct", percent_of(F.col("won"), F.col("total_leads")))


def win_rate(crm: DataFrame) -> DataFrame:
    won = F.count_if(F.col("outcome") == C.CLOSED_WON)
    return crm.agg(percent_of(won, F.count("*")).alias("win_rate_pct"))


def source_performance(crm: DataFrame) -> DataFrame:
    """Leads, won deals and win rate by source, best first."""
    by_source = crm.filter(F.col("lead_source").isNotNull()).groupBy("lead_source").agg(
        F.count("contact_id").alias("leads"), sum_or_zero("reached_close").cast("long").alias("won")
    )
    rated = by_source.withColumn("win_rate", percent_of(F.col("won"), F.col("leads")))
    return rated.orderBy(F.desc("win_rate"), "lead_source")


def best_and_worst(rated: DataFrame, name: str, score: str) -> DataFrame:
    """Names with the highest and the lowest score. Of equal scores the first name is the best
    and the last name the worst, as in a descending list with names in order."""
    return rated.agg(
        F.min_by(name, F.struct(-F.col(score), F.col(name))).alias("best"),
        F.max_by(name, F.struct(-F.col(score), F.col(name))).alias("worst"),
    )


def outcome_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value of a tier or outcome column."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows"))


def funnel_stage_share(crm: DataFrame) -> DataFrame:
    """One row per stage: its count and its share of all leads in %."""
    wide = _stage_sums(crm)
    counts = ("total_leads", "mqls", "sqls", "opportunities", "closed_won")
    pairs = F.array(
        *[
            F.struct(F.lit(place).alias("position"), F.lit(stage).alias("stage"), F.col(c).alias("contacts"),
                     percent_of(F.col(c), F.col("total_leads"), 1).alias("share_pct"))
            for place, (stage, c) in enumerate(zip(C.FUNNEL_STAGES, counts), 1)
        ]
    )
    return wide.select(F.inline(pairs))
