"""Account features, churn and growth scores, actions and portfolio figures."""

import datetime as dt

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from tidemark import constants as C
from tidemark.functions import scalars
from tidemark.functions.dates import months_between_30
from tidemark.functions.scalars import round_to
from tidemark.operators import trees
from tidemark.operators.filters import active_accounts
from tidemark.operators.ranks import pct_rank_avg
from tidemark.session import pin

# --- Fixed values: model features. The months since the last order give the label away and are left out.
CHURN_NUMBERS = (
    "months_since_close", "avg_monthly_revenue", "revenue_trend_slope", "mom_growth_3m",
    "revenue_volatility", "deal_value", "months_active",
)
CHURN_CATEGORIES = ("industry", "deal_size_band")
# Bytes of features that a partition of the training table holds at least and at most; every boosting round reads it.
_TRAIN_LEAST, _TRAIN_BYTES = 2 << 20, 32 << 20


def _months_back(as_of: dt.date, months: int) -> dt.date:
    """Start of the month that many months before the month of `as_of`."""
    count = as_of.year * 12 + as_of.month - 1 - months
    return dt.date(count // 12, count % 12 + 1, 1)


def first_deals(deals: DataFrame, key: str = "account_id") -> DataFrame:
    """One deal per account: the earliest close. Partial aggregation keeps one row per key and task."""
    rest = [c for c in deals.columns if c not in (key, "close_date")]
    earliest = deals.groupBy(key).agg(F.min(F.struct("close_date", *rest)).alias("_deal"))
    return earliest.select(key, "_deal.*")


def attach_deal_value(accounts: DataFrame, deals: DataFrame, key: str = "account_id") -> DataFrame:
    """Add the deal value of the first matching deal."""
    return accounts.join(first_deals(deals.select(key, "close_date", "deal_value"), key).drop("close_date"), key)


def account_summary(monthly: DataFrame, deals: DataFrame, as_of: dt.date) -> DataFrame:
    """One feature row per account from its monthly revenue up to `as_of`.

    `monthly` has one row per account and month. The slope is taken over the last half year's months by their order. It does
    not depend on where the numbering starts, so that the window holds these months only, and no other step sorts rows. The
    window, the aggregates and the joins use one partitioning by account. Reads `monthly` twice.
    """
    month, revenue = F.col("month"), F.col("monthly_revenue")
    last3, prev3 = F.lit(_months_back(as_of, 2)), F.lit(_months_back(as_of, 5))
    recent, before, half_year = month >= last3, (month >= prev3) & (month < last3), month >= prev3
    active = revenue > 0
    figures = (
        monthly.groupBy("account_id")
        .agg(
            F.count_if(active).alias("months_active"),
            F.sum(revenue).alias("total"),
            F.coalesce(F.avg(F.when(active, revenue)), F.lit(0.0)).alias("mean"),
            F.coalesce(F.avg(F.when(recent, revenue)), F.lit(0.0)).alias("last3"),
            F.coalesce(F.avg(F.when(before, revenue)), F.lit(0.0)).alias("prev3"),
            F.coalesce(F.max(F.when(active, month)), F.min(month)).alias("last_order"),
            F.coalesce(F.stddev_samp(F.when(active, revenue)), F.lit(0.0)).alias("spread"),
            ((F.count_if(recent) == 3) & (F.count_if(recent & (revenue == 0)) == 3)).cast("long").alias("is_churned"),
        )
    )
    place = F.row_number().over(Window.partitionBy("account_id").orderBy("month"))
    placed = monthly.filter(half_year).select("account_id", "monthly_revenue", place.alias("_place"))
    slopes = placed.groupBy("account_id").agg(F.regr_slope("monthly_revenue", "_place").alias("slope"))
    growth = F.when(F.col("prev3") > 0, scalars.clip((F.col("last3") - F.col("prev3")) / F.col("prev3"), -0.5, 1.0)).otherwise(0.0)
    end = F.lit(as_of)
    return figures.join(slopes, "account_id", "left").join(first_deals(deals), "account_id").select(
        "account_id", "industry", "lead_source", "deal_size_band", "close_date", "deal_value", "months_active",
        round_to("total", 2).alias("total_revenue"),
        round_to("mean", 2).alias("avg_monthly_revenue"),
        round_to("last3", 2).alias("last_3m_avg"),
        round_to("prev3", 2).alias("prev_3m_avg"),
        round_to(F.coalesce("slope", F.lit(0.0)), 4).alias("revenue_trend_slope"),
        round_to(growth, 4).alias("mom_growth_3m"),
        months_between_30(end, F.col("last_order")).alias("months_since_last_order"),
        round_to("spread", 2).alias("revenue_volatility"),
        "is_churned",
        months_between_30(end, F.col("close_date")).alias("months_since_close"),
    )


def one_hot(columns) -> list:
    """Stages that turn text columns into one indicator per fitted value; other values and nulls get zeros.

    The indexer puts what it has not seen behind the fitted labels, and the encoder drops that place.
    """
    indexer = StringIndexer(inputCols=list(columns), outputCols=[f"{c}_index" for c in columns], handleInvalid="keep")
    encoder = OneHotEncoder(
        inputCols=[f"{c}_index" for c in columns], outputCols=[f"{c}_flags" for c in columns],
        dropLast=True, handleInvalid="error",
    )
    return [indexer, encoder]


def feature_stages(numbers=CHURN_NUMBERS, categories=CHURN_CATEGORIES) -> Pipeline:
    assembler = VectorAssembler(inputCols=[*numbers, *[f"{c}_flags" for c in categories]], outputCol="features")
    return Pipeline(stages=[*one_hot(categories), assembler])


def packed(vectors: DataFrame) -> DataFrame:
    """A training table in few partitions, as each of many short rounds reads it: one while it is small, then one for
    each core, and whole waves of the cores beyond _TRAIN_BYTES a partition.
    """
    vectors = pin(vectors)
    size = vectors.agg(F.coalesce(F.sum(F.size(vector_to_array("features"))), F.lit(0))).first()[0] * 8
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    waves = max(1, -(-size // (_TRAIN_BYTES * cores)))
    wanted = min(max(1, -(-size // _TRAIN_LEAST)), waves * cores)
    return vectors.coalesce(wanted) if vectors.rdd.getNumPartitions() >= wanted else vectors.repartition(wanted)


def class_weight(accounts: DataFrame, label: str = "is_churned") -> DataFrame:
    """Weight of a positive row: negatives over positives, 1 without positives."""
    positives, negatives = F.count_if(F.col(label) == 1), F.count_if(F.col(label) != 1)
    return accounts.agg(F.coalesce(F.try_divide(negatives, positives), F.lit(1.0)).alias("positive_weight"))


CHURN_DEPTH = 3


def _prepared(accounts: DataFrame) -> DataFrame:
    return accounts.fillna(0.0, list(CHURN_NUMBERS))


def fit_churn(accounts: DataFrame, cutoff: dt.date = C.CHURN_TRAIN_BEFORE, rounds: int = 400):
    """Boosted trees of the accounts closed before the cutoff: feature stages and fitted model.

    The feature table is pinned: each round reads it. A checkpoint every fifty rounds keeps the lineage short enough.
    """
    train = pin(_prepared(accounts).filter(F.col("close_date") < F.lit(cutoff)))
    weight = class_weight(train).first()["positive_weight"]
    stages = feature_stages().fit(train)
    weighted = stages.transform(train).select(
        "features", F.col("is_churned").cast("double").alias("label"),
        F.when(F.col("is_churned") == 1, F.lit(float(weight))).otherwise(F.lit(1.0)).alias("weight"),
    )
    fitted = GBTClassifier(
        cacheNodeIds=True, checkpointInterval=50, maxIter=rounds, maxDepth=CHURN_DEPTH, stepSize=0.04, subsamplingRate=0.8,
        featureSubsetStrategy="0.8", minInstancesPerNode=3, seed=42, weightCol="weight",
    ).fit(packed(weighted))
    return stages, fitted


def churn_model(accounts: DataFrame, cutoff: dt.date = C.CHURN_TRAIN_BEFORE, rounds: int = 400) -> trees.TreeModel:
    """The fitted churn model as tables, to be saved and scored later without a fit."""
    spark = accounts.sparkSession
    stages, fitted = fit_churn(accounts, cutoff, rounds)
    labels = zip(CHURN_CATEGORIES, stages.stages[0].labelsArray)
    columns = [(c, None) for c in CHURN_NUMBERS] + [(c, x) for c, found in labels for x in found]
    return trees.TreeModel(trees.feature_table(spark, columns), trees.fitted_nodes(spark, fitted))


def score_churn(accounts: DataFrame, model: trees.TreeModel) -> DataFrame:
    """Add churn_probability and risk_tier from a model in tables; a churned account has probability 1."""
    scored = trees.score(accounts, model, CHURN_DEPTH, "_margin")
    chance = round_to(trees.probability(F.col("_margin")), 4)
    rated = scored.withColumn("churn_probability", F.when(F.col("is_churned") == 1, 1.0).otherwise(chance))
    return rated.drop("_margin").withColumn("risk_tier", scalars.risk_tier(F.col("churn_probability")))


def churn_score(accounts: DataFrame, cutoff: dt.date = C.CHURN_TRAIN_BEFORE, rounds: int = 400) -> DataFrame:
    """Fit on the accounts closed before the cutoff and score all of them."""
    accounts = pin(accounts)
    return score_churn(accounts, churn_model(accounts, cutoff, rounds))


def growth_score(accounts: DataFrame) -> DataFrame:
    """Add growth_score (percentile of mom_growth_3m in the industry, 0–100) and growth_tier.

    Reads `accounts` twice: pin a derived table first.
    """
    ranked = pct_rank_avg(accounts, "mom_growth_3m", "industry")
    scored = ranked.withColumn("growth_score", round_to(F.col("pct_rank") * 100, 1)).drop("pct_rank")
    return scored.withColumn("growth_tier", scalars.growth_tier(F.col("growth_score"))).select(
        *accounts.columns, "growth_score", "growth_tier"
    )


def with_action(accounts: DataFrame) -> DataFrame:
    action = scalars.recommended_action(F.col("is_churned"), F.col("risk_tier"), F.col("growth_tier"))
    return accounts.withColumn("recommended_action", action)


def score_accounts(
    accounts: DataFrame, cutoff: dt.date = C.CHURN_TRAIN_BEFORE, rounds: int = 400, model: trees.TreeModel | None = None
) -> DataFrame:
    """Churn, growth and action for every account of a summary table; with a `model` nothing is fitted."""
    scored = churn_score(accounts, cutoff, rounds) if model is None else score_churn(accounts, model)
    return with_action(growth_score(pin(scored)))


def portfolio_kpis(scored: DataFrame) -> DataFrame:
    """One row of portfolio figures."""
    active, risk = F.col("is_churned") == 0, F.col("risk_tier")
    sums = scored.agg(
        F.count("*").alias("total_accounts"),
        F.count_if(active).alias("active_accounts"),
        F.count_if(F.col("is_churned") == 1).alias("churned_accounts"),
        F.count_if(risk == "High").alias("high_risk_accounts"),
        F.count_if(F.col("growth_tier") == "High Potential").alias("high_growth_accounts"),
        round_to(F.coalesce(F.sum(F.when(active, F.col("last_3m_avg") * 12)), F.lit(0.0)), 2).alias("total_arr"),
        round_to(F.avg("churn_probability"), 4).alias("avg_churn_prob"),
        F.count_if(active & risk.isin("High", "Medium")).alias("_exposed"),
    )
    share = F.coalesce(F.try_divide("_exposed", "active_accounts"), F.lit(0.0))
    return sums.withColumn("pct_at_risk", round_to(share, 4)).drop("_exposed")


def top_churn_risk(scored: DataFrame, n: int = 10) -> DataFrame:
    rows = active_accounts(scored).orderBy(F.desc("churn_probability"), "account_id").limit(n)
    return rows.select("account_id", "industry", "avg_monthly_revenue", "churn_probability", "recommended_action")


def top_growth(scored: DataFrame, n: int = 10) -> DataFrame:
    rows = active_accounts(scored).orderBy(F.desc("growth_score"), "account_id").limit(n)
    return rows.select("account_id", "industry", "mom_growth_3m", "growth_score", "recommended_action")
