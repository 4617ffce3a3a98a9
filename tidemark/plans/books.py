"""Queries on account features, tiers, actions and the churn model."""

import datetime as dt

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import scalars
from tidemark.functions.scalars import round_to
from tidemark.operators import accounts, filters, funnel, ranks, trees
from tidemark.plans.registry import query
from tidemark.plans.views import over
from tidemark.session import pin, scratch_folder
from tidemark.sources import bridge

_CUTOFF = dt.date(1995, 10, 1)


def summary(spark, folder):
    deals, monthly, as_of = bridge.account_books(spark, folder)
    return accounts.account_summary(monthly, deals, as_of)


def _with_risk(spark, folder):
    """A rule stands in for the model's probability, so that everything after it can be checked."""
    share = round_to(F.least(F.col("months_since_last_order") / 12, F.lit(1.0)), 4)
    chance = F.when(F.col("is_churned") == 1, 1.0).otherwise(share)
    rated = summary(spark, folder).withColumn("churn_probability", chance)
    return rated.withColumn("risk_tier", scalars.risk_tier(F.col("churn_probability")))


def _scored(spark, folder):
    return accounts.with_action(accounts.growth_score(pin(_with_risk(spark, folder))))


@query("account_revenue", over("account_revenue", "SELECT account_id, month, months_since_close, monthly_revenue FROM account_revenue"))
def _(spark, folder):
    return bridge.account_books(spark, folder)[1].select("account_id", "month", "months_since_close", "monthly_revenue")


@query("account_summary", over("account_summary", "SELECT * FROM account_summary"))
def _(spark, folder):
    return summary(spark, folder)


@query("trend_slope", over("account_summary", "SELECT account_id, revenue_trend_slope, mom_growth_3m FROM account_summary"))
def _(spark, folder):
    return summary(spark, folder).select("account_id", "revenue_trend_slope", "mom_growth_3m")


@query("is_churned", over("account_summary", "SELECT is_churned, count(*) AS accounts FROM account_summary GROUP BY 1"))
def _(spark, folder):
    return summary(spark, folder).groupBy("is_churned").agg(F.count("*").alias("accounts"))


@query("active_accounts", over("account_summary", "SELECT account_id, last_3m_avg FROM account_summary WHERE is_churned = 0"))
def _(spark, folder):
    return filters.active_accounts(summary(spark, folder)).select("account_id", "last_3m_avg")


@query("at_risk", over("scored_accounts", "SELECT account_id, risk_tier, churn_probability FROM scored_accounts WHERE risk_tier IN ('High', 'Medium')"))
def _(spark, folder):
    return filters.at_risk(_with_risk(spark, folder)).select("account_id", "risk_tier", "churn_probability")


@query("pct_rank_avg", over("growth_ranks", "SELECT account_id, round_even(pct_rank, 8) AS pct_rank FROM growth_ranks"))
def _(spark, folder):
    ranked = ranks.pct_rank_avg(pin(summary(spark, folder)), "mom_growth_3m", "industry")
    return ranked.select("account_id", round_to("pct_rank", 8).alias("pct_rank"))


@query("growth_score", over("scored_accounts", "SELECT account_id, growth_score, growth_tier FROM scored_accounts"))
def _(spark, folder):
    scored = accounts.growth_score(pin(summary(spark, folder)))
    return scored.select("account_id", "growth_score", "growth_tier")


@query("risk_tier", over("scored_accounts", "SELECT risk_tier, count(*) AS rows FROM scored_accounts GROUP BY 1"))
def _(spark, folder):
    return funnel.outcome_counts(_with_risk(spark, folder), "risk_tier")


@query("growth_tier", over("scored_accounts", "SELECT growth_tier, count(*) AS rows FROM scored_accounts GROUP BY 1"))
def _(spark, folder):
    return funnel.outcome_counts(_scored(spark, folder), "growth_tier")


@query("recommended_action", over("scored_accounts", "SELECT account_id, risk_tier, growth_tier, recommended_action FROM scored_accounts"))
def _(spark, folder):
    return _scored(spark, folder).select("account_id", "risk_tier", "growth_tier", "recommended_action")


@query(
    "portfolio_kpis",
    over(
        "scored_accounts",
        """SELECT count(*) AS total_accounts, count(*) FILTER (WHERE is_churned = 0) AS active_accounts,
                  count(*) FILTER (WHERE is_churned = 1) AS churned_accounts, count(*) FILTER (WHERE risk_tier = 'High') AS high_risk_accounts,
                  count(*) FILTER (WHERE growth_tier = 'High Potential') AS high_growth_accounts,
                  round_even(coalesce(sum(last_3m_avg * 12) FILTER (WHERE is_churned = 0), 0), 2) AS total_arr,
                  round_even(avg(churn_probability), 4) AS avg_churn_prob,
                  round_even(coalesce(count(*) FILTER (WHERE is_churned = 0 AND risk_tier IN ('High', 'Medium'))
                        / nullif(count(*) FILTER (WHERE is_churned = 0), 0), 0), 4) AS pct_at_risk FROM scored_accounts""",
    ),
)
def _(spark, folder):
    return accounts.portfolio_kpis(_scored(spark, folder))


@query("top_growth", over("scored_accounts", "SELECT account_id, industry, mom_growth_3m, growth_score, recommended_action FROM scored_accounts WHERE is_churned = 0 ORDER BY growth_score DESC, account_id LIMIT 10"))
def _(spark, folder):
    return accounts.top_growth(_scored(spark, folder))


@query("top_churn_risk", over("scored_accounts", "SELECT account_id, industry, avg_monthly_revenue, churn_probability, recommended_action FROM scored_accounts WHERE is_churned = 0 ORDER BY churn_probability DESC, account_id LIMIT 10"))
def _(spark, folder):
    return accounts.top_churn_risk(_scored(spark, folder))


@query("class_weight", over("account_summary", "SELECT coalesce(count(*) FILTER (WHERE is_churned <> 1) / nullif(count(*) FILTER (WHERE is_churned = 1), 0), 1) AS positive_weight FROM account_summary"))
def _(spark, folder):
    return accounts.class_weight(summary(spark, folder))


@query(
    "one_hot",
    over(
        "account_summary",
        """SELECT account_id, category, CAST(category = industry AS DOUBLE) AS flag
           FROM account_summary CROSS JOIN (SELECT DISTINCT industry AS category FROM account_summary)""",
    ),
)
def _(spark, folder):
    """A row per account and fitted category."""
    rows = pin(summary(spark, folder).select("account_id", "industry"))
    indexer, encoder = accounts.one_hot(["industry"])
    labels = indexer.fit(rows)
    indexed = labels.transform(rows)
    encoded = encoder.fit(indexed).transform(indexed)
    names = F.array(*[F.lit(x) for x in labels.labelsArray[0]])
    flags = F.arrays_zip(names.alias("category"), vector_to_array("industry_flags").alias("flag"))
    return encoded.select("account_id", F.inline(flags).alias("category", "flag"))


_EARLY = "close_date < DATE '1995-10-01'"
_FEATURES = " UNION ALL ".join(
    f"SELECT account_id, CAST({i} AS BIGINT) AS position, round_even(coalesce(CAST({c} AS DOUBLE), 0), 6) + 0.0 AS value FROM account_summary"
    for i, c in enumerate(accounts.CHURN_NUMBERS)
)


def _flags_sql(column, before):
    return f"""SELECT account_id, {before} + place - 1 AS position, CAST({column} = name AS DOUBLE) AS value FROM account_summary CROSS JOIN (
        SELECT {column} AS name, row_number() OVER (ORDER BY count(*) DESC, {column}) AS place FROM account_summary WHERE {_EARLY} GROUP BY 1)"""


@query(
    "align_features",
    over(
        "account_summary",
        f"""{_FEATURES} UNION ALL {_flags_sql("industry", len(accounts.CHURN_NUMBERS))} UNION ALL {_flags_sql(
            "deal_size_band", f"{len(accounts.CHURN_NUMBERS)} + (SELECT count(DISTINCT industry) FROM account_summary WHERE {_EARLY})")}""",
    ),
)
def _(spark, folder):
    """Feature vectors of all accounts in the columns that the early accounts defined, a row per place."""
    rows = pin(summary(spark, folder).fillna(0.0, list(accounts.CHURN_NUMBERS)))
    stages = accounts.feature_stages().fit(rows.filter(F.col("close_date") < F.lit(_CUTOFF)))
    placed = stages.transform(rows).select("account_id", F.posexplode(vector_to_array("features")).alias("position", "value"))
    return placed.select("account_id", F.col("position").cast("long").alias("position"), round_to("value", 6).alias("value"))


_MODELS: dict[tuple[str, str], trees.TreeModel] = {}


def _model(spark, folder, rows) -> trees.TreeModel:
    """The churn model of a folder's pinned accounts, fitted once a session, saved and read back; all questions score from it."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _MODELS:
        kept = scratch_folder(spark, "churn")
        accounts.churn_model(rows, _CUTOFF).save(kept)
        _MODELS[key] = trees.load_model(spark, kept)
    return _MODELS[key]


def _really_scored(spark, folder):
    rows = pin(summary(spark, folder))
    return pin(accounts.score_accounts(rows, model=_model(spark, folder, rows)))


@query("churn_score")
def _(spark, folder):
    rows = pin(summary(spark, folder))
    scored = accounts.score_churn(rows, _model(spark, folder, rows))
    return scored.select("account_id", "is_churned", "churn_probability", "risk_tier")


@query("score_accounts")
def _(spark, folder):
    return _really_scored(spark, folder)


@query(
    "score_accounts_rows",
    over(
        "scored_accounts",
        """SELECT account_id, is_churned, growth_score, growth_tier, true AS chance_fits, true AS tier_fits,
                  CASE WHEN is_churned = 1 THEN recommended_action END AS churned_action FROM scored_accounts""",
    ),
)
def _(spark, folder):
    """What SQL can tell of the scored accounts: all are there, growth does not depend on the model, tiers follow the chance."""
    chance, tier = F.col("churn_probability"), F.col("risk_tier")
    right = F.when(chance >= C.HIGH_RISK_FROM, "High").when(chance >= C.MEDIUM_RISK_FROM, "Medium").otherwise("Low")
    return _really_scored(spark, folder).select(
        "account_id", "is_churned", "growth_score", "growth_tier",
        (chance.between(0, 1) & ((F.col("is_churned") == 0) | (chance == 1))).alias("chance_fits"), (tier == right).alias("tier_fits"),
        F.when(F.col("is_churned") == 1, F.col("recommended_action")).alias("churned_action"),
    )


@query("portfolio_scored")
def _(spark, folder):
    return accounts.portfolio_kpis(_really_scored(spark, folder))


@query(
    "portfolio_scored_known",
    over(
        "scored_accounts",
        """SELECT count(*) AS total_accounts, count(*) FILTER (WHERE is_churned = 0) AS active_accounts, count(*) FILTER (WHERE is_churned = 1) AS churned_accounts,
                  count(*) FILTER (WHERE growth_tier = 'High Potential') AS high_growth_accounts,
                  round_even(coalesce(sum(last_3m_avg * 12) FILTER (WHERE is_churned = 0), 0), 2) AS total_arr, true AS risk_fits FROM scored_accounts""",
    ),
)
def _(spark, folder):
    """The figures of the really scored portfolio that do not depend on the model, and whether the others are possible."""
    found = accounts.portfolio_kpis(_really_scored(spark, folder))
    fits = (F.col("high_risk_accounts") >= F.col("churned_accounts")) & F.col("avg_churn_prob").between(0, 1) & F.col("pct_at_risk").between(0, 1)
    return found.select("total_accounts", "active_accounts", "churned_accounts", "high_growth_accounts", "total_arr", fits.alias("risk_fits"))


@query("top_churn_scored")
def _(spark, folder):
    return accounts.top_churn_risk(_really_scored(spark, folder))


@query("churn_model_agrees", over("account_summary", "SELECT account_id, true AS agrees FROM account_summary"))
def _(spark, folder):
    """The model table scores every account as the library's own model does."""
    rows = pin(summary(spark, folder))
    stages, fitted = accounts.fit_churn(rows, _CUTOFF, 60)
    labels = zip(accounts.CHURN_CATEGORIES, stages.stages[0].labelsArray)
    columns = [(c, None) for c in accounts.CHURN_NUMBERS] + [(c, x) for c, found in labels for x in found]
    model = trees.TreeModel(trees.feature_table(spark, columns), trees.fitted_nodes(spark, fitted))
    own = trees.probability(F.col("_margin"))
    filled = rows.fillna(0.0, list(accounts.CHURN_NUMBERS))
    scored = fitted.transform(stages.transform(trees.score(filled, model, accounts.CHURN_DEPTH, "_margin")))
    return scored.select("account_id", (F.abs(own - vector_to_array("probability")[1]) < 1e-9).alias("agrees"))


# A small model in the form of the model tables: two splits on numbers and one on a category per tree.
_GIVEN_FEATURES = [("avg_monthly_revenue", None), ("mom_growth_3m", None), ("months_since_close", None), ("industry", "MACHINERY"), ("deal_size_band", "Large")]
_GIVEN_NODES = [
    (0, 0, 0, 90000.0, 1, 2, 0.0, 1.0), (0, 1, 1, -0.25, 3, 4, 0.1, 1.0), (0, 2, 3, 0.5, 5, 6, -0.2, 1.0),
    (0, 3, -1, None, -1, -1, 0.75, 1.0), (0, 4, -1, None, -1, -1, 0.25, 1.0), (0, 5, -1, None, -1, -1, -0.5, 1.0), (0, 6, -1, None, -1, -1, -0.125, 1.0),
    (1, 0, 4, 0.5, 1, 2, 0.0, 0.25), (1, 1, 2, 40.0, 3, 4, 0.0, 0.25), (1, 2, -1, None, -1, -1, 0.5, 0.25),
    (1, 3, -1, None, -1, -1, -1.5, 0.25), (1, 4, -1, None, -1, -1, 1.25, 0.25), (2, 0, -1, None, -1, -1, -0.375, 0.5),
]


def _given_sql() -> str:
    def text(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)

    values = " UNION ALL ".join(
        f"SELECT account_id, {i} AS position, coalesce(CAST({c} AS DOUBLE), 0) AS x FROM account_summary" if category is None
        else f"SELECT account_id, {i}, CAST({c} = '{category}' AS DOUBLE) FROM account_summary" for i, (c, category) in enumerate(_GIVEN_FEATURES)
    )
    nodes = ", ".join("(" + ", ".join(map(text, n)) + ")" for n in _GIVEN_NODES)
    walk = """SELECT account_id, tree, 0 AS node, 0 AS steps FROM account_summary CROSS JOIN (SELECT DISTINCT tree FROM nodes)
        UNION ALL SELECT w.account_id, w.tree, CASE WHEN v.x <= n.threshold THEN n.below ELSE n.above END, steps + 1
        FROM walk w JOIN nodes n USING (tree, node) JOIN feature_values v ON v.account_id = w.account_id AND v.position = n.feature WHERE n.feature >= 0"""
    body = """SELECT account_id, round_even(1 / (1 + exp(-2 * sum(n.weight * n.value))), 6) AS chance
        FROM walk w JOIN nodes n USING (tree, node) WHERE n.feature < 0 GROUP BY account_id"""
    return over(
        "account_summary", body, feature_values=values,
        nodes=f"SELECT * FROM (VALUES {nodes}) n(tree, node, feature, threshold, below, above, value, weight)", walk=walk,
    ).replace("WITH ", "WITH RECURSIVE ", 1)


@query("tree_scores", _given_sql())
def _(spark, folder):
    """A model given as tables, saved, read back and scored."""
    kept = scratch_folder(spark, "given")
    trees.TreeModel(trees.feature_table(spark, _GIVEN_FEATURES), spark.createDataFrame(_GIVEN_NODES, trees.NODES)).save(kept)
    scored = trees.score(summary(spark, folder), trees.load_model(spark, kept), 2)
    return scored.select("account_id", round_to(trees.probability(F.col("margin")), 6).alias("chance"))
