"""Queries on buckets, spines, splits and series windows."""

import math

from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.functions.scalars import round_to
from tidemark.operators import buckets, series as S
from tidemark.plans.registry import query
from tidemark.plans.views import over
from tidemark.session import pin
from tidemark.sources import bridge

_WEEKLY = "SELECT category, week_start, sum(total_revenue) AS x FROM offline_sales GROUP BY 1, 2"


def _weekly(spark, folder):
    """Weekly revenue per category in cents kept exact."""
    weeks = bridge.offline_sales(spark, folder, ("category",))
    return weeks.select("category", "week_start", F.col("total_revenue").alias("x"))


def _weekly_sql(expression: str, name: str, digits: int = 4) -> str:
    return over(
        "offline_sales", f"SELECT category, week_start, round_even({name}, {digits}) AS {name} FROM r",
        w=_WEEKLY, r=f"SELECT category, week_start, {expression} AS {name} FROM w",
    )


_KEYS = ["category"]


@query(
    "rolling_mean",
    _weekly_sql("CASE WHEN count(x) OVER f >= 2 THEN avg(x) OVER f END", "mean", 4).replace(
        "FROM w)", "FROM w WINDOW f AS (PARTITION BY category ORDER BY week_start ROWS 3 PRECEDING))"
    ),
)
def _(spark, folder):
    mean = S.rolling_mean("x", "week_start", _KEYS)
    return _weekly(spark, folder).select("category", "week_start", round_to(mean, 4).alias("mean"))


@query("pct_change", _weekly_sql("x / lag(x) OVER (PARTITION BY category ORDER BY week_start) - 1", "change", 6))
def _(spark, folder):
    change = S.pct_change("x", "week_start", _KEYS)
    return _weekly(spark, folder).select("category", "week_start", round_to(change, 6).alias("change"))


@query("zscore", _weekly_sql("abs(x - avg(x) OVER (PARTITION BY category)) / stddev_pop(x) OVER (PARTITION BY category)", "z", 6))
def _(spark, folder):
    return _weekly(spark, folder).select("category", "week_start", round_to(S.zscore("x", _KEYS), 6).alias("z"))


@query(
    "ffill",
    over("metric_facts", "SELECT metric, date, round_even(last_value(revenue IGNORE NULLS) OVER (PARTITION BY metric ORDER BY date ROWS UNBOUNDED PRECEDING), 2) AS revenue FROM metric_facts"),
)
def _(spark, folder):
    filled = S.ffill("revenue", "date", ["metric"])
    return bridge.metric_facts(spark, folder).select("metric", "date", round_to(filled, 2).alias("revenue"))


def _adstock_sql(decay: float) -> str:
    """The recursion itself, row by row."""
    text = over(
        "media_spend",
        "SELECT channel, week_start, round_even(a, 4) AS adstocked FROM walk",
        n="SELECT channel, week_start, spend, row_number() OVER (PARTITION BY channel ORDER BY week_start) AS i FROM media_spend",
        walk=f"""SELECT channel, week_start, i, spend AS a FROM n WHERE i = 1 UNION ALL
                 SELECT n.channel, n.week_start, n.i, n.spend + {decay}::DOUBLE * walk.a FROM walk JOIN n
                 ON n.channel = walk.channel AND n.i = walk.i + 1""",
    )
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def _adstock(spark, folder, decay):
    spend = pin(bridge.media_spend(spark, folder).select("channel", "week_start", "spend"))
    carried = S.with_adstock(spend, {"adstocked": "spend"}, "week_start", decay, ["channel"])
    return carried.select("channel", "week_start", round_to("adstocked", 4).alias("adstocked"))


@query("adstock", _adstock_sql(0.4))
def _(spark, folder):
    return _adstock(spark, folder, 0.4)


@query("adstock_slow", _adstock_sql(0.7))
def _(spark, folder):
    return _adstock(spark, folder, 0.7)


@query("trend_index", _weekly_sql("(row_number() OVER (PARTITION BY category ORDER BY week_start) - 1) / count(*) OVER (PARTITION BY category)", "trend", 8))
def _(spark, folder):
    place = S.trend_index("week_start", _KEYS)
    return _weekly(spark, folder).select("category", "week_start", round_to(place, 8).alias("trend"))


@query("row_sequence", over("offline_sales", "SELECT category, week_start, row_number() OVER (PARTITION BY category ORDER BY week_start) - 1 AS place FROM w", w=_WEEKLY))
def _(spark, folder):
    return _weekly(spark, folder).select("category", "week_start", S.row_sequence("week_start", _KEYS).alias("place"))


@query(
    "recent_vs_history",
    over(
        "metric_facts",
        """SELECT metric, date AS period, recent, historical_avg, round_even((historical_avg - recent) / greatest(historical_avg, 1), 4) AS drop_pct
           FROM (SELECT metric, date, CAST(events AS DOUBLE) AS recent, avg(events) OVER (PARTITION BY metric ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS historical_avg,
                        row_number() OVER (PARTITION BY metric ORDER BY date DESC) AS back FROM metric_facts) WHERE back = 1""",
    ),
)
def _(spark, folder):
    found = S.recent_vs_history(bridge.metric_facts(spark, folder), "events", "date", 4, ["metric"])
    return found.withColumn("drop_pct", round_to("drop_pct", 4))


def _months(spark, folder):
    orders = bridge.customer_months(spark, folder)
    return buckets.month_spine(bridge.account_deals(spark, folder, orders), "close_date", bridge.account_as_of(orders))


@query("month_number", over("account_months", "SELECT account_id, month, months_since_close FROM account_months"))
def _(spark, folder):
    return _months(spark, folder).select("account_id", "month", "months_since_close")


@query(
    "bucket_weekly_by_channel",
    over(
        "online_sales",
        "SELECT channel, period, round_even(coalesce(v, 0), 2) AS revenue FROM s LEFT JOIN t USING (channel, period)",
        t="""SELECT channel, CAST(date_trunc('week', date - INTERVAL 1 DAY) + INTERVAL 7 DAY AS DATE) AS period, sum(revenue) AS v
             FROM online_sales GROUP BY 1, 2""",
        s="SELECT channel, CAST(unnest(generate_series(min(period), max(period), INTERVAL 7 DAY)) AS DATE) AS period FROM t GROUP BY channel",
    ),
)
def _(spark, folder):
    online = bridge.online_sales(spark, folder, ("channel",))
    found = buckets.bucket(online, "date", "weekly", "revenue", ["channel"])
    return found.withColumn("revenue", round_to("revenue", 2))


@query("month_period", over("online_sales", "SELECT CAST(date_trunc('month', date) AS DATE) AS month, CAST(sum(orders) AS BIGINT) AS orders FROM online_sales GROUP BY 1"))
def _(spark, folder):
    online = bridge.online_sales(spark, folder, ())
    return online.groupBy(dates.month_period(F.col("date")).alias("month")).agg(F.sum("orders").alias("orders"))


@query("week_period", over("online_sales", "SELECT CAST(date_trunc('week', date) AS DATE) AS week, CAST(sum(orders) AS BIGINT) AS orders FROM online_sales GROUP BY 1"))
def _(spark, folder):
    online = bridge.online_sales(spark, folder, ())
    return online.groupBy(dates.week_period(F.col("date")).alias("week")).agg(F.sum("orders").alias("orders"))


_TURN = repr(2 * math.pi)


@query(
    "calendar_features",
    f"""SELECT date, isodow(date) - 1 AS day_of_week, dayofyear(date) AS day_of_year, weekofyear(date) AS week_of_year, month(date) AS month,
               quarter(date) AS quarter, year(date) AS year, round_even(sin(dayofyear(date) * {_TURN}::DOUBLE / 365), 9) AS sin_doy,
               round_even(cos(dayofyear(date) * {_TURN}::DOUBLE / 365), 9) AS cos_doy
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)""",
)
def _(spark, folder):
    features = dates.calendar_features(F.col("date"))
    waves = {c: round_to(features.pop(c), 9) for c in ("sin_doy", "cos_doy")}
    numbers = {name: column.cast("long") for name, column in features.items()}
    return bridge.online_sales(spark, folder, ()).select("date").withColumns(numbers | waves)


@query(
    "week_harmonics",
    over(
        "offline_sales",
        f"""SELECT DISTINCT week_start, round_even(sin(weekofyear(week_start) * {_TURN}::DOUBLE / 52), 9) + 0.0 AS sin_week,
                   round_even(cos(weekofyear(week_start) * {_TURN}::DOUBLE / 52), 9) + 0.0 AS cos_week FROM offline_sales""",
    ),
)
def _(spark, folder):
    waves = {name: round_to(column, 9) for name, column in dates.week_harmonics(F.col("week_start")).items()}
    return bridge.offline_sales(spark, folder, ()).select("week_start").withColumns(waves)


@query(
    "month_spine",
    over("account_months", "SELECT account_id, count(*) AS months, min(month) AS first_month, max(month) AS last_month FROM account_months GROUP BY 1"),
)
def _(spark, folder):
    return _months(spark, folder).groupBy("account_id").agg(
        F.count("*").alias("months"), F.min("month").alias("first_month"), F.max("month").alias("last_month")
    )


@query(
    "week_spine",
    over(
        "online_sales",
        """SELECT channel, CAST(unnest(generate_series(CAST(date_trunc('week', lo - INTERVAL 1 DAY) + INTERVAL 7 DAY AS DATE), hi, INTERVAL 7 DAY)) AS DATE) AS week_start
           FROM (SELECT channel, min(date) AS lo, max(date) AS hi FROM online_sales GROUP BY channel)""",
    ),
)
def _(spark, folder):
    bounds = bridge.online_sales(spark, folder, ("channel",)).groupBy("channel").agg(
        F.min("date").alias("lo"), F.max("date").alias("hi")
    )
    return buckets.week_spine(bounds, "lo", "hi")


@query(
    "reindex_spine",
    over(
        "online_sales crm_funnel",
        """SELECT week_start, coalesce(won, 0) AS won FROM (
             SELECT CAST(unnest(generate_series(CAST(date_trunc('week', lo - INTERVAL 1 DAY) + INTERVAL 7 DAY AS DATE), hi, INTERVAL 7 DAY)) AS DATE) AS week_start
             FROM (SELECT min(date) AS lo, max(date) AS hi FROM online_sales))
           LEFT JOIN (SELECT CAST(date_trunc('week', close_date) AS DATE) AS week_start, count(*) AS won FROM crm_funnel
                      WHERE outcome = 'Closed Won' GROUP BY 1) USING (week_start)""",
    ),
)
def _(spark, folder):
    bounds = bridge.online_sales(spark, folder, ()).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    spine = buckets.week_spine(bounds, "lo", "hi")
    won = bridge.crm_funnel(spark, folder, ()).filter(F.col("outcome") == "Closed Won")
    weekly = won.groupBy(dates.week_period(F.col("close_date")).alias("week_start")).agg(F.count("*").alias("won"))
    return buckets.reindex_spine(weekly, spine, "week_start", ["won"])


@query(
    "horizon_spine",
    over("offline_sales", "SELECT category, CAST(hi + CAST(k AS INT) * 7 AS DATE) AS date FROM (SELECT category, max(week_start) AS hi FROM offline_sales GROUP BY 1), (SELECT unnest(generate_series(1, 90)) AS k)"),
)
def _(spark, folder):
    last = bridge.offline_sales(spark, folder, ("category",)).groupBy("category").agg(F.max("week_start").alias("hi"))
    return buckets.horizon_spine(last, "hi", 90, 7)


_CUTS = "SELECT {k} lo + CAST(floor((hi - lo) * 0.7::DOUBLE) AS INT) AS c1, lo + CAST(floor((hi - lo) * 0.85::DOUBLE) AS INT) AS c2 FROM (SELECT {k} min({d}) AS lo, max({d}) AS hi FROM {t} {g})"
_LABEL = "CASE WHEN {d} <= c1 THEN 'train' WHEN {d} <= c2 THEN 'validation' ELSE 'test' END AS split"


@query(
    "chrono_split",
    over(
        "online_sales",
        f"SELECT date, c1 AS train_end, c2 AS validation_end, {_LABEL.format(d='date')} FROM (SELECT DISTINCT date FROM online_sales), cuts",
        cuts=_CUTS.format(k="", d="date", t="online_sales", g=""),
    ),
)
def _(spark, folder):
    daily = bridge.online_sales(spark, folder, ()).select("date")
    return buckets.chrono_split(daily, "date")


@query(
    "split_summary",
    over(
        "metric_facts",
        "SELECT metric, split, count(*) AS rows, min(date) AS first_date, max(date) AS last_date FROM m GROUP BY 1, 2",
        cuts=_CUTS.format(k="metric,", d="date", t="metric_facts", g="GROUP BY metric"),
        m=f"SELECT metric, date, {_LABEL.format(d='date')} FROM metric_facts JOIN cuts USING (metric)",
    ),
)
def _(spark, folder):
    marked = buckets.chrono_split(bridge.metric_facts(spark, folder), "date", keys=["metric"])
    return buckets.split_summary(marked, "date", ["metric"])


@query("months_between_30", over("crm_funnel", "SELECT contact_id, CAST(round_even(date_diff('day', lead_date, DATE '2001-12-31') / 30.44::DOUBLE, 0) AS BIGINT) AS months FROM crm_funnel"))
def _(spark, folder):
    end = F.to_date(F.lit("2001-12-31"))
    return bridge.crm_funnel(spark, folder, ()).select("contact_id", dates.months_between_30(end, F.col("lead_date")).alias("months"))


@query("days_between", over("crm_funnel", "SELECT contact_id, date_diff('day', lead_date, mql_date) AS to_mql, date_diff('day', sql_date, opportunity_date) AS sql_to_opp FROM crm_funnel"))
def _(spark, folder):
    return bridge.crm_funnel(spark, folder, ()).select(
        "contact_id",
        dates.days_between(F.col("mql_date"), F.col("lead_date")).alias("to_mql"),
        dates.days_between(F.col("opportunity_date"), F.col("sql_date")).alias("sql_to_opp"),
    )
