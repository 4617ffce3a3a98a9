"""Queries on revenue, spend, funnel and the report context."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidemark import constants as C
from tidemark.functions import scalars
from tidemark.functions.scalars import round_to
from tidemark.operators import buckets, context, filters, funnel, kpis, series
from tidemark.operators.filters import FilterParams
from tidemark.plans.registry import query
from tidemark.plans.views import over
from tidemark.session import pin
from tidemark.sources import bridge, sinks


def _trend_sql(label: str, step: str, where: str = "true") -> str:
    def side(name, table, day, value):
        totals = f"SELECT {label.format(d=day)} AS period, sum({value}) AS v FROM {table} WHERE {where.format(d=day)} GROUP BY 1"
        spine = f"SELECT CAST(unnest(generate_series(min(period), max(period), INTERVAL {step})) AS DATE) AS period FROM {name}_t"
        return {f"{name}_t": totals, f"{name}_s": spine}

    parts = side("web", "online_sales", "date", "revenue") | side("shop", "offline_sales", "week_start", "total_revenue")
    body = """
        SELECT coalesce(w.period, s.period) AS period, round_even(coalesce(w.v, 0), 2) AS online_revenue,
               round_even(coalesce(s.v, 0), 2) AS offline_revenue, round_even(coalesce(w.v, 0) + coalesce(s.v, 0), 2) AS total_revenue
        FROM (SELECT web_s.period, coalesce(v, 0) AS v FROM web_s LEFT JOIN web_t USING (period)) w
        FULL JOIN (SELECT shop_s.period, coalesce(v, 0) AS v FROM shop_s LEFT JOIN shop_t USING (period)) s
             ON w.period = s.period"""
    return over("online_sales offline_sales", body, **parts)


_DAILY = "CAST({d} AS DATE)"
_WEEKLY = "CAST(date_trunc('week', {d} - INTERVAL 1 DAY) + INTERVAL 7 DAY AS DATE)"
_MONTHLY = "CAST(date_trunc('month', {d}) AS DATE)"


def _trend(spark, folder, granularity, start=None, end=None):
    found = kpis.kpi_trend(
        bridge.online_sales(spark, folder, (), start, end), bridge.offline_sales(spark, folder, (), start, end), granularity
    )
    return found.select("period", *[round_to(c, 2).alias(c) for c in found.columns[1:]])


@query("kpi_trend_daily", _trend_sql(_DAILY, "1 DAY"))
def _(spark, folder):
    return _trend(spark, folder, "daily")


@query("kpi_trend_weekly", _trend_sql(_WEEKLY, "7 DAY"))
def kpi_trend_weekly(spark, folder):
    return _trend(spark, folder, "weekly")


@query("kpi_trend_monthly", _trend_sql(_MONTHLY, "1 MONTH"))
def _(spark, folder):
    return _trend(spark, folder, "monthly")


@query("kpi_trend_filtered", _trend_sql(_WEEKLY, "7 DAY", "{d} BETWEEN DATE '1997-03-05' AND DATE '1998-10-20'"))
def _(spark, folder):
    return _trend(spark, folder, "weekly", "1997-03-05", "1998-10-20")


def _summary_sql(where: str) -> str:
    return over(
        "online_sales offline_sales media_spend crm_funnel",
        """
        SELECT round_even(web + shop, 2) AS total_revenue, round_even(web, 2) AS online_revenue, round_even(shop, 2) AS offline_revenue,
               round_even(web / greatest(web + shop, 1) * 100, 2) AS online_share_pct, orders AS total_orders_online,
               round_even(spend, 2) AS total_media_spend, round_even(inc / greatest(spend, 1), 2) AS blended_roas,
               leads AS total_leads, round_even(pipeline, 2) AS pipeline_closed_won,
               round_even(won / greatest(leads, 1) * 100, 2) AS win_rate_pct,
               CASE WHEN n = 0 THEN '""" + C.NO_DATA_TEXT % " (online sales)" + """'
                    WHEN n < """ + str(C.MIN_RELIABLE_ROWS) + """ THEN printf('""" + C.FEW_ROWS_TEXT + """', n, ' (online sales)') END AS warning
        FROM a, b, c, d""",
        a=f"SELECT coalesce(sum(revenue), 0) AS web, CAST(coalesce(sum(orders), 0) AS BIGINT) AS orders, count(*) AS n FROM online_sales WHERE {where.format(d='date')}",
        b=f"SELECT coalesce(sum(total_revenue), 0) AS shop FROM offline_sales WHERE {where.format(d='week_start')}",
        c=f"SELECT coalesce(sum(spend), 0) AS spend, coalesce(sum(incremental_revenue), 0) AS inc FROM media_spend WHERE {where.format(d='week_start')}",
        d=f"SELECT count(*) AS leads, count(*) FILTER (WHERE outcome = 'Closed Won') AS won, coalesce(sum(deal_value) FILTER (WHERE outcome = 'Closed Won'), 0) AS pipeline FROM crm_funnel WHERE {where.format(d='lead_date')}",
    )


def _summary(spark, folder, start=None, end=None, dims=("channel", "category")):
    shop, media = bridge.offline_and_media(spark, folder, (), start, end)
    crm = bridge.crm_funnel(spark, folder, (), FilterParams(start, end) if start or end else None)
    return kpis.kpi_summary(bridge.online_sales(spark, folder, dims, start, end), shop, media, crm)


@query("kpi_summary", _summary_sql("true"))
def _(spark, folder):
    return _summary(spark, folder)


@query("kpi_summary_filtered", _summary_sql("{d} BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"))
def _(spark, folder):
    return _summary(spark, folder, "1996-01-01", "1996-12-31")


@query("kpi_summary_no_data", _summary_sql("{d} >= DATE '2030-01-01'"))
def _(spark, folder):
    return _summary(spark, folder, "2030-01-01")


@query(
    "trend_join",
    over(
        "crm_funnel",
        """SELECT coalesce(l.period, c.period) AS period, round_even(coalesce(opened, 0), 2) AS opened,
                  round_even(coalesce(closed, 0), 2) AS closed,
                  round_even(coalesce(opened, 0) + coalesce(closed, 0), 2) AS total_revenue
           FROM (SELECT CAST(date_trunc('month', lead_date) AS DATE) AS period, CAST(count(*) AS DOUBLE) AS opened FROM crm_funnel GROUP BY 1) l
           FULL JOIN (SELECT CAST(date_trunc('month', close_date) AS DATE) AS period, CAST(count(*) AS DOUBLE) AS closed
                      FROM crm_funnel WHERE close_date IS NOT NULL GROUP BY 1) c ON l.period = c.period""",
    ),
)
def _(spark, folder):
    crm = bridge.crm_funnel(spark, folder, ()).withColumn("one", F.lit(1.0))
    opened = buckets.bucket(crm, "lead_date", "monthly", "one").withColumnRenamed("one", "opened")
    closed = buckets.bucket(crm, "close_date", "monthly", "one").withColumnRenamed("one", "closed")
    return kpis.trend_join(opened, closed, "opened", "closed")


@query("daily_rollup", over("", "SELECT CAST(o_orderdate AS DATE) AS date, round_even(sum(round(o_totalprice * 100)) / 100, 2) AS revenue FROM orders GROUP BY 1").replace("WITH  ", ""))
def _(spark, folder):
    daily = buckets.period_totals(bridge.online_sales(spark, folder, ()), "date", "revenue")
    return daily.withColumn("revenue", round_to("revenue", 2))


@query(
    "spend_efficiency",
    over(
        "media_spend",
        """SELECT channel, round_even(sum(spend), 3) AS total_spend, CAST(sum(impressions) AS BIGINT) AS total_impressions,
                  CAST(sum(clicks) AS BIGINT) AS total_clicks, CAST(sum(conversions) AS BIGINT) AS total_conversions,
                  round_even(avg(roas), 3) AS avg_roas, round_even(avg(cpm), 3) AS avg_cpm, round_even(avg(ctr), 3) AS avg_ctr,
                  round_even(avg(cpa), 3) AS avg_cpa FROM media_spend GROUP BY channel""",
    ),
)
def _(spark, folder):
    return kpis.spend_efficiency(bridge.media_spend(spark, folder))


@query(
    "media_ratios",
    over(
        "media_spend",
        """SELECT week_start, channel, round_even(cpm, 4) AS cpm, round_even(ctr, 6) AS ctr, round_even(cvr, 6) AS cvr,
                  round_even(cpc, 4) AS cpc, round_even(cpa, 4) AS cpa FROM media_spend""",
    ),
)
def _(spark, folder):
    media = bridge.media_spend(spark, folder)
    digits = {"cpm": 4, "ctr": 6, "cvr": 6, "cpc": 4, "cpa": 4}
    return media.select("week_start", "channel", *[round_to(c, d).alias(c) for c, d in digits.items()])


_FUNNEL_SUMS = """
    SELECT count(*) AS total_leads, CAST(sum(reached_mql) AS BIGINT) AS mqls, CAST(sum(reached_sql) AS BIGINT) AS sqls,
           CAST(sum(reached_opp) AS BIGINT) AS opportunities, CAST(sum(reached_close) AS BIGINT) AS closed_won,
           coalesce(sum(deal_value) FILTER (WHERE outcome = 'Closed Won'), 0) AS pipeline,
           coalesce(avg(deal_value) FILTER (WHERE outcome = 'Closed Won'), 0) AS deal,
           coalesce(avg(days_to_close), 0) AS days FROM crm_funnel"""
_FUNNEL_BODY = """
    SELECT total_leads, mqls, sqls, opportunities, closed_won,
           round_even(mqls / greatest(total_leads, 1) * 100, 2) AS lead_to_mql_rate,
           round_even(sqls / greatest(mqls, 1) * 100, 2) AS mql_to_sql_rate,
           round_even(opportunities / greatest(sqls, 1) * 100, 2) AS sql_to_opp_rate,
           round_even(closed_won / greatest(opportunities, 1) * 100, 2) AS opp_win_rate,
           round_even(closed_won / greatest(total_leads, 1) * 100, 2) AS overall_win_rate,
           round_even(pipeline, 2) AS pipeline_closed_won, round_even(deal, 2) AS avg_deal_value,
           round_even(days, 1) AS avg_days_to_close FROM sums"""


@query("funnel_summary", over("crm_funnel", _FUNNEL_BODY, sums=_FUNNEL_SUMS))
def _(spark, folder):
    return funnel.funnel_summary(bridge.crm_funnel(spark, folder, ()))


@query(
    "funnel_summary_filtered",
    over(
        "crm_funnel", _FUNNEL_BODY,
        sums=_FUNNEL_SUMS + " WHERE lead_date >= DATE '1997-01-01' AND industry = 'MACHINERY' AND lead_source = '2-HIGH'",
    ),
)
def _(spark, folder):
    params = FilterParams(start_date="1997-01-01", industry="MACHINERY", lead_source="2-HIGH", region="ignored")
    return funnel.funnel_summary(bridge.crm_funnel(spark, folder, params=params))


_BY_SOURCE = over(
    "crm_funnel",
    """SELECT lead_source, count(contact_id) AS total_leads, CAST(sum(reached_mql) AS BIGINT) AS mqls,
              CAST(sum(reached_sql) AS BIGINT) AS sqls, CAST(sum(reached_opp) AS BIGINT) AS opps,
              CAST(sum(reached_close) AS BIGINT) AS won, round_even(coalesce(sum(deal_value), 0), 2) AS pipeline_value,
              round_even(sum(reached_close) / greatest(count(contact_id), 1) * 100, 2) AS win_rate_pct
       FROM crm_funnel GROUP BY lead_source""",
)


@query("funnel_by_source", _BY_SOURCE)
def _(spark, folder):
    return funnel.funnel_by_source(bridge.crm_funnel(spark, folder, ()))


@query("funnel_by_source_filtered", _BY_SOURCE.replace("FROM crm_funnel GROUP", "FROM crm_funnel WHERE lead_date BETWEEN DATE '1996-02-03' AND DATE '1996-09-30' GROUP"))
def _(spark, folder):
    return funnel.funnel_by_source(bridge.crm_funnel(spark, folder, (), FilterParams("1996-02-03", "1996-09-30")))


_PERIODS = {
    "day": "CAST(l_shipdate AS DATE)", "week": "CAST(date_trunc('week', l_shipdate) AS DATE)",
    "closing week": "CAST(date_trunc('week', l_shipdate - INTERVAL 1 DAY) + INTERVAL 7 DAY AS DATE)",
    "month": "CAST(date_trunc('month', l_shipdate) AS DATE)",
}
_RANGES = (("1995-03-08", "1996-03-08"), ("1996-04-01", None), (None, "1994-12-26"))


@query(
    "period_filter",
    " UNION ALL ".join(
        f"""SELECT '{kind}' AS kind, {i} AS nth, count(*) AS rows, CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day
            FROM lineitem WHERE {label} BETWEEN DATE '{start or "1900-01-01"}' AND DATE '{end or "2100-01-01"}'"""
        for kind, label in _PERIODS.items() for i, (start, end) in enumerate(_RANGES)
    ),
)
def _(spark, folder):
    """Order lines whose period lies in a range, picked by their raw date."""
    line = bridge.star(spark, folder, "lineitem")
    parts = [
        filters.period_filter(line, "l_shipdate", kind, *bounds).agg(
            F.lit(kind).alias("kind"), F.lit(i).alias("nth"), F.count("*").alias("rows"),
            F.min("l_shipdate").cast("date").alias("first_day"), F.max("l_shipdate").cast("date").alias("last_day"),
        )
        for kind in _PERIODS for i, bounds in enumerate(_RANGES)
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "as_records",
    over(
        "crm_funnel",
        """SELECT '{"lead_source":"' || lead_source || '","total_leads":' || count(*) || ',"first_lead":"'
                  || strftime(min(lead_date), '%Y-%m-%d') || '","won":' || sum(reached_close) || ',"none":null}' AS record
           FROM crm_funnel GROUP BY lead_source""",
    ),
)
def _(spark, folder):
    by_source = bridge.crm_funnel(spark, folder, ()).groupBy("lead_source").agg(
        F.count("*").alias("total_leads"), F.min("lead_date").alias("first_lead"),
        F.sum("reached_close").alias("won"), F.lit(None).cast("string").alias("none"),
    )
    return sinks.as_records(by_source)


def _revenue_sql(table, dim, value="revenue"):
    return over(table, f"SELECT {dim}, round_even(round_even(sum({value}), 2), 0) AS {value} FROM {table} GROUP BY {dim}")


@query("revenue_by_channel", _revenue_sql("online_sales", "channel"))
def _(spark, folder):
    return kpis.revenue_by(bridge.online_sales(spark, folder, ("channel",)), "channel")


@query("revenue_by_category", _revenue_sql("online_sales", "category"))
def _(spark, folder):
    return kpis.revenue_by(bridge.online_sales(spark, folder, ("category",)), "category")


@query("revenue_by_region", _revenue_sql("offline_sales", "region", "total_revenue"))
def _(spark, folder):
    return kpis.revenue_by(bridge.offline_sales(spark, folder, ("region",)), "region", "total_revenue")


@query("roas_by_channel", over("media_spend", "SELECT channel, round_even(avg(roas), 3) AS roas FROM media_spend GROUP BY channel"))
def _(spark, folder):
    return kpis.roas_by_channel(bridge.media_spend(spark, folder))


@query("spend_by_channel", _revenue_sql("media_spend", "channel", "spend"))
def _(spark, folder):
    return kpis.spend_by_channel(bridge.media_spend(spark, folder))


@query("blended_roas", over("media_spend", "SELECT round_even(sum(incremental_revenue) / greatest(sum(spend), 1), 2) AS blended_roas FROM media_spend"))
def _(spark, folder):
    return kpis.blended_roas(bridge.media_spend(spark, folder))


@query("win_rate", over("crm_funnel", "SELECT round_even(count(*) FILTER (WHERE outcome = 'Closed Won') / greatest(count(*), 1) * 100, 2) AS win_rate_pct FROM crm_funnel"))
def _(spark, folder):
    return funnel.win_rate(bridge.crm_funnel(spark, folder, ()))


_PERFORMANCE = "SELECT lead_source, count(contact_id) AS leads, CAST(sum(reached_close) AS BIGINT) AS won, round_even(sum(reached_close) / greatest(count(contact_id), 1) * 100, 2) AS win_rate FROM crm_funnel GROUP BY 1"


@query("source_performance", over("crm_funnel", _PERFORMANCE))
def _(spark, folder):
    return funnel.source_performance(bridge.crm_funnel(spark, folder, ()))


@query(
    "best_and_worst",
    over(
        "crm_funnel",
        """SELECT (SELECT lead_source FROM p ORDER BY win_rate DESC, lead_source LIMIT 1) AS best,
                  (SELECT lead_source FROM p ORDER BY win_rate, lead_source DESC LIMIT 1) AS worst""",
        p=_PERFORMANCE,
    ),
)
def _(spark, folder):
    rated = funnel.source_performance(bridge.crm_funnel(spark, folder, ()))
    return funnel.best_and_worst(rated, "lead_source", "win_rate")


@query(
    "mom_change",
    over(
        "online_sales",
        """SELECT month, round_even((curr - prev) / greatest(prev, 1) * 100, 2) AS mom_change_pct
           FROM (SELECT month, curr, lag(curr) OVER (ORDER BY month) AS prev FROM m) ORDER BY month DESC LIMIT 1""",
        m="SELECT CAST(date_trunc('month', date) AS DATE) AS month, sum(revenue) AS curr FROM online_sales GROUP BY 1",
    ),
)
def _(spark, folder):
    return kpis.mom_change(bridge.online_sales(spark, folder, ()))


@query("period_bounds", "SELECT DATE '1996-06-01' AS period_start, CAST(max(o_orderdate) AS DATE) AS period_end FROM orders")
def _(spark, folder):
    return kpis.period_bounds(bridge.online_sales(spark, folder, ()), "date", start="1996-06-01")


@query("weekly_range", over("offline_sales", "SELECT round_even(min(w), 2) AS min_week, round_even(max(w), 2) AS max_week FROM (SELECT sum(total_revenue) AS w FROM offline_sales GROUP BY week_start)"))
def _(spark, folder):
    return kpis.weekly_range(bridge.offline_sales(spark, folder, ()))


@query("outcome_counts", over("crm_funnel", "SELECT outcome, count(*) AS rows FROM crm_funnel GROUP BY outcome"))
def _(spark, folder):
    return funnel.outcome_counts(bridge.crm_funnel(spark, folder, ()), "outcome")


@query(
    "funnel_stage_share",
    over(
        "crm_funnel",
        """SELECT CAST(position AS INT) AS position, stage, contacts, round_even(contacts / greatest(total_leads, 1) * 100, 1) AS share_pct
           FROM sums, LATERAL (VALUES (1, 'Lead', total_leads), (2, 'MQL', mqls), (3, 'SQL', sqls),
                (4, 'Opportunity', opportunities), (5, 'Closed Won', closed_won)) v(position, stage, contacts)""",
        sums=_FUNNEL_SUMS,
    ),
)
def _(spark, folder):
    return funnel.funnel_stage_share(bridge.crm_funnel(spark, folder, ()))


@query(
    "roas_band",
    over(
        "media_spend",
        """SELECT week_start, channel, CASE WHEN roas / 8 >= 2.5 THEN 'green' WHEN roas / 8 >= 1.9 THEN 'amber' ELSE 'red' END AS band
           FROM media_spend""",
    ),
)
def _(spark, folder):
    media = bridge.media_spend(spark, folder).withColumn("roas", F.col("roas") / 8)
    return kpis.with_roas_band(media).select("week_start", "channel", "band")


@query(
    "budget_shift",
    over(
        "media_spend",
        """SELECT round_even(sum(greatest(delta, 0)), 2) AS reallocated, round_even(sum(delta * roas * 0.55::DOUBLE), 2) AS revenue_gain,
                  round_even(sum(revenue) / greatest(sum(spend), 1), 4) AS roas_before,
                  round_even((sum(revenue) + sum(delta * roas * 0.55::DOUBLE)) / greatest(sum(spend + delta), 1), 4) AS roas_after FROM m""",
        c="SELECT channel, sum(spend) AS spend, sum(incremental_revenue) AS revenue FROM media_spend GROUP BY channel",
        m="""SELECT *, revenue / greatest(spend, 1) AS roas, CASE channel WHEN 'ECONOMY' THEN round_even(spend * 0.3::DOUBLE, 2)
                    WHEN 'SMALL' THEN -round_even(spend * 0.3::DOUBLE, 2) ELSE 0 END AS delta FROM c""",
    ),
)
def _(spark, folder):
    by_channel = pin(
        bridge.media_spend(spark, folder).groupBy("channel").agg(
            F.sum("spend").alias("spend"), F.sum("incremental_revenue").alias("revenue")
        )
    )
    third = round_to(F.col("spend") * 0.3, 2)
    moved = F.when(F.col("channel") == "ECONOMY", third).when(F.col("channel") == "SMALL", -third)
    deltas = by_channel.select("channel", moved.alias("delta")).dropna()
    return kpis.budget_shift(by_channel, deltas, 0.55)


_CONTEXT_ROW = "SELECT '{s}' AS section, '{m}' AS metric, CAST({n} AS VARCHAR) AS name, CAST({v} AS DOUBLE) AS value, CAST({t} AS VARCHAR) AS text FROM {f}"


def _row(section, metric, source, value="NULL", name="NULL", text="NULL"):
    return _CONTEXT_ROW.format(s=section, m=metric, n=name, v=value, t=text, f=source)


_CONTEXT = over(
    "online_sales offline_sales media_spend crm_funnel",
    " UNION ALL ".join(
        [
            _row("period", "start", "web", text="lo"),
            _row("period", "end", "web", text="hi"),
            _row("revenue", "online_total", "web", "round_even(round_even(v, 2), 0)"),
            _row("revenue", "offline_total", "shop", "round_even(round_even(v, 2), 0)"),
            _row("revenue", "combined_total", "web, shop", "round_even(round_even(web.v + shop.v, 2), 0)"),
            _row("revenue", "online_share_pct", "web, shop", "round_even(web.v / greatest(web.v + shop.v, 1) * 100, 1)"),
            _row("revenue", "mom_online_change_pct", "(SELECT month, curr, lag(curr) OVER (ORDER BY month) AS prev FROM months ORDER BY month DESC LIMIT 1)", "round_even((curr - prev) / greatest(prev, 1) * 100, 2)"),
            _row("revenue", "by_channel", "online_sales GROUP BY channel", "round_even(round_even(sum(revenue), 2), 0)", "channel"),
            _row("revenue", "by_category", "online_sales GROUP BY category", "round_even(round_even(sum(revenue), 2), 0)", "category"),
            _row("revenue", "offline_by_region", "offline_sales GROUP BY region", "round_even(round_even(sum(total_revenue), 2), 0)", "region"),
            _row("media", "total_spend", "media_spend", "round_even(round_even(sum(spend), 2), 0)"),
            _row("media", "blended_roas", "media_spend", "round_even(sum(incremental_revenue) / greatest(sum(spend), 1), 2)"),
            _row("media", "roas_by_channel", "media_spend GROUP BY channel", "round_even(avg(roas), 3)", "channel"),
            _row("media", "spend_by_channel", "media_spend GROUP BY channel", "round_even(round_even(sum(spend), 2), 0)", "channel"),
            _row("crm", "total_leads", "crm_funnel", "count(*)"),
            _row("crm", "win_rate_pct", "crm_funnel", "round_even(count(*) FILTER (WHERE outcome = 'Closed Won') / greatest(count(*), 1) * 100, 2)"),
            _row("crm", "pipeline_closed_won", "crm_funnel", "round_even(round_even(sum(deal_value) FILTER (WHERE outcome = 'Closed Won'), 2), 0)"),
            _row("crm", "avg_deal_value", "crm_funnel", "round_even(round_even(avg(deal_value) FILTER (WHERE outcome = 'Closed Won'), 2), 0)"),
            _row("crm", "top_lead_source", "(SELECT * FROM p ORDER BY win_rate DESC, lead_source LIMIT 1)", text="lead_source"),
            _row("crm", "bottom_lead_source", "(SELECT * FROM p ORDER BY win_rate, lead_source DESC LIMIT 1)", text="lead_source"),
        ]
    ),
    web="SELECT sum(revenue) AS v, min(date) AS lo, max(date) AS hi FROM online_sales",
    shop="SELECT sum(total_revenue) AS v FROM offline_sales",
    months="SELECT date_trunc('month', date) AS month, sum(revenue) AS curr FROM online_sales GROUP BY 1",
    p=_PERFORMANCE,
)


def _metrics(spark, folder):
    shop, media = bridge.offline_and_media(spark, folder, ("region",))
    return context.context_metrics(bridge.online_sales(spark, folder), shop, media, bridge.crm_funnel(spark, folder, ()))


@query("context_metrics", _CONTEXT)
def _(spark, folder):
    return _metrics(spark, folder)


@query("build_context")
def _(spark, folder):
    return context.build_context(_metrics(spark, folder))


@query("context_document", f"SELECT * FROM ({_CONTEXT}) WHERE value IS NOT NULL OR text IS NOT NULL")
def _(spark, folder):
    """The figures of the document that build_context writes, read back from its JSON."""
    return context.context_rows(context.build_context(_metrics(spark, folder)))


@query(
    "share_of_total",
    over("media_spend", "SELECT week_start, channel, round_even(incremental_revenue / greatest(sum(incremental_revenue) OVER (PARTITION BY week_start), 1), 4) AS share FROM media_spend"),
)
def _(spark, folder):
    media = pin(bridge.media_spend(spark, folder).select("week_start", "channel", "incremental_revenue"))
    return series.share_of_total(media, "incremental_revenue", "week_start").drop("incremental_revenue")


@query(
    "scale_to_total",
    over(
        "offline_sales online_sales",
        """SELECT week_start, region, store_format, category, round_even(round_even(total_revenue * (target / greatest(total, 1)), 2), 2) AS total_revenue,
                  round_even(round_even(total_revenue * (target / greatest(total, 1)), 2) / greatest(active_stores, 1), 2) AS revenue_per_store
           FROM offline_sales JOIN t USING (week_start) LEFT JOIN g USING (week_start)""",
        t="SELECT week_start, sum(total_revenue) AS total FROM offline_sales GROUP BY 1",
        g="SELECT CAST(date_trunc('week', date) AS DATE) AS week_start, sum(revenue) AS target FROM online_sales GROUP BY 1",
    ),
)
def _(spark, folder):
    offline = pin(bridge.offline_sales(spark, folder))
    target = bridge.online_sales(spark, folder, ()).groupBy(
        F.date_trunc("week", "date").cast("date").alias("week_start")
    ).agg(F.sum("revenue").alias("target"))
    scaled = series.scale_to_total(offline, "total_revenue", "week_start", target, "target")
    per_store = round_to(scalars.safe_ratio(F.col("total_revenue"), F.col("active_stores")), 2)
    return scaled.withColumn("revenue_per_store", per_store).drop("active_stores", "units_sold")


@query(
    "map_by_period",
    over(
        "offline_sales",
        "SELECT week_start, region, category, store_format, total_revenue, round_even(total, 2) AS total FROM offline_sales JOIN (SELECT week_start, sum(total_revenue) AS total FROM offline_sales GROUP BY 1) USING (week_start)",
    ),
)
def _(spark, folder):
    offline = pin(bridge.offline_sales(spark, folder))
    totals = offline.groupBy("week_start").agg(round_to(F.sum("total_revenue"), 2).alias("total"))
    return series.map_by_period(offline, totals, "week_start").drop("active_stores", "units_sold")
