"""SQL text of the business tables of `sources.bridge`, for the SQL twins of the queries."""

_NET = "floor(round(l_extendedprice * 100) * round((1 - l_discount) * 100) / 100 + 0.5)"
_OFF = "floor(round(l_extendedprice * 100) * round(l_discount * 100) / 100 + 0.5)"

_VIEWS = {
    "online_sales": """
        SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS channel, c_mktsegment AS category,
               count(*) AS orders, sum(round(o_totalprice * 100)) / 100 AS revenue
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""",
    "offline_sales": f"""
        SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week_start, r_name AS region,
               p_type AS store_format, l_returnflag AS category, count(*) AS active_stores,
               sum({_NET}) / 100 AS total_revenue, CAST(sum(l_quantity) AS BIGINT) AS units_sold
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
             JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
        GROUP BY 1, 2, 3, 4""",
    "media_facts": f"""
        SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week_start, p_type AS channel,
               sum({_OFF}) / 100 AS spend, CAST(sum(l_quantity) AS BIGINT) AS impressions,
               count(*) AS clicks, count(*) FILTER (WHERE l_returnflag = 'N') AS conversions,
               sum({_NET}) / 100 AS incremental_revenue
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "media_spend": """
        SELECT *, spend / greatest(impressions, 1) * 1000 AS cpm, clicks / greatest(impressions, 1) AS ctr,
               conversions / greatest(clicks, 1) AS cvr, spend / greatest(clicks, 1) AS cpc,
               spend / greatest(conversions, 1) AS cpa, incremental_revenue / greatest(spend, 1) AS roas
        FROM media_facts""",
    "contact_lines": """
        SELECT l_orderkey, bool_or(l_linestatus = 'F') AS any_f, bool_or(l_returnflag = 'A') AS any_a,
               CAST(min(l_shipdate) AS DATE) AS first_ship, CAST(max(l_shipdate) AS DATE) AS last_ship,
               CAST(min(l_shipdate) FILTER (WHERE l_linestatus = 'F') AS DATE) AS first_f,
               CAST(min(l_shipdate) FILTER (WHERE l_returnflag = 'A') AS DATE) AS first_a
        FROM lineitem GROUP BY l_orderkey""",
    "contact_flags": """
        SELECT *, l_orderkey IS NOT NULL AS mql, l_orderkey IS NOT NULL AND any_f AS sql,
               l_orderkey IS NOT NULL AND any_f AND any_a AS opp,
               l_orderkey IS NOT NULL AND any_f AND any_a AND o_orderstatus = 'F' AS won
        FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN contact_lines ON o_orderkey = l_orderkey""",
    "crm_funnel": """
        SELECT CAST(o_orderkey AS VARCHAR) AS contact_id, o_custkey AS customer_id,
               o_orderpriority AS lead_source, c_mktsegment AS industry,
               CAST(o_orderdate AS DATE) AS lead_date, first_ship AS mql_date,
               CASE WHEN sql THEN first_f END AS sql_date, CASE WHEN opp THEN first_a END AS opportunity_date,
               CASE WHEN won THEN last_ship END AS close_date,
               CASE WHEN won THEN 'Closed Won' WHEN opp AND o_orderstatus = 'O' THEN 'Closed Lost'
                    WHEN opp THEN 'In Progress' WHEN sql THEN 'SQL Only' WHEN mql THEN 'MQL Only'
                    ELSE 'Lead Only' END AS outcome,
               CASE WHEN won THEN o_totalprice END AS deal_value,
               CASE WHEN won THEN date_diff('day', CAST(o_orderdate AS DATE), last_ship) END AS days_to_close,
               CAST(coalesce(mql, false) AS INT) AS reached_mql, CAST(coalesce(sql, false) AS INT) AS reached_sql,
               CAST(coalesce(opp, false) AS INT) AS reached_opp, CAST(coalesce(won, false) AS INT) AS reached_close
        FROM contact_flags""",
    "account_deals": """
        SELECT CAST(o_custkey AS VARCHAR) AS account_id, c_mktsegment AS industry, o_orderpriority AS lead_source,
               CASE WHEN o_totalprice < 20000 THEN 'Small' WHEN o_totalprice <= 60000 THEN 'Mid'
                    ELSE 'Large' END AS deal_size_band,
               CAST(o_orderdate AS DATE) AS close_date, o_totalprice AS deal_value
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM orders)
             JOIN customer ON o_custkey = c_custkey WHERE nth = 1""",
    "account_months": """
        SELECT account_id, industry, lead_source, deal_size_band, close_date, CAST(m AS DATE) AS month,
               row_number() OVER (PARTITION BY account_id ORDER BY m) AS months_since_close
        FROM account_deals, LATERAL (SELECT unnest(generate_series(date_trunc('month', close_date) + INTERVAL 1 MONTH,
             CAST((SELECT last_day(max(o_orderdate)) FROM orders) AS TIMESTAMP), INTERVAL 1 MONTH)) AS m)""",
    "as_of": """SELECT last_day(max(o_orderdate)) AS d, CAST(date_trunc('month', d) - INTERVAL 2 MONTH AS DATE) AS last3,
        CAST(date_trunc('month', d) - INTERVAL 5 MONTH AS DATE) AS prev3 FROM orders""",
    "account_revenue": """
        SELECT s.*, coalesce(monthly_revenue, 0) AS monthly_revenue FROM account_months s LEFT JOIN (
            SELECT CAST(o_custkey AS VARCHAR) AS account_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
                   round_even(sum(round(o_totalprice * 100)) / 100, 0) AS monthly_revenue
            FROM orders GROUP BY 1, 2) e ON s.account_id = e.account_id AND s.month = e.month""",
    "account_figures": """
        SELECT account_id, count(*) FILTER (WHERE monthly_revenue > 0) AS months_active, sum(monthly_revenue) AS total,
               coalesce(avg(monthly_revenue) FILTER (WHERE monthly_revenue > 0), 0) AS mean,
               coalesce(avg(monthly_revenue) FILTER (WHERE month >= a.last3), 0) AS last3,
               coalesce(avg(monthly_revenue) FILTER (WHERE month >= a.prev3 AND month < a.last3), 0) AS prev3,
               CASE WHEN count(*) FILTER (WHERE month >= a.prev3) >= 2 THEN regr_slope(monthly_revenue, months_since_close) FILTER (WHERE month >= a.prev3) ELSE 0 END AS slope,
               coalesce(max(month) FILTER (WHERE monthly_revenue > 0), min(month)) AS last_order,
               coalesce(stddev_samp(monthly_revenue) FILTER (WHERE monthly_revenue > 0), 0) AS spread,
               CAST(count(*) FILTER (WHERE month >= a.last3) = 3
                    AND sum(monthly_revenue) FILTER (WHERE month >= a.last3) = 0 AS BIGINT) AS is_churned
        FROM account_revenue CROSS JOIN as_of a GROUP BY account_id""",
    "account_summary": """
        SELECT account_id, industry, lead_source, deal_size_band, close_date, deal_value, months_active,
               round_even(total, 2) AS total_revenue, round_even(mean, 2) AS avg_monthly_revenue,
               round_even(last3, 2) AS last_3m_avg, round_even(prev3, 2) AS prev_3m_avg,
               round_even(slope, 4) + 0.0 AS revenue_trend_slope,
               CASE WHEN prev3 > 0 THEN round_even(least(greatest((last3 - prev3) / prev3, -0.5), 1.0), 4) + 0.0
                    ELSE 0.0 END AS mom_growth_3m,
               CAST(round_even(date_diff('day', last_order, (SELECT d FROM as_of)) / 30.44::DOUBLE, 0) AS BIGINT) AS months_since_last_order,
               round_even(spread, 2) AS revenue_volatility, is_churned,
               CAST(round_even(date_diff('day', close_date, (SELECT d FROM as_of)) / 30.44::DOUBLE, 0) AS BIGINT) AS months_since_close
        FROM account_figures JOIN account_deals USING (account_id)""",
    "scored_risk": """
        SELECT *, CASE WHEN is_churned = 1 THEN 1.0 ELSE round_even(least(months_since_last_order / 12, 1.0), 4) END
                  AS churn_probability
        FROM account_summary""",
    "growth_ranks": """
        SELECT account_id, CASE WHEN mom_growth_3m IS NOT NULL THEN
               (rank() OVER (PARTITION BY industry ORDER BY mom_growth_3m)
                + (count(*) OVER (PARTITION BY industry, mom_growth_3m) - 1) / 2)
               / count(mom_growth_3m) OVER (PARTITION BY industry) END AS pct_rank
        FROM account_summary""",
    "scored_accounts": """
        SELECT *, CASE WHEN is_churned = 1 THEN 'Re-engage: launch win-back campaign within 30 days'
                       WHEN risk_tier = 'High' THEN 'Urgent: schedule QBR and offer renewal incentive'
                       WHEN risk_tier = 'Medium' AND growth_tier = 'High Potential'
                           THEN 'Expand: assign dedicated account manager, propose upsell'
                       WHEN risk_tier = 'Medium' AND growth_tier = 'Moderate'
                           THEN 'Nurture: increase touchpoint cadence, share case studies'
                       WHEN risk_tier = 'Low' AND growth_tier = 'High Potential'
                           THEN 'Scale: prioritise for co-marketing and trade investment'
                       ELSE 'Maintain: monitor quarterly' END AS recommended_action
        FROM (SELECT *, CASE WHEN growth_score >= 75 THEN 'High Potential' WHEN growth_score >= 40 THEN 'Moderate'
                        ELSE 'Stable/Declining' END AS growth_tier
              FROM (SELECT r.*, CASE WHEN churn_probability >= 0.60 THEN 'High' WHEN churn_probability >= 0.30
                           THEN 'Medium' ELSE 'Low' END AS risk_tier, round_even(pct_rank * 100, 1) AS growth_score
                    FROM scored_risk r JOIN growth_ranks USING (account_id)))""",
    "metric_facts": """
        SELECT CAST(ts AS DATE) AS date, event_type AS metric, count(*) AS events,
               sum(round(value * 100)) / 100 AS revenue FROM events GROUP BY 1, 2""",
    "metric_series": """
        SELECT date, metric, events, CASE WHEN metric = 'error' AND day(date) = 15 THEN revenue * 10
               WHEN metric = 'purchase' AND day(date) >= 20 THEN revenue * 4
               WHEN metric = 'signup' AND day(date) BETWEEN 5 AND 9 THEN NULL ELSE revenue END AS revenue
        FROM metric_facts""",
}

_NEEDS = {
    "media_spend": ["media_facts"],
    "contact_flags": ["contact_lines"],
    "crm_funnel": ["contact_flags"],
    "account_months": ["account_deals"],
    "account_revenue": ["account_months"],
    "account_figures": ["account_revenue", "as_of"],
    "account_summary": ["account_figures", "account_deals"],
    "scored_risk": ["account_summary"],
    "growth_ranks": ["account_summary"],
    "scored_accounts": ["scored_risk", "growth_ranks"],
    "metric_series": ["metric_facts"],
}


def over(views: str, body: str, **extra: str) -> str:
    """`body` with the named views (blank separated) and extra ones in front of it."""
    found: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in found:
            found.append(name)

    for view in views.split():
        add(view)
    parts = [f"{name} AS ({_VIEWS[name]})" for name in found] + [f"{n} AS ({text})" for n, text in extra.items()]
    return f"WITH {', '.join(parts)} {body}"
