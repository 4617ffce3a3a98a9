"""Queries on scans, typed loads, filters, guards and row expressions."""

import datetime as dt

from pyspark.sql import functions as F, types as T

from tidemark import constants as C
from tidemark.functions import dates, scalars
from tidemark.functions.scalars import round_to
from tidemark.operators import accounts, filters, ranks, reports
from tidemark.operators.filters import FilterParams
from tidemark.plans.registry import query
from tidemark.plans.views import over
from tidemark.session import scratch_folder
from tidemark.sources import bridge, ingest, sinks, tables


@query("read_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, folder):
    schema = T.StructType(
        [T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
         T.StructField("o_totalprice", T.DoubleType())]
    )
    return tables.read_table(spark, folder, "orders", schema)


def _as_text(df, *columns):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in columns})


def _kept(spark, **named):
    """A folder with the named tables, written as a load would find them: dates as text."""
    folder = scratch_folder(spark, "tables")
    sinks.write_tables(folder, **named)
    return folder


@query("load_online_sales", over("online_sales", "SELECT date, channel, category, orders, round_even(revenue, 2) AS revenue FROM online_sales"))
def _(spark, folder):
    kept = _kept(spark, online_sales=_as_text(bridge.online_sales(spark, folder), "date"))
    return tables.load_online_sales(spark, kept).withColumn("revenue", round_to("revenue", 2))


@query("load_offline_sales", over("offline_sales", "SELECT * FROM offline_sales"))
def _(spark, folder):
    return tables.load_offline_sales(spark, _kept(spark, offline_sales=_as_text(bridge.offline_sales(spark, folder), "week_start")))


@query("load_media_spend", over("media_spend", "SELECT * FROM media_spend"))
def _(spark, folder):
    return tables.load_media_spend(spark, _kept(spark, media_spend=_as_text(bridge.media_spend(spark, folder), "week_start")))


@query(
    "load_crm_funnel",
    over(
        "crm_funnel",
        """SELECT contact_id, lead_date, mql_date, CASE WHEN outcome <> 'SQL Only' THEN sql_date END AS sql_date,
                  opportunity_date, CASE WHEN outcome = 'Closed Won' THEN close_date END AS close_date FROM crm_funnel""",
    ),
)
def _(spark, folder):
    text = _as_text(bridge.crm_funnel(spark, folder, ()), *C.CRM_DATE_COLUMNS).withColumns(
        {
            "sql_date": F.when(F.col("outcome") == "SQL Only", F.lit("2001-02-30")).otherwise(F.col("sql_date")),
            "close_date": F.coalesce("close_date", F.lit("pending")),
        }
    )
    return tables.load_crm_funnel(spark, _kept(spark, crm_funnel=text)).select("contact_id", *C.CRM_DATE_COLUMNS)


@query("high_water", over("offline_sales", "SELECT max(week_start) AS high_water FROM offline_sales"))
def _(spark, folder):
    return ingest.high_water(bridge.offline_sales(spark, folder, ()), "week_start")


@query("newer_rows", over("online_sales", "SELECT date, channel, orders FROM (SELECT date, channel, CAST(sum(orders) AS BIGINT) AS orders FROM online_sales GROUP BY 1, 2) WHERE date > DATE '2000-01-01'"))
def _(spark, folder):
    online = bridge.online_sales(spark, folder, ("channel",))
    return ingest.newer_rows(online, "date", dt.date(2000, 1, 1)).select("date", "channel", "orders")


@query("date_filter", over("crm_funnel", "SELECT contact_id, lead_date FROM crm_funnel WHERE lead_date >= DATE '1998-02-01' AND lead_date <= DATE '1998-04-30'"))
def _(spark, folder):
    crm = bridge.crm_funnel(spark, folder, ())
    return filters.date_filter(crm, "lead_date", "1998-02-01", "1998-04-30").select("contact_id", "lead_date")


@query("apply_filters", over("crm_funnel", "SELECT contact_id, lead_date, industry FROM crm_funnel WHERE lead_source = '5-LOW' AND industry = 'BUILDING' AND lead_date >= DATE '1996-01-01'"))
def _(spark, folder):
    params = FilterParams(start_date="1996-01-01", end_date="", channel="5-LOW", industry="BUILDING", region="ignored")
    crm = bridge.crm_funnel(spark, folder)
    found = filters.apply_filters(crm, "lead_date", params, {"channel": "lead_source"})
    return found.select("contact_id", "lead_date", "industry")


@query("closed_won", over("crm_funnel", "SELECT contact_id, deal_value, close_date FROM crm_funnel WHERE outcome = 'Closed Won'"))
def _(spark, folder):
    return filters.closed_won(bridge.crm_funnel(spark, folder, ())).select("contact_id", "deal_value", "close_date")


@query("require_won", over("crm_funnel", "SELECT contact_id, deal_value, close_date FROM crm_funnel WHERE deal_value IS NOT NULL AND close_date IS NOT NULL"))
def _(spark, folder):
    return filters.require_won(bridge.crm_funnel(spark, folder, ())).select("contact_id", "deal_value", "close_date")


@query(
    "reliability_warning",
    """SELECT 'all' AS range, CAST(NULL AS VARCHAR) AS warning UNION ALL
       SELECT 'none', 'No data matches the selected filters (orders).' UNION ALL
       SELECT 'few', 'Only ' || n || ' rows match the selected filters. Statistics and model outputs may be unreliable with fewer than 30 data points. Consider broadening your date range or removing dimension filters.'
       FROM (SELECT count(*) AS n FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) WHERE d BETWEEN DATE '1998-01-01' AND DATE '1998-01-20')""",
)
def _(spark, folder):
    daily = bridge.online_sales(spark, folder, ())
    few = filters.date_filter(daily, "date", "1998-01-01", "1998-01-20")
    none = filters.date_filter(daily, "date", "2030-01-01")
    cases = {"all": (daily, ""), "few": (few, ""), "none": (none, "orders")}
    found = [
        filters.reliability_warning(rows, about).select(F.lit(name).alias("range"), "warning")
        for name, (rows, about) in cases.items()
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    "long_enough",
    over(
        "online_sales",
        """SELECT channel, count(*) AS points FROM (SELECT DISTINCT channel, date FROM online_sales
) GROUP BY channel HAVING count(*) >= 60""",
    ),
)
def _(spark, folder):
    kept = filters.long_enough(bridge.online_sales(spark, folder, ("channel",)), ["channel"])
    return kept.groupBy("channel").agg(F.count("*").alias("points"))


@query(
    "safe_ratio",
    over("crm_funnel", "SELECT lead_date, round_even(coalesce(sum(deal_value), 0) / greatest(sum(reached_close), 1), 2) AS per_deal FROM crm_funnel GROUP BY 1"),
)
def _(spark, folder):
    daily = bridge.crm_funnel(spark, folder, ()).groupBy("lead_date").agg(
        scalars.sum_or_zero("deal_value").alias("value"), F.sum("reached_close").alias("won")
    )
    ratio = scalars.safe_ratio(F.col("value"), F.col("won"))
    return daily.select("lead_date", round_to(ratio, 2).alias("per_deal"))


@query("rename_project", over("online_sales", "SELECT date AS ds, channel AS series, CAST(sum(orders) AS DOUBLE) AS y FROM online_sales GROUP BY 1, 2"))
def _(spark, folder):
    online = bridge.online_sales(spark, folder, ("channel",))
    return online.select(F.col("date").alias("ds"), F.col("channel").alias("series"), F.col("orders").cast("double").alias("y"))


@query("fill_nulls", over("crm_funnel", "SELECT contact_id, coalesce(days_to_close, 0) AS days_to_close, coalesce(deal_value, 0) AS deal_value FROM crm_funnel"))
def _(spark, folder):
    crm = bridge.crm_funnel(spark, folder, ()).select("contact_id", "days_to_close", "deal_value")
    return crm.fillna(0, ["days_to_close", "deal_value"])


@query("clip", over("crm_funnel", "SELECT contact_id, CASE WHEN days_to_close IS NOT NULL THEN least(greatest(days_to_close, 0), 365) END AS days FROM crm_funnel"))
def _(spark, folder):
    crm = bridge.crm_funnel(spark, folder, ())
    return crm.select("contact_id", scalars.clip(F.col("days_to_close"), 0, 365).cast("long").alias("days"))


@query(
    "deal_size_band",
    """SELECT CASE WHEN l_extendedprice < 20000 THEN 'Small' WHEN l_extendedprice <= 60000 THEN 'Mid' ELSE 'Large' END AS band,
              count(*) AS rows, min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest FROM lineitem GROUP BY 1""",
)
def _(spark, folder):
    line = bridge.star(spark, folder, "lineitem")
    band = scalars.deal_size_band(F.col("l_extendedprice")).alias("band")
    return line.groupBy(band).agg(
        F.count("*").alias("rows"), F.min("l_extendedprice").alias("lowest"), F.max("l_extendedprice").alias("highest")
    )


def _window_sql():
    lifts = " * ".join(
        f"CASE WHEN (month(date) = {a} AND day(date) >= {b}) OR (month(date) = {c} AND day(date) <= {d}) THEN {lift}::DOUBLE ELSE 1.0::DOUBLE END"
        for a, b, c, d, lift in ((2, 10, 2, 14, 1.2), (5, 25, 5, 27, 1.25), (7, 4, 7, 6, 1.15), (11, 25, 11, 30, 1.55), (12, 20, 12, 26, 1.45), (12, 30, 12, 31, 1.1))
    )
    return over("online_sales", "SELECT date, round_even(lift, 6) AS lift, CAST(lift > 1 AS INT) AS promo_flag FROM l", l=f"SELECT DISTINCT date, {lifts} AS lift FROM online_sales")


@query("promo_windows", _window_sql())
def _(spark, folder):
    lift = dates.window_lift(F.col("date"))
    daily = bridge.online_sales(spark, folder, ())
    return daily.select("date", round_to(lift, 6).alias("lift"), (lift > 1).cast("int").alias("promo_flag"))


@query(
    "promo_months",
    over(
        "offline_sales",
        """SELECT DISTINCT week_start, CASE month(week_start) WHEN 2 THEN 1.12::DOUBLE WHEN 5 THEN 1.18::DOUBLE WHEN 7 THEN 1.1::DOUBLE
                  WHEN 11 THEN 1.4::DOUBLE WHEN 12 THEN 1.35::DOUBLE ELSE 1.0::DOUBLE END AS lift,
                  CAST(month(week_start) IN (2, 5, 7, 11, 12) AS INT) AS promo_flag FROM offline_sales""",
    ),
)
def _(spark, folder):
    lift = dates.month_lift(F.col("week_start"))
    weeks = bridge.offline_sales(spark, folder, ())
    return weeks.select("week_start", lift.alias("lift"), (lift > 1).cast("int").alias("promo_flag"))


@query(
    "attach_deal_value",
    over(
        "crm_funnel",
        """SELECT CAST(customer_id AS VARCHAR) AS account_id, count(*) AS leads, min(deal) AS deal_value FROM crm_funnel
           JOIN (SELECT customer_id, arg_min(deal_value, (close_date, deal_value)) AS deal FROM crm_funnel
                 WHERE deal_value IS NOT NULL GROUP BY 1) USING (customer_id) GROUP BY 1""",
    ),
)
def _(spark, folder):
    crm = bridge.crm_funnel(spark, folder, ()).withColumn("account_id", F.col("customer_id").cast("string"))
    leads = crm.groupBy("account_id").agg(F.count("*").alias("leads"))
    return accounts.attach_deal_value(leads, filters.require_won(crm))


@query(
    "union_series",
    over(
        "online_sales offline_sales",
        """SELECT 'online' AS source, date AS period, round_even(sum(revenue), 2) AS revenue FROM online_sales GROUP BY 2
           UNION ALL SELECT 'offline', week_start, round_even(sum(total_revenue), 2) FROM offline_sales GROUP BY 2""",
    ),
)
def _(spark, folder):
    web = bridge.online_sales(spark, folder, ()).select(F.lit("online").alias("source"), F.col("date").alias("period"), "revenue")
    shop = bridge.offline_sales(spark, folder, ()).select(
        F.col("week_start").alias("period"), F.col("total_revenue").alias("revenue"), F.lit("offline").alias("source")
    )
    return web.unionByName(shop).withColumn("revenue", round_to("revenue", 2))


@query(
    "describe",
    over(
        "account_revenue",
        """SELECT unnest(['count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) AS statistic,
                  round_even(unnest([count(x)::DOUBLE, avg(x), stddev_samp(x), min(x), quantile_cont(x, 0.25), quantile_cont(x, 0.5),
                  quantile_cont(x, 0.75), max(x)]), 4) AS value FROM (SELECT monthly_revenue AS x FROM account_revenue)""",
    ),
)
def _(spark, folder):
    found = ranks.describe(bridge.account_books(spark, folder)[1], "monthly_revenue")
    return found.select("statistic", round_to("value", 4).alias("value"))


@query(
    "exact_quantiles",
    """SELECT l_returnflag, prob, round_even(quantile, 4) AS quantile FROM (
         SELECT l_returnflag, unnest([0.1, 0.5, 0.9])::DOUBLE AS prob, unnest(quantile_cont(l_extendedprice, [0.1, 0.5, 0.9])) AS quantile
         FROM lineitem GROUP BY 1)""",
)
def _(spark, folder):
    line = bridge.star(spark, folder, "lineitem")
    found = ranks.exact_quantiles(line, "l_extendedprice", (0.1, 0.5, 0.9), ["l_returnflag"])
    return found.withColumn("quantile", round_to("quantile", 4))


@query(
    "shorten",
    """SELECT doc_id, CASE WHEN instr(text, '. ') BETWEEN 1 AND 90 THEN substr(text, 1, instr(text, '. ') - 1)
              WHEN length(text) > 90 THEN substr(text, 1, 90) || '…' ELSE text END AS headline FROM documents""",
)
def _(spark, folder):
    documents = bridge.star(spark, folder, "documents")
    return documents.select("doc_id", reports.headline(F.col("text")).alias("headline"))


@query(
    "report_fields",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
              CASE WHEN event_type = 'error' THEN 'no ' || props END AS raw_response FROM events""",
)
def _(spark, folder):
    props, kind = F.col("props"), F.col("event_type")
    text = (
        F.when(kind == "error", F.concat(F.lit("no "), props))
        .when(kind == "view", F.concat(F.lit("Here it is:\n```json\n"), props, F.lit("\n```\nDone.")))
        .when(kind == "click", F.concat(F.lit("```\n"), props, F.lit("\n```")))
        .otherwise(props)
    )
    events = bridge.star(spark, folder, "events").select("event_id", text.alias("text"))
    parsed = reports.report_fields(events, "text", T.StructType([T.StructField("k", T.LongType())]))
    return parsed.select("event_id", "report.k", "raw_response")


@query(
    "first_entries",
    over(
        "metric_facts",
        """SELECT metric, position, entry FROM (SELECT metric, date AS entry,
             row_number() OVER (PARTITION BY metric ORDER BY events DESC, date) AS position FROM metric_facts) WHERE position <= 3""",
    ),
)
def _(spark, folder):
    """The busiest days of each metric, out of a list with one entry per day."""
    days = F.array_sort(F.collect_list(F.struct((-F.col("events")).alias("down"), "date")))
    listed = bridge.metric_facts(spark, folder).groupBy("metric").agg(days.alias("days"))
    found = reports.first_entries(listed, "days", 3, ["metric"])
    return found.select("metric", F.col("position").cast("long").alias("position"), F.col("entry.date").alias("entry"))
