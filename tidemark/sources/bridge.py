"""Business tables in the engine's shapes, derived from a TPC-H-like star schema.

Money is added up in whole cents held in doubles, so a sum does not depend on the order in
which tasks deliver it. Each builder joins only the dimensions that the caller asks for. Bounds on a table's
own date (`start`, `end`) become bounds on the raw date, so the scan can skip what is outside.
"""

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark import constants as C
from tidemark.functions import dates, scalars
from tidemark.operators.buckets import month_spine
from tidemark.operators.filters import FilterParams, only_keys, period_filter
from tidemark.schemas import STAR
from tidemark.session import pin
from tidemark.sources.tables import read_table

CHANNELS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def star(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, folder, name, STAR[name])


def _day(name: str) -> Column:
    return F.col(name).cast("date")


def _cents(money: Column) -> Column:
    return F.rint(money * 100)


def _share_cents(money: Column, share: Column) -> Column:
    """Whole cents of money × share, for a share in whole percent."""
    return F.floor(_cents(money) * F.rint(share * 100) / 100 + 0.5).cast("double")


def _sum_money(cents: Column) -> Column:
    return F.sum(cents) / 100


def online_sales(spark: SparkSession, folder: str, dims=("channel", "category"), start=None, end=None) -> DataFrame:
    """Day × channel × category from orders and customers."""
    orders = period_filter(star(spark, folder, "orders"), "o_orderdate", "day", start, end)
    if "category" in dims:
        customer = star(spark, folder, "customer")
        orders = orders.join(customer, orders.o_custkey == customer.c_custkey)
    named = {"channel": "o_orderpriority", "category": "c_mktsegment"}
    return (
        orders.groupBy(_day("o_orderdate").alias("date"), *[F.col(named[d]).alias(d) for d in dims])
        .agg(F.count("*").alias("orders"), _sum_money(_cents(F.col("o_totalprice"))).alias("revenue"))
    )


def _lines(spark: SparkSession, folder: str, start=None, end=None) -> DataFrame:
    line = period_filter(star(spark, folder, "lineitem"), "l_shipdate", "week", start, end)
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    return line.select(
        "l_partkey", "l_suppkey", "l_returnflag", "l_quantity",
        dates.week_period(_day("l_shipdate")).alias("week_start"),
        _share_cents(price, 1 - discount).alias("net_cents"),
        _share_cents(price, discount).alias("off_cents"),
    )


def _places(spark: SparkSession, folder: str) -> DataFrame:
    return (
        star(spark, folder, "supplier")
        .join(star(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(star(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "r_name")
    )


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    return star(spark, folder, "part").select("p_partkey", "p_type")


_OFFLINE_KEYS = {"region": "r_name", "store_format": "p_type", "category": "l_returnflag"}


def offline_sales(
    spark: SparkSession, folder: str, dims=("region", "store_format", "category"), start=None, end=None
) -> DataFrame:
    """Week × region × format × category from order lines and their dimensions."""
    lines = _lines(spark, folder, start, end)
    if "region" in dims:
        lines = lines.join(_places(spark, folder), F.col("l_suppkey") == F.col("s_suppkey"))
    if "store_format" in dims:
        lines = lines.join(_parts(spark, folder), F.col("l_partkey") == F.col("p_partkey"))
    return (
        lines.groupBy("week_start", *[F.col(_OFFLINE_KEYS[d]).alias(d) for d in dims])
        .agg(
            F.count("*").alias("active_stores"),
            _sum_money(F.col("net_cents")).alias("total_revenue"),
            F.sum("l_quantity").cast("long").alias("units_sold"),
        )
    )


def _media_ratios(facts: DataFrame) -> DataFrame:
    ratios = scalars.media_ratios()
    ratios["roas"] = scalars.safe_ratio(F.col("incremental_revenue"), F.col("spend"))
    return facts.withColumns(ratios)


def media_spend(spark: SparkSession, folder: str, start=None, end=None) -> DataFrame:
    """Week × channel from order lines and parts, with the derived ratios."""
    facts = (
        _lines(spark, folder, start, end)
        .join(_parts(spark, folder), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("week_start", F.col("p_type").alias("channel"))
        .agg(
            _sum_money(F.col("off_cents")).alias("spend"),
            F.sum("l_quantity").cast("long").alias("impressions"),
            F.count("*").alias("clicks"),
            F.count_if(F.col("l_returnflag") == "N").alias("conversions"),
            _sum_money(F.col("net_cents")).alias("incremental_revenue"),
        )
    )
    return _media_ratios(facts)


def line_cube(spark: SparkSession, folder: str, dims=(), start=None, end=None) -> DataFrame:
    """Sums of the order lines for both offline sales (by `dims`) and media spend, in one aggregate with two grouping sets.

    A line without a supplier's region or a part counts for the table that does not need it.
    """
    lines = _lines(spark, folder, start, end).join(_parts(spark, folder), F.col("l_partkey") == F.col("p_partkey"), "left")
    paid = F.col("p_partkey").isNotNull()
    sold = paid if "store_format" in dims else F.lit(True)
    if "region" in dims:
        lines = lines.join(_places(spark, folder), F.col("l_suppkey") == F.col("s_suppkey"), "left")
        sold = sold & F.col("s_suppkey").isNotNull()
    keyed = lines.select(
        "week_start", *[F.col(_OFFLINE_KEYS[d]).alias(d) for d in dims], sold.alias("sold"), F.col("p_type").alias("channel"),
        paid.alias("paid"), "net_cents", "off_cents", "l_quantity", "l_returnflag",
    )
    shop, media = ["week_start", *dims, "sold"], ["week_start", "channel", "paid"]
    return keyed.groupingSets([shop, media], *dict.fromkeys(shop + media)).agg(
        F.grouping("channel").alias("is_shop"), F.count("*").alias("rows"), F.sum("l_quantity").cast("long").alias("units"),
        F.count_if(F.col("l_returnflag") == "N").alias("returned"),
        _sum_money(F.col("net_cents")).alias("net"), _sum_money(F.col("off_cents")).alias("off"),
    )


def offline_and_media(spark: SparkSession, folder: str, dims=(), start=None, end=None) -> tuple[DataFrame, DataFrame]:
    """offline_sales (by `dims`) and media_spend from one pass over the order lines."""
    cube = pin(line_cube(spark, folder, dims, start, end))
    shop = cube.filter("is_shop = 1 and sold").select(
        "week_start", *dims, F.col("rows").alias("active_stores"), F.col("net").alias("total_revenue"), F.col("units").alias("units_sold")
    )
    facts = cube.filter("is_shop = 0 and paid").select(
        "week_start", "channel", F.col("off").alias("spend"), F.col("units").alias("impressions"), F.col("rows").alias("clicks"),
        F.col("returned").alias("conversions"), F.col("net").alias("incremental_revenue"),
    )
    return shop, _media_ratios(facts)


def contact_lines(lines: DataFrame) -> DataFrame:
    """What an order's lines say about its contact."""
    flag, status, shipped = F.col("l_returnflag") == "A", F.col("l_linestatus") == "F", _day("l_shipdate")
    return lines.groupBy("l_orderkey").agg(
        F.bool_or(status).alias("any_f"),
        F.bool_or(flag).alias("any_a"),
        F.min(shipped).alias("first_ship"),
        F.min(F.when(status, shipped)).alias("first_f"),
        F.min(F.when(flag, shipped)).alias("first_a"),
        F.max(shipped).alias("last_ship"),
    )


def crm_funnel(spark: SparkSession, folder: str, dims=("industry",), params: FilterParams | None = None) -> DataFrame:
    """One contact per order; the stages follow from the order's lines.

    With `params`, the orders are picked first, and only their lines are aggregated.
    """
    lead = _day("o_orderdate")
    orders = star(spark, folder, "orders")
    lines = star(spark, folder, "lineitem")
    if "industry" in dims:
        customer = star(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("industry"))
        orders = orders.join(customer, orders.o_custkey == customer.c_custkey)
    if params is not None:
        orders = period_filter(orders, "o_orderdate", "day", params.start_date, params.end_date)
        named = {"lead_source": "o_orderpriority", **{d: d for d in dims}}
        for name, value in params.equalities().items():
            if name in named:
                orders = orders.filter(F.col(named[name]) == value)
        orders = pin(orders)
        lines = only_keys(lines, "l_orderkey", orders, "o_orderkey")
    seen = contact_lines(lines)
    joined = orders.join(seen, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    mql = F.col("l_orderkey").isNotNull()
    sql = mql & F.col("any_f")
    opp = sql & F.col("any_a")
    won = opp & (F.col("o_orderstatus") == "F")
    outcome = (
        F.when(won, C.CLOSED_WON)
        .when(opp & (F.col("o_orderstatus") == "O"), "Closed Lost")
        .when(opp, "In Progress")
        .when(sql, "SQL Only")
        .when(mql, "MQL Only")
        .otherwise("Lead Only")
    )
    return joined.select(
        F.col("o_orderkey").cast("string").alias("contact_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderpriority").alias("lead_source"),
        *[d for d in dims],
        lead.alias("lead_date"),
        F.col("first_ship").alias("mql_date"),
        F.when(sql, F.col("first_f")).alias("sql_date"),
        F.when(opp, F.col("first_a")).alias("opportunity_date"),
        F.when(won, F.col("last_ship")).alias("close_date"),
        outcome.alias("outcome"),
        F.when(won, F.col("o_totalprice")).alias("deal_value"),
        F.when(won, dates.days_between(F.col("last_ship"), lead)).alias("days_to_close"),
        *[
            F.coalesce(flag_, F.lit(False)).cast("int").alias(name)
            for name, flag_ in zip(("reached_mql", "reached_sql", "reached_opp", "reached_close"), (mql, sql, opp, won))
        ],
    )


def customer_months(spark: SparkSession, folder: str) -> DataFrame:
    """Customer × month: revenue, the earliest order and the latest day. All account tables come from it.

    Pinned, so that the orders are read once. The earliest order of a customer is the earliest of a month's.
    """
    first = F.min(F.struct(_day("o_orderdate").alias("close_date"), "o_orderkey", "o_totalprice", "o_orderpriority"))
    by_month = star(spark, folder, "orders").groupBy("o_custkey", dates.month_period(_day("o_orderdate")).alias("month"))
    return pin(
        by_month.agg(_sum_money(_cents(F.col("o_totalprice"))).alias("revenue"), first.alias("d"), F.max(_day("o_orderdate")).alias("last_day"))
    )


def account_deals(spark: SparkSession, folder: str, months: DataFrame | None = None) -> DataFrame:
    """One row per customer: the first order closes the deal."""
    months = customer_months(spark, folder) if months is None else months
    deals = months.groupBy("o_custkey").agg(F.min("d").alias("d"))
    customer = star(spark, folder, "customer")
    return deals.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").cast("string").alias("account_id"),
        F.col("c_mktsegment").alias("industry"),
        F.col("d.o_orderpriority").alias("lead_source"),
        scalars.deal_size_band(F.col("d.o_totalprice")).alias("deal_size_band"),
        F.col("d.close_date").alias("close_date"),
        F.col("d.o_totalprice").alias("deal_value"),
    )


def account_as_of(months: DataFrame) -> dt.date:
    """The end of the month of the latest order (today for no orders)."""
    last = months.agg(F.last_day(F.max("last_day")).alias("d")).first()["d"]
    return last or dt.date.today()


def account_revenue(deals: DataFrame, months: DataFrame, as_of: dt.date) -> DataFrame:
    """Account × month after the close in whole units of money, silent months at 0.

    The earned months go to their account as one map, before the months are spread: only the accounts are joined, and
    the spread rows stay where their account is.
    """
    entry = F.struct("month", F.rint("revenue").alias("monthly_revenue"))
    earned = months.filter(F.col("month").isNotNull()).groupBy(F.col("o_custkey").cast("string").alias("account_id")).agg(
        F.map_from_entries(F.collect_list(entry)).alias("_earned")
    )
    spine = month_spine(deals.drop("deal_value").join(earned, "account_id", "left"), "close_date", as_of)
    rest = [c for c in deals.columns if c not in ("account_id", "deal_value")]
    found = spine.select("account_id", "month", *rest, "months_since_close", F.try_element_at("_earned", F.col("month")).alias("monthly_revenue"))
    return found.fillna(0.0, ["monthly_revenue"])


def account_books(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dt.date]:
    """Deals, monthly revenue and as-of date of all accounts from one scan of the orders."""
    months = customer_months(spark, folder)
    deals, as_of = pin(account_deals(spark, folder, months)), account_as_of(months)
    return deals, account_revenue(deals, months, as_of), as_of


def metric_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Day × event type."""
    day = F.col("ts").cast("date")
    return (
        star(spark, folder, "events")
        .groupBy(day.alias("date"), F.col("event_type").alias("metric"))
        .agg(F.count("*").alias("events"), _sum_money(_cents(F.col("value"))).alias("revenue"))
    )


def metric_series(spark: SparkSession, folder: str) -> DataFrame:
    """metric_facts with a planted outlier, a planted step and planted nulls, for the alert queries."""
    kind, dom = F.col("metric"), F.dayofmonth("date")
    planted = (
        F.when((kind == "error") & (dom == 15), F.col("revenue") * 10)
        .when((kind == "purchase") & (dom >= 20), F.col("revenue") * 4)
        .when((kind == "signup") & dom.between(5, 9), F.lit(None))
        .otherwise(F.col("revenue"))
    )
    return metric_facts(spark, folder).withColumn("revenue", planted)
