"""Declared table schemas and the layer registry."""

from pyspark.sql import types as T

_KINDS = {
    "ts": T.TimestampType(),
    "date": T.DateType(),
    "str": T.StringType(),
    "int": T.LongType(),
    "num": T.DoubleType(),
    "bool": T.BooleanType(),
    "short": T.IntegerType(),
    "moment": T.TimestampNTZType(),
}


def _table(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k], True) for n, k in columns.items()])


ONLINE_SALES = _table(
    ingested_at="ts", date="date", channel="str", category="str", orders="int", revenue="num",
    avg_order_value="num", units_sold="int", returns="int", return_rate="num", promo_flag="int",
)

OFFLINE_SALES = _table(
    ingested_at="ts", week_start="date", region="str", store_format="str", category="str",
    active_stores="int", total_revenue="num", revenue_per_store="num", units_sold="int",
    avg_selling_price="num", promo_flag="int", distribution_pct="num",
)

CRM_FUNNEL = _table(
    ingested_at="ts", contact_id="str", lead_source="str", industry="str", lead_date="date",
    mql_date="date", sql_date="date", opportunity_date="date", close_date="date", outcome="str",
    deal_value="num", days_to_close="int", reached_mql="int", reached_sql="int",
    reached_opp="int", reached_close="int",
)

MEDIA_SPEND = _table(
    ingested_at="ts", week_start="date", channel="str", spend="num", impressions="int",
    clicks="int", conversions="int", cpm="num", ctr="num", cvr="num", cpc="num", cpa="num",
    roas="num", adstocked_spend="num", saturated_spend="num", incremental_revenue="num",
    media_contribution_pct="num",
)

ACCOUNT_REVENUE = _table(
    account_id="str", industry="str", lead_source="str", deal_size_band="str",
    close_date="date", month="date", monthly_revenue="num", months_since_close="int",
)

ACCOUNT_SUMMARY = _table(
    account_id="str", industry="str", lead_source="str", deal_size_band="str",
    close_date="date", deal_value="num", months_active="int", total_revenue="num",
    avg_monthly_revenue="num", last_3m_avg="num", prev_3m_avg="num", revenue_trend_slope="num",
    mom_growth_3m="num", months_since_last_order="int", revenue_volatility="num",
    is_churned="int", months_since_close="int",
)

PIPELINE_RUNS = _table(
    run_id="str", run_at="ts", table_name="str", rows_ingested="int", status="str",
    error_message="str", duration_secs="num",
)

DATA_QUALITY = _table(
    check_id="str", checked_at="ts", table_name="str", check_type="str", column_name="str",
    metric_value="num", threshold="num", passed="bool", severity="str", root_cause_hint="str",
)

MODEL_METRICS = _table(
    metric_id="str", recorded_at="ts", model_name="str", model_version="str",
    metric_name="str", metric_value="num", threshold="num", passed="bool",
)

LAYERS = ("raw", "staging", "mart", "ml", "monitoring")

REGISTRY = {
    ("raw", "online_sales"): ONLINE_SALES,
    ("raw", "offline_sales"): OFFLINE_SALES,
    ("raw", "crm_funnel"): CRM_FUNNEL,
    ("raw", "media_spend"): MEDIA_SPEND,
    ("monitoring", "pipeline_runs"): PIPELINE_RUNS,
    ("monitoring", "data_quality"): DATA_QUALITY,
    ("monitoring", "model_metrics"): MODEL_METRICS,
}

# The date column that new rows are told by, per raw table.
LOAD_DATES = {
    "online_sales": "date",
    "offline_sales": "week_start",
    "crm_funnel": "lead_date",
    "media_spend": "week_start",
}



def _texts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _with_lists(texts: tuple[str, ...], lists: tuple[str, ...]) -> T.StructType:
    listed = [T.StructField(n, T.ArrayType(T.StringType())) for n in lists]
    return T.StructType(_texts(*texts).fields + listed)


INSIGHT_REPORT = T.StructType(
    [
        T.StructField("executive_summary", T.StringType()),
        T.StructField(
            "revenue_performance",
            _with_lists(("headline", "online_vs_offline"), ("top_segments", "bottom_segments")),
        ),
        T.StructField(
            "channel_assessment",
            _with_lists((), ("top_performers", "underperformers", "budget_recommendations")),
        ),
        T.StructField(
            "funnel_health",
            _with_lists(("conversion_assessment", "lead_quality_notes"), ("sales_recommendations",)),
        ),
        T.StructField("risks", T.ArrayType(_texts("risk", "severity", "action"))),
        T.StructField("opportunities", T.ArrayType(_texts("opportunity", "estimated_impact", "timeframe"))),
        T.StructField("recommended_actions", T.ArrayType(_texts("action", "expected_impact", "urgency"))),
    ]
)

CHECK_RESULT = _table(
    table_name="str", check="str", status="str", detail="str", metric_value="num", threshold="num",
    root_cause_hint="str",
)

# The star schema that `sources.bridge` reads. A declared schema saves a look into the files.
STAR = {
    "region": _table(r_regionkey="short", r_name="str"),
    "nation": _table(n_nationkey="short", n_name="str", n_regionkey="short"),
    "customer": _table(c_custkey="int", c_name="str", c_nationkey="short", c_acctbal="num", c_mktsegment="str"),
    "supplier": _table(s_suppkey="int", s_name="str", s_nationkey="short", s_acctbal="num"),
    "part": _table(p_partkey="int", p_name="str", p_brand="str", p_type="str", p_size="short", p_retailprice="num"),
    "orders": _table(
        o_orderkey="int", o_custkey="int", o_orderstatus="str", o_totalprice="num", o_orderdate="moment",
        o_orderpriority="str",
    ),
    "lineitem": _table(
        l_orderkey="int", l_partkey="int", l_suppkey="int", l_linenumber="short", l_quantity="num",
        l_extendedprice="num", l_discount="num", l_tax="num", l_returnflag="str", l_linestatus="str",
        l_shipdate="moment",
    ),
    "events": _table(event_id="int", ts="moment", user_id="int", event_type="str", value="num", props="str"),
    "documents": _table(doc_id="int", text="str", lang="str", source="str", n_chars="int"),
}
