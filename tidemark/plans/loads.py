"""Queries that write and read back: loads, run log, reports, quality rows, kept counts, file schemas."""

import datetime as dt
import uuid

from pyspark.sql import Window, functions as F

from tidemark.functions.scalars import round_to
from tidemark.operators import alerts, checks, funnel
from tidemark.plans import books, watch
from tidemark.plans.registry import query
from tidemark.plans.views import over
from tidemark.schemas import LAYERS, MEDIA_SPEND, REGISTRY
from tidemark.session import pin, scratch_folder
from tidemark.sources import bridge, ingest, layers, sinks, tables

_HALF = "1996-01-01"


def _layers(spark) -> str:
    """Databases of this query alone, in the shared scratch folder; their prefix."""
    prefix = f"q{uuid.uuid4().hex[:12]}_"
    layers.ensure_layers(spark, LAYERS, scratch_folder(spark, "layers"), prefix)
    layers.ensure_tables(spark, REGISTRY, prefix)
    return prefix


_DONE: dict[tuple[str, str], str] = {}


def _loaded(spark, folder) -> str:
    """Two source tables loaded in full up to a date, then the rest of both, then nothing new.

    Three queries look at the outcome, so the loads of a session and folder are made once.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _DONE:
        _DONE[key] = _load_twice(spark, folder)
    return _DONE[key]


def _load_twice(spark, folder) -> str:
    prefix, source = _layers(spark), scratch_folder(spark, "source")
    shop, media = bridge.offline_and_media(spark, folder)
    media = media.select(*[c for c in media.columns if c in MEDIA_SPEND.fieldNames()])
    for when, mode in ((f"week_start < '{_HALF}'", "full"), ("true", "incremental"), ("true", "incremental")):
        sinks.write_tables(source, offline_sales=shop.filter(when).drop("active_stores"), media_spend=media.filter(when))
        ingest.load_all(spark, source, mode, ("offline_sales", "media_spend"), prefix)
    return prefix


_WEEKS = "SELECT week_start, sum(total_revenue) AS total_revenue, CAST(sum(units_sold) AS BIGINT) AS units_sold FROM offline_sales GROUP BY 1"


@query(
    "load_readback",
    over(
        "offline_sales media_spend",
        """SELECT 'offline_sales' AS table_name, week_start, '' AS channel, round_even(total_revenue, 2) AS money, units_sold AS units, true AS stamped FROM w
           UNION ALL SELECT 'media_spend', week_start, channel, round_even(spend, 2), impressions, true FROM media_spend""",
        w=_WEEKS,
    ),
)
def _(spark, folder):
    """The rows of a full load and two incremental ones, as the tables have them afterwards."""
    prefix = _loaded(spark, folder)
    shop, media = (spark.table(f"{prefix}raw.{name}") for name in ("offline_sales", "media_spend"))
    stamped = F.col("ingested_at").isNotNull().alias("stamped")
    rows = shop.select(
        F.lit("offline_sales").alias("table_name"), "week_start", F.lit("").alias("channel"),
        round_to("total_revenue", 2).alias("money"), F.col("units_sold").alias("units"), stamped,
    )
    return rows.union(
        media.select(F.lit("media_spend"), "week_start", "channel", round_to("spend", 2), F.col("impressions"), stamped)
    )


@query(
    "run_log_readback",
    over(
        "offline_sales media_spend",
        f"""SELECT table_name, nth, CAST(n AS BIGINT) AS rows_ingested, 'success' AS status, '' AS error_message FROM (
            SELECT 'offline_sales' AS table_name, 1 AS nth, count(DISTINCT week_start) FILTER (WHERE week_start < DATE '{_HALF}') AS n FROM offline_sales
            UNION ALL SELECT 'offline_sales', 2, count(DISTINCT week_start) FILTER (WHERE week_start >= DATE '{_HALF}') FROM offline_sales
            UNION ALL SELECT 'media_spend', 1, count(*) FILTER (WHERE week_start < DATE '{_HALF}') FROM media_spend
            UNION ALL SELECT 'media_spend', 2, count(*) FILTER (WHERE week_start >= DATE '{_HALF}') FROM media_spend)""",
    ),
)
def _(spark, folder):
    """The run log after the same loads; the last load had nothing new and left no record."""
    log = spark.table(f"{_loaded(spark, folder)}{ingest.RUN_LOG}")
    nth = F.rank().over(Window.partitionBy("table_name").orderBy("run_at"))
    return log.select("table_name", nth.alias("nth"), "rows_ingested", "status", "error_message")


@query(
    "high_water_partitions",
    over("offline_sales media_spend", "SELECT 'offline_sales' AS table_name, max(week_start) AS high_water FROM offline_sales UNION ALL SELECT 'media_spend', max(week_start) FROM media_spend"),
)
def _(spark, folder):
    """The latest loaded date of each table, as the catalog knows it."""
    prefix = _loaded(spark, folder)
    rows = [(name, ingest.table_high_water(spark, f"{prefix}raw.{name}", "week_start")) for name in ("offline_sales", "media_spend")]
    return spark.createDataFrame(rows, "table_name string, high_water date")


@query("account_summary_readback", over("account_summary", "SELECT * FROM account_summary"))
def _(spark, folder):
    """The account table, written and read as the account questions do."""
    kept = scratch_folder(spark, "accounts")
    sinks.write_tables(kept, account_summary=books.summary(spark, folder))
    return tables.read_account_summary(spark, kept)


@query(
    "report_readback",
    over("crm_funnel", "SELECT lead_source, count(contact_id) AS leads, CAST(sum(reached_close) AS BIGINT) AS won, round_even(sum(reached_close) / greatest(count(contact_id), 1) * 100, 2) AS win_rate FROM crm_funnel GROUP BY 1"),
)
def _(spark, folder):
    """A table written as JSON documents and read again."""
    path = scratch_folder(spark, "report")
    rated = funnel.source_performance(bridge.crm_funnel(spark, folder, ()))
    sinks.write_report(rated, path)
    return spark.read.schema(rated.schema).json(path)


@query(
    "alerts_readback",
    over(
        "metric_series online_sales",
        """SELECT "table" AS table_name, coalesce(check_type, "check") AS check_type, CASE severity WHEN 'ok' THEN 'info' ELSE severity END AS severity,
                  count(*) AS rows, count(*) FILTER (WHERE severity = 'ok') AS passed, true AS identified FROM every GROUP BY 1, 2, 3""",
        **watch.COMBINED_VIEWS,
    ),
)
def _(spark, folder):
    """Alerts after they were appended to the quality table."""
    table = f"{_layers(spark)}monitoring.data_quality"
    alerts.write_alerts(watch.combined(spark, folder), table, watch.NOW)
    return spark.table(table).groupBy("table_name", "check_type", "severity").agg(
        F.count("*").alias("rows"), F.count_if("passed").alias("passed"),
        (F.count_distinct("check_id") == F.count("*")).alias("identified"),
    )


@query("kept_weekly_counts", "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS rows, max(ts) AS latest FROM events GROUP BY 1")
def _(spark, folder):
    """Weekly counts of a table that grows in three steps; each step counts its new files only."""
    events = pin(bridge.star(spark, folder, "events").select("event_id", "ts"))
    kept, state = scratch_folder(spark, "events"), scratch_folder(spark, "counts")
    weeks = None
    for when in ("ts < '2024-01-10'", "ts >= '2024-01-10' and ts < '2024-01-20'", "ts >= '2024-01-20' or ts is null"):
        events.filter(when).write.mode("append").parquet(kept)
        weeks = checks.keep_weekly_counts(spark, kept, "ts", state)
    return weeks


@query("check_kept_counts", f"{watch.fresh_sql('events', 'SELECT * FROM events', 'ts')} UNION ALL {watch.count_sql('events', 'SELECT * FROM events', 'ts')}")
def _(spark, folder):
    """Freshness and volume from kept counts."""
    kept, state = scratch_folder(spark, "events"), scratch_folder(spark, "counts")
    bridge.star(spark, folder, "events").select("event_id", "ts").write.parquet(kept)
    checks.keep_weekly_counts(spark, kept, "ts", state)
    return checks.check_kept_counts(checks.keep_weekly_counts(spark, kept, "ts", state), "events", watch.NOW)


@query(
    "check_file_schemas",
    """SELECT 'orders' AS table_name, 'file_schema' AS check, 'critical' AS status, 'Missing columns: [o_totalprice]; Changed types: [o_custkey: string is not bigint]' AS detail,
              n AS rows FROM (SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')""",
)
def _(spark, folder):
    """Orders in two folders, one of which lacks a column and has another type: found in the footers."""
    orders = bridge.star(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    kept = scratch_folder(spark, "orders")
    types = dict(orders.dtypes)
    orders.filter(F.col("o_orderdate") < F.lit(dt.datetime(1997, 1, 1))).write.parquet(f"{kept}/old")
    late = orders.filter(F.col("o_orderdate") >= F.lit(dt.datetime(1997, 1, 1)))
    late.withColumn("o_custkey", F.col("o_custkey").cast("string")).drop("o_totalprice").coalesce(1).write.parquet(f"{kept}/new")
    found = checks.check_file_schemas(spark, kept, "orders", types)
    without_name = F.regexp_replace("detail", "^[^;]*; ", "")
    rows = late.agg(F.count("*").alias("n")).select("n").scalar()
    return found.select("table_name", "check", "status", without_name.alias("detail"), rows.alias("rows"))
