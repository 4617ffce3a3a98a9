"""Queries on anomaly alerts and table checks."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.scalars import round_to
from tidemark.operators import alerts, anomaly, checks
from tidemark.plans.registry import query
from tidemark.plans.views import over
from tidemark.sources import bridge

_KEY = ["metric"]


def _text(words: str) -> str:
    """A message text as an SQL string."""
    return "'" + words.replace("'", "''") + "'"


NOW = dt.datetime(2024, 2, 4, 12, 0)


def _flat(found):
    """Alerts with the range in two columns and rounded numbers."""
    flat = found.withColumns({"lo": F.col("expected_range.lo"), "hi": F.col("expected_range.hi")}).drop("expected_range")
    return flat.withColumns({c: round_to(c, 2) for c in ("value", "lo", "hi")})


def _alert_sql(column, value, lo, hi, severity, hint, kind, source, where, date="strftime(date, '%Y-%m-%d')", key="metric"):
    return f"""SELECT {key} AS metric, 'events' AS table_name, {column} AS column_name, {date} AS date, round_even(round_even({value}, 4), 2) AS value,
        round_even(round_even({lo}, 4), 2) AS lo, round_even(round_even({hi}, 4), 2) AS hi, {severity} AS severity, {hint} AS root_cause_hint,
        '{kind}' AS check_type FROM {source} WHERE {where}"""


_LONG = "SELECT metric, date, 'revenue' AS c, revenue AS x FROM metric_series UNION ALL SELECT metric, date, 'events', events FROM metric_series"
_FILLED = "SELECT metric, date, c, last_value(x IGNORE NULLS) OVER (PARTITION BY metric, c ORDER BY date ROWS UNBOUNDED PRECEDING) AS x FROM long"


def _z_parts(source):
    return {
        "zs": f"""SELECT *, avg(x) OVER w AS m, stddev_samp(x) OVER w AS s, abs(x - avg(x) OVER w) / stddev_pop(x) OVER w AS z
                  FROM {source} WHERE x IS NOT NULL WINDOW w AS (PARTITION BY metric, c)"""
    }


_Z_BODY = _alert_sql(
    "c", "x", "m - 3 * s", "m + 3 * s", "CASE WHEN z > 4.5 THEN 'critical' ELSE 'warning' END",
    f"printf({_text(C.Z_HINT % '%.1f')}, z)",
    "zscore", "zs", "z > 3",
)


def _shift_parts(source):
    return {
        "rolled": f"""SELECT metric, date, c, CASE WHEN count(x) OVER w >= 2 THEN avg(x) OVER w END AS mean FROM {source}
                      WINDOW w AS (PARTITION BY metric, c ORDER BY date ROWS 3 PRECEDING)""",
        "moved": "SELECT metric, date, c, abs(mean / lag(mean) OVER (PARTITION BY metric, c ORDER BY date) - 1) AS p FROM rolled",
    }


_SHIFT_BODY = _alert_sql(
    "c", "p", "0.0::DOUBLE", "0.4::DOUBLE", "'warning'",
    f"printf({_text(C.SHIFT_HINT.replace('%s', '%.1f', 1))}, p * 100, c)",
    "level_shift", "moved", "p > 0.4",
)


@query("zscore_alerts", over("metric_series", _Z_BODY, long=_LONG, **_z_parts("long")))
def _(spark, folder):
    series = bridge.metric_series(spark, folder)
    return _flat(anomaly.zscore_alerts(series, "date", ["revenue", "events"], "events", keys=_KEY))


@query("level_shift_alerts", over("metric_series", _SHIFT_BODY, long=_LONG, **_shift_parts("long")))
def _(spark, folder):
    series = bridge.metric_series(spark, folder)
    return _flat(anomaly.level_shift_alerts(series, "date", ["revenue", "events"], "events", keys=_KEY))


@query(
    "iqr_alerts",
    over(
        "metric_series",
        _alert_sql("c", "x", "q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)", "'warning'",
                   f"printf({_text(C.IQR_HINT)}, c)", "iqr", "q",
                   "x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)"),
        long=_LONG,
        q="SELECT * FROM long JOIN (SELECT metric, c, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM long GROUP BY 1, 2) USING (metric, c) WHERE x IS NOT NULL",
    ),
)
def _(spark, folder):
    series = bridge.metric_series(spark, folder)
    return _flat(anomaly.iqr_alerts(series, "date", ["revenue", "events"], "events", keys=_KEY))


_RATES = "SELECT count(*) FILTER (WHERE {c} IS NULL) / count(*) AS rate, '{c}' AS c FROM crm_funnel"
_CRM_COLUMNS = ("mql_date", "sql_date", "opportunity_date", "close_date", "outcome", "deal_value", "days_to_close")
_ALL_RATES = " UNION ALL ".join(_RATES.format(c=c) for c in _CRM_COLUMNS)


@query("null_rates", over("crm_funnel", "SELECT c AS column_name, round_even(rate, 8) AS null_rate FROM r", r=_ALL_RATES))
def _(spark, folder):
    crm = bridge.crm_funnel(spark, folder, ()).select("lead_date", *_CRM_COLUMNS)
    return anomaly.null_rates(crm, ["lead_date"]).withColumn("null_rate", round_to("null_rate", 8))


def _null_sql(rates, key):
    return _alert_sql(
        "c", "rate", "0.0::DOUBLE", "0.1::DOUBLE", "CASE WHEN rate > 0.3 THEN 'critical' ELSE 'warning' END",
        f"printf({_text(C.NULL_HINT)}, rate * 100, c)",
        "null_spike", rates, "rate > 0.1", "'overall'", key,
    )


@query("null_spike_alerts", "SELECT * EXCLUDE (metric) FROM (" + over("crm_funnel", _null_sql("r", "NULL"), r=_ALL_RATES) + ")")
def _(spark, folder):
    crm = bridge.crm_funnel(spark, folder, ()).select("lead_date", *_CRM_COLUMNS)
    return _flat(anomaly.null_spike_alerts(crm, "events", ["lead_date"]))


_SERIES_RATES = " UNION ALL ".join(
    f"SELECT count(*) FILTER (WHERE {c} IS NULL) / count(*) AS rate, '{c}' AS c FROM metric_series" for c in ("revenue", "events")
)
def _anomalies(spark, folder):
    """Every series with its alerts."""
    series = bridge.metric_series(spark, folder)
    return anomaly.detect_anomalies(series, "date", ["revenue", "events", "absent"], "events", keys=_KEY)


_ANOMALIES = over(
    "metric_series",
    f"{_null_sql('rates', 'CAST(NULL AS VARCHAR)')} UNION ALL {_Z_BODY} UNION ALL {_SHIFT_BODY}",
    rates=_SERIES_RATES,
    long=_LONG, filled=_FILLED, **_z_parts("filled"), **_shift_parts("filled"),
)


@query("detect_anomalies", _ANOMALIES)
def _(spark, folder):
    return _flat(_anomalies(spark, folder))


@query("rows_per_week", "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS rows FROM events GROUP BY 1")
def _(spark, folder):
    events = bridge.star(spark, folder, "events").withColumn("date", F.col("ts").cast("date"))
    return checks.rows_per_week(events, "date")


def _events(spark, folder):
    return bridge.star(spark, folder, "events").withColumn("date", F.col("ts").cast("date"))


_EVENTS = "SELECT *, CAST(ts AS DATE) AS date FROM events"


def fresh_sql(name, source, day, now="TIMESTAMP '2024-02-04 12:00:00'"):
    return f"""SELECT '{name}' AS table_name, 'freshness' AS check,
        CASE WHEN n = 0 OR age >= 7 THEN 'critical' WHEN age >= 3 THEN 'warning' ELSE 'ok' END AS status,
        CASE WHEN n = 0 THEN {_text(C.EMPTY_DETAIL)} ELSE printf({_text(C.FRESH_DETAIL)}, strftime(latest, '%Y-%m-%d'), age) END AS detail,
        CAST(age AS DOUBLE) AS metric_value, CASE WHEN n > 0 THEN 3.0::DOUBLE END AS threshold,
        CASE WHEN n = 0 THEN {_text(C.EMPTY_HINT)}
             WHEN age >= 7 THEN printf({_text(C.STALE_HINT)}, age)
             WHEN age >= 3 THEN printf({_text(C.LATE_HINT)}, age) END AS root_cause_hint
        FROM (SELECT n, latest, CAST(floor((epoch({now}) - epoch(latest)) / 86400) AS BIGINT) AS age
              FROM (SELECT count(*) AS n, max({day}) AS latest FROM ({source})))"""


def count_sql(name, source, day):
    return f"""SELECT '{name}' AS table_name, 'row_count' AS check,
        CASE WHEN total < 8 THEN 'warning' WHEN periods < 5 THEN 'ok' WHEN p >= 0.6 THEN 'critical' WHEN p >= 0.4 THEN 'warning' ELSE 'ok' END AS status,
        CASE WHEN total < 8 THEN {_text(C.TOO_FEW_ROWS_DETAIL)} WHEN periods < 5 THEN {_text(C.TOO_FEW_PERIODS_DETAIL)}
             ELSE printf({_text(C.ROWS_DETAIL)}, recent, before) END AS detail,
        CASE WHEN total >= 8 AND periods >= 5 THEN round_even(p, 4) END AS metric_value,
        CASE WHEN total >= 8 AND periods >= 5 THEN 0.4::DOUBLE END AS threshold,
        CASE WHEN total >= 8 AND periods >= 5 AND p >= 0.4 THEN printf({_text(C.ROWS_HINT)}, p * 100, recent, before) END AS root_cause_hint
        FROM (SELECT *, (before - recent) / greatest(before, 1) AS p FROM (
              SELECT coalesce(sum(n), 0) AS total, count(*) AS periods, CAST(max(n) FILTER (WHERE back = 1) AS DOUBLE) AS recent,
                     avg(n) FILTER (WHERE back BETWEEN 2 AND 5) AS before
              FROM (SELECT n, row_number() OVER (ORDER BY wk DESC) AS back FROM (
                    SELECT date_trunc('week', {day}) AS wk, count(*) AS n FROM ({source}) GROUP BY 1))))"""


@query("check_freshness", fresh_sql("events", _EVENTS, "date"))
def _(spark, folder):
    return checks.check_freshness(_events(spark, folder), "date", "events", NOW)


@query("check_row_count", count_sql("events", _EVENTS, "date"))
def _(spark, folder):
    return checks.check_row_count(_events(spark, folder), "date", "events")


@query("check_row_count_weeks", over("online_sales", count_sql("online", "SELECT * FROM online_sales", "date")))
def _(spark, folder):
    return checks.check_row_count(bridge.online_sales(spark, folder), "date", "online")


def _schema_sql(name, missing):
    if not missing:
        return f"SELECT '{name}' AS table_name, 'schema_drift' AS check, 'ok' AS status, {_text(C.SCHEMA_OK_DETAIL)} AS detail, NULL::DOUBLE AS metric_value, NULL::DOUBLE AS threshold, NULL::VARCHAR AS root_cause_hint"
    return f"SELECT '{name}' AS table_name, 'schema_drift' AS check, 'critical' AS status, {_text(C.MISSING_DETAIL % [missing])} AS detail, NULL::DOUBLE AS metric_value, NULL::DOUBLE AS threshold, {_text(C.SCHEMA_HINT)} AS root_cause_hint"


_CHECKS = " UNION ALL ".join(
    [
        fresh_sql("events", _EVENTS, "date"), count_sql("events", _EVENTS, "date"), _schema_sql("events", "channel"),
        fresh_sql("online", "SELECT * FROM online_sales", "date"), count_sql("online", "SELECT * FROM online_sales", "date"),
        _schema_sql("online", None),
    ]
)


def _checked(spark, folder):
    return checks.run_all_checks(
        {
            "events": (_events(spark, folder), "date", ["event_id", "channel"]),
            "online": (bridge.online_sales(spark, folder), "date", ["date", "channel", "revenue", "orders"]),
        },
        NOW,
    )


@query("run_all_checks", over("online_sales", _CHECKS))
def _(spark, folder):
    return _checked(spark, folder)


def combined(spark, folder):
    return alerts.combine_alerts(_checked(spark, folder), _anomalies(spark, folder), NOW)


COMBINED_VIEWS = dict(
    rates=_SERIES_RATES,
    long=_LONG, filled=_FILLED, **_z_parts("filled"), **_shift_parts("filled"),
    odd=f"{_null_sql('rates', 'CAST(NULL AS VARCHAR)')} UNION ALL {_Z_BODY} UNION ALL {_SHIFT_BODY}",
    watched=_CHECKS,
    every="""SELECT 'pipeline_monitor' AS type, status AS severity, table_name AS "table", "check", detail, root_cause_hint, NULL AS col,
                   NULL AS date, NULL AS check_type, metric_value, threshold, NULL::DOUBLE AS value, NULL::DOUBLE AS hi FROM watched
            UNION ALL SELECT 'anomaly', severity, table_name, NULL, NULL, root_cause_hint, column_name, date, check_type, NULL, NULL, value, hi FROM odd""",
)


@query(
    "alert_counts",
    over("metric_series online_sales", "SELECT count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM every", **COMBINED_VIEWS),
)
def _(spark, folder):
    return alerts.alert_counts(combined(spark, folder))


@query(
    "top_alerts",
    over(
        "metric_series online_sales",
        """SELECT severity, "table", type, '*[' || upper(severity) || ']* `' || "table" || '` — ' || coalesce(detail, root_cause_hint) AS line
           FROM every WHERE severity IN ('critical', 'warning')
           ORDER BY CASE severity WHEN 'critical' THEN 0 ELSE 1 END, "table", type, "check" NULLS FIRST, col NULLS FIRST, date NULLS FIRST, check_type NULLS FIRST LIMIT 5""",
        **COMBINED_VIEWS,
    ),
)
def _(spark, folder):
    return alerts.top_alerts(combined(spark, folder)).select("severity", "table", "type", "line")


@query("format_alerts")
def _(spark, folder):
    return alerts.format_alerts(combined(spark, folder))


@query(
    "alert_payloads",
    over(
        "metric_series online_sales",
        """SELECT type, severity, "table", "check", detail, root_cause_hint, col AS "column", date, check_type, round_even(value, 2) AS value,
                  CASE WHEN type = 'anomaly' THEN 8 + CAST(col IS NOT NULL AS BIGINT) + CAST(date IS NOT NULL AS BIGINT) - 1
                       ELSE 6 + CAST(root_cause_hint IS NOT NULL AS BIGINT) END AS fields FROM every""",
        **COMBINED_VIEWS,
    ),
)
def _(spark, folder):
    """The payload of each alert, read back from its JSON, and its number of fields."""
    sent = alerts.format_alerts(combined(spark, folder))
    schema = "type string, severity string, `table` string, `check` string, detail string, root_cause_hint string, `column` string, date string, check_type string, value double"
    found = sent.select(F.from_json("payload", schema).alias("p"), F.size(F.json_object_keys("payload")).cast("long").alias("fields"))
    return found.select("p.*", "fields").withColumn("value", round_to("value", 2))


@query(
    "quality_rows",
    over(
        "metric_series online_sales",
        """SELECT "table" AS table_name, coalesce(check_type, "check") AS check_type, col AS column_name,
                  round_even(coalesce(value, metric_value), 2) AS metric_value, round_even(coalesce(threshold, hi), 2) AS threshold, severity = 'ok' AS passed,
                  CASE severity WHEN 'ok' THEN 'info' ELSE severity END AS severity, root_cause_hint FROM every""",
        **COMBINED_VIEWS,
    ),
)
def _(spark, folder):
    rows = alerts.quality_rows(combined(spark, folder), NOW).drop("check_id", "checked_at")
    return rows.withColumns({c: round_to(c, 2) for c in ("metric_value", "threshold")})
