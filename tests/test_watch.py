import datetime as dt
import glob
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.operators import alerts, anomaly, checks

D = dt.date


def series(spark, n=100, spread=50.0, outlier=None, start=D(2023, 1, 1)):
    noise = np.random.default_rng(4).normal(1000, spread, n)
    if outlier is not None:
        noise[outlier] = 9999.0
    rows = [(start + dt.timedelta(i), float(v)) for i, v in enumerate(noise)]
    return spark.createDataFrame(rows, "date date, revenue double")


NOW = dt.datetime(2023, 4, 10, 15)  # the last day of `series` is 2023-04-10


@pytest.mark.parametrize("days, status", [(0, "ok"), (2, "ok"), (3, "warning"), (6, "warning"), (7, "critical")])
def test_freshness_edges(spark, days, status):
    row = checks.check_freshness(series(spark), "date", "t", NOW + dt.timedelta(days)).first()
    assert (row["status"], row["metric_value"]) == (status, float(days))
    assert (row["root_cause_hint"] is None) == (status == "ok")


def test_freshness_of_an_empty_table(spark):
    row = checks.check_freshness(series(spark).limit(0), "date", "t", NOW).first()
    assert (row["status"], row["detail"], row["metric_value"]) == ("critical", "Table is empty.", None)


def test_row_count(spark):
    def status(df):
        return checks.check_row_count(df, "date", "t").first()

    assert status(series(spark, 7))["detail"] == "Insufficient data for row count comparison."
    assert status(series(spark, 20))["detail"] == "Not enough periods to compare."
    assert status(series(spark).limit(0))["status"] == "warning"
    full = series(spark, 99)  # ends on a Sunday
    assert status(full)["status"] == "ok"
    for kept, expected in ((4, "warning"), (2, "critical"), (5, "ok")):
        cut = full.filter(F.col("date") <= D(2023, 4, 2) + dt.timedelta(kept))
        assert status(cut)["status"] == expected


def test_schema_names_and_types(spark):
    df = series(spark, 1)
    assert checks.check_schema(df, "t", ["date", "revenue"]).first()["status"] == "ok"
    row = checks.check_schema(df, "t", ["date", "orders"]).first()
    assert (row["status"], row["detail"]) == ("critical", "Missing columns: ['orders']")
    assert checks.check_schema(df, "t", ["date"], {"revenue": "bigint"}).first()["status"] == "critical"


def test_planted_outlier_is_critical(spark):
    found = anomaly.detect_anomalies(series(spark, outlier=50), "date", ["revenue", "absent"], "online").collect()
    z = [a for a in found if a["check_type"] == "zscore"]
    assert [(a["date"], a["value"], a["severity"]) for a in z] == [("2023-02-20", 9999.0, "critical")]
    assert z[0]["root_cause_hint"].startswith("Value is 9.") and found[0]["severity"] == "critical"


def test_clean_series_has_no_critical_alert(spark):
    found = anomaly.detect_anomalies(series(spark, spread=20.0), "date", ["revenue"], "online")
    assert found.filter("severity = 'critical'").count() == 0


def test_null_spikes_are_judged_before_filling(spark):
    df = series(spark).withColumn("revenue", F.when(F.dayofmonth("date") > 19, None).otherwise(F.col("revenue")))
    found = anomaly.detect_anomalies(df, "date", ["revenue"], "online").filter("check_type = 'null_spike'").first()
    assert found["severity"] == "critical" and found["date"] == "overall" and found["expected_range"]["hi"] == 0.1


def test_jump_from_zero_is_an_infinite_shift(spark):
    rows = [(D(2023, 1, 1) + dt.timedelta(i), v) for i, v in enumerate([0.0, 0.0, 1.0, 4.0])]
    df = spark.createDataFrame(rows, "date date, revenue double")
    found = anomaly.level_shift_alerts(df, "date", ["revenue"], "t").orderBy("date").collect()
    assert [a["value"] for a in found] == [math.inf, 2.75]
    assert "shifted by inf%" in found[0]["root_cause_hint"]


def test_iqr_finds_the_outlier(spark):
    found = anomaly.iqr_alerts(series(spark, outlier=50), "date", ["revenue"], "t").filter("value = 9999.0")
    assert found.count() == 1


def test_one_shuffle_serves_all_columns(spark):
    df = series(spark).withColumn("orders", F.col("revenue") * 2)
    plan = anomaly.zscore_alerts(df, "date", ["revenue", "orders"], "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_alerts_of_both_kinds(spark):
    df = series(spark, outlier=50)
    checked = checks.run_all_checks({"online": (df, "date", ["date", "orders"])}, NOW)
    # The last day is a Monday, so its week has one row against seven.
    found = [(r["check"], r["status"]) for r in checked.collect()]
    assert found == [("row_count", "critical"), ("schema_drift", "critical"), ("freshness", "ok")]
    both = alerts.combine_alerts(checked, anomaly.detect_anomalies(df, "date", ["revenue"], "online"), NOW)
    counts = alerts.alert_counts(both).first()
    assert counts["critical"] == 3
    payloads = [json.loads(r["payload"]) for r in alerts.format_alerts(both).collect()]
    assert {p["type"] for p in payloads} == {"anomaly", "pipeline_monitor"}
    assert all("metric_value" not in p for p in payloads)
    top = alerts.top_alerts(both, 3).collect()
    assert [r["severity"] for r in top][:2] == ["critical", "critical"] and top[0]["line"].startswith("*[CRITICAL]* `online` — ")


def test_schema_tells_missing_and_changed_together(spark):
    row = checks.check_schema(series(spark, 1), "t", ["date", "orders"], {"revenue": "bigint", "date": "date"}).first()
    assert row["detail"] == "Missing columns: ['orders']; Changed types: ['revenue: double is not bigint']"


def test_files_that_differ_are_found_in_their_footers(spark, tmp_path):
    folder, types = str(tmp_path / "t.parquet"), {"date": "date", "revenue": "double"}
    series(spark, 40).repartition(3).write.parquet(folder)
    assert [tuple(r)[:4] for r in checks.check_file_schemas(spark, folder, "t", types).collect()] == [("t", "file_schema", "ok", C.SCHEMA_OK_DETAIL)]
    series(spark, 2).selectExpr("cast(date as string) as date", "1 as extra").coalesce(1).write.parquet(f"{folder}/late")
    found = checks.check_file_schemas(spark, folder, "t", types).collect()
    assert [r["status"] for r in found] == ["critical"]
    assert "Missing columns: [revenue]; Changed types: [date: string is not date]" in found[0]["detail"]
    # The scan of the folder shows one schema and hides this.
    assert checks.check_schema(spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/part*"), "t", types, types).first()["status"] == "ok"


def test_kept_counts_read_new_files_only(spark, tmp_path):
    folder, state = f"{tmp_path}/t.parquet", f"{tmp_path}/state"
    many = series(spark, 60)

    def add(df):
        df.coalesce(1).write.mode("append").parquet(folder)

    def agrees():
        got = {(r["week"], r["rows"], r["latest"]) for r in checks.keep_weekly_counts(spark, folder, "date", state).collect()}
        want = checks._weekly(spark.read.parquet(folder), "date").collect()
        assert got == {(r["week"], r["rows"], dt.datetime.combine(r["latest"], dt.time()) if r["latest"] else None) for r in want}

    def noted():
        return spark.read.parquet(state).agg(F.count_distinct("path"), F.sum("rows")).first()

    add(many.filter("date < '2023-02-01'"))
    agrees()
    first = glob.glob(f"{folder}/*.parquet")
    assert tuple(noted()) == (1, 31)
    add(many.filter("date >= '2023-02-01'"))
    add(many.limit(0))
    add(spark.createDataFrame([(None, 1.0)], "date date, revenue double"))
    # A file that is counted already is not opened again: it cannot even be read.
    saved = open(first[0], "rb").read()
    stamp = os.stat(first[0])
    with open(first[0], "wb") as f:
        f.write(b"x" * len(saved))
    os.utime(first[0], ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    found = {r["week"]: r["rows"] for r in checks.keep_weekly_counts(spark, folder, "date", state).collect()}
    assert sum(found.values()) == 61 and found[None] == 1
    with open(first[0], "wb") as f:
        f.write(saved)
    os.utime(first[0], ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    agrees()
    assert noted()[1] == 61
    os.remove(first[0])
    spark.catalog.refreshByPath(folder)
    agrees()
    kept = checks.keep_weekly_counts(spark, folder, "date", state)
    whole = {"t": (spark.read.parquet(folder), "date", [])}
    want = [tuple(r) for r in checks.run_all_checks(whole, NOW).filter("check <> 'schema_drift'").orderBy("check").collect()]
    assert [tuple(r) for r in checks.check_kept_counts(kept, "t", NOW).orderBy("check").collect()] == want
