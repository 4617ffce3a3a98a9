import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import alerts, anomaly, checks, metrics, reports
from tidemark.sources import ingest, layers, sinks, tables

D = dt.date


@pytest.fixture(scope="module")
def warehouse(spark):
    layers.ensure_layers(spark)
    layers.ensure_tables(spark)
    return spark


def online(spark, *days):
    rows = [(d, "DTC", "Snacks", 1, 10.0) for d in days]
    return spark.createDataFrame(rows, "date date, channel string, category string, orders bigint, revenue double")


def runs(spark):
    return [(r["table_name"], r["rows_ingested"], r["status"]) for r in spark.table("monitoring.pipeline_runs").orderBy("run_at").collect()]


def test_layers_are_idempotent_and_partitioned(warehouse):
    layers.ensure_layers(warehouse)
    layers.ensure_tables(warehouse)
    assert layers.partition_column("raw", schemas.CRM_FUNNEL) == "lead_date"
    assert layers.partition_column("monitoring", schemas.PIPELINE_RUNS) is None
    names = {c.name for c in warehouse.catalog.listColumns("raw.online_sales") if c.isPartition}
    assert names == {"date"}


def test_full_then_incremental_loads(warehouse, tmp_path):
    spark, folder = warehouse, str(tmp_path)
    sinks.write_tables(folder, online_sales=online(spark, D(2024, 1, 1), D(2024, 1, 2)))
    before = len(runs(spark))
    ingest.load_all(spark, folder, "full", ["online_sales"])
    ingest.load_all(spark, folder, "full", ["online_sales"])
    assert spark.table("raw.online_sales").count() == 2
    # Earlier and equal dates are passed over, the later one is added.
    sinks.write_tables(folder, online_sales=online(spark, D(2023, 12, 31), D(2024, 1, 2), D(2024, 1, 3)))
    ingest.load_all(spark, folder, "incremental", ["online_sales"])
    ingest.load_all(spark, folder, "incremental", ["online_sales"])
    loaded = spark.table("raw.online_sales")
    assert [r["date"] for r in loaded.orderBy("date").select("date").collect()] == [D(2024, 1, 1), D(2024, 1, 2), D(2024, 1, 3)]
    assert loaded.filter("ingested_at is null").count() == 0
    assert runs(spark)[before:] == [("online_sales", 2, "success"), ("online_sales", 2, "success"), ("online_sales", 1, "success")]


def test_a_failed_table_is_logged_and_the_rest_goes_on(warehouse, tmp_path):
    spark, folder = warehouse, str(tmp_path)
    bad = spark.createDataFrame([("2024-01-01", 1)], "week_start string, unknown int")
    good = spark.createDataFrame([("c1", D(2024, 1, 1))], "contact_id string, lead_date date")
    sinks.write_tables(folder, offline_sales=bad, crm_funnel=good)
    before = len(runs(spark))
    ingest.load_all(spark, folder, "full")
    assert sorted(runs(spark)[before:]) == [("crm_funnel", 1, "success"), ("offline_sales", 0, "failed")]
    with pytest.raises(ValueError):
        ingest.load_all(spark, folder, "partial")


def test_log_failure_does_not_raise(spark):
    ingest.log_run(spark, "t", "not a number", "success", None, 0.1)


def test_incremental_from_a_missing_table_is_an_error(spark):
    with pytest.raises(Exception):
        ingest.load_incremental(online(spark, D(2024, 1, 1)), "raw.nowhere", schemas.ONLINE_SALES, "date")


def test_missing_file_names_its_path(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="online_sales.parquet"):
        tables.load_online_sales(spark, str(tmp_path))


def test_typed_loads(spark, tmp_path):
    folder = str(tmp_path)
    crm = spark.createDataFrame([("c", "2024-01-01", "soon", None, "2024-02-30", "2024-03-01")], "contact_id string, lead_date string, mql_date string, sql_date string, opportunity_date string, close_date string")
    week = spark.createDataFrame([("2024-01-01", 1.0)], "week_start string, spend double")
    sinks.write_tables(folder, crm_funnel=crm, media_spend=week, offline_sales=week, account_summary=week)
    row = tables.load_crm_funnel(spark, folder).first()
    assert (row["lead_date"], row["mql_date"], row["opportunity_date"], row["close_date"]) == (D(2024, 1, 1), None, None, D(2024, 3, 1))
    assert tables.load_media_spend(spark, folder).schema["week_start"].dataType.typeName() == "date"
    assert tables.load_offline_sales(spark, folder).count() == 1
    assert tables.read_account_summary(spark, folder).count() == 1
    assert tables.read_account_summary(spark, "nowhere", tables.table_path(folder, "account_summary")).count() == 1


def test_cache_and_refresh(spark, tmp_path):
    folder = str(tmp_path)
    sinks.write_tables(folder, t=spark.range(3))
    df = tables.cache_table(tables.read_table(spark, folder, "t"))
    assert df.count() == 3 and df.is_cached
    sinks.write_tables(folder, t=spark.range(5))
    tables.refresh(df, paths=(tables.table_path(folder, "t"),))
    assert not df.is_cached and tables.read_table(spark, folder, "t").count() == 5


def test_alerts_are_appended(warehouse):
    spark = warehouse
    rows = [(D(2024, 1, 1) + dt.timedelta(i), 9999.0 if i == 9 else 10.0 + i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "date date, revenue double")
    now = dt.datetime(2024, 1, 31)
    both = alerts.combine_alerts(checks.run_all_checks({"t": (df, "date", ["date"])}, now), anomaly.detect_anomalies(df, "date", ["revenue"], "t"), now)
    alerts.write_alerts(both, checked_at=now)
    stored = spark.table("monitoring.data_quality")
    assert stored.count() == both.count() and stored.filter("check_id is null or checked_at is null").count() == 0
    assert stored.filter("check_type = 'zscore' and not passed and column_name = 'revenue'").count() == 1


def test_model_metrics_are_appended(warehouse):
    found = warehouse.createDataFrame([(12.5, 3.0, 0.9)], "mape double, rmse double, r2 double")
    before = warehouse.table("monitoring.model_metrics").count()
    for _ in range(2):
        metrics.write_model_metrics(metrics.model_metric_rows(found, "naive", "1", 20.0, 0.5))
    rows = warehouse.table("monitoring.model_metrics")
    assert rows.count() == before + 6 and rows.filter("metric_name = 'mape' AND passed").count() >= 2


def test_report_sink_and_records(spark, tmp_path):
    df = spark.createDataFrame([(D(2024, 1, 1), 1, None)], "d date, n int, s string")
    assert sinks.as_records(df).first()["record"] == '{"d":"2024-01-01","n":1,"s":null}'
    sinks.write_report(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 1


def test_reports_are_parsed_or_kept(spark):
    body = '{"executive_summary": "Good.", "risks": [{"risk": "A", "severity": "high", "action": "B"}]}'
    texts = [body, f"```json\n{body}\n```", f"Note:\n```\n{body}\n```\nend", "no report", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = reports.report_fields(df, "text").orderBy("i").collect()
    assert [r["report"] is not None and r["report"]["risks"][0]["severity"] == "high" for r in found] == [True, True, True, False, False]
    assert [r["raw_response"] for r in found] == [None, None, None, "no report", None]


def test_shortened_texts(spark):
    texts = ["Cut cost. Then grow.", "x" * 95, "short", "Scale email — now. Later", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(reports.headline(F.col("t"))).collect()] == ["Cut cost", "x" * 90 + "…", "short", "Scale email — now", None]
    assert df.select(reports.recommendation(F.col("t"))).collect()[3][0] == "Scale email"


def test_first_entries(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "list array<string>")
    assert [tuple(r) for r in reports.first_entries(df, "list", 2).collect()] == [(1, "a"), (2, "b")]


def folder_of(spark, table):
    return spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Location'").first()["data_type"].removeprefix("file:")


def test_the_high_water_mark_opens_no_data_file(warehouse, tmp_path):
    spark = warehouse
    spark.sql("CREATE TABLE raw.marked (x int, date date) USING parquet PARTITIONED BY (date)")
    spark.createDataFrame([(1, D(2024, 5, 1)), (2, D(2024, 5, 3))], "x int, date date").write.insertInto("raw.marked")
    for path in glob.glob(f"{folder_of(spark, 'raw.marked')}/*/*.parquet"):
        with open(path, "wb") as f:
            f.write(b"no parquet")
    spark.sql("ALTER TABLE raw.marked ADD PARTITION (date = '2024-06-01')")
    assert ingest.table_high_water(spark, "raw.marked", "date") == D(2024, 5, 3)
    with pytest.raises(Exception):
        spark.table("raw.marked").select("x").collect()
    spark.sql("CREATE TABLE raw.plain (date date) USING parquet")
    assert ingest.table_high_water(spark, "raw.plain", "date") is None
    spark.sql("INSERT INTO raw.plain VALUES (DATE '2024-01-09'), (DATE '2024-01-07')")
    assert ingest.table_high_water(spark, "raw.plain", "date") == D(2024, 1, 9)


@pytest.mark.parametrize("step", ["_insert", "log_run", "hadoop_path"])
@pytest.mark.parametrize("mode", ["full", "incremental"])
def test_a_load_that_breaks_off_is_finished_by_the_next(warehouse, tmp_path, monkeypatch, step, mode):
    """A failure before publishing, between publishing and logging, and before the clean-up."""
    spark, folder = warehouse, str(tmp_path)
    sinks.write_tables(folder, online_sales=online(spark, D(2024, 2, 1), D(2024, 2, 1), D(2024, 2, 2)))
    ingest.load_all(spark, folder, "full", ["online_sales"])
    before = len(runs(spark))
    more = [D(2024, 2, 2), D(2024, 2, 3), D(2024, 2, 3), D(2024, 2, 4)]
    sinks.write_tables(folder, online_sales=online(spark, *more))
    real, calls = getattr(ingest, step), []

    def breaks(*args, **kw):
        calls.append(args)
        # The third folder that is looked up is the run's own, for its removal.
        if step != "hadoop_path" or "__runs/" in args[1] and not args[1].endswith("_SUCCESS"):
            raise KeyboardInterrupt
        return real(*args, **kw)

    monkeypatch.setattr(ingest, step, breaks)
    with pytest.raises(KeyboardInterrupt):
        ingest.load_all(spark, folder, mode, ["online_sales"])
    monkeypatch.setattr(ingest, step, real)
    assert len(ingest.unfinished_runs(spark, "raw.online_sales")) == 1
    ingest.load_all(spark, folder, "incremental", ["online_sales"])
    days = sorted(r["date"] for r in spark.table("raw.online_sales").select("date").collect())
    assert days == (sorted(more) if mode == "full" else [D(2024, 2, 1)] * 2 + [D(2024, 2, 2)] + more[1:])
    assert runs(spark)[before:] == [("online_sales", 4 if mode == "full" else 3, "success")]
    assert ingest.unfinished_runs(spark, "raw.online_sales") == [] and ingest.recover(spark, "raw.online_sales", schemas.ONLINE_SALES) == 0


def test_a_load_that_was_never_whole_is_dropped(warehouse, tmp_path):
    spark = warehouse
    runs_at = ingest._runs_folder(spark, "raw.media_spend")
    spark.range(3).write.parquet(f"{runs_at}/000000000000001_broken_incremental")
    os.remove(f"{runs_at.removeprefix('file:')}/000000000000001_broken_incremental/_SUCCESS")
    assert ingest.unfinished_runs(spark, "raw.media_spend") == []
    assert os.listdir(runs_at.removeprefix("file:")) == []
