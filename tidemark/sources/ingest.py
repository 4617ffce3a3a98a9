"""Full and incremental loads of the raw layer, with a run log.

A load first writes its rows under a run id beside the table, then publishes them by replacing the table (full) or
exactly the dates that it has (incremental), then logs the run, then removes what it wrote. A load that breaks off is
finished by the next one. Incremental rows are later than every loaded date, so the dates they have are theirs alone.
"""

import datetime as dt
import logging
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.schemas import LAYERS, LOAD_DATES, PIPELINE_RUNS, REGISTRY
from tidemark.session import hadoop_path
from tidemark.sources.layers import partition_column
from tidemark.sources.tables import conform, read_table

log = logging.getLogger(__name__)
RUN_LOG = "monitoring.pipeline_runs"


def _split(table: str) -> tuple[str, str, str]:
    """Prefix, layer and name of a catalog table."""
    database, name = table.split(".")
    layer = next((x for x in LAYERS if database.endswith(x)), database)
    return database.removesuffix(layer), layer, name


def stamp_ingested(df: DataFrame, moment: dt.datetime | None = None) -> DataFrame:
    """Add the load time (UTC)."""
    moment = moment or dt.datetime.now(dt.timezone.utc)
    return df.withColumn("ingested_at", F.lit(moment))


def high_water(df: DataFrame, date_col: str) -> DataFrame:
    """Latest loaded date as one row; null for an empty table."""
    return df.agg(F.max(F.to_date(date_col)).alias("high_water"))


def table_high_water(spark: SparkSession, table: str, date_col: str) -> dt.date | None:
    """Latest loaded date of a catalog table.

    If the table is partitioned by the date, the catalog knows it and no data file is opened; a partition
    that is left without files is passed over. Otherwise the date column is scanned.
    """
    rows = spark.table(table)
    if date_col not in {c.name for c in spark.catalog.listColumns(table) if c.isPartition}:
        return high_water(rows, date_col).first()["high_water"]
    value = F.regexp_extract("partition", f"(?:^|/){date_col}=([^/]+)", 1).try_cast("date")
    days = spark.sql(f"SHOW PARTITIONS {table}").select(value.alias("day")).filter("day is not null")
    for row in days.distinct().orderBy(F.desc("day")).toLocalIterator():
        if rows.filter(F.col(date_col) == F.lit(row["day"])).inputFiles():
            return row["day"]
    return None


def newer_rows(df: DataFrame, date_col: str, mark: dt.date | None) -> DataFrame:
    """Rows dated strictly after the mark; everything when there is none."""
    return df if mark is None else df.filter(F.col(date_col) > F.lit(mark))


def _insert(df: DataFrame, table: str, schema, mode: str) -> None:
    """Replace the whole table (mode full) or exactly the dates that `df` has (mode incremental).

    The rebalance lets AQE group the rows of a date and split the dates that are too big.
    """
    by = partition_column(_split(table)[1], schema)
    if by:
        df = df.hint("rebalance", F.col(by))
    spark = df.sparkSession
    setting = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic" if by and mode == "incremental" else "static")
    try:
        # Without partitions an incremental load can only be added.
        overwrite = mode == "full" or bool(by)
        df.select(*spark.table(table).columns).write.insertInto(table, overwrite=overwrite)
    finally:
        spark.conf.set(setting, before)


def _runs_folder(spark: SparkSession, table: str) -> str:
    """Where loads of a table are written before they are published: beside the table, not in it."""
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table}")
    location = described.filter("col_name = 'Location'").first()["data_type"]
    return f"{location.rstrip('/')}__runs"


def unfinished_runs(spark: SparkSession, table: str) -> list[tuple[str, str, str]]:
    """(run id, mode, folder) of the loads of a table that were written whole but not finished, oldest first."""
    folder = _runs_folder(spark, table)
    path, files = hadoop_path(spark, folder)
    if not files.exists(path):
        return []
    found = []
    for status in files.listStatus(path):
        name = status.getPath().getName()
        whole, _ = hadoop_path(spark, f"{folder}/{name}/_SUCCESS")
        if files.exists(whole):
            started, run_id, mode = name.split("_")
            found.append((started, run_id, mode, f"{folder}/{name}"))
        else:
            files.delete(status.getPath(), True)  # a load that broke off before it was whole: nothing was published
    return [run[1:] for run in sorted(found)]


def _is_logged(spark: SparkSession, run_id: str, prefix: str) -> bool:
    return not spark.table(prefix + RUN_LOG).filter(F.col("run_id") == run_id).isEmpty()


def _finish(spark: SparkSession, table: str, schema, run: tuple[str, str, str], started: float) -> int:
    """Publish a load that was written whole, log it once, and remove what it wrote. Each step can be repeated."""
    run_id, mode, folder = run
    rows = spark.read.schema(spark.table(table).schema).parquet(folder)
    count = rows.count()
    _insert(rows, table, schema, mode)
    prefix, _, name = _split(table)
    if not _is_logged(spark, run_id, prefix):
        log_run(spark, name, count, "success", None, time.time() - started, run_id, prefix)
    path, files = hadoop_path(spark, folder)
    files.delete(path, True)
    return count


def _load(df: DataFrame, table: str, schema, mode: str) -> int:
    """Write the rows under a run id, then publish them.

    What a run has written is published as a whole, by replacing the table or the dates it has; so a load that
    broke off anywhere and is finished later neither loses nor doubles rows. One load of a table runs at a time.
    """
    spark, started = df.sparkSession, time.time()
    run_id = uuid.uuid4().hex
    folder = f"{_runs_folder(spark, table)}/{int(started * 1000):015d}_{run_id}_{mode}"
    df.select(*spark.table(table).columns).write.parquet(folder)
    return _finish(spark, table, schema, (run_id, mode, folder), started)


def recover(spark: SparkSession, table: str, schema) -> int:
    """Finish the loads that were left half-way; returns their number."""
    left = unfinished_runs(spark, table)
    for run in left:
        log.warning("%s: finishing the load %s", table, run[0])
        _finish(spark, table, schema, run, time.time())
    return len(left)


def load_full(df: DataFrame, table: str, schema) -> int:
    """Truncate and reload; returns the row count."""
    recover(df.sparkSession, table, schema)
    return _load(conform(df, schema), table, schema, "full")


def load_incremental(df: DataFrame, table: str, schema, date_col: str) -> int:
    """Add the rows after the table's latest date; returns their count, 0 for a skipped load.

    An unreadable table is an error and never taken for an empty one.
    """
    recover(df.sparkSession, table, schema)
    mark = table_high_water(df.sparkSession, table, date_col)
    fresh = newer_rows(conform(df, schema), date_col, mark)
    if mark is not None and fresh.isEmpty():
        return 0
    return _load(fresh, table, schema, "incremental")


def log_run(
    spark: SparkSession, table: str, rows: int, status: str, error: str | None, secs: float, run_id: str | None = None,
    prefix: str = "",
) -> None:
    """Append a run record; a failure to log never fails the load."""
    record = (
        run_id or uuid.uuid4().hex, dt.datetime.now(dt.timezone.utc), table, rows, status, error or "", round(secs, 2),
    )
    try:
        frame = spark.createDataFrame([record], PIPELINE_RUNS).coalesce(1)
        frame.write.insertInto(prefix + RUN_LOG)
    except Exception as failure:  # noqa: BLE001
        log.warning("run of %s was not logged: %s", table, failure)


def load_one(spark: SparkSession, folder: str, name: str, mode: str, prefix: str = "") -> None:
    """Load one raw table and log the run. A failure is logged, not raised."""
    started = time.time()
    table, schema, date_col = f"{prefix}raw.{name}", REGISTRY[("raw", name)], LOAD_DATES[name]
    try:
        source = read_table(spark, folder, name)
    except FileNotFoundError as missing:
        log.warning("skipped: %s", missing)
        return
    source = stamp_ingested(source)
    try:
        if mode == "full":
            load_full(source, table, schema)
        else:
            rows = load_incremental(source, table, schema, date_col)
            if rows == 0:
                log.info("%s: no new rows", table)
    except Exception as failure:  # noqa: BLE001
        log.error("%s: %s", table, failure)
        log_run(spark, name, 0, "failed", str(failure), time.time() - started, prefix=prefix)


def load_all(spark: SparkSession, folder: str, mode: str = "full", tables=tuple(LOAD_DATES), prefix: str = "") -> None:
    """Load every configured table into the databases with `prefix`; one bad table does not stop the rest."""
    if mode not in ("full", "incremental"):
        raise ValueError(f"unknown mode {mode!r}: full or incremental")
    for name in tables:
        load_one(spark, folder, name, mode, prefix)
