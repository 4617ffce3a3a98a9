"""Freshness, volume and schema checks of tables."""

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark import constants as C
from tidemark.functions.dates import week_period
from tidemark.functions.scalars import round_to, safe_ratio
from tidemark.operators.anomaly import by_severity
from tidemark.schemas import CHECK_RESULT
from tidemark.session import hadoop_path, pin, pin_all
from tidemark.sources.files import FILE_KEY, data_files, file_schemas


def _result(table: str, check: str, status: Column, detail: Column, metric: Column, threshold: Column, hint: Column):
    columns = (F.lit(table), F.lit(check), status, detail, metric, threshold, hint)
    return [c.cast(f.dataType).alias(f.name) for c, f in zip(columns, CHECK_RESULT.fields)]


def _weekly(df: DataFrame, date_col: str) -> DataFrame:
    """Rows and newest record per week: all that the freshness and volume checks need."""
    return df.groupBy(week_period(F.col(date_col).cast("date")).alias("week")).agg(
        F.count("*").alias("rows"), F.max(date_col).alias("latest")
    )


def _freshness(weeks: DataFrame, table: str, now: dt.datetime, warning_days: int, critical_days: int) -> DataFrame:
    latest, age = F.col("latest"), F.col("age")
    seconds = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(latest.cast("timestamp"))
    found = weeks.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.max("latest").alias("latest"))
    found = found.withColumn("age", F.floor(seconds / 86400))
    empty = (F.col("rows") == 0) | latest.isNull()
    stale, late = age >= critical_days, age >= warning_days
    status = F.when(empty | stale, "critical").when(late, "warning").otherwise("ok")
    detail = F.when(empty, C.EMPTY_DETAIL).otherwise(F.format_string(C.FRESH_DETAIL, F.date_format(latest, "yyyy-MM-dd"), age))
    hint = F.when(empty, C.EMPTY_HINT).when(stale, F.format_string(C.STALE_HINT, age)).when(late, F.format_string(C.LATE_HINT, age))
    return found.select(
        *_result(table, "freshness", status, detail, age, F.when(~empty, F.lit(float(warning_days))), hint)
    )


def check_freshness(
    df: DataFrame, date_col: str, table: str, now: dt.datetime,
    warning_days: int = C.FRESH_WARN_DAYS, critical_days: int = C.FRESH_CRITICAL_DAYS,
) -> DataFrame:
    """Age of the newest record in whole days at `now`."""
    return _freshness(_weekly(df, date_col), table, now, warning_days, critical_days)


def rows_per_week(df: DataFrame, date_col: str) -> DataFrame:
    """Rows per Monday-to-Sunday week that has any."""
    dated = df.filter(F.col(date_col).isNotNull())
    return dated.groupBy(week_period(F.col(date_col)).alias("week")).agg(F.count("*").alias("rows"))


def _row_count(weeks: DataFrame, table: str, lookback: int, drop: float) -> DataFrame:
    """The window is over weeks, so the calendar bounds it."""
    back = F.row_number().over(Window.partitionBy().orderBy(F.col("week").desc_nulls_last()))
    known = F.col("week").isNotNull()
    found = weeks.withColumn("_back", back).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total"),
        F.count("week").alias("periods"),
        F.max(F.when(known & (F.col("_back") == 1), F.col("rows"))).cast("double").alias("recent"),
        F.avg(F.when(known & F.col("_back").between(2, lookback + 1), F.col("rows"))).alias("before"),
    )
    few_rows, few_weeks = F.col("total") < lookback * 2, F.col("periods") < lookback + 1
    lost = safe_ratio(F.col("before") - F.col("recent"), F.col("before"))
    compared = ~few_rows & ~few_weeks
    dropped = compared & (lost >= drop)
    status = (
        F.when(few_rows, "warning").when(few_weeks, "ok")
        .when(dropped & (lost >= C.ROWS_DROP_CRITICAL), "critical").when(dropped, "warning").otherwise("ok")
    )
    detail = F.when(few_rows, C.TOO_FEW_ROWS_DETAIL).when(few_weeks, C.TOO_FEW_PERIODS_DETAIL).otherwise(
        F.format_string(C.ROWS_DETAIL, F.col("recent"), round_to("before"))
    )
    hint = F.when(dropped, F.format_string(C.ROWS_HINT, round_to(lost * 100), F.col("recent"), round_to("before")))
    return found.select(
        *_result(table, "row_count", status, detail, F.when(compared, round_to(lost, 4)), F.when(compared, F.lit(drop)), hint)
    )


def check_row_count(df: DataFrame, date_col: str, table: str, lookback: int = C.ROWS_LOOKBACK, drop: float = C.ROWS_DROP_WARN) -> DataFrame:
    """The last week's rows against the mean of the weeks before it."""
    return _row_count(_weekly(df, date_col), table, lookback, drop)


def missing_columns(df: DataFrame, expected) -> list[str]:
    return [c for c in expected if c not in df.columns]


def check_schema(df: DataFrame, table: str, expected, types: dict[str, str] | None = None) -> DataFrame:
    """Expected columns, and their types when given. Reads the schema only, no rows."""
    missing = missing_columns(df, expected)
    actual = dict(df.dtypes)
    changed = [f"{c}: {actual[c]} is not {t}" for c, t in (types or {}).items() if actual.get(c, t) != t]
    found = [C.MISSING_DETAIL % missing] * bool(missing) + [C.CHANGED_DETAIL % changed] * bool(changed)
    bad = bool(found)
    row = (
        table, "schema_drift", "critical" if bad else "ok", "; ".join(found) or C.SCHEMA_OK_DETAIL, None, None,
        C.SCHEMA_HINT if bad else None,
    )
    return df.sparkSession.createDataFrame([row], CHECK_RESULT)


def check_file_schemas(spark: SparkSession, folder: str, table: str, types: dict[str, str]) -> DataFrame:
    """One row per file below `folder` that lacks a column or has it in another type, or one "ok" row.

    The schemas come from the files' footers, read in tasks; a scan of the folder would show one schema for all.
    """
    expected = F.map_from_arrays(F.array(*[F.lit(c) for c in types]), F.array(*[F.lit(t) for t in types.values()]))
    own = F.map_from_entries(F.collect_list(F.struct("column", "type")))
    files = file_schemas(spark, folder).groupBy("path").agg(own.alias("own")).withColumn("wanted", expected)
    missing = F.filter(F.map_keys("wanted"), lambda c: ~F.map_contains_key("own", c))
    changed = F.filter(
        F.map_keys("wanted"), lambda c: F.map_contains_key("own", c) & (F.element_at("own", c) != F.element_at("wanted", c))
    )
    told = F.transform("changed", lambda c: F.concat(c, F.lit(": "), F.element_at("own", c), F.lit(" is not "), F.element_at("wanted", c)))

    def listed(names: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(names, ", "), F.lit("]"))

    drifted = pin(files.withColumns({"missing": missing, "changed": changed}).filter("size(missing) + size(changed) > 0"))
    detail = F.concat_ws(
        "; ", F.element_at(F.split("path", "/"), -1),
        F.when(F.size("missing") > 0, F.format_string(C.MISSING_DETAIL, listed(F.col("missing")))),
        F.when(F.size("changed") > 0, F.format_string(C.CHANGED_DETAIL, listed(told))),
    )
    none = F.lit(None)
    bad = drifted.select(*_result(table, "file_schema", F.lit("critical"), detail, none, none, F.lit(C.SCHEMA_HINT)))
    fine = drifted.agg(F.count("*").alias("n")).filter("n = 0").select(
        *_result(table, "file_schema", F.lit("ok"), F.lit(C.SCHEMA_OK_DETAIL), none, none, none)
    )
    return bad.union(fine)


_COUNTS = "path string, modified timestamp, bytes long, week date, rows long, latest timestamp_ntz"


def keep_weekly_counts(spark: SparkSession, folder: str, date_col: str, state: str) -> DataFrame:
    """Rows and newest record per week of the Parquet files below `folder`, from counts that are kept in `state`.

    Each run counts only the files that the state does not know (by path, time and size) and adds their counts.
    Counts of files that are gone or were written anew are passed over. A file without rows is noted too. A run that
    breaks off has added nothing, or its files twice at most; files are told apart, so nothing is counted twice.
    """
    files = pin(data_files(spark, folder))
    path, system = hadoop_path(spark, state)
    kept = spark.read.schema(_COUNTS).parquet(state) if system.exists(path) else spark.createDataFrame([], _COUNTS)
    fresh = files.join(kept.select(*FILE_KEY), list(FILE_KEY), "left_anti")
    names = [r["path"] for r in fresh.select("path").toLocalIterator()]
    if names:
        # Only new files are opened: their number is that of the new partitions, not of the table.
        rows = spark.read.option("basePath", folder).parquet(*names)
        counted = rows.groupBy(F.col("_metadata.file_path").alias("_file"), week_period(F.col(date_col).cast("date")).alias("week")).agg(
            F.count("*").alias("rows"), F.max(F.col(date_col).cast("timestamp_ntz")).alias("latest")
        )
        same = F.regexp_replace(F.col("_file"), "^file:/+", "file:/") == F.regexp_replace(F.col("path"), "^file:/+", "file:/")
        noted = fresh.join(counted, same, "left").select(*FILE_KEY, "week", F.coalesce("rows", F.lit(0)).alias("rows"), "latest")
        noted.write.mode("append").parquet(state)
        kept = spark.read.schema(_COUNTS).parquet(state)
    now = kept.dropDuplicates([*FILE_KEY, "week"]).join(files, list(FILE_KEY), "left_semi").filter("rows > 0")
    return now.groupBy("week").agg(F.sum("rows").alias("rows"), F.max("latest").alias("latest"))


def check_kept_counts(weeks: DataFrame, table: str, now: dt.datetime) -> DataFrame:
    """The freshness and volume checks on kept weekly counts, without a scan of the table."""
    weeks = pin(weeks)
    return _freshness(weeks, table, now, C.FRESH_WARN_DAYS, C.FRESH_CRITICAL_DAYS).union(
        _row_count(weeks, table, C.ROWS_LOOKBACK, C.ROWS_DROP_WARN)
    )


def run_all_checks(tables: dict[str, tuple[DataFrame, str, list[str]]], now: dt.datetime) -> DataFrame:
    """All checks of all tables, worst first. `tables` maps a name to (rows, date column, columns).

    Each table is read once, for its weekly counts.
    """
    counted = pin_all(*[_weekly(df, date_col) for df, date_col, _ in tables.values()])
    parts = []
    for (name, (df, _, expected)), weeks in zip(tables.items(), counted):
        parts += [
            _freshness(weeks, name, now, C.FRESH_WARN_DAYS, C.FRESH_CRITICAL_DAYS),
            _row_count(weeks, name, C.ROWS_LOOKBACK, C.ROWS_DROP_WARN),
            check_schema(df, name, expected),
        ]
    return by_severity(reduce(DataFrame.unionByName, parts), "status", ("table_name", "check"))
