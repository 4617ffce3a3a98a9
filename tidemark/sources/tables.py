"""Typed scans of the business tables."""

import os

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException

from tidemark import constants as C


def table_path(folder: str, name: str) -> str:
    return os.path.join(folder, f"{name}.parquet")


def read_table(spark: SparkSession, folder: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Scan `<folder>/<name>.parquet`; a missing path is an error that names it."""
    path = table_path(folder, name)
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"Data file not found: {path}. Load the table first.") from error
        raise


def cast_dates(df: DataFrame, *columns: str) -> DataFrame:
    """Cast to DATE; a value that is no date is an error."""
    return df.withColumns({c: F.to_date(c) for c in columns})


def cast_dates_leniently(df: DataFrame, *columns: str) -> DataFrame:
    """Cast to DATE; a value that is no date becomes null."""
    return df.withColumns({c: F.col(c).try_cast("date") for c in columns})


def load_online_sales(spark: SparkSession, folder: str) -> DataFrame:
    return cast_dates(read_table(spark, folder, "online_sales"), "date")


def load_offline_sales(spark: SparkSession, folder: str) -> DataFrame:
    return cast_dates(read_table(spark, folder, "offline_sales"), "week_start")


def load_crm_funnel(spark: SparkSession, folder: str) -> DataFrame:
    return cast_dates_leniently(read_table(spark, folder, "crm_funnel"), *C.CRM_DATE_COLUMNS)


def load_media_spend(spark: SparkSession, folder: str) -> DataFrame:
    return cast_dates(read_table(spark, folder, "media_spend"), "week_start")


def read_account_summary(spark: SparkSession, folder: str, path: str | None = None) -> DataFrame:
    """The account feature table, from `path` when one is given."""
    if path:
        return spark.read.parquet(path)
    return read_table(spark, folder, "account_summary")


def cache_table(df: DataFrame) -> DataFrame:
    """Keep a loaded table on the executors until `refresh`."""
    return df.persist()


def refresh(*frames: DataFrame, paths: tuple[str, ...] = ()) -> None:
    """Drop cached tables and stale file listings after new data came in."""
    for df in frames:
        df.unpersist()
        for path in paths:
            df.sparkSession.catalog.refreshByPath(path)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns, order and types of a declared schema; absent columns are null, extra ones an error."""
    extra = [c for c in df.columns if c not in schema.fieldNames()]
    if extra:
        raise ValueError(f"columns outside the declared schema: {extra}")
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
