"""One catalog database per layer, and the registered tables in them."""

from pyspark.sql import SparkSession, types as T

from tidemark.schemas import LAYERS, LOAD_DATES, REGISTRY


def ensure_layers(spark: SparkSession, layers=LAYERS, folder: str | None = None, prefix: str = "") -> None:
    """A database per layer, in `folder` if one is given and in the warehouse otherwise; `prefix` goes before its name."""
    for layer in layers:
        place = f" LOCATION '{folder}/{layer}'" if folder else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {prefix}{layer}{place}")


def partition_column(layer: str, schema: T.StructType) -> str | None:
    """Raw and staging tables are partitioned by their load date."""
    if layer not in ("raw", "staging"):
        return None
    load_dates = set(LOAD_DATES.values())
    return next((name for name in schema.fieldNames() if name in load_dates), None)


def ensure_tables(spark: SparkSession, registry=REGISTRY, prefix: str = "") -> None:
    for (layer, table), schema in registry.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        by = partition_column(layer, schema)
        partitioning = f"PARTITIONED BY (`{by}`)" if by else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{layer}.{table} ({columns}) USING parquet {partitioning}")
