"""Parquet, JSON and record outputs."""

from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.sources.tables import table_path


def write_tables(folder: str, **tables: DataFrame) -> None:
    """Write each table as `<folder>/<name>.parquet`."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(table_path(folder, name))


def write_report(df: DataFrame, path: str) -> None:
    """JSON documents, one per row; overwrites."""
    df.write.mode("overwrite").json(path)


def iso_dates(df: DataFrame) -> DataFrame:
    """Date and timestamp columns as YYYY-MM-DD text."""
    moments = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in moments}) if moments else df


def as_records(df: DataFrame) -> DataFrame:
    """Each row as a JSON record, nulls kept."""
    plain = iso_dates(df)
    packed = F.to_json(F.struct(*plain.columns), {"ignoreNullFields": "false"})
    return plain.select(packed.alias("record"))
