"""The data files of a Parquet table: which there are, and what schema each has in its footer."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

FILE_KEY = ("path", "modified", "bytes")
_FOOTER = "path string, column string, type string"


def data_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, modified and bytes of every Parquet file below `folder`. Lists the folder, opens no file."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    )
    return listed.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.fs as fs
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_type

    for batch in batches:
        rows = []
        for path in batch.column(0).to_pylist():
            if "://" not in path and path.startswith("file:"):
                path = f"file://{path[5:]}"
            system, inner = fs.FileSystem.from_uri(path)
            with system.open_input_file(inner) as file:
                schema = pq.read_schema(file)
            for field in schema:
                try:
                    kind = from_arrow_type(field.type, prefer_timestamp_ntz=True).simpleString()
                except Exception:  # noqa: BLE001  a type that Spark does not have is named as it is
                    kind = str(field.type)
                rows.append((path, field.name, kind))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["path", "column", "type"])


def file_schemas(spark: SparkSession, folder: str, width: int = 64) -> DataFrame:
    """path, column and type of each file, from its footer, read in up to `width` tasks. No rows are read.

    A scan takes one schema for all files, so files that differ do not show there.
    """
    paths = data_files(spark, folder).select("path").repartition(width, "path")
    return paths.mapInArrow(_footers, _FOOTER)
