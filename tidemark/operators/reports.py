"""Parsing of written reports and the lists that are drawn from them."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.scalars import shorten
from tidemark.schemas import INSIGHT_REPORT


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_fences(text: Column) -> Column:
    """The part inside a code fence when the text has one, else the text."""
    tagged = F.regexp_extract(text, r"(?s)```json(.*?)(?:```|$)", 1)
    plain = F.regexp_extract(text, r"(?s)```(.*?)(?:```|$)", 1)
    return F.when(F.instr(text, "```json") > 0, _strip(tagged)).when(F.instr(text, "```") > 0, _strip(plain)).otherwise(text)


def report_fields(df: DataFrame, json_col: str, schema: T.StructType = INSIGHT_REPORT) -> DataFrame:
    """Add `report`, the parsed struct, and `raw_response`, the text that is no JSON."""
    body = strip_fences(F.col(json_col))
    checked = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(body, checked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    bad = F.col("_report").isNull() | F.col("_report._corrupt").isNotNull()
    fields = [F.col(f"_report.{f}").alias(f) for f in schema.fieldNames()]
    return (
        df.withColumns({"_report": parsed, "_body": body})
        .withColumns({"report": F.when(~bad, F.struct(*fields)), "raw_response": F.when(bad, F.col("_body"))})
        .drop("_report", "_body")
    )


def first_entries(df: DataFrame, array_col: str, n: int, keys=()) -> DataFrame:
    """The first n entries of a list as rows, numbered from 1."""
    listed = df.select(*keys, F.posexplode(F.slice(F.col(array_col), 1, n)).alias("_at", "entry"))
    return listed.select(*keys, (F.col("_at") + 1).alias("position"), "entry")


def headline(text: Column) -> Column:
    return shorten(text, 90, (". ",))


def recommendation(text: Column) -> Column:
    return shorten(text, 90, (" —", ". ", ".\n"))
