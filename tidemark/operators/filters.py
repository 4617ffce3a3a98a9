"""Request filters and data sufficiency checks."""

import datetime as dt
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import constants as C
from tidemark.functions.dates import as_date, raw_days
from tidemark.session import broadcast_if_small


@dataclass(frozen=True)
class FilterParams:
    start_date: str | dt.date | None = None
    end_date: str | dt.date | None = None
    channel: str | None = None
    category: str | None = None
    region: str | None = None
    store_format: str | None = None
    industry: str | None = None
    lead_source: str | None = None

    def equalities(self) -> dict[str, str]:
        picked = {f.name: getattr(self, f.name) for f in fields(self) if not f.name.endswith("_date")}
        return {name: value for name, value in picked.items() if value is not None}


def date_filter(df: DataFrame, date_col: str, start=None, end=None) -> DataFrame:
    """Both bounds are inclusive and optional. Typed literals, so the scan can skip row groups."""
    start, end = as_date(start), as_date(end)
    if start is not None:
        df = df.filter(F.col(date_col) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(date_col) <= F.lit(end))
    return df


def period_filter(df: DataFrame, raw_col: str, kind: str, start=None, end=None) -> DataFrame:
    """The rows whose period of `kind` (see raw_days) is in [start, end], asked of the raw date column itself.

    A bound on a period that is computed from the column would be evaluated per row; this one reaches
    the scan and skips row groups. The literals have the column's own type, so nothing is cast.
    """
    first, after = raw_days(kind, start, end)
    of = dict(df.dtypes)[raw_col]
    if first is not None:
        df = df.filter(F.col(raw_col) >= F.lit(first).cast(of))
    if after is not None:
        df = df.filter(F.col(raw_col) < F.lit(after).cast(of))
    return df


def only_keys(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows of `df` whose key is among the pinned `wanted` ones.

    Put before an aggregation by that key, it spares everything else the shuffle: few keys are broadcast
    after they have been measured; many are joined on the key, which leaves the rows where the aggregation needs them.
    """
    keys = wanted.select(F.col(wanted_key).alias("_wanted"))
    return df.join(broadcast_if_small(keys), F.col(key) == F.col("_wanted"), "left_semi")


def apply_filters(df: DataFrame, date_col: str, params: FilterParams, col_map: dict[str, str] | None = None) -> DataFrame:
    """Date bounds, then equality on every parameter whose (mapped) column the table has."""
    df = date_filter(df, date_col, params.start_date, params.end_date)
    for name, value in params.equalities().items():
        column = (col_map or {}).get(name, name)
        if column in df.columns:
            df = df.filter(F.col(column) == value)
    return df


def closed_won(crm: DataFrame) -> DataFrame:
    return crm.filter(F.col("outcome") == C.CLOSED_WON)


def active_accounts(accounts: DataFrame) -> DataFrame:
    return accounts.filter(F.col("is_churned") == 0)


def at_risk(accounts: DataFrame) -> DataFrame:
    return accounts.filter(F.col("risk_tier").isin("High", "Medium"))


def require_won(deals: DataFrame) -> DataFrame:
    return deals.dropna(subset=["deal_value", "close_date"])


def warning_text(rows: Column, context: str = "") -> Column:
    """The warning for a row count, null from the minimum on."""
    suffix = f" ({context})" if context else ""
    return F.when(rows == 0, F.lit(C.NO_DATA_TEXT % suffix)).when(
        rows < C.MIN_RELIABLE_ROWS, F.format_string(C.FEW_ROWS_TEXT, rows, F.lit(suffix))
    )


def reliability_warning(df: DataFrame, context: str = "") -> DataFrame:
    """One row with the warning text, or null when there are rows enough.

    The text depends on the count only below the minimum, so each task stops at that many rows.
    """
    rows = df.select(F.lit(1).alias("one")).limit(C.MIN_RELIABLE_ROWS).agg(F.count("*").alias("n"))
    return rows.select(warning_text(F.col("n"), context).alias("warning"))


def require_points(series: DataFrame, minimum: int = C.MIN_MODEL_POINTS) -> DataFrame:
    """Pass a single series through, or raise when it has too few points for a model."""
    points = series.limit(minimum).count()
    if points < minimum:
        raise ValueError(
            f"{points} points are left after the filters and a model needs {minimum}: "
            "use a longer date range or fewer filters"
        )
    return series


def long_enough(series: DataFrame, keys, minimum: int = C.MIN_MODEL_POINTS) -> DataFrame:
    """Keep the series with enough points for a model; one row per period and series."""
    points = F.count("*").over(Window.partitionBy(*keys))
    return series.withColumn("_points", points).filter(F.col("_points") >= minimum).drop("_points")
