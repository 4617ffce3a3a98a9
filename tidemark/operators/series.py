"""Ordered operators over series.

`keys` name a series; each window covers one series with one row per period, so its length is
bounded by the calendar. Aggregate raw rows with `buckets.period_totals` first.
"""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.scalars import round_to, safe_ratio
from tidemark.session import lookup_join


def _ordered(keys, order):
    return Window.partitionBy(*keys).orderBy(order)


def rolling_mean(x: str, order: str, keys=(), window: int = 4, min_periods: int = 2) -> Column:
    """Trailing mean, null with fewer than `min_periods` values in the frame."""
    frame = _ordered(keys, order).rowsBetween(1 - window, 0)
    return F.when(F.count(x).over(frame) >= min_periods, F.avg(x).over(frame))


def pct_change(x: str, order: str, keys=()) -> Column:
    """x / previous − 1. From 0 it is infinite, or null when x is 0 too."""
    now, before = F.col(x), F.lag(x).over(_ordered(keys, order))
    from_zero = F.when(now > 0, F.lit(math.inf)).when(now < 0, F.lit(-math.inf))
    return F.when(before == 0, from_zero).otherwise(F.try_divide(now, before) - 1)


def zscore(x: str, keys=()) -> Column:
    """Distance from the mean in population standard deviations; null for a constant series."""
    whole = Window.partitionBy(*keys)
    spread = F.stddev_pop(x).over(whole)
    return F.when(spread > 0, F.abs(F.col(x) - F.avg(x).over(whole)) / spread)


def ffill(x: str, order: str, keys=()) -> Column:
    """Last value that is not null."""
    return F.last(x, ignorenulls=True).over(_ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0))


# Calendar days of a block and of a super-block: a block is carried over inside one window, a super-block and
# a series in one short list of blocks.
_BLOCK_DAYS, _BLOCKS = 64, 64
# Rows of a block that one window takes; powers of the decay stay within the range of doubles.
_WINDOW_ROWS = 64


def _blocks(order: str, df: DataFrame) -> Column:
    """Number of the stretch of the order column that a row lies in; nulls come last."""
    kind = dict(df.dtypes)[order]
    at = F.col(order)
    if kind in ("date", "timestamp", "timestamp_ntz"):
        at = F.unix_date(at.cast("date"))
    elif kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{order} has to be a date, a timestamp or a whole number, not {kind}")
    return F.coalesce(F.floor(at / _BLOCK_DAYS).cast("long"), F.lit(1 << 40))


def _carried(pairs: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    """What comes into each block of a group, as a pair (share, carry): share · (into the group) + carry.

    A block turns what comes in into share · in + carry. Two blocks in a row are again such a pair, and this
    composition is associative, so groups can be put together in any number of steps. `pairs` has the group,
    `_seq` and per name a struct of share and carry; each group's list is short.
    """
    one = F.struct(F.lit(1.0).alias("share"), F.lit(0.0).alias("carry"))

    def after(state, block):
        return F.struct(
            (block["share"] * state["share"]).alias("share"), (block["share"] * state["carry"] + block["carry"]).alias("carry")
        )

    def prefix(name):
        listed = F.transform("_list", lambda b: b[name])
        empty = F.array().cast("array<struct<share:double,carry:double>>")
        start = F.struct(one.alias("now"), empty.alias("before"))
        return F.aggregate(
            listed, start,
            lambda s, b: F.struct(after(s["now"], b).alias("now"), F.concat(s["before"], F.array(s["now"])).alias("before")),
        )

    gathered = pairs.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_seq", *names))).alias("_list"))
    return gathered.select(*group, F.transform("_list", lambda b: b["_seq"]).alias("_seqs"), *[prefix(n).alias(n) for n in names])


def _null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on columns of the same names where nulls are equal."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(renamed, same).drop(*[f"_r_{c}" for c in on])


def with_adstock(df: DataFrame, terms: dict[str, str], order: str, decay: float, keys=()) -> DataFrame:
    """Add columns that carry a share of each row on to the next: a[t] = x[t] + decay · a[t−1].

    `terms` maps a new column to its x. Nulls count as 0, and nothing is cut off. A series is split into blocks of its calendar,
    which can lie in different tasks: each block is summed by a window, a block as a whole is the pair
    (decay ** rows, what it carries out), and the pairs are put together along the series. Built-in functions only.
    Rows of one date keep the order in which the window meets them. Reads `df` twice: pin a derived table first.
    """
    if not 0 <= decay < 1:
        raise ValueError("the decay must be in [0, 1)")
    keys = list(keys)
    if decay == 0:
        return df.withColumns({n: F.coalesce(F.col(f"`{x}`").cast("double"), F.lit(0.0)) for n, x in terms.items()})
    rows = max(1, min(_WINDOW_ROWS, int(250 / -math.log10(decay))))
    cell = [*keys, "_block", "_part"]
    share = F.lit(decay)
    values = {f"_x{i}": F.coalesce(F.col(f"`{x}`").cast("double"), F.lit(0.0)) for i, x in enumerate(terms.values())}
    placed = (
        df.withColumns({"_block": _blocks(order, df), **values})
        .withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(F.col(order).asc_nulls_last())) - 1)
        .withColumns({"_part": F.floor(F.col("_nth") / rows), "_at": F.col("_nth") % rows})
    )
    so_far = Window.partitionBy(*cell).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns(
        {f"_x{i}": F.sum(F.col(f"_x{i}") * F.pow(share, -F.col("_at"))).over(so_far) * F.pow(share, F.col("_at")) for i in range(len(terms))}
    )
    names = [f"_p{i}" for i in range(len(terms))]

    def pair(a, b):
        return F.struct(a.alias("share"), b.alias("carry"))

    # Parts within blocks, blocks within super-blocks, super-blocks within the series.
    parts = local.groupBy(*cell).agg(
        *[pair(F.pow(share, F.count("*")), F.max_by(f"_x{i}", "_at")).alias(n) for i, n in enumerate(names)]
    )
    levels, now = [], parts.withColumnRenamed("_part", "_seq")
    for group, seq in (
        ([*keys, "_super", "_block"], "_block"), ([*keys, "_super"], "_super"), (keys, None),
    ):
        now = now.withColumn("_super", F.floor(F.col("_block") / _BLOCKS)) if seq == "_block" else now
        found = _carried(now, group, names)
        levels.append(found)
        if seq:
            now = found.select(*[c for c in group if c != seq], F.col(seq).alias("_seq"), *[F.col(n)["now"].alias(n) for n in names])
    into = levels[2].select(*keys, F.posexplode("_seqs").alias("_i", "_super"), *[F.col(n)["before"].alias(n) for n in names])
    into = into.select(*keys, "_super", *[F.get(n, F.col("_i"))["carry"].alias(n) for n in names])
    for level, name in ((levels[1], "_block"), (levels[0], "_part")):
        spread = level.select(
            *[c for c in level.columns if c not in (*names, "_seqs")], F.posexplode("_seqs").alias("_i", name),
            *[F.col(n)["before"].alias(f"{n}b") for n in names],
        )
        on = [*keys, "_super"] + (["_block"] if name == "_part" else [])
        joined = _null_safe(spread, into, on)
        into = joined.select(
            *on, name, *[(F.get(f"{n}b", F.col("_i"))["share"] * F.col(n) + F.get(f"{n}b", F.col("_i"))["carry"]).alias(n) for n in names]
        )
    done = _null_safe(local, into.drop("_super"), cell)
    return done.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"_x{i}") + F.pow(share, F.col("_at") + 1) * F.col(n)).alias(name) for i, (name, n) in enumerate(zip(terms, names))],
    )


def trend_index(order: str, keys=()) -> Column:
    """Row position in [0, 1)."""
    place = F.row_number().over(_ordered(keys, order)) - 1
    return place / F.count("*").over(Window.partitionBy(*keys))


def row_sequence(order: str, keys=()) -> Column:
    """0, 1, 2, … in row order."""
    return (F.row_number().over(_ordered(keys, order)) - 1).cast("long")


def mean_of_previous(x: str, order: str, k: int = 4, keys=()) -> Column:
    """Mean of the k rows before this one."""
    return F.avg(x).over(_ordered(keys, order).rowsBetween(-k, -1))


def recent_vs_history(series: DataFrame, x: str, order: str, k: int = 4, keys=()) -> DataFrame:
    """The last row of each series against the mean of the k rows before it."""
    compared = series.select(
        *keys, F.col(order).alias("period"), F.col(x).cast("double").alias("recent"),
        mean_of_previous(x, order, k, keys).alias("historical_avg"),
        F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))).alias("_back"),
    )
    last = compared.filter(F.col("_back") == 1).drop("_back")
    drop = safe_ratio(F.col("historical_avg") - F.col("recent"), F.col("historical_avg"))
    return last.withColumn("drop_pct", drop)


def share_of_total(df: DataFrame, x: str, period: str, digits: int = 4) -> DataFrame:
    """Add `share`: x over its period's total (1 or more).

    The totals come from a partial aggregate and a join, so a period with very many rows is
    never gathered in one task. Reads `df` twice: pin a derived table first.
    """
    totals = df.groupBy(period).agg(F.sum(x).alias("_total"))
    share = round_to(safe_ratio(F.col(x), F.col("_total")), digits)
    return lookup_join(df, totals, period, "inner").withColumn("share", share).drop("_total")


def map_by_period(df: DataFrame, per_period: DataFrame, period: str) -> DataFrame:
    """Attach a per-period value to every row."""
    return lookup_join(df, per_period, period)


def scale_to_total(df: DataFrame, x: str, period: str, targets: DataFrame, target: str) -> DataFrame:
    """Share out each period's target over its rows in proportion to x (2 decimals).

    Reads `df` twice: pin a derived table first.
    """
    totals = df.groupBy(period).agg(F.sum(x).alias("_total"))
    factors = totals.join(targets, period, "left").select(
        period, safe_ratio(F.col(target), F.col("_total")).alias("_factor")
    )
    scaled = map_by_period(df, factors, period)
    return scaled.withColumn(x, round_to(F.col(x) * F.col("_factor"), 2)).drop("_factor")
