"""Exact ranks and quantiles without gathering a group.

Values are first counted, so equal values cost one row. The distinct values are then range
partitioned; counts run inside each range, and the ranges before it are added as an offset.
No task sees more than its own range, however large or skewed a group is.
"""

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import lookup_join, pin


def running_counts(df: DataFrame, value: str, keys=()) -> DataFrame:
    """Per (keys, value): `n` equal values, `below` smaller ones and `total` in the group."""
    keys = list(keys)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count("*").alias("n"))
    )
    # The partition number must be the same in both uses below, hence the pin.
    ranges = pin(counts.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()))
    sums = ranges.groupBy(*keys, "_range").agg(F.sum("n").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    offsets = sums.select(
        *keys, "_range",
        (F.sum("_n").over(before) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("total"),
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranges.withColumn("_upto", F.sum("n").over(inside))
        .join(offsets, [*keys, "_range"])
        .select(*keys, value, "n", (F.col("_offset") + F.col("_upto") - F.col("n")).alias("below"), "total")
    )


def pct_rank_avg(df: DataFrame, value: str, cohort) -> DataFrame:
    """Add `pct_rank`: mean rank of equal values over the cohort's non-null count, in (0, 1].

    Reads `df` twice: pin a derived table first.
    """
    cohort = [cohort] if isinstance(cohort, str) else list(cohort)
    counts = running_counts(df, value, cohort)
    ranks = counts.select(
        *cohort, value,
        ((F.col("below") + (F.col("n") + 1) / 2) / F.col("total")).alias("pct_rank"),
    )
    return lookup_join(df, ranks, [*cohort, value])


def exact_quantiles(df: DataFrame, value: str, probs, keys=()) -> DataFrame:
    """Long table (keys, prob, quantile), linear between neighbours."""
    counts = running_counts(df, value, keys)
    first, last = F.col("below"), F.col("below") + F.col("n") - 1

    def place(prob):
        return prob * (F.col("total") - 1)

    # A row of the counts covers the places first..last; only the probabilities it serves are spread.
    def served(prob):
        return F.floor(place(prob)).between(first, last) | F.ceil(place(prob)).between(first, last)

    wanted = F.filter(F.array(*[F.lit(float(p)) for p in probs]), served)
    low = F.floor(place(F.col("prob")))
    near = counts.select("*", F.explode(wanted).alias("prob")).withColumns(
        {"_low": low.between(first, last), "_part": place(F.col("prob")) - low}
    )
    ends = near.groupBy(*keys, "prob").agg(
        F.max(F.when(F.col("_low"), F.col(value))).alias("_a"),
        F.max(value).alias("_b"),
        F.max("_part").alias("_part"),
    )
    return ends.select(
        *keys, "prob", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias("quantile")
    )


def describe(df: DataFrame, column: str) -> DataFrame:
    """Long table (statistic, value): count, mean, std, min, quartiles, max. Computes `df` once."""
    df = pin(df.select(column))
    moments = df.agg(
        F.count(column).cast("double").alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).cast("double").alias("min"),
        F.max(column).cast("double").alias("max"),
    )
    moments = moments.unpivot([], moments.columns, "statistic", "value")
    quartiles = exact_quantiles(df.select(F.col(column).cast("double")), column, (0.25, 0.5, 0.75))
    named = quartiles.select(
        F.concat((F.col("prob") * 100).cast("int").cast("string"), F.lit("%")).alias("statistic"),
        F.col("quantile").alias("value"),
    )
    return moments.unionByName(named)
