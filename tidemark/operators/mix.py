"""Marketing mix model: carryover, saturation, non-negative ridge, contributions.

The heavy work is aggregation to weeks and one aggregate for the normal equations. The driver
gets k × k sums, k being the number of features, and solves that small problem.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidemark import constants as C
from tidemark.functions.dates import week_harmonics
from tidemark.functions.scalars import mix_warning, round_to, saturate, whole_money
from tidemark.operators.buckets import chrono_split, period_totals
from tidemark.operators.metrics import regression_metrics
from tidemark.operators.series import trend_index, with_adstock
from tidemark.session import pin


def pivot_spend(media: DataFrame, channels=C.MEDIA_CHANNELS, date_col: str = "week_start") -> DataFrame:
    """Weeks down, channels across; a cell without rows is null. Spend of an unlisted channel is an error."""
    unlisted = F.raise_error(F.concat(F.lit("channel not in the list: "), F.coalesce(F.col("channel"), F.lit("null"))))
    known = F.col("channel").isin(*channels)
    spend = F.when(known | F.coalesce(F.col("spend") == 0, F.lit(True)), F.col("spend")).otherwise(unlisted.cast("double"))
    rows = media.filter(F.col(date_col).isNotNull()).withColumn("spend", spend)
    return rows.groupBy(date_col).pivot("channel", list(channels)).agg(F.sum("spend"))


def mix_input(media: DataFrame, sales: DataFrame, channels=C.MEDIA_CHANNELS, date_col="week_start", sales_col="total_revenue") -> DataFrame:
    """Wide spend next to the weekly sales, for the weeks that both have."""
    return pivot_spend(media, channels, date_col).join(period_totals(sales, date_col, sales_col), date_col)


def feature_name(channel: str) -> str:
    return f"{channel}_transformed"


def feature_columns(channels=C.MEDIA_CHANNELS) -> list[str]:
    return [feature_name(c) for c in channels] + list(C.CALENDAR_TERMS)


def mix_features(
    media: DataFrame, sales: DataFrame, channels=C.MEDIA_CHANNELS, decay: float = C.MIX_DECAY,
    k: float = C.MIX_SATURATION, date_col: str = "week_start", sales_col: str = "total_revenue",
) -> DataFrame:
    """One row per week: the transformed spend of each channel, season, trend and sales."""
    wide = pin(mix_input(media, sales, channels, date_col, sales_col))
    wide = with_adstock(wide, {feature_name(c): c for c in channels}, date_col, decay)
    terms = {feature_name(c): saturate(F.col(f"`{feature_name(c)}`"), k) for c in channels}
    terms.update(week_harmonics(F.col(date_col)))
    terms["trend"] = trend_index(date_col)
    return wide.withColumns(terms).select(date_col, *[F.col(f"`{f}`") for f in feature_columns(channels)], sales_col)


def standardize(df: DataFrame, columns, fit_on: Column | None = None) -> DataFrame:
    """Centre and scale by the population deviation of the rows in `fit_on`; a constant is only centred."""
    fit = df if fit_on is None else df.filter(fit_on)
    stats = fit.agg(
        *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return df.withColumns(
        {c: (F.col(f"`{c}`") - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0) for i, c in enumerate(columns)}
    )


def feature_gram(df: DataFrame, columns, target: str) -> DataFrame:
    """Long table of means and centred cross products for each pair of columns, in one aggregate."""
    names = [*columns, target]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    quoted = {n: F.col(f"`{n}`") for n in names}
    sums = df.agg(
        F.count("*").alias("n"),
        *[F.avg(quoted[n]).alias(f"m{i}") for i, n in enumerate(names)],
        *[F.covar_pop(quoted[a], quoted[b]).alias(f"c{i}") for i, (a, b) in enumerate(pairs)],
    )
    place = {n: i for i, n in enumerate(names)}
    rows = [
        F.struct(
            F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("n").alias("n"), F.col(f"m{place[a]}").alias("mean_a"),
            F.col(f"m{place[b]}").alias("mean_b"), (F.col(f"c{i}") * F.col("n")).alias("cross"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return sums.select(F.inline(F.array(*rows)))


def solve_nonneg_ridge(gram: np.ndarray, moment: np.ndarray, alpha: float = 1.0, sweeps: int = 100_000) -> np.ndarray:
    """min w'Gw − 2m'w + α|w|² with w ≥ 0, by cyclic coordinate descent on the k × k sums.

    Raises if the sweeps end before the weights settle.
    """
    w = np.zeros(len(moment))
    scale = max(float(np.abs(moment).max(initial=0.0)), 1.0)
    for _ in range(sweeps):
        change = 0.0
        for j in range(len(w)):
            curve = gram[j, j] + alpha
            new = max(0.0, (moment[j] - gram[j] @ w + gram[j, j] * w[j]) / curve)
            change = max(change, abs(new - w[j]) * curve)
            w[j] = new
        if change <= 1e-13 * scale:
            return w
    raise RuntimeError(f"the ridge weights have not settled after {sweeps} sweeps")


@dataclass(frozen=True)
class RidgeFit:
    """Weights on standardized features, and the same fit on the raw features."""

    columns: list[str]
    weights: dict[str, float]
    raw_weights: dict[str, float]
    raw_intercept: float

    def predicted(self) -> Column:
        return sum((self.term(c) for c in self.columns), F.lit(self.raw_intercept))

    def term(self, column: str) -> Column:
        return F.col(f"`{column}`") * F.lit(self.raw_weights[column])


def nonneg_ridge(train: DataFrame, columns, target: str, alpha: float = 1.0) -> RidgeFit:
    """Ridge with non-negative weights on standardized features and a free intercept."""
    columns = list(columns)
    found = {(r["a"], r["b"]): r for r in feature_gram(train, columns, target).collect()}
    if not found[(target, target)]["n"]:
        raise ValueError("no rows to fit the mix model on")
    first = {c: found[(c, c)] for c in columns}
    spread = {c: np.sqrt(max(r["cross"], 0.0) / r["n"]) or 1.0 for c, r in first.items()}
    k = len(columns)
    gram, moment = np.zeros((k, k)), np.zeros(k)
    for i, a in enumerate(columns):
        moment[i] = found[(a, target)]["cross"] / spread[a]
        for j in range(i, k):
            b = columns[j]
            gram[i, j] = gram[j, i] = found[(a, b)]["cross"] / (spread[a] * spread[b])
    w = solve_nonneg_ridge(gram, moment, alpha)
    raw = {c: float(w[i] / spread[c]) for i, c in enumerate(columns)}
    intercept = found[(target, target)]["mean_a"] - sum(raw[c] * first[c]["mean_a"] for c in columns)
    return RidgeFit(columns, {c: float(w[i]) for i, c in enumerate(columns)}, raw, float(intercept))


def optimality(train: DataFrame, fit: RidgeFit, target: str, alpha: float = 1.0) -> DataFrame:
    """Per feature: its weight on the standardized scale and the slope of the objective there, from sums over the rows.

    At the optimum the slope is 0 where the weight is positive, and does not fall where the weight is 0. The slope is
    2 (alpha w − Σ z · residual), the residual being what the fitted model leaves over, so it checks weights and intercept
    against the rows and not against the sums that they were fitted on.
    """
    residual = F.col(target) - fit.predicted()
    stats = [
        F.struct(
            F.lit(c).alias("feature"), F.lit(fit.weights[c]).alias("weight"),
            F.covar_pop(F.col(f"`{c}`"), residual).alias("together"), F.stddev_pop(f"`{c}`").alias("spread"),
            F.count("*").alias("n"), F.avg(residual).alias("left_over"), F.sqrt(F.sum(F.col(target) * F.col(target))).alias("size"),
        )
        for c in fit.columns
    ]
    spread = F.when(F.col("spread") > 0, F.col("spread")).otherwise(1.0)
    slope = 2 * (alpha * F.col("weight") - F.col("n") * F.col("together") / spread)
    return train.agg(F.array(*stats).alias("s")).select(F.inline("s")).select(
        "feature", "weight", slope.alias("slope"), "left_over", "size"
    )


def is_optimal(found: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """`optimality` as yes or no, relative to the size of the target."""
    near = F.abs("slope") <= tolerance * F.col("size")
    good = F.when(F.col("weight") > 0, near).otherwise((F.col("weight") == 0) & (F.col("slope") >= -tolerance * F.col("size")))
    return found.select("feature", (good & (F.abs("left_over") <= tolerance * F.col("size"))).alias("optimal"))


def given_fit(raw_weights: dict[str, float], intercept: float) -> RidgeFit:
    """A model whose raw weights are known, for explaining without fitting."""
    return RidgeFit(list(raw_weights), dict(raw_weights), dict(raw_weights), intercept)


def mix_metrics(checked: DataFrame, fit: RidgeFit, sales_col: str = "total_revenue") -> DataFrame:
    """Quality on the given weeks, and its warning."""
    found = regression_metrics(checked.withColumn("_predicted", fit.predicted()), sales_col, "_predicted")
    return found.withColumn("warning", mix_warning(F.col("mape"), F.col("r2")))


def channel_contribution(features: DataFrame, fit: RidgeFit, media: DataFrame, channels=C.MEDIA_CHANNELS) -> DataFrame:
    """Per channel: share of the mean prediction, incremental revenue, spend and return; largest first."""
    sums = features.agg(
        F.count("*").alias("weeks"), F.avg(fit.predicted()).alias("mean_predicted"),
        *[F.avg(fit.term(feature_name(c))).alias(f"c{i}") for i, c in enumerate(channels)],
    )
    rows = [
        F.struct(F.lit(c).alias("channel"), F.col(f"c{i}").alias("gain"), F.col("weeks").alias("weeks"),
                 F.col("mean_predicted").alias("mean_predicted"))
        for i, c in enumerate(channels)
    ]
    spend = media.groupBy("channel").agg(F.sum("spend").alias("spend"))
    joined = sums.select(F.inline(F.array(*rows))).join(spend, "channel", "left").fillna(0.0, ["spend"])
    revenue = F.col("gain") * F.col("weeks")
    return joined.select(
        "channel",
        round_to(F.col("gain") / F.greatest("mean_predicted", F.lit(1.0)) * 100, 2).alias("contribution_pct"),
        round_to(revenue, 0).alias("incremental_revenue"),
        whole_money("spend").alias("total_spend"),
        round_to(revenue / F.greatest("spend", F.lit(1.0)), 3).alias("incremental_roi"),
    ).orderBy(F.desc("contribution_pct"), "channel")


def decompose(features: DataFrame, fit: RidgeFit, channels=C.MEDIA_CHANNELS, date_col="week_start", sales_col="total_revenue") -> DataFrame:
    """Per week: base + calendar + media = predicted, beside the actual sales."""
    media = sum((fit.term(feature_name(c)) for c in channels), F.lit(0.0))
    calendar = sum((fit.term(c) for c in C.CALENDAR_TERMS), F.lit(0.0))
    return features.select(
        date_col,
        (fit.predicted() - calendar - media).alias("base_sales"),
        calendar.alias("calendar_sales"),
        media.alias("media_sales"),
        fit.predicted().alias("total_predicted"),
        F.col(sales_col).alias("actual_sales"),
    )


@dataclass(frozen=True)
class MixResult:
    metrics: DataFrame
    channel_contributions: DataFrame
    decomposition: DataFrame
    fit: RidgeFit


def run_mix(
    media: DataFrame, sales: DataFrame, channels=C.MEDIA_CHANNELS, train: float = 0.70, validation: float = 0.15,
    alpha: float = 1.0, decay: float = C.MIX_DECAY, k: float = C.MIX_SATURATION,
    date_col: str = "week_start", sales_col: str = "total_revenue",
) -> MixResult:
    """Fit on the train weeks, measure on the validation weeks, explain all weeks.

    The spend is reduced to week × channel once; features and totals both come from there.
    """
    media = pin(media.groupBy(date_col, "channel").agg(F.sum("spend").alias("spend")))
    features = pin(mix_features(media, sales, channels, decay, k, date_col, sales_col))
    marked = chrono_split(features, date_col, train, validation)
    fit = nonneg_ridge(marked.filter(F.col("split") == "train"), feature_columns(channels), sales_col, alpha)
    return MixResult(
        mix_metrics(marked.filter(F.col("split") == "validation"), fit, sales_col),
        channel_contribution(features, fit, media, channels),
        decompose(features, fit, channels, date_col, sales_col),
        fit,
    )
