"""Column expressions shared by the operators. All of them stay inside code generation."""

from pyspark.sql import Column, functions as F

from tidemark import constants as C


def round_to(column: Column | str, digits: int = 0) -> Column:
    """Scale, round halves to even, scale back: plain double arithmetic, and never -0.0."""
    column = F.col(column) if isinstance(column, str) else column
    scale = float(10**digits)
    return F.rint(column * scale) / scale + F.lit(0.0)


def whole_money(column: Column | str) -> Column:
    """Money in whole units. Cents come first, so that summation noise cannot tip an exact half."""
    return round_to(round_to(column, 2))


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom with the divisor held at 1 or more."""
    return top / F.greatest(bottom.cast("double"), F.lit(1.0))


def percent_of(top: Column, bottom: Column, digits: int = 2) -> Column:
    return round_to(safe_ratio(top, bottom) * 100, digits)


def sum_or_zero(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def clip(column: Column, low=None, high=None) -> Column:
    """Bound a column; nulls stay null."""
    bounded = column
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(column.isNotNull(), bounded)


def saturate(column: Column, k: float) -> Column:
    """Diminishing returns x / (1 + k x)."""
    return column / (1 + F.lit(float(k)) * column)


def media_ratios() -> dict[str, Column]:
    """Cost and response ratios of a media row."""
    spend, imps = F.col("spend"), F.col("impressions")
    clicks, conv = F.col("clicks"), F.col("conversions")
    return {
        "cpm": safe_ratio(spend, imps) * 1000,
        "ctr": safe_ratio(clicks, imps),
        "cvr": safe_ratio(conv, clicks),
        "cpc": safe_ratio(spend, clicks),
        "cpa": safe_ratio(spend, conv),
    }


def deal_size_band(value: Column) -> Column:
    return (
        F.when(value < C.SMALL_DEAL_BELOW, "Small")
        .when(value <= C.MID_DEAL_UP_TO, "Mid")
        .otherwise("Large")
    )


def risk_tier(probability: Column) -> Column:
    return (
        F.when(probability >= C.HIGH_RISK_FROM, "High")
        .when(probability >= C.MEDIUM_RISK_FROM, "Medium")
        .otherwise("Low")
    )


def growth_tier(score: Column) -> Column:
    """A null score falls to the last tier."""
    return (
        F.when(score >= C.HIGH_GROWTH_FROM, "High Potential")
        .when(score >= C.MODERATE_GROWTH_FROM, "Moderate")
        .otherwise("Stable/Declining")
    )


def recommended_action(churned: Column, risk: Column, growth: Column) -> Column:
    """First matching rule wins."""
    medium = risk == "Medium"
    return (
        F.when(churned == 1, C.ACTION_CHURNED)
        .when(risk == "High", C.ACTION_HIGH_RISK)
        .when(medium & (growth == "High Potential"), C.ACTION_MEDIUM_HIGH)
        .when(medium & (growth == "Moderate"), C.ACTION_MEDIUM_MODERATE)
        .when((risk == "Low") & (growth == "High Potential"), C.ACTION_LOW_HIGH)
        .otherwise(C.ACTION_OTHER)
    )


def roas_band(roas: Column) -> Column:
    return (
        F.when(roas >= C.ROAS_GREEN_FROM, "green")
        .when(roas >= C.ROAS_AMBER_FROM, "amber")
        .otherwise("red")
    )


def severity_rank(severity: Column) -> Column:
    """Sort key: critical, then warning, then the rest."""
    return (
        F.when(severity == "critical", 0)
        .when(severity == "warning", 1)
        .when(severity.isin("info", "ok"), 2)
        .otherwise(3)
    )


def forecast_warning(mape: Column, r2: Column) -> Column:
    return (
        F.when(mape > C.FORECAST_MAPE_LIMIT, F.format_string(C.FORECAST_MAPE_TEXT, round_to(mape, 1)))
        .when(r2 < C.R2_LIMIT, F.format_string(C.FORECAST_R2_TEXT, round_to(r2, 2)))
    )


def mix_warning(mape: Column, r2: Column) -> Column:
    return (
        F.when(mape > C.MIX_MAPE_LIMIT, F.format_string(C.MIX_MAPE_TEXT, round_to(mape, 1)))
        .when(r2 < C.R2_LIMIT, F.format_string(C.MIX_R2_TEXT, round_to(r2, 2)))
    )


def shorten(text: Column, limit: int = 90, separators: tuple[str, ...] = (". ",)) -> Column:
    """The lead sentence when it ends before `limit`, else the text cut at `limit`."""
    cut = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)
    for mark in reversed(separators):
        at = F.instr(text, mark)
        cut = F.when(at.between(1, limit), F.left(text, at - 1)).otherwise(cut)
    return F.when(text.isNotNull(), cut)
