"""Date labels and calendar columns."""

import datetime as dt
import math

from pyspark.sql import Column, functions as F

from tidemark import constants as C


def as_date(value) -> dt.date | None:
    """Text or date to a typed literal; blank text counts as absent."""
    if value is None or value == "":
        return None
    if isinstance(value, dt.datetime):
        return value.date()
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(str(value)[:10])


def month_period(day: Column) -> Column:
    return F.trunc(day, "MM")


def week_period(day: Column) -> Column:
    """First day of the Monday-to-Sunday week."""
    return F.trunc(day, "week")


def closing_monday(day: Column) -> Column:
    """Label of the Tuesday-to-Monday week: its last day."""
    return F.next_day(F.date_sub(day, 1), "Mon")


def bucket_label(day: Column, granularity: str) -> Column:
    """Period label; an unknown granularity is read as weekly."""
    if granularity == "daily":
        return day
    if granularity == "monthly":
        return month_period(day)
    return closing_monday(day)


def _monday_from(day: dt.date) -> dt.date:
    """The first Monday that is not before `day`."""
    return day + dt.timedelta(-day.weekday() % 7)


def _month_after(day: dt.date) -> dt.date:
    return (day.replace(day=1) + dt.timedelta(31)).replace(day=1)


def raw_days(kind: str, start=None, end=None) -> tuple[dt.date | None, dt.date | None]:
    """The days whose period label lies in [start, end]: first day, and the first day after them.

    Labels are "day", "week" (its Monday), "closing week" (the Monday that ends it) or "month" (its first day).
    A label grows with the day, so the range of labels is one range of days and neither bound loses or adds a day.
    """
    start, end = as_date(start), as_date(end)
    day = dt.timedelta(1)
    after = None if end is None else end + day
    if kind in ("week", "closing week"):
        back = dt.timedelta(6 if kind == "closing week" else 0)
        return start and _monday_from(start) - back, after and _monday_from(after) - back
    if kind == "month":
        first = start if start is None or start.day == 1 else _month_after(start)
        return first, end and _month_after(end)
    if kind != "day":
        raise ValueError(f"unknown period {kind!r}")
    return start, after


def calendar_features(day: Column) -> dict[str, Column]:
    yearly = F.dayofyear(day) * (2 * math.pi) / 365
    return {
        "day_of_week": F.weekday(day),
        "day_of_year": F.dayofyear(day),
        "week_of_year": F.weekofyear(day),
        "month": F.month(day),
        "quarter": F.quarter(day),
        "year": F.year(day),
        "sin_doy": F.sin(yearly),
        "cos_doy": F.cos(yearly),
    }


def week_harmonics(day: Column) -> dict[str, Column]:
    angle = F.weekofyear(day) * (2 * math.pi) / 52
    return {"sin_week": F.sin(angle), "cos_week": F.cos(angle)}


def months_between_30(later: Column, earlier: Column) -> Column:
    """Days over 30.44, halves to the even month."""
    return F.rint(F.date_diff(later, earlier) / F.lit(30.44)).cast("long")


def days_between(later: Column, earlier: Column) -> Column:
    return F.date_diff(later, earlier).cast("long")


def _product_of(lifts) -> Column:
    total = F.lit(1.0)
    for inside, lift in lifts:
        total = total * F.when(inside, F.lit(lift)).otherwise(F.lit(1.0))
    return total


def window_lift(day: Column, windows=C.PROMO_WINDOWS) -> Column:
    """Promotion lift by window: from a day of the first month on, or up to a day of the last.

    The two halves are joined by "or", so a window inside one month covers all of that month
    whenever its first day is not after its last.
    """
    month, dom = F.month(day), F.dayofmonth(day)
    return _product_of(
        (((month == m1) & (dom >= d1)) | ((month == m2) & (dom <= d2)), lift)
        for m1, d1, m2, d2, lift in windows
    )


def month_lift(day: Column, periods=C.PROMO_MONTHS) -> Column:
    """Promotion lift by calendar month range."""
    return _product_of((F.month(day).between(first, last), lift) for first, last, lift in periods)
