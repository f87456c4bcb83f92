"""Column functions on prices, sessions and calendars.

Bars carry ``ts``, a UTC time without zone; sessions and days are those of New York.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"


def change(new: Column, old: Column) -> Column:
    """new / old - 1; null where old is 0 or null."""
    return F.try_divide(new, old) - 1


def percent(part: Column, of: Column) -> Column:
    """part / of in percent; null where ``of`` is 0 or null."""
    return F.try_divide(part, of) * 100


def to_zone(ts: Column, zone: str = NEW_YORK, source: str = "UTC") -> Column:
    """The wall clock of ``zone`` at a wall clock of ``source``."""
    return F.convert_timezone(F.lit(source), F.lit(zone), ts)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def in_session(ts: Column, first: int, last: int) -> Column:
    """Whether the minute of the day lies from ``first`` up to, not including, ``last``."""
    return (minute_of_day(ts) >= first) & (minute_of_day(ts) < last)


def premarket(ts: Column) -> Column:
    return in_session(ts, 240, 570)


def regular(ts: Column) -> Column:
    return in_session(ts, 570, 960)


def after_hours(ts: Column) -> Column:
    return in_session(ts, 960, 1200)


def weekday_angle(day: Column) -> tuple[Column, Column]:
    """Sine and cosine of the weekday on the circle of the five trading days, Monday first."""
    turn = F.weekday(day) * F.lit(2 * math.pi / 5)
    return F.sin(turn), F.cos(turn)


def share_of_range(part: Column, high: Column, low: Column) -> Column:
    """part / (high - low), 0 where the range is empty."""
    return F.when(high == low, F.lit(0.0)).otherwise(F.try_divide(part, high - low))


def threshold_flag(x: Column, cut: float) -> Column:
    return F.coalesce(x >= cut, F.lit(False)).cast("int")


def _nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1))


def _last_weekday(year: Column, month: int, weekday: int) -> Column:
    last = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.date_sub(last, F.pmod(F.weekday(last) - F.lit(weekday), F.lit(7)))


def _observed(year: Column, month: int, day: int) -> Column:
    """The date itself, the Friday before a Saturday or the Monday after a Sunday."""
    date = F.make_date(year, F.lit(month), F.lit(day))
    return F.date_add(date, F.when(F.weekday(date) == 5, -1).when(F.weekday(date) == 6, 1).otherwise(0))


def federal_holidays(year: Column) -> Column:
    """The observed US federal holidays that the rules give for a year, as an array of dates."""
    return F.array(
        _observed(year, 1, 1),
        _nth_weekday(year, 1, 0, 3),
        _nth_weekday(year, 2, 0, 3),
        _last_weekday(year, 5, 0),
        F.when(year >= 2021, _observed(year, 6, 19)),
        _observed(year, 7, 4),
        _nth_weekday(year, 9, 0, 1),
        _nth_weekday(year, 10, 0, 2),
        _observed(year, 11, 11),
        _nth_weekday(year, 11, 3, 4),
        _observed(year, 12, 25),
    )


def last_holiday(day: Column, first: Column) -> Column:
    """The latest federal holiday up to ``day`` and not before ``first``, or null.

    The years around a day hold all candidates (a New Year can be observed on December 31), so
    an as-of look-up needs no join.
    """
    near = F.concat(*[federal_holidays(F.year(day) + k) for k in (-1, 0, 1)])
    return F.array_max(F.filter(near, lambda h: (h <= day) & (h >= first)))


def _half_even(x: Column, digits: int) -> Column:
    return F.rint(x * 10.0**digits) / 10.0**digits


def price_band(price: Column) -> Column:
    """(min_target, max_target) around a price, as far off as its tier says; an error at 0 and below.

    The price is rounded to the tier's digits first, the lower target after that; the upper
    target lies as far above.
    """

    def tier(share: float, digits: int) -> Column:
        p = _half_even(price, digits)
        low = _half_even(p * (1 - share), digits)
        return F.struct(low.alias("min_target"), (p + (p - low)).alias("max_target"))

    banded = F.when(price <= 0, F.raise_error(F.lit("a price must be above 0")).cast("struct<min_target:double,max_target:double>"))
    for top, share, digits in ((0.1, 0.12, 4), (0.5, 0.08, 4), (2, 0.05, 3), (10, 0.03, 2)):
        banded = banded.when(price <= top, tier(share, digits))
    return banded.otherwise(tier(0.02, 2))
