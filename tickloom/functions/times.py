"""Column functions on times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.market import minute_of_day


def parsed(x: Column) -> Column:
    """A time out of text, null where it is none."""
    return F.try_to_timestamp(x).cast("timestamp_ntz")


def parts(ts: Column) -> dict[str, Column]:
    return {"day": F.to_date(ts), "minute": minute_of_day(ts), "year": F.year(ts), "month": F.month(ts)}


def day_start(ts: Column) -> Column:
    return F.date_trunc("day", ts).cast("timestamp_ntz")


def day_ceiling(ts: Column) -> Column:
    """The midnight at or after a time."""
    start = day_start(ts)
    return F.when(start == ts, start).otherwise(start + F.expr("interval 1 day"))


def request_bounds(first: Column, last: Column) -> tuple[Column, Column]:
    """From one second after the start of the first day to one before the end of the last."""
    return day_start(first) + F.expr("interval 1 second"), day_ceiling(last) - F.expr("interval 1 second")


def at_time(day: Column, minutes: int) -> Column:
    return day.cast("timestamp_ntz") + F.expr(f"interval {minutes} minutes")
