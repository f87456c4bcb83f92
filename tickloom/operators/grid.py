"""Regular trading grids: slots per symbol, gap filling, date trimming.

Slots come from ``sequence``, day by day, so no night is generated to be dropped; filling is one
window per direction, linear in a symbol's slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def symbol_ranges(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def trim_dates(bars: DataFrame, first: str, last: str) -> DataFrame:
    """Bars from midnight of ``first`` to midnight of ``last``, both included."""
    return bars.filter(F.col("ts").between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")))


def _weekday_slots(days: Column, first: int, last: int, minutes: int, weekends: bool = False) -> Column:
    """An array of the slots of an array of dates: every ``minutes`` from minute ``first`` up to, not including, ``last``."""
    wanted = days if weekends else F.filter(days, lambda d: F.weekday(d) < 5)
    starts = F.expr(f"sequence(0, {(last - 1 - first) // minutes})")

    def of_day(day: Column) -> Column:
        opens = day.cast("timestamp_ntz") + F.expr(f"interval {first} minutes")
        return F.transform(starts, lambda k: opens + k * F.expr(f"interval {minutes} minutes"))

    return F.flatten(F.transform(wanted, of_day))


def slots(bars: DataFrame, minutes: int = 30) -> DataFrame:
    """(symbol, ts): weekday slots from 04:00 to before 20:00 within each symbol's range.

    Slots lie on the symbol's own raster, which its first bar sets; nights and weekends are
    never generated.
    """
    ranges = symbol_ranges(bars)
    days = F.sequence(F.to_date("first_ts"), F.to_date("last_ts"))
    offset = F.expr(f"pmod(timestampdiff(MINUTE, TIMESTAMP_NTZ'1970-01-01 00:00:00', first_ts), {minutes})")
    each = ranges.withColumn("_offset", offset).select(
        "symbol", "first_ts", "last_ts", "_offset", F.explode(_weekday_slots(days, 240, 1200, minutes)).alias("ts")
    )
    # a raster that is off the full slots moves with its first bar
    moved = F.when(F.col("_offset") == 0, F.col("ts")).otherwise(F.col("ts") + F.col("_offset") * F.expr("interval 1 minute"))
    each = each.withColumn("ts", moved)
    return each.filter(F.col("ts").between(F.col("first_ts"), F.col("last_ts"))).select("symbol", "ts")


def fixed_grid(spark, first: str, last: str, minutes: int = 30) -> DataFrame:
    """(ts): every weekday slot from 04:00 to before 20:00 between two days, both included."""
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return spark.range(1).select(F.explode(_weekday_slots(days, 240, 1200, minutes)).alias("ts"))


def global_slots(bars: DataFrame, minutes: int, weekends: bool) -> DataFrame:
    """(symbol, ts): the same slots for every symbol, over the days of all bars together."""
    ranges = symbol_ranges(bars)
    bounds = ranges.agg(F.to_date(F.min("first_ts")).alias("_lo"), F.to_date(F.max("last_ts")).alias("_hi"))
    each = _weekday_slots(F.sequence("_lo", "_hi"), 240, 1200, minutes, weekends)
    # one row of bounds beside one row per symbol
    return ranges.select("symbol").crossJoin(F.broadcast(bounds)).select("symbol", F.explode(each).alias("ts"))


def global_days(daily: DataFrame) -> DataFrame:
    """(symbol, day): every day, weekends too, between the first and the last of all rows."""
    symbols = daily.select("symbol").distinct()
    bounds = daily.agg(F.min("day").alias("_lo"), F.max("day").alias("_hi"))
    return symbols.crossJoin(F.broadcast(bounds)).select("symbol", F.explode(F.sequence("_lo", "_hi")).alias("day"))


def fill_from_close(grid: DataFrame, bars: DataFrame, at: str = "ts") -> DataFrame:
    """The bars on a grid: a missing close is the last one before, else the next one after;
    missing prices are that close; no volume and no trades where there is no bar."""
    joined = grid.join(bars, ["symbol", at], "left")
    by = Window.partitionBy("symbol").orderBy(at)
    # without a close before, the next one is the symbol's first: a frame over all its rows, which is
    # linear, as one that reaches from each row to the end is not
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    close = F.coalesce(F.last("close", True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.first("close", True).over(whole))
    prices = [c for c in ("open", "high", "low", "vwap") if c in bars.columns]
    filled = joined.withColumn("close", close)
    filled = filled.withColumns({c: F.coalesce(c, "close") for c in prices})
    return filled.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("volume", "trade_count")})


def fill_gaps(bars: DataFrame, minutes: int = 30) -> DataFrame:
    """The grid with prices: the last close before a gap, else the next open; no volume in it."""
    joined = slots(bars, minutes).join(bars, ["symbol", "ts"], "left")
    by = Window.partitionBy("symbol").orderBy("ts")
    before = F.last("close", True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    # in descending order the frame only grows, so that both directions are linear
    after = F.last("open", True).over(Window.partitionBy("symbol").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0))
    fill = F.coalesce(before, after)
    return joined.withColumn("fill", fill).select(
        "symbol",
        "ts",
        *[F.coalesce(c, "fill").alias(c) for c in ("open", "high", "low", "close", "vwap")],
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("volume", "trade_count")],
    )
