"""Trend events: one row per movement of a price in one direction, out of bars and finer candles.

A bar whose adjusted range reaches a target around the reference price is looked into: its
candles are followed until a close reaches a target, which ends the event and starts the next
one at that close. A factor of adjusted to raw close, against the one at the event's start,
takes splits out. The last event of a symbol is open and always there.

A price may be 0 or less. It ends an event as any other does, but has no targets itself: an event
that starts at it ends at the first close above 0, and its change in per cent is null. A bar whose
close gives no factor above 0 keeps the factor before it.

The state machine is sequential in a symbol, so the rows are dealt by symbol, sorted, and read
as a stream: a task holds one batch and one symbol's state, however long its history.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "symbol string, start_time timestamp_ntz, end_time timestamp_ntz, open double, high double, low double, "
    "close double, close_adj double, factor double, pct_change double"
)
#: fixed values: up to which price, which share a target is off and with how many digits
TIERS = [(0.1, 0.12, 4), (0.5, 0.08, 4), (2.0, 0.05, 3), (10.0, 0.03, 2), (float("inf"), 0.02, 2)]
MINUTE = 60_000_000


def targets(price: float) -> tuple[float, float]:
    """(lower, upper) target of a price."""
    if price <= 0:
        raise ValueError("a reference price must be above 0")
    share, digits = next((s, d) for top, s, d in TIERS if price <= top)
    near = round(price, digits)
    lower = round(near * (1 - share), digits)
    return lower, near + (near - lower)


@dataclass
class Trend:
    """The open event of one symbol; a factor is None until a bar has one."""

    symbol: str
    price: float
    factor: float | None
    start: int
    high: float
    low: float
    ratio: float = 1.0
    bar_factor: float | None = None
    inside: bool = False
    last: tuple[int, float] = (0, 0.0)

    def bar(self, at: int, high: float, low: float, close: float, adjusted: float) -> None:
        """A bar: either it only widens the range, or its candles are to be followed."""
        found = adjusted / close if close else 0.0
        if 0 < found < math.inf:
            self.bar_factor = found
            if self.factor is None:
                self.factor = found
            ratio = found / self.factor
            self.ratio = round(ratio, 3) or ratio  # a split of more than 2000 to 1 must not make it 0
        self.last = (at, close)
        lower, upper = self._band()
        self.inside = high * self.ratio >= upper or low * self.ratio <= lower
        if not self.inside:
            self.high, self.low = max(self.high, high), min(self.low, low)

    def candle(self, at: int, high: float, low: float, close: float) -> tuple | None:
        """A candle of the bar that came last; the event that it ends, if it does."""
        if not self.inside:
            return None
        self.high, self.low = max(self.high, high), min(self.low, low)
        now = close * self.ratio
        lower, upper = self._band()
        if lower < now < upper:
            return None
        if self.ratio > 1:
            self.high = round(self.high / self.ratio, 3)
        elif self.ratio < 1:
            self.low = round(self.low * self.ratio, 3)
        done = self._row(at, self.price / self.ratio, close, now)
        self.price = self.high = self.low = close
        self.start, self.factor, self.ratio = at + MINUTE, self.bar_factor, 1.0
        return done

    def open_event(self) -> tuple:
        at, close = self.last
        return self._row(at, self.price, close, close * self.ratio)

    def _band(self) -> tuple[float, float]:
        """The targets; of a price that has none, anything above 0."""
        return targets(self.price) if self.price > 0 else (-math.inf, math.ulp(0.0))

    def _row(self, end: int, first: float, close: float, now: float) -> tuple:
        change = (now - self.price) / self.price if self.price > 0 else None
        return (self.symbol, self.start, end, first, self.high, self.low, close, now, self.ratio, change)


def trend_events(bars: DataFrame, candles: DataFrame, minutes: int = 30) -> DataFrame:
    """Events of every symbol from ``bars`` (symbol, ts, open, high, low, close, close_adj) of
    ``minutes`` and finer ``candles`` (symbol, ts, high, low, close).

    Candles outside every bar are passed over; rows with a null price or one that is no number are
    too. A symbol without bars has no event.
    """
    bucket = F.window("ts", f"{minutes} minutes").start.alias("bucket")
    wide = bars.select("symbol", bucket, F.lit(0).alias("kind"), "ts", "open", "high", "low", "close", "close_adj").na.drop(subset=["open", "close_adj"])
    fine = candles.select(
        "symbol", bucket, F.lit(1).alias("kind"), "ts", F.lit(None).cast("double").alias("open"), "high", "low", "close", F.lit(None).cast("double").alias("close_adj")
    )
    rows = wide.unionByName(fine).na.drop(subset=["symbol", "ts", "high", "low", "close"])
    dealt = rows.repartition("symbol").sortWithinPartitions("symbol", "bucket", "kind", "ts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trend, bar_at = None, None
        for batch in batches:
            out = []
            columns = [batch.column(0).to_pylist(), *[batch.column(k).cast(pa.int64()).to_pylist() for k in (1, 2, 3)]]
            columns += [batch.column(k).to_pylist() for k in range(4, 9)]
            for symbol, start, kind, at, first, high, low, close, adjusted in zip(*columns):
                if trend is not None and trend.symbol != symbol:
                    out.append(trend.open_event())
                    trend = None
                if kind == 0:
                    if trend is None:
                        trend = Trend(symbol, first, None, at, first, first)
                    trend.bar(at, high, low, close, adjusted)
                    bar_at = start
                elif trend is not None and bar_at == start:
                    done = trend.candle(at, high, low, close)
                    if done is not None:
                        out.append(done)
            yield _batch(out)
        if trend is not None:
            yield _batch([trend.open_event()])

    return dealt.mapInArrow(work, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.timestamp("us"), pa.timestamp("us"), *[pa.float64()] * 7]
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)
