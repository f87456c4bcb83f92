"""Streams: bars behind a watermark, inserts without repeats, running means."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.sources.bars import event_order


def streaming_bars(events: DataFrame, minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """Bars of a streaming frame (event_type, event_id, ts, value, props), closed by a watermark.

    ``ts`` is a timestamp without zone or one of the session's; the bars are those of the batch
    source. Events later than ``late`` behind the newest are left out.
    """
    kind = events.schema["ts"].dataType.simpleString()
    plain = events if kind == "timestamp_ntz" else events.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows = plain.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("at"),
        event_order().alias("nth"),
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("volume"),
    )
    bars = rows.withWatermark("at", late).groupBy("symbol", F.window("at", f"{minutes} minutes")).agg(
        F.min_by("value", "nth").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "nth").alias("close"),
        F.sum("volume").alias("volume"),
        F.count("*").alias("trade_count"),
        F.try_divide(F.sum(F.col("value") * F.col("volume")), F.sum("volume")).alias("vwap"),
    )
    return bars.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume", "trade_count", "vwap")


def without_repeats(rows: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark: an insert that may be sent twice."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def running_mean(rows: DataFrame, alpha: float, column: str = "close", order: str = "ts") -> DataFrame:
    """(symbol, order, mean): the recursive mean of a streaming frame, one state per symbol.

    Rows of a symbol count in the order of a micro-batch's ``order``; the batches, in theirs.
    A null keeps the mean.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean = state.get[0] if state.exists else None
        for frame in [pd.concat(list(frames)).sort_values(order)]:
            out = []
            for x in frame[column]:
                if x == x and x is not None:
                    mean = x if mean is None else alpha * x + (1 - alpha) * mean
                out.append(mean)
            if mean is not None:
                state.update((mean,))
            yield pd.DataFrame({"symbol": key[0], order: frame[order].to_numpy(), "mean": out})

    kind = rows.schema[order].dataType.simpleString()
    return rows.groupBy("symbol").applyInPandasWithState(
        step, f"symbol string, {order} {kind}, mean double", "mean double", "append", GroupStateTimeout.NoTimeout
    )
