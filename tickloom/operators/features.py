"""Window features over bars and daily rows.

``day_frame`` rolls bars up to one row per symbol and New York day with all that the daily
features need, in one aggregation; each feature is then a window expression over the days of a
symbol. Features built together therefore share one shuffle and one sort, and each one alone
is the same plan with the other columns pruned. A symbol's days are few thousands at most.

The daily features are (symbol, timestamp, feature) with the timestamp at 04:00 of the day.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import market
from tickloom.functions.market import change, percent, share_of_range


def _by_day():
    return Window.partitionBy("symbol").orderBy("day")


def _full(x: Column, first: int, last: int, n: int, value: Column) -> Column:
    """``value`` over the rows from ``first`` to ``last`` if ``x`` has ``n`` values there."""
    frame = _by_day().rowsBetween(first, last)
    return F.when(F.count(x).over(frame) == n, value.over(frame))


def _ordered(pick, value: str, keep: Column | None = None) -> Column:
    """The first or last value by ``ts`` that is not null, of the rows that ``keep`` admits."""
    wanted = F.col(value).isNotNull() if keep is None else F.col(value).isNotNull() & keep
    return pick(value, F.when(wanted, F.col("ts")))


def day_frame(bars: DataFrame) -> DataFrame:
    """One row per symbol and New York day, from bars whose ``ts`` is UTC."""
    local = bars.withColumn("local", market.to_zone(F.col("ts")))
    local = local.withColumns({"day": F.to_date("local"), "pre": market.premarket(F.col("local")), "reg": market.regular(F.col("local"))})
    within = Window.partitionBy("symbol", "day").orderBy("ts")
    ratio = F.try_divide(F.col("close"), F.lag("close").over(within))
    local = local.withColumn("log_ret", F.when(ratio > 0, F.ln(ratio)))
    pre, reg = F.col("pre"), F.col("reg")
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    high, low = F.col("high"), F.col("low")
    volume, money = F.col("volume").cast("double"), F.col("volume") * F.col("vwap")
    return local.groupBy("symbol", "day").agg(
        _ordered(F.max_by, "close").alias("close"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.coalesce(F.sum("log_ret"), F.lit(0.0)).alias("log_ret"),
        F.coalesce(F.sum(money), F.lit(0.0)).alias("dollars"),
        _ordered(F.min_by, "open", market.minute_of_day(F.col("local")) < 570).alias("early_open"),
        F.avg(share_of_range(high - top, high, low)).alias("upper_wick"),
        F.avg(share_of_range(bottom - low, high, low)).alias("lower_wick"),
        F.count_if(pre).alias("pre_rows"),
        _ordered(F.min_by, "open", pre).alias("pre_open"),
        _ordered(F.max_by, "close", pre).alias("pre_close"),
        F.sum(F.when(pre, volume)).alias("pre_volume"),
        F.sum(F.when(pre, volume * volume)).alias("pre_volume_squares"),
        F.sum(F.when(pre, money)).alias("pre_dollars"),
        F.sum(F.when(pre, F.col("trade_count"))).alias("pre_trades"),
        F.count_if(reg).alias("reg_rows"),
        _ordered(F.max_by, "close", reg).alias("reg_close"),
    )


@dataclass(frozen=True)
class Feature:
    """A feature of a day: its columns over ``day_frame`` and the days it is defined on."""

    columns: dict[str, Callable[[], Column]]
    #: of which days rows are returned; evaluated after the columns
    days: Callable[[], Column] | None = None


def _prior(column: str) -> Column:
    return F.lag(column).over(_by_day())


def _daily_return() -> Column:
    return F.col("daily_return")


def _prev_day_return() -> Column:
    return F.lag("daily_return").over(_by_day())


def _std5() -> Column:
    x = F.col("log_ret")
    return _full(x, -4, 0, 5, F.stddev_samp(x))


def _rvol() -> Column:
    x = F.col("dollars")
    return F.try_divide(x, _full(x, -20, -1, 20, F.avg(x)))


def _gap() -> Column:
    first, prior = F.coalesce("early_open", F.lit(0.0)), _prior("close")
    return F.when(prior.isNotNull() & (first != 0), F.try_divide(first - prior, prior)).otherwise(0.0)


def _dist_max() -> Column:
    x = F.col("close")
    top = _full(x, -20, -1, 20, F.max(x))
    return F.try_divide(_prior("close") - top, top)


def _range() -> Column:
    return F.lag(F.try_divide(F.col("high") - F.col("low"), F.col("close"))).over(_by_day())


def _z_pm() -> Column:
    moved, x = F.try_divide(F.col("pre_close") - F.col("pre_open"), F.col("pre_open")), _daily_return()
    return F.try_divide(moved - _full(x, -19, 0, 20, F.avg(x)), _full(x, -19, 0, 20, F.stddev_samp(x)))


def _r_pm() -> Column:
    """Over the days with premarket rows only: those are numbered apart from the others."""
    size = F.try_divide(F.col("pre_volume"), F.col("pre_trades"))
    frame = Window.partitionBy("symbol", F.col("pre_rows") > 0).orderBy("day").rowsBetween(-19, 0)
    usual = F.when(F.count(size).over(frame) == 20, F.percentile(size, F.lit(0.5)).over(frame))
    return F.ln((size + 0.01) / (usual + 0.01))


def _vwap_return() -> Column:
    earlier = _by_day().rowsBetween(Window.unboundedPreceding, -1)
    prior = F.last(F.when(F.col("reg_rows") > 0, F.col("reg_close")), True).over(earlier)
    return change(F.try_divide(F.col("pre_dollars"), F.col("pre_volume")), F.when(F.col("reg_rows") > 0, prior))


def _since_holiday() -> Column:
    first = F.min("day").over(Window.partitionBy("symbol"))
    return F.datediff("day", market.last_holiday(F.col("day"), first)).cast("double")


def _has_premarket() -> Column:
    return F.col("pre_rows") > 0


#: the feature registry; ``attach`` and the queries build from it
FEATURES: dict[str, Feature] = {
    "prev_day_return": Feature({"prev_day_return": _prev_day_return}, lambda: F.col("prev_day_return").isNotNull()),
    "std_return_last5d": Feature({"std_return_last5d": _std5}),
    "range_rel_last1d": Feature({"range_rel_last1d": _range}),
    "rvol_20d": Feature({"rvol_20d": _rvol}),
    "gap_pct": Feature({"gap_pct": _gap}),
    "dist_max_20d": Feature({"dist_max_20d": _dist_max}),
    "upper_wick_ratio_last1d": Feature({"upper_wick_ratio_last1d": lambda: _prior("upper_wick")}),
    "lower_wick_ratio_last1d": Feature({"lower_wick_ratio_last1d": lambda: _prior("lower_wick")}),
    "weekday": Feature({"weekday": lambda: F.date_format("day", "EEEE")}),
    "weekday_cyclic": Feature(
        {"weekday_sin": lambda: market.weekday_angle(F.col("day"))[0], "weekday_cos": lambda: market.weekday_angle(F.col("day"))[1]},
        lambda: F.weekday("day") < 5,
    ),
    "days_since_holiday": Feature({"days_since_holiday": _since_holiday}),
    "hhi_premarket_volume": Feature(
        {"hhi_premarket_volume": lambda: F.try_divide(F.col("pre_volume_squares"), F.col("pre_volume") * F.col("pre_volume"))}, _has_premarket
    ),
    "z_pm": Feature({"z_pm": _z_pm}, _has_premarket),
    "R_PM_hist": Feature({"R_PM_hist": _r_pm}, _has_premarket),
    "PM_VWAP_Return": Feature({"PM_VWAP_Return": _vwap_return}, _has_premarket),
}


def _with_returns(days: DataFrame) -> DataFrame:
    return days.withColumn("daily_return", change(F.col("close"), _prior("close")))


def feature(bars: DataFrame, name: str) -> DataFrame:
    """(symbol, timestamp, the feature's columns) of one registered feature."""
    made = FEATURES[name]
    out = _with_returns(day_frame(bars)).withColumns({c: f() for c, f in made.columns.items()})
    if made.days is not None:
        out = out.filter(made.days())
    return out.select("symbol", _at_four(), *made.columns)


def _at_four() -> Column:
    return (F.col("day").cast("timestamp_ntz") + F.expr("interval 4 hours")).alias("timestamp")


def attach(daily: DataFrame, bars: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``daily`` (symbol, day, ...) with the columns of registered features, all from one plan.

    Columns of ``daily`` named like a feature's are replaced. Days on which a feature has no
    row get null; days that ``daily`` lacks are left out.
    """
    chosen = [FEATURES[n] for n in (names or FEATURES)]
    out = _with_returns(day_frame(bars))
    for made in chosen:
        # days are judged on the columns as they come, then the others' values become null
        out = out.withColumns({c: f() for c, f in made.columns.items()})
        if made.days is not None:
            wanted = made.days()
            out = out.withColumns({c: F.when(wanted, F.col(c)) for c in made.columns})
    columns = [c for made in chosen for c in made.columns]
    return daily.drop(*columns).join(out.select("symbol", "day", *columns), ["symbol", "day"], "left")


def lookback_percent(bars: DataFrame, steps: list[int]) -> DataFrame:
    """Percent change of each close against the open ``k`` bars back; 0 is the bar itself."""
    by = Window.partitionBy("symbol").orderBy("ts")
    back = {k: F.lag("open", k).over(by) for k in steps}
    return bars.select("symbol", "ts", *[percent(F.col("close") - o, o).alias(f"pct_{k}") for k, o in back.items()])


def candle_percent(bars: DataFrame) -> DataFrame:
    """Percent of the open that a bar spans, that it moves, and of the last close that it opens off."""
    prior = F.lag("close").over(Window.partitionBy("symbol").orderBy("ts"))
    return bars.select(
        "symbol",
        "ts",
        percent(F.col("high") - F.col("low"), F.col("open")).alias("pct_high_low"),
        percent(F.col("close") - F.col("open"), F.col("open")).alias("pct_open_close"),
        percent(F.col("open") - prior, prior).alias("pct_gap"),
    )


def true_range(bars: DataFrame) -> DataFrame:
    """(symbol, ts, tr, rel_tr): the range widened to the last close (the own open without one)."""
    prior = F.coalesce(F.lag("close").over(Window.partitionBy("symbol").orderBy("ts")), F.col("open"))
    wide = bars.withColumn("_prior", prior).withColumn("tr", F.greatest("high", "low", "_prior") - F.least("low", "_prior"))
    return wide.select("symbol", "ts", "tr", F.try_divide(F.col("tr"), F.col("_prior")).alias("rel_tr"))


def smoothed(rows: DataFrame, alphas: dict[str, float], column: str, order: str) -> DataFrame:
    """(symbol, order, one column per alpha): y = alpha x + (1 - alpha) y, starting at the first value.

    The recursion is linear in a symbol's rows, which are sorted by the shuffle and read as a
    stream of Arrow batches: a task holds one batch and one state per alpha. A null keeps the
    last value; before the first value the result is null.
    """
    names = list(alphas)
    kinds = rows.schema
    dealt = rows.select("symbol", order, F.col(column).cast("double").alias("_x")).repartition("symbol").sortWithinPartitions("symbol", order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, {}
        for batch in batches:
            symbol, x = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out: dict[str, list] = {n: [] for n in names}
            for s, value in zip(symbol, x):
                if s != held:
                    held, state = s, dict.fromkeys(names)
                for n in names:
                    y = state[n]
                    if value is not None:
                        y = value if y is None else alphas[n] * value + (1 - alphas[n]) * y
                    state[n] = y
                    out[n].append(y)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(out[n], pa.float64()) for n in names]], ["symbol", order, *names]
            )

    schema = ", ".join([f"symbol {kinds['symbol'].dataType.simpleString()}", f"{order} {kinds[order].dataType.simpleString()}", *[f"{n} double" for n in names]])
    return dealt.mapInArrow(work, schema)


def relative_true_range_means(bars: DataFrame, soft: float = 0.01, peak: float = 0.1) -> DataFrame:
    """(symbol, ts, soft, peak): two recursive means of the relative true range."""
    if peak <= soft:
        raise ValueError("the peak's alpha must be above the soft one's")
    return smoothed(true_range(bars), {"soft": soft, "peak": peak}, "rel_tr", "ts")


def bars_above(bars: DataFrame, soft: float = 0.001, peak: float = 0.01) -> DataFrame:
    """(symbol, soft_above, peak_above): bars whose recursive means lie above two thresholds."""
    means = relative_true_range_means(bars)
    return means.groupBy("symbol").agg(F.count_if(F.col("soft") > soft).alias("soft_above"), F.count_if(F.col("peak") > peak).alias("peak_above"))
