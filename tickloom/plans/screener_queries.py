"""The screener: volume band, recursive means above thresholds, returns of the last days and minutes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import market
from tickloom.operators import aggregates, features, grid
from tickloom.plans.feature_queries import LOCAL
from tickloom.plans.grid_queries import _filled_sql, _local_bars
from tickloom.plans.registry import BARS, DAILY, bars_of, daily_of, query
from tickloom.sources.bars import event_bars

_BAND = "100000 AND 250000"


@query(
    f"""WITH {BARS}, amounts AS (
  SELECT symbol, CAST(ts AS DATE) AS day, sum(volume) * (sum(vwap * volume) / sum(volume)) AS amount FROM bars WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-15' - 8 AND DATE '2024-01-15' - 1 GROUP BY ALL)
SELECT symbol FROM amounts GROUP BY symbol HAVING bool_and(amount BETWEEN {_BAND})"""
)
def all_days_in_range(t):
    """Symbols whose traded amount lay within the band on every day of the week before a date."""
    bars = event_bars(t("events"))
    days = bars.groupBy("symbol", F.to_date("ts").alias("day")).agg(
        F.sum("volume").alias("volume"), F.try_divide(F.sum(F.col("vwap") * F.col("volume")), F.sum("volume")).alias("vwap")
    )
    return aggregates.within_band(days.filter(F.col("day").between(F.lit("2024-01-07").cast("date"), F.lit("2024-01-14").cast("date"))), 100_000, 250_000)


_TR = f"""{BARS}, pr AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY ts), open) AS p FROM bars),
n AS (SELECT symbol, ts, (greatest(high, low, p) - least(low, p)) / nullif(p, 0) AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM pr),
e AS (SELECT symbol, x AS soft, x AS peak, i FROM n WHERE i = 1
  UNION ALL SELECT n.symbol, 0.01 * n.x + 0.99 * e.soft, 0.1 * n.x + 0.9 * e.peak, n.i FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)"""


@query(f"WITH RECURSIVE {_TR} SELECT symbol, count(*) FILTER (soft > 1.5) AS soft_above, count(*) FILTER (peak > 2) AS peak_above FROM e GROUP BY symbol")
def minutes_above(t):
    """How many bars had their recursive means of the relative true range above a threshold."""
    return features.bars_above(bars_of(t), 1.5, 2.0)


def _tail_sql(rows: str, order: str, sizes: list[int], unit: str) -> str:
    parts = ", ".join(
        f"""CASE WHEN count(*) FILTER (n <= {d}) = {d} THEN max(close) FILTER (n = 1) / max(open) FILTER (n = {d}) - 1 END AS return_{d}{unit},
  CASE WHEN count(*) FILTER (n <= {d}) = {d} THEN stddev_samp(close) FILTER (n <= {d}) / max(open) FILTER (n = {d}) END AS std_{d}{unit}"""
        for d in sizes
    )
    return f"SELECT symbol, {parts} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {order} DESC) AS n FROM ({rows})) GROUP BY symbol"


def _tail(name: str, days: int):
    def plan(t):
        out = aggregates.tail_returns(daily_of(t), [days])
        return out.toDF("symbol", "ret", "std")

    plan.__name__ = name
    sql = _tail_sql(f"WITH {DAILY} SELECT * FROM daily", "day", [days], "d")
    query(f"SELECT symbol, return_{days}d AS ret, std_{days}d AS std FROM ({sql})", "ret std")(plan)


_tail("tail_returns_7d", 7)
_tail("tail_returns_30d", 30)


@query(
    f"SELECT * EXCLUDE std_1d FROM ({_tail_sql(f'WITH {DAILY} SELECT * FROM daily', 'day', [1, 7, 30, 180], 'd')})",
    "return_1d return_7d std_7d return_30d std_30d return_180d std_180d",
)
def tail_returns_d(t):
    """The events span 30 days, so the columns of 180 days are null here; a fixture tests them."""
    return aggregates.tail_returns(daily_of(t), [1, 7, 30, 180])


_MINUTES = _tail_sql(_filled_sql("1 MINUTE", ""), "ts", [60, 240], "m")


@query(_MINUTES, "return_60m std_60m return_240m std_240m")
def tail_returns_m(t):
    """Returns and deviations of the last hour and four hours of the filled minutes."""
    bars = _local_bars(t)
    return aggregates.tail_returns(grid.fill_from_close(grid.global_slots(bars, 1, weekends=True), bars), [60, 240], "m", "ts")


@query(
    f"""WITH {LOCAL}, s AS (SELECT symbol, count(*) AS bars FROM nb GROUP BY symbol)
SELECT s.symbol, s.bars, r.return_7d, r.std_7d FROM s LEFT JOIN ({_tail_sql(f"WITH {DAILY} SELECT * FROM daily WHERE symbol <> 'error'", "day", [7], "d")}) r USING (symbol)""",
    "return_7d std_7d",
)
def screener_merge(t):
    """All symbols with the returns of those that have them."""
    counts = bars_of(t).withColumn("local", market.to_zone(F.col("ts"))).groupBy("symbol").agg(F.count("local").alias("bars"))
    return counts.join(aggregates.tail_returns(daily_of(t).filter("symbol <> 'error'"), [7]), "symbol", "left")
