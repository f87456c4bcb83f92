"""Registry of plans and the DuckDB statements they must equal, with the SQL they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import aggregates
from tickloom.sources.bars import event_bars, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
BARS = f"""bars AS (
  SELECT event_type AS symbol, time_bucket(INTERVAL 30 MINUTE, ts) AS ts,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, CAST(sum({_K}) AS BIGINT) AS volume, count(*) AS trade_count,
         sum(value * {_K}) / nullif(sum({_K}), 0) AS vwap
  FROM events WHERE ts IS NOT NULL GROUP BY ALL)"""
DAILY = f"""{BARS}, daily AS (
  SELECT symbol, CAST(ts AS DATE) AS day, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low,
         last(close ORDER BY ts) AS close, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(trade_count) AS BIGINT) AS trade_count
  FROM bars GROUP BY ALL)"""
MEMBERS = """members AS (
  SELECT c_custkey AS symbol, c_mktsegment AS index_symbol, CAST(min(o_orderdate) AS DATE) AS start_date, CAST(max(o_orderdate) AS DATE) AS end_date
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def query(sql: str, rounded: str = ""):
    """Register a plan; the double columns named in ``rounded`` are compared to 6 decimals."""

    def add(plan):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = plan(lambda name: table(spark, sf_dir, name))
            return out.withColumns({c: F.round(c, 6) for c in rounded.split()}) if rounded else out

        swap = ", ".join(f"round({c}, 6) AS {c}" for c in rounded.split())
        QUERIES[plan.__name__] = run
        ORACLES[plan.__name__] = f"SELECT * REPLACE ({swap}) FROM ({sql})" if rounded else sql
        return plan

    return add


def bars_of(t) -> DataFrame:
    return event_bars(t("events"))


def daily_of(t) -> DataFrame:
    return aggregates.daily_ohlcv(bars_of(t))
