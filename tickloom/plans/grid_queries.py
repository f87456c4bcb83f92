"""Grids, gap filling, time zones, sessions and the daily consolidation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import market
from tickloom.operators import aggregates, grid, joins
from tickloom.plans.feature_queries import LOCAL
from tickloom.plans.registry import BARS, DAILY, MEMBERS, bars_of, daily_of, query


@query(
    """SELECT ts FROM (SELECT unnest(generate_series(TIMESTAMP '2016-01-01', TIMESTAMP '2025-12-31 23:30', INTERVAL 30 MINUTE)) AS ts)
WHERE isodow(ts) < 6 AND hour(ts) BETWEEN 4 AND 19"""
)
def time_grid(t):
    return grid.fixed_grid(t("events").sparkSession, "2016-01-01", "2025-12-31")


_BOUNDED = f"""{BARS}, slots AS (
  SELECT unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)) + INTERVAL 1 DAY, INTERVAL 30 MINUTE)) AS ts FROM bars
), bounded AS (
  SELECT r.symbol, s.ts FROM slots s JOIN (SELECT symbol, min(ts) AS a, max(ts) AS b FROM bars GROUP BY symbol) r ON s.ts BETWEEN a AND b
  WHERE isodow(s.ts) < 6 AND hour(s.ts) BETWEEN 4 AND 19)"""


@query(f"WITH {_BOUNDED} SELECT * FROM bounded")
def grid_bounded(t):
    return grid.slots(bars_of(t))


@query(f"WITH {_BOUNDED} SELECT symbol, ts, close FROM bounded LEFT JOIN bars USING (symbol, ts)")
def grid_left(t):
    bars = bars_of(t)
    return grid.slots(bars).join(bars.select("symbol", "ts", "close"), ["symbol", "ts"], "left")


def _filled_sql(step: str, weekdays: str) -> str:
    """Bars of New York time on the slots of all days, filled from the close."""
    return f"""WITH {LOCAL}, b AS (SELECT min(day) AS lo, max(day) AS hi FROM nb), slots AS (
  SELECT symbol, ts FROM (SELECT DISTINCT symbol FROM nb), (SELECT unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL {step})) AS ts FROM b)
  WHERE hour(ts) BETWEEN 4 AND 19 {weekdays}
), j AS (
  SELECT s.symbol, s.ts, open, high, low, close, vwap, volume, trade_count FROM slots s LEFT JOIN nb ON nb.symbol = s.symbol AND nb.local = s.ts
), c AS (
  SELECT * REPLACE (coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING),
    first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close) FROM j)
SELECT symbol, ts, coalesce(open, close) AS open, coalesce(high, close) AS high, coalesce(low, close) AS low, close, coalesce(vwap, close) AS vwap,
  coalesce(volume, 0) AS volume, coalesce(trade_count, 0) AS trade_count FROM c"""


def _local_bars(t):
    return bars_of(t).withColumn("ts", market.to_zone(F.col("ts")))


@query(_filled_sql("30 MINUTE", "AND isodow(ts) < 6"), "vwap")
def gapfill_30m_global(t):
    bars = _local_bars(t)
    return grid.fill_from_close(grid.global_slots(bars, 30, weekends=False), bars)


@query(_filled_sql("1 MINUTE", ""), "vwap")
def gapfill_1m(t):
    bars = _local_bars(t)
    return grid.fill_from_close(grid.global_slots(bars, 1, weekends=True), bars)


@query(
    f"""WITH {DAILY}, sparse AS (SELECT * FROM daily WHERE isodow(day) < 6), d AS (
  SELECT symbol, day FROM (SELECT DISTINCT symbol FROM sparse), (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM sparse)),
j AS (SELECT symbol, day, open, high, low, volume, trade_count,
  coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING),
    first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close FROM d LEFT JOIN sparse USING (symbol, day))
SELECT symbol, day, coalesce(open, close) AS open, coalesce(high, close) AS high, coalesce(low, close) AS low, close,
  coalesce(volume, 0) AS volume, coalesce(trade_count, 0) AS trade_count FROM j"""
)
def gapfill_1d(t):
    """Daily rows of weekdays, put on a grid of all days."""
    daily = daily_of(t).filter(F.weekday("day") < 5)
    return grid.fill_from_close(grid.global_days(daily), daily, "day")


@query(
    f"""WITH {BARS} SELECT symbol, ts, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS new_york,
  (ts AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS utc FROM bars"""
)
def tz_convert(t):
    ts = F.col("ts")
    return bars_of(t).select("symbol", "ts", market.to_zone(ts).alias("new_york"), market.to_zone(ts, "UTC", market.NEW_YORK).alias("utc"))


@query(f"WITH {LOCAL} SELECT symbol, ts, close FROM nb WHERE m >= 240 AND m < 570")
def session_premarket(t):
    return bars_of(t).filter(market.premarket(market.to_zone(F.col("ts")))).select("symbol", "ts", "close")


@query(f"WITH {LOCAL} SELECT symbol, ts, close FROM nb WHERE m >= 960 AND m < 1200")
def session_after_hours(t):
    return bars_of(t).filter(market.after_hours(market.to_zone(F.col("ts")))).select("symbol", "ts", "close")


#: adjusted bars: the raw ones with the close scaled, without those of odd volume
_ADJ = f"{BARS}, adj AS (SELECT symbol, ts, close * 0.5 AS close FROM bars WHERE volume % 2 = 0)"


def _adjusted(bars):
    return bars.filter("volume % 2 = 0").withColumn("close", F.col("close") * 0.5)


@query(f"WITH {_ADJ} SELECT bars.*, adj.close AS close_adj FROM bars JOIN adj ON bars.symbol = adj.symbol AND bars.ts = adj.ts", "vwap")
def merge_raw_adj(t):
    bars = bars_of(t)
    return joins.with_adjusted_close(bars, _adjusted(bars))


#: memberships of event types, of which some overlap
_SPANS = """(VALUES ('click', 'A', DATE '2024-01-03', DATE '2024-01-20'), ('click', 'B', DATE '2024-01-10', DATE '2024-01-15'),
  ('view', 'B', DATE '2024-01-01', DATE '2024-01-12'), ('view', 'C', DATE '2024-01-08', DATE '2199-12-31')) AS c(symbol, index_symbol, start_date, end_date)"""
_SPAN_ROWS = [
    ("click", "A", "2024-01-03", "2024-01-20"),
    ("click", "B", "2024-01-10", "2024-01-15"),
    ("view", "B", "2024-01-01", "2024-01-12"),
    ("view", "C", "2024-01-08", "2199-12-31"),
]


def _spans(t):
    kinds = "symbol string, index_symbol string, start_date string, end_date string"
    rows = t("events").sparkSession.createDataFrame(_SPAN_ROWS, kinds)
    return rows.withColumns({c: F.to_date(c) for c in ("start_date", "end_date")})


@query(
    f"""WITH {_ADJ}, m AS (SELECT bars.*, adj.close AS close_adj, (bars.ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS local
  FROM bars JOIN adj ON bars.symbol = adj.symbol AND bars.ts = adj.ts),
d AS (SELECT symbol, CAST(local AS DATE) AS day, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close,
  arg_max(close_adj, ts) AS close_adj, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(trade_count) AS BIGINT) AS trade_count
  FROM m WHERE local >= TIMESTAMP '2024-01-02' AND local <= TIMESTAMP '2024-01-28' GROUP BY ALL)
SELECT d.*, (SELECT arg_max(index_symbol, end_date) FROM {_SPANS} WHERE c.symbol = d.symbol AND day >= start_date AND day < end_date) AS size_index FROM d"""
)
def consolidate_daily(t):
    """Raw and adjusted bars merged, trimmed, rolled up to days and labelled with an index."""
    bars = bars_of(t)
    return aggregates.consolidated(bars, _adjusted(bars), "2024-01-02", "2024-01-28", {"size_index": _spans(t)})


@query(
    f"""WITH {MEMBERS}, spans AS (SELECT o_custkey AS symbol, o_orderpriority AS index_symbol, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY ALL)
SELECT o_orderkey, symbol, day, (SELECT arg_max(index_symbol, (b, index_symbol)) FROM spans s WHERE s.symbol = r.symbol AND r.day >= a AND r.day < b) AS index_symbol
FROM (SELECT o_orderkey, o_custkey AS symbol, CAST(o_orderdate AS DATE) AS day FROM orders) r"""
)
def interval_join_overlaps(t):
    """Every order with the latest ending of its customer's overlapping intervals."""
    orders = t("orders").select("o_orderkey", F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("day"), "o_orderpriority")
    spans = orders.groupBy("symbol", F.col("o_orderpriority").alias("index_symbol")).agg(F.min("day").alias("start_date"), F.max("day").alias("end_date"))
    return joins.label_intervals(orders.drop("o_orderpriority"), spans)


def _session_sql(first: int, last: int) -> str:
    """One bar per symbol and New York day out of the ticks of a session."""
    return f"""WITH e AS (SELECT event_type AS symbol, ts, event_id, value, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS local FROM events)
SELECT symbol, CAST(local AS DATE) AS session_date, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY ts, event_id) AS close, count(*) AS trade_count FROM e
WHERE isodow(local) < 6 AND hour(local) * 60 + minute(local) >= {first} AND hour(local) * 60 + minute(local) < {last} GROUP BY ALL"""


def _session(t, first: int, last: int):
    return aggregates.session_bars(t("events"), first, last).filter(F.weekday("session_date") < 5)


@query(_session_sql(960, 970))
def session_am10(t):
    return _session(t, 960, 970)


@query(_session_sql(960, 1200))
def session_am4h(t):
    return _session(t, 960, 1200)


@query(_session_sql(180, 420))
def session_pm4h(t):
    return _session(t, 180, 420)


@query("SELECT event_id, CAST(ts AS DATE) AS session_date FROM events")
def session_date(t):
    return t("events").select("event_id", F.to_date("ts").alias("session_date"))


_SYNC = """stored AS (SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS day FROM orders), marks AS (
  SELECT c_custkey AS symbol, max(day) AS last_day FROM customer LEFT JOIN stored ON c_custkey = symbol GROUP BY ALL)"""


def _stored(t):
    return t("orders").select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("day"))


@query(f"WITH {_SYNC} SELECT * FROM marks WHERE last_day IS NOT NULL")
def last_dates(t):
    """The last stored day of each wanted symbol that has one."""
    wanted = t("customer").select(F.col("c_custkey").alias("symbol"))
    return _stored(t).join(wanted, "symbol", "left_semi").groupBy("symbol").agg(F.max("day").alias("last_day"))


#: of every tenth symbol nothing is stored, so that both kinds of symbols occur
_PLAN = f"""WITH {_SYNC.replace("FROM orders)", "FROM orders WHERE o_custkey % 10 <> 0)")}, plan AS (
  SELECT symbol, CAST(coalesce(last_day + 1, DATE '2001-06-01' - 730) AS DATE) AS start, DATE '2001-06-01' AS "end", last_day IS NOT NULL AS has_history FROM marks)
SELECT * FROM plan WHERE start <= "end\""""


def _plan(t):
    wanted = t("customer").select(F.col("c_custkey").alias("symbol"))
    return joins.sync_plan(wanted, _stored(t).filter("symbol % 10 <> 0"), "2001-06-01")


@query(_PLAN)
def sync_plan(t):
    return _plan(t)


@query(f"""SELECT start, "end", count(*) AS symbols, min(symbol) AS first_symbol FROM ({_PLAN}) GROUP BY ALL""")
def sync_buckets(t):
    """Symbols that share a range are fetched together; here how many and the first of them."""
    return _plan(t).groupBy("start", "end").agg(F.count("*").alias("symbols"), F.min("symbol").alias("first_symbol"))


@query("SELECT c_custkey AS symbol, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 200 AS BIGINT) AS chunk FROM customer")
def chunk_ids(t):
    return aggregates.chunked(t("customer").select(F.col("c_custkey").alias("symbol")), "symbol", 200)


@query(
    """SELECT o_custkey AS symbol, day, o_orderkey FROM (
  SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL) n
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey % 3 = 0 AND o.o_custkey = n.o_custkey AND CAST(o.o_orderdate AS DATE) = n.day)"""
)
def insert_if_absent(t):
    """What two thirds of the orders add to the third that is there, by customer and day."""
    rows = t("orders").select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("day"), "o_orderkey")
    return joins.insert_if_absent(rows.filter("o_orderkey % 3 = 0"), rows.filter("o_orderkey % 3 <> 0"), ["symbol", "day"], "o_orderkey")


@query(
    """SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-06-01')"""
)
def backfill_missing(t):
    """The symbols of which nothing recent is stored."""
    recent = t("orders").filter(F.col("o_orderdate") >= F.lit("2000-06-01").cast("timestamp_ntz"))
    return t("customer").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")
