"""Registered queries over the driver tables: bars, grids, daily frames, membership, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import market
from tickloom.operators import aggregates, features, grid, joins
from tickloom.plans.registry import BARS, DAILY, MEMBERS, ORACLES, QUERIES, query
from tickloom.plans.registry import bars_of as _bars
from tickloom.plans.registry import daily_of as _daily
from tickloom.sources.bars import constituents, event_bars

__all__ = ["ORACLES", "QUERIES"]


@query(f"WITH {BARS} SELECT * FROM bars", "vwap")
def bars_30m(t):
    return _bars(t)


@query(f"WITH {BARS} SELECT * FROM bars WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'", "vwap")
def trim_dates(t):
    """The raw times are cut first, a bar wider, so that the range reaches the scan."""
    events = grid.trim_dates(t("events"), "2024-01-05", "2024-01-20T00:30:00")
    return grid.trim_dates(event_bars(events), "2024-01-05", "2024-01-20")


@query(f"WITH {BARS} SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY symbol")
def symbol_ranges(t):
    return grid.symbol_ranges(_bars(t))


_SLOTS = f"""{BARS}, slots AS (
  SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 30 MINUTE)) AS ts FROM bars GROUP BY symbol
), grid AS (
  SELECT * FROM slots WHERE isodow(ts) < 6 AND hour(ts) BETWEEN 4 AND 19)"""


@query(f"WITH {_SLOTS} SELECT * FROM grid")
def grid_cross(t):
    return grid.slots(_bars(t))


@query(
    f"""WITH {_SLOTS}, filled AS (
  SELECT symbol, ts, open, high, low, close, vwap, volume, trade_count,
         coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING),
                  first_value(open IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS fill
  FROM grid LEFT JOIN bars USING (symbol, ts))
SELECT symbol, ts, coalesce(open, fill) AS open, coalesce(high, fill) AS high, coalesce(low, fill) AS low, coalesce(close, fill) AS close,
       coalesce(vwap, fill) AS vwap, coalesce(volume, 0) AS volume, coalesce(trade_count, 0) AS trade_count FROM filled""",
    "vwap",
)
def grid_filled(t):
    return grid.fill_gaps(_bars(t))


@query(f"WITH {DAILY} SELECT * FROM daily")
def daily_ohlcv(t):
    return _daily(t)


@query(
    f"""WITH RECURSIVE {DAILY}, n AS (SELECT symbol, day, close, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i FROM daily),
e AS (SELECT symbol, day, close AS ewm, i FROM n WHERE i = 1
  UNION ALL SELECT n.symbol, n.day, 0.1 * n.close + 0.9 * e.ewm, n.i FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)
SELECT symbol, day, ewm FROM e""",
    "ewm",
)
def ewm(t):
    return features.smoothed(_daily(t), {"ewm": 0.1}, "close", "day")


_PRE = "hour(ts) * 60 + minute(ts) >= 240 AND hour(ts) * 60 + minute(ts) < 570"


@query(
    f"WITH {BARS} SELECT symbol, CAST(ts AS DATE) AS day, sum(CAST(volume AS DOUBLE) * volume) / nullif(sum(CAST(volume AS DOUBLE)) ^ 2, 0) AS hhi FROM bars WHERE {_PRE} GROUP BY ALL",
    "hhi",
)
def hhi_premarket(t):
    return aggregates.concentration(_bars(t).filter(market.premarket(F.col("ts"))))


@query(f"WITH {BARS} SELECT symbol, CAST(ts AS DATE) AS day, sum(vwap * volume) / nullif(sum(volume), 0) AS vwap FROM bars WHERE {_PRE} GROUP BY ALL", "vwap")
def vwap_premarket(t):
    return aggregates.weighted_price(_bars(t).filter(market.premarket(F.col("ts"))))


@query(f"WITH {BARS} SELECT * FROM bars WHERE hour(ts) * 60 + minute(ts) >= 570 AND hour(ts) * 60 + minute(ts) < 960", "vwap")
def session_regular(t):
    return _bars(t).filter(market.regular(F.col("ts")))


@query(f"WITH {BARS} SELECT symbol, ts, close FROM bars WHERE isodow(ts) < 6")
def weekdays_only(t):
    return _bars(t).filter(F.weekday("ts") < 5).select("symbol", "ts", "close")


@query("SELECT DISTINCT event_type AS symbol FROM events")
def distinct_symbols(t):
    return t("events").select(F.col("event_type").alias("symbol")).distinct()


@query("SELECT event_type AS symbol, count(*) AS n FROM events GROUP BY ALL")
def value_counts(t):
    """Most frequent first."""
    return t("events").groupBy(F.col("event_type").alias("symbol")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "symbol")


@query("SELECT count(DISTINCT user_id) AS user_id, count(DISTINCT event_type) AS event_type, count(DISTINCT value) AS value FROM events")
def nunique_cols(t):
    return t("events").agg(*[F.countDistinct(c).alias(c) for c in ("user_id", "event_type", "value")])


@query(
    """SELECT event_type AS symbol, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS low,
  quantile_cont(value, 0.25) AS q1, median(value) AS q2, quantile_cont(value, 0.75) AS q3, max(value) AS high FROM events GROUP BY ALL""",
    "mean std q1 q2 q3",
)
def describe_col(t):
    """The exact quartiles share one buffer of a group's distinct values and their counts."""
    found = t("events").groupBy(F.col("event_type").alias("symbol")).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("low"),
        F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
        F.max("value").alias("high"),
    )
    return found.select("symbol", "n", "mean", "std", "low", *[F.col("q")[k].alias(f"q{k + 1}") for k in range(3)], "high")


@query(
    """SELECT * FROM (
  SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r FROM lineitem
  UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem) WHERE abs(r) > 0.0001""",
    "r",
)
def corr_pairs(t):
    return aggregates.correlated_pairs(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], 0.0001)


@query(f"WITH {DAILY} SELECT CAST(isodow(day) - 1 AS INTEGER) AS weekday, median(volume) AS volume FROM daily GROUP BY ALL")
def median_by_weekday(t):
    return _daily(t).groupBy(F.weekday("day").alias("weekday")).agg(F.percentile("volume", F.lit(0.5)).alias("volume"))


_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH_SQL = ", ".join(f'avg(o_totalprice) FILTER (month(o_orderdate) = {k}) AS "{m}"' for k, m in enumerate(_MONTHS, 1))


@query(f"SELECT CAST(year(o_orderdate) AS INTEGER) AS year, {_MONTH_SQL} FROM orders GROUP BY ALL", " ".join(_MONTHS))
def pivot_year_month(t):
    dated = t("orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), "o_totalprice")
    return dated.groupBy("year").pivot("month", list(range(1, 13))).agg(F.avg("o_totalprice")).toDF("year", *_MONTHS)


# the name of an earlier version, whose pivot_year_month had three of the twelve
QUERIES["pivot_year_all_months"], ORACLES["pivot_year_all_months"] = QUERIES["pivot_year_month"], ORACLES["pivot_year_month"]


@query(f"WITH {DAILY} SELECT * EXCLUDE n FROM (SELECT symbol, day, close, row_number() OVER (PARTITION BY symbol ORDER BY day) AS n FROM daily) WHERE n > 5")
def trim_first_n(t):
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("day"))
    return _daily(t).select("symbol", "day", "close", n.alias("n")).filter("n > 5").drop("n")


@query("SELECT symbol, value FROM (SELECT event_type AS symbol, value FROM events) WHERE symbol IN ('click', 'view', 'purchase')")
def filter_isin(t):
    return t("events").filter(F.col("event_type").isin("click", "view", "purchase")).select(F.col("event_type").alias("symbol"), "value")


@query(f"WITH {MEMBERS} SELECT index_symbol, count(*) AS n FROM members GROUP BY ALL")
def constituent_count(t):
    return constituents(t("orders"), t("customer")).groupBy("index_symbol").agg(F.count("*").alias("n"))


@query(
    f"""WITH {MEMBERS}, d AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1995-03-31', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT symbol, index_symbol, day FROM members JOIN d ON start_date <= day AND day < end_date WHERE isodow(day) < 6"""
)
def active_days(t):
    return joins.active_days(constituents(t("orders"), t("customer")), "1995-01-01", "1995-03-31")


@query(
    f"""WITH {MEMBERS}, d AS (SELECT CAST(unnest(generate_series(min(start_date), max(end_date), INTERVAL 1 DAY)) AS DATE) AS day FROM members)
SELECT symbol, index_symbol, day FROM members JOIN d ON start_date <= day AND day < end_date WHERE isodow(day) < 6"""
)
def active_days_whole(t):
    return joins.active_days(constituents(t("orders"), t("customer")))


@query(
    f"""WITH {MEMBERS} SELECT o_orderkey, o_custkey AS symbol, CAST(o_orderdate AS DATE) AS day,
  (SELECT arg_max(index_symbol, end_date) FROM members WHERE symbol = o_custkey AND CAST(o_orderdate AS DATE) >= start_date AND CAST(o_orderdate AS DATE) < end_date) AS index_symbol FROM orders"""
)
def interval_join_index(t):
    rows = t("orders").select("o_orderkey", F.col("o_custkey").alias("symbol"), F.col("o_orderdate").cast("date").alias("day"))
    return joins.label_intervals(rows, constituents(t("orders"), t("customer")))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_members(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_existing(t):
    """Customers without an urgent order; there are some at every size."""
    urgent = t("orders").filter("o_orderpriority = '1-URGENT'")
    return t("customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query(f"WITH {DAILY} SELECT symbol, last(day ORDER BY close, day) AS day, max(close) AS close FROM daily GROUP BY symbol")
def argmax_rows(t):
    return _daily(t).groupBy("symbol").agg(F.max_by("day", F.struct("close", "day")).alias("day"), F.max("close").alias("close"))


@query("SELECT doc_id, CASE WHEN n_chars / 10000.0 >= 0.06 THEN 1 ELSE 0 END AS flag FROM documents")
def label_flag(t):
    return t("documents").select("doc_id", market.threshold_flag(F.col("n_chars") / 10000, 0.06).alias("flag"))


_ML = "ml AS (SELECT source, quality AS y, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS p, n_chars AS score FROM labels JOIN documents USING (doc_id))"


def _ml(t) -> DataFrame:
    return t("labels").join(t("documents"), "doc_id").select(
        "source", F.col("quality").alias("y"), (F.col("n_chars") >= 1000).cast("int").alias("p"), F.col("n_chars").alias("score")
    )


@query(
    f"""WITH {_ML} SELECT source, coalesce(count(*) FILTER (y = 1 AND p = 1) / nullif(count(*) FILTER (p = 1), 0), 0) AS precision,
  coalesce(count(*) FILTER (y = 1 AND p = 1) / nullif(count(*) FILTER (y = 1), 0), 0) AS recall,
  coalesce(2 * count(*) FILTER (y = 1 AND p = 1) / nullif(count(*) FILTER (p = 1) + count(*) FILTER (y = 1), 0), 0) AS f1 FROM ml GROUP BY source""",
    "precision recall f1",
)
def class_metrics(t):
    return aggregates.class_metrics(_ml(t), "y", "p", ["source"])


@query(
    f"""WITH {_ML}, r AS (SELECT source, y, rank() OVER w + (count(*) OVER (PARTITION BY source, score) - 1) / 2.0 AS rank FROM ml WINDOW w AS (PARTITION BY source ORDER BY score))
SELECT source, coalesce((sum(CASE WHEN y = 1 THEN rank END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 0) AS auc FROM r GROUP BY source""",
    "auc",
)
def roc_auc(t):
    return aggregates.roc_auc(_ml(t), "y", "score", ["source"])


# the other modules register their queries in the same tables
from tickloom.plans import feature_queries, frame_queries, grid_queries, model_queries, screener_queries  # noqa: E402, F401
