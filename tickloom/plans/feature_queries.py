"""The daily feature set and the bar features, one query each."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import market
from tickloom.operators import features
from tickloom.plans.registry import BARS, DAILY, ORACLES, QUERIES, bars_of, daily_of, query

#: bars with their New York day and minute of the day
LOCAL = f"""{BARS}, nb AS (
  SELECT *, CAST(local AS DATE) AS day, hour(local) * 60 + minute(local) AS m
  FROM (SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS local FROM bars)),
dc AS (SELECT symbol, day, arg_max(close, ts) AS c FROM nb GROUP BY ALL)"""
_AT = "CAST(day AS TIMESTAMP) + INTERVAL 4 HOUR AS timestamp"
_D = "(PARTITION BY symbol ORDER BY day)"
_PRE = "m >= 240 AND m < 570"


def _rows(first: int, last: str) -> str:
    return f"(PARTITION BY symbol ORDER BY day ROWS BETWEEN {first} PRECEDING AND {last})"


def _feature(name: str, body: str, columns: str, doubles: str | None = None):
    """Register ``feat_<name>``; ``body`` ends in a select of (symbol, day, columns)."""

    def plan(t):
        return features.feature(bars_of(t), name)

    plan.__name__ = f"feat_{name.lower()}"
    query(f"WITH {LOCAL} SELECT symbol, {_AT}, {columns} FROM ({body})", columns.replace(",", "") if doubles is None else doubles)(plan)


_feature(
    "prev_day_return",
    f"SELECT symbol, day, lag(r) OVER {_D} AS prev_day_return FROM (SELECT symbol, day, c / lag(c) OVER {_D} - 1 AS r FROM dc) QUALIFY prev_day_return IS NOT NULL",
    "prev_day_return",
)
_feature(
    "std_return_last5d",
    f"""SELECT symbol, day, CASE WHEN count(*) OVER w = 5 THEN stddev_samp(r) OVER w END AS std_return_last5d FROM (
  SELECT symbol, day, coalesce(sum(g), 0) AS r FROM (SELECT symbol, day, ln(close / lag(close) OVER (PARTITION BY symbol, day ORDER BY ts)) AS g FROM nb) GROUP BY ALL
) WINDOW w AS {_rows(4, "CURRENT ROW")}""",
    "std_return_last5d",
)
_feature(
    "range_rel_last1d",
    f"SELECT symbol, day, lag((h - l) / c) OVER {_D} AS range_rel_last1d FROM (SELECT symbol, day, max(high) AS h, min(low) AS l FROM nb GROUP BY ALL) JOIN dc USING (symbol, day)",
    "range_rel_last1d",
)
_feature(
    "rvol_20d",
    f"""SELECT symbol, day, v / CASE WHEN count(*) OVER w = 20 THEN avg(v) OVER w END AS rvol_20d
FROM (SELECT symbol, day, sum(volume * vwap) AS v FROM nb GROUP BY ALL) WINDOW w AS {_rows(20, "1 PRECEDING")}""",
    "rvol_20d",
)
_feature(
    "gap_pct",
    f"""SELECT symbol, day, CASE WHEN lag(c) OVER {_D} IS NOT NULL AND o <> 0 THEN (o - lag(c) OVER {_D}) / lag(c) OVER {_D} ELSE 0 END AS gap_pct
FROM (SELECT symbol, day, c, coalesce(o, 0) AS o FROM dc LEFT JOIN (SELECT symbol, day, arg_min(open, ts) AS o FROM nb WHERE m < 570 GROUP BY ALL) USING (symbol, day))""",
    "gap_pct",
)
_feature(
    "dist_max_20d",
    f"""SELECT symbol, day, CASE WHEN count(*) OVER w = 20 THEN (lag(c) OVER {_D} - max(c) OVER w) / max(c) OVER w END AS dist_max_20d
FROM dc WINDOW w AS {_rows(20, "1 PRECEDING")}""",
    "dist_max_20d",
)
for _side, _part in (("upper", "high - greatest(open, close)"), ("lower", "least(open, close) - low")):
    _feature(
        f"{_side}_wick_ratio_last1d",
        f"""SELECT symbol, day, lag(x) OVER {_D} AS {_side}_wick_ratio_last1d
FROM (SELECT symbol, day, avg(CASE WHEN high = low THEN 0 ELSE ({_part}) / (high - low) END) AS x FROM nb GROUP BY ALL)""",
        f"{_side}_wick_ratio_last1d",
    )
_feature("weekday", "SELECT DISTINCT symbol, day, dayname(day) AS weekday FROM nb", "weekday", "")
_feature(
    "weekday_cyclic",
    "SELECT DISTINCT symbol, day, sin(2 * pi() * (isodow(day) - 1) / 5) AS weekday_sin, cos(2 * pi() * (isodow(day) - 1) / 5) AS weekday_cos FROM nb WHERE isodow(day) <= 5",
    "weekday_sin, weekday_cos",
)
#: fixed values: observed US federal holidays around the dates of the events
_HOLIDAYS = """(VALUES (DATE '2023-11-10'), (DATE '2023-11-23'), (DATE '2023-12-25'), (DATE '2024-01-01'), (DATE '2024-01-15'), (DATE '2024-02-19'),
  (DATE '2024-05-27'), (DATE '2024-06-19'), (DATE '2024-07-04'), (DATE '2024-09-02'), (DATE '2024-10-14'), (DATE '2024-11-11'), (DATE '2024-11-28'), (DATE '2024-12-25')) AS h(holiday)"""
_feature(
    "days_since_holiday",
    f"""SELECT x.symbol, x.day, CAST(x.day - y.holiday AS DOUBLE) AS days_since_holiday FROM dc x ASOF LEFT JOIN (
  SELECT symbol, holiday FROM (SELECT symbol, min(day) AS a, max(day) AS b FROM dc GROUP BY symbol) JOIN {_HOLIDAYS} ON holiday BETWEEN a AND b
) y ON x.symbol = y.symbol AND x.day >= y.holiday""",
    "days_since_holiday",
    "",
)
_feature(
    "hhi_premarket_volume",
    f"SELECT symbol, day, sum(CAST(volume AS DOUBLE) * volume) / nullif(sum(CAST(volume AS DOUBLE)) ^ 2, 0) AS hhi_premarket_volume FROM nb WHERE {_PRE} GROUP BY ALL",
    "hhi_premarket_volume",
)
_feature(
    "z_pm",
    f"""SELECT symbol, day, (pc / po - 1 - CASE WHEN count(r) OVER w = 20 THEN avg(r) OVER w END) / nullif(stddev_samp(r) OVER w, 0) AS z_pm
FROM (SELECT symbol, day, c / lag(c) OVER {_D} - 1 AS r FROM dc)
LEFT JOIN (SELECT symbol, day, arg_min(open, ts) AS po, arg_max(close, ts) AS pc FROM nb WHERE {_PRE} GROUP BY ALL) USING (symbol, day)
WINDOW w AS {_rows(19, "CURRENT ROW")} QUALIFY po IS NOT NULL""",
    "z_pm",
)
_feature(
    "R_PM_hist",
    f"""SELECT symbol, day, ln((a + 0.01) / (CASE WHEN count(*) OVER w = 20 THEN median(a) OVER w END + 0.01)) AS R_PM_hist
FROM (SELECT symbol, day, sum(volume) / sum(trade_count) AS a FROM nb WHERE {_PRE} GROUP BY ALL) WINDOW w AS {_rows(19, "CURRENT ROW")}""",
    "R_PM_hist",
)
_feature(
    "PM_VWAP_Return",
    f"""SELECT symbol, day, v / p - 1 AS PM_VWAP_Return FROM (SELECT symbol, day, sum(vwap * volume) / nullif(sum(volume), 0) AS v FROM nb WHERE {_PRE} GROUP BY ALL)
LEFT JOIN (SELECT symbol, day, lag(c) OVER {_D} AS p FROM (SELECT symbol, day, arg_max(close, ts) AS c FROM nb WHERE m >= 570 AND m < 960 GROUP BY ALL)) USING (symbol, day)""",
    "PM_VWAP_Return",
)

_ATTACHED = "range_rel_last1d hhi_premarket_volume gap_pct"


@query(
    f"""WITH {LOCAL}, {DAILY.removeprefix(BARS + ", ")}
SELECT symbol, day, close, range_rel_last1d, hhi_premarket_volume, gap_pct FROM daily
LEFT JOIN (SELECT symbol, day, lag((h - l) / c) OVER {_D} AS range_rel_last1d FROM (SELECT symbol, day, max(high) AS h, min(low) AS l FROM nb GROUP BY ALL) JOIN dc USING (symbol, day)) USING (symbol, day)
LEFT JOIN (SELECT symbol, day, sum(CAST(volume AS DOUBLE) * volume) / nullif(sum(CAST(volume AS DOUBLE)) ^ 2, 0) AS hhi_premarket_volume FROM nb WHERE {_PRE} GROUP BY ALL) USING (symbol, day)
LEFT JOIN (SELECT symbol, day, CASE WHEN lag(c) OVER {_D} IS NOT NULL AND o <> 0 THEN (o - lag(c) OVER {_D}) / lag(c) OVER {_D} ELSE 0 END AS gap_pct
  FROM (SELECT symbol, day, c, coalesce(o, 0) AS o FROM dc LEFT JOIN (SELECT symbol, day, arg_min(open, ts) AS o FROM nb WHERE m < 570 GROUP BY ALL) USING (symbol, day))) USING (symbol, day)""",
    _ATTACHED,
)
def attach_features(t):
    """Daily rows with three features; a column of the daily rows named like one is replaced."""
    daily = daily_of(t).select("symbol", "day", "close", F.lit(0.0).alias("gap_pct"))
    return features.attach(daily, bars_of(t), _ATTACHED.split())


_LOOKBACKS = [0, 32, 224, 896, 3584, 11680]
_LOOKBACK_SQL = ", ".join(f"(close - lag(open, {k}) OVER w) / nullif(lag(open, {k}) OVER w, 0) * 100 AS pct_{k}" for k in _LOOKBACKS)


@query(
    f"WITH {BARS} SELECT symbol, ts, {_LOOKBACK_SQL} FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)",
    " ".join(f"pct_{k}" for k in _LOOKBACKS),
)
def lookback_pct(t):
    return features.lookback_percent(bars_of(t), _LOOKBACKS)


# the name of an earlier version, whose lookback_pct had three of the six
QUERIES["lookback_pct_all"], ORACLES["lookback_pct_all"] = QUERIES["lookback_pct"], ORACLES["lookback_pct"]


@query(
    f"WITH {BARS} SELECT symbol, ts, (high - low) / nullif(open, 0) * 100 AS pct_high_low, (close - open) / nullif(open, 0) * 100 AS pct_open_close FROM bars",
    "pct_high_low pct_open_close",
)
def pct_candle(t):
    return features.candle_percent(bars_of(t)).drop("pct_gap")


@query(
    f"""WITH {BARS} SELECT symbol, ts, (open - lag(close) OVER w) / nullif(lag(close) OVER w, 0) * 100 AS pct_gap
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)""",
    "pct_gap",
)
def gap_open_prev_close(t):
    return features.candle_percent(bars_of(t)).select("symbol", "ts", "pct_gap")


_TR = f"""{BARS}, pr AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY ts), open) AS p FROM bars),
tr AS (SELECT symbol, ts, greatest(high, low, p) - least(low, p) AS tr, (greatest(high, low, p) - least(low, p)) / nullif(p, 0) AS rel_tr FROM pr)"""


@query(f"WITH {_TR} SELECT * FROM tr", "tr rel_tr")
def true_range(t):
    return features.true_range(bars_of(t))


@query(
    f"""WITH RECURSIVE {_TR}, n AS (SELECT symbol, ts, rel_tr, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM tr),
e AS (SELECT symbol, ts, rel_tr AS soft, rel_tr AS peak, i FROM n WHERE i = 1
  UNION ALL SELECT n.symbol, n.ts, 0.01 * n.rel_tr + 0.99 * e.soft, 0.1 * n.rel_tr + 0.9 * e.peak, n.i FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)
SELECT symbol, ts, soft, peak FROM e""",
    "soft peak",
)
def ewm_rel_tr(t):
    return features.relative_true_range_means(bars_of(t))


@query(
    """SELECT p_partkey, min_target, round(p + (p - min_target), 6) AS max_target FROM (
  SELECT *, round_even(p * (1 - f) * 10.0 ** d, 0) / 10.0 ** d AS min_target FROM (
    SELECT p_partkey, f, d, round_even(x * 10.0 ** d, 0) / 10.0 ** d AS p FROM (
      SELECT *, CASE WHEN x <= 0.1 THEN 0.12 WHEN x <= 0.5 THEN 0.08 WHEN x <= 2 THEN 0.05 WHEN x <= 10 THEN 0.03 ELSE 0.02 END AS f,
             CASE WHEN x <= 0.5 THEN 4 WHEN x <= 2 THEN 3 ELSE 2 END AS d FROM (SELECT p_partkey, p_retailprice / 100.0 AS x FROM part))))""",
    "min_target max_target",
)
def min_max_target(t):
    band = market.price_band(F.col("p_retailprice") / 100)
    return t("part").select("p_partkey", band.alias("band")).select("p_partkey", "band.*")
