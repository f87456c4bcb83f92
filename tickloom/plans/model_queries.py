"""Preparation, splits, metrics and models; trend events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import aggregates, events, models
from tickloom.plans.frame_queries import _rows_only
from tickloom.plans.registry import DAILY, bars_of, daily_of, query
from tickloom.sources.bars import event_bars

#: predictions: an order's status stands for the model, a high price for class 1
_SCORED = """s AS (SELECT o_orderstatus AS model, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
  CASE WHEN o_totalprice >= 200000 THEN 1 ELSE 0 END AS y, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS p, (o_custkey * 7) % 101 AS score FROM orders)"""
_BY = ["model", "year", "month"]


def _scored(t):
    return t("orders").select(
        F.col("o_orderstatus").alias("model"),
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
        (F.col("o_totalprice") >= 200000).cast("int").alias("y"),
        (F.col("o_orderkey") % 3 == 0).cast("int").alias("p"),
        ((F.col("o_custkey") * 7) % 101).alias("score"),
    )


_ONE = """coalesce(count(*) FILTER (y = {c} AND p = {c}) / nullif(count(*) FILTER (p = {c}), 0), 0)"""
_TWO = """coalesce(count(*) FILTER (y = {c} AND p = {c}) / nullif(count(*) FILTER (y = {c}), 0), 0)"""
_F1 = """coalesce(2 * count(*) FILTER (y = {c} AND p = {c}) / nullif(count(*) FILTER (p = {c}) + count(*) FILTER (y = {c}), 0), 0)"""


@query(
    f"WITH {_SCORED} SELECT model, year, month, {_ONE.format(c=1)} AS precision, {_TWO.format(c=1)} AS recall, {_F1.format(c=1)} AS f1 FROM s GROUP BY ALL",
    "precision recall f1",
)
def class_metrics_monthly(t):
    return aggregates.class_metrics(_scored(t), "y", "p", _BY)


@query(
    f"""WITH {_SCORED}, r AS (SELECT model, year, month, y, rank() OVER w + (count(*) OVER (PARTITION BY model, year, month, score) - 1) / 2.0 AS rank
  FROM s WINDOW w AS (PARTITION BY model, year, month ORDER BY score))
SELECT model, year, month, coalesce((sum(CASE WHEN y = 1 THEN rank END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 0) AS auc FROM r GROUP BY ALL""",
    "auc",
)
def roc_auc_monthly(t):
    return aggregates.roc_auc(_scored(t), "y", "score", _BY)


_CLASS = f"SELECT {{c}} AS c, {_ONE} AS p_, {_TWO} AS r_, {_F1} AS f_, count(*) FILTER (y = {{c}}) AS n FROM s"


@query(
    f"""WITH {_SCORED}, c AS ({_CLASS.format(c=0)} UNION ALL {_CLASS.format(c=1)})
SELECT CAST(c AS VARCHAR) AS label, p_ AS precision, r_ AS recall, f_ AS f1, n AS support FROM c
UNION ALL SELECT 'macro avg', avg(p_), avg(r_), avg(f_), CAST(sum(n) AS BIGINT) FROM c
UNION ALL SELECT 'weighted avg', sum(p_ * n) / sum(n), sum(r_ * n) / sum(n), sum(f_ * n) / sum(n), CAST(sum(n) AS BIGINT) FROM c
UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS a, count(*) AS n FROM s)""",
    "precision recall f1",
)
def class_report(t):
    return aggregates.class_report(_scored(t), "y", "p")


@query(
    f"""WITH {DAILY}, d AS (SELECT symbol, day, CASE WHEN isodow(day) < 6 THEN close END AS close FROM daily)
SELECT symbol, day, coalesce(close, (SELECT median(close) FROM d)) AS close FROM d""",
    "close",
)
def fill_median(t):
    gaps = daily_of(t).select("symbol", "day", F.when(F.weekday("day") < 5, F.col("close")).alias("close"))
    return aggregates.filled_with_median(gaps, "close")


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{s}' AS DOUBLE) AS \"c_mktsegment_{s}\"" for s in _SEGMENTS) + " FROM customer")
def one_hot(t):
    return models.one_hot(t("customer").select("c_custkey", "c_mktsegment"), {"c_mktsegment": _SEGMENTS})


def _features(t):
    """Daily rows with a label, two features and a gappy column."""
    by = Window.partitionBy("symbol").orderBy("day")
    move = F.try_divide(F.col("high") - F.col("low"), F.col("open"))
    return daily_of(t).select(
        "symbol",
        F.col("day").cast("timestamp_ntz").alias("timestamp"),
        (F.col("close") >= F.col("open")).cast("int").alias("flag"),
        move.alias("move"),
        F.lag("volume").over(by).alias("volume"),
        F.when(F.weekday("day") < 3, F.weekday("day")).cast("double").alias("days_since_holiday"),
    )


_FEATURES = f"""{DAILY}, f AS (SELECT symbol, CAST(day AS TIMESTAMP) AS timestamp, day, CAST(close >= open AS INTEGER) AS flag, (high - low) / nullif(open, 0) AS move,
  lag(volume) OVER (PARTITION BY symbol ORDER BY day) AS volume, CASE WHEN isodow(day) < 4 THEN CAST(isodow(day) - 1 AS DOUBLE) END AS days_since_holiday FROM daily)"""


@query(
    f"""WITH {_FEATURES}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS n FROM f) WHERE n > 20)
SELECT flag, move, coalesce(days_since_holiday, (SELECT median(days_since_holiday) FROM k)) AS days_since_holiday, day AS date FROM k""",
    "move",
)
def ml_prepare(t):
    return models.prepared(_features(t), drop=("volume",))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) >= (SELECT CAST(max(CAST(o_orderdate AS DATE)) - INTERVAL 12 MONTH AS DATE) FROM orders) AS is_test FROM orders")
def temporal_split(t):
    return models.temporal_split(t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")), "day", 12)


@query(
    """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders), e AS (SELECT min(day) AS a, max(day) AS b FROM o),
w AS (SELECT CAST(k AS INTEGER) AS split, CAST(a + to_months(CAST(k * 6 AS INTEGER)) AS DATE) AS s, b FROM e, (SELECT unnest(range(0, 60)) AS k)),
v AS (SELECT split, s, CAST(s + INTERVAL 24 MONTH AS DATE) AS m, CAST(CAST(s + INTERVAL 24 MONTH AS DATE) + INTERVAL 6 MONTH AS DATE) AS x, b FROM w)
SELECT o_orderkey, day, split, day >= m AS is_test FROM o JOIN v ON day >= s AND day < x WHERE x <= b"""
)
def rolling_splits(t):
    return models.rolling_splits(t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")), "day", 24, 6)


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, year(o_orderdate) = 1998 AS is_test FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998")
def split_by_years(t):
    return models.year_split(t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")), "day", 1996, 1997, 1998)


@query(
    """WITH q AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, median(p_retailprice) AS b, quantile_cont(p_retailprice, 0.75) AS c,
  quantile_cont(p_size, 0.25) AS d, median(p_size) AS e, quantile_cont(p_size, 0.75) AS f FROM part)
SELECT p_partkey, (p_retailprice - b) / coalesce(nullif(c - a, 0), 1) AS p_retailprice, (p_size - e) / coalesce(nullif(f - d, 0), 1) AS p_size FROM part, q""",
    "p_retailprice p_size",
)
def robust_scale(t):
    return models.robust_scaled(t("part").select("p_partkey", "p_retailprice", "p_size"), ["p_retailprice", "p_size"])


@query(
    f"""WITH {_SCORED}, m AS (SELECT y AS guess FROM s WHERE year <= 1998 GROUP BY y ORDER BY count(*) DESC, y LIMIT 1)
SELECT model, year, month, y, guess FROM s, m WHERE year > 1998"""
)
def ml_dummy(t):
    rows = _scored(t).withColumn("is_test", F.col("year") > 1998)
    return models.most_frequent(rows, "y").select("model", "year", "month", "y", "guess")


def _learned(family: str, **params):
    def plan(t):
        rows = models.temporal_split(t("orders").select(
            F.to_date("o_orderdate").alias("day"),
            (F.col("o_totalprice") >= 200000).cast("int").alias("y"),
            (F.col("o_custkey") % 97).cast("double").alias("a"),
            (F.col("o_totalprice") / 1000 + F.pmod(F.xxhash64("o_orderkey"), F.lit(100))).alias("b"),
        ), "day", 12)
        model = models.fitted(rows.filter("not is_test"), family, ["a", "b"], "y", **params)
        return models.predicted(model, rows.filter("is_test")).select("day", "y", "a", "b", "score", "guess")

    plan.__name__ = f"ml_{family}"
    return _rows_only(plan)


_learned("logreg", maxIter=20)
_learned("dtree", maxDepth=4, seed=42)
_learned("gbt", maxDepth=2, maxIter=5, seed=42)
_learned("rf", maxDepth=4, numTrees=10, seed=42)


@_rows_only
def trend_events(t):
    """Events of every event type's bars, whose adjusted prices are the raw ones."""
    bars = bars_of(t).withColumn("close_adj", F.col("close"))
    return events.trend_events(bars, event_bars(t("events"), minutes=1))
