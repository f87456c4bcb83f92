"""Sources, projections, scalar functions, top-k, samples and unions, over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import market, text, times
from tickloom.operators import aggregates
from tickloom.plans.registry import BARS, DAILY, MEMBERS, QUERIES, bars_of, daily_of, query
from tickloom.sources import files
from tickloom.sources.bars import constituents, table


def _members(t):
    return constituents(t("orders"), t("customer"))


# sources


@query(f"WITH {BARS} SELECT symbol, ts, close FROM bars WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:01' AND TIMESTAMP '2024-01-08 23:59:59'")
def bars_between(t):
    return files.between_days(bars_of(t), "2024-01-05", "2024-01-08").select("symbol", "ts", "close")


@query(f"WITH {BARS} SELECT symbol, ts, close FROM bars WHERE ts BETWEEN TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND TIMESTAMP '2024-01-20'")
def bars_30m_window(t):
    return files.days_back(bars_of(t), "2024-01-20", 7).select("symbol", "ts", "close")


@query(f"WITH {BARS} SELECT symbol, ts, close FROM bars WHERE ts BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-21'")
def bars_1m_window(t):
    return files.days_forward(bars_of(t), "2024-01-20", 1).select("symbol", "ts", "close")


#: an index document per segment, made from the customers: codes, empty and missing dates
_ENTRY = """json_object('Code', c_name, 'Name', c_name, 'StartDate', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '2001-02-03' END,
  'EndDate', CASE WHEN c_custkey % 2 = 0 THEN '2005-06-07' END, 'IsActiveNow', CASE WHEN c_custkey % 5 = 0 THEN '0' ELSE '1' END)"""


def _documents(t, field: str):
    part = lambda rule, value: F.when(rule, F.lit(value))
    entry = F.struct(
        F.col("c_name").alias("Code"),
        F.col("c_name").alias("Name"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.lit("2001-02-03")).alias("StartDate"),
        part(F.col("c_custkey") % 2 == 0, "2005-06-07").alias("EndDate"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit("0")).otherwise(F.lit("1")).alias("IsActiveNow"),
    )
    rows = t("customer").groupBy(F.col("c_mktsegment").alias("index_symbol"), (F.col("c_custkey") % 7).alias("part")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string"), entry))).alias("m")
    )
    return rows.select("index_symbol", F.to_json(F.struct(F.col("m").alias(field))).alias("document"))


@query(
    """SELECT c_mktsegment AS index_symbol, c_name AS symbol, CASE WHEN c_custkey % 3 = 0 THEN DATE '1950-01-01' ELSE DATE '2001-02-03' END AS start_date,
  CASE WHEN c_custkey % 2 = 0 THEN DATE '2005-06-07' ELSE DATE '2199-12-31' END AS end_date FROM customer"""
)
def constituents_parse(t):
    found = files.historical_constituents(_documents(t, "HistoricalTickerComponents"))
    return found.select("index_symbol", "symbol", "start_date", "end_date")


@query("SELECT c_mktsegment AS index_symbol, c_name AS symbol, CASE WHEN c_custkey % 5 = 0 THEN '0' ELSE '1' END AS is_active_in_index FROM customer")
def constituents_current(t):
    return files.current_constituents(_documents(t, "Components")).select("index_symbol", "symbol", "is_active_in_index")


@query("SELECT c_mktsegment AS full_symbol, c_custkey AS symbol, c_name AS name, c_acctbal AS value FROM customer")
def rename_index(t):
    raw = t("customer").select(F.col("c_mktsegment").alias("ID"), F.col("c_custkey").alias("Code"), F.col("c_name").alias("Name"), F.col("c_acctbal").alias("Value"))
    return raw.withColumnsRenamed(files.INDEX_NAMES)


@query("SELECT c_custkey AS symbol, c_name AS name FROM customer WHERE c_nationkey < 5")
def index_list(t):
    """The list falls back to its copy at status 403."""
    copy = lambda: t("customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("Code"), F.col("c_name").alias("Name"))
    return files.index_list(lambda: (403, None), copy)


@query("SELECT c_custkey AS symbol, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def select_indices(t):
    wanted = t("orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("symbol"))
    return files.select_indices(t("customer").select(F.col("c_custkey").alias("symbol"), "c_name"), wanted)


@query("SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY ALL")
def etf_dedupe(t):
    return files.first_of_each(t("customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey")


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def calendar_days(t):
    return files.open_days(t("orders").select(F.to_date("o_orderdate").alias("day")).distinct(), "1996-01-01", "1996-12-31")


@query("SELECT c_custkey AS symbol FROM customer WHERE c_acctbal > 0 AND c_nationkey <> 3")
def active_symbols(t):
    stocks = t("customer").select(
        F.col("c_custkey").alias("symbol"), F.when(F.col("c_acctbal") > 0, "active").otherwise("inactive").alias("status"), (F.col("c_nationkey") != 3).alias("tradable")
    )
    return files.active_symbols(stocks)


# projections and filters


@query("SELECT o_orderkey, o_totalprice FROM orders")
def project_cols(t):
    return t("orders").select("o_orderkey", "o_totalprice")


@query(f"WITH {DAILY} SELECT symbol, day, p FROM (SELECT symbol, day, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS p FROM daily) WHERE p IS NOT NULL")
def dropna_subset(t):
    prior = F.lag("close").over(Window.partitionBy("symbol").orderBy("day"))
    return daily_of(t).select("symbol", "day", prior.alias("p")).na.drop(subset=["p"])


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000 AND o_orderpriority <> '5-LOW'")
def filter_conj(t):
    return t("orders").filter((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 1000) & (F.col("o_orderpriority") != "5-LOW")).select("o_orderkey")


@query(f"WITH {MEMBERS} SELECT symbol, index_symbol FROM members WHERE symbol % 3 = 0")
def active_only(t):
    members = _members(t).withColumn("is_active_in_index", F.col("symbol") % 3 == 0)
    return files.selected_constituents(members, only_active=True).select("symbol", "index_symbol")


@query(f"WITH {MEMBERS} SELECT symbol, index_symbol FROM members WHERE start_date < DATE '1997-01-02' AND end_date >= DATE '1997-01-02'")
def active_on_date(t):
    return files.selected_constituents(_members(t), on="1997-01-02").select("symbol", "index_symbol")


@query(f"WITH {MEMBERS} SELECT symbol, index_symbol, start_date, end_date FROM members")
def constituents_sorted(t):
    return files.selected_constituents(_members(t)).select("symbol", "index_symbol", "start_date", "end_date")


@query(
    f"""WITH {MEMBERS} SELECT * FROM (SELECT symbol, 'X' AS index_symbol, start_date, end_date FROM members WHERE index_symbol = 'BUILDING'
  UNION ALL SELECT symbol, 'Y', start_date, end_date FROM members WHERE index_symbol <> 'BUILDING') WHERE symbol % 3 = 0 AND start_date < DATE '1997-01-02' AND end_date >= DATE '1997-01-02'"""
)
def selected_constituents(t):
    """Members of two indices, tagged, put together and narrowed to the active ones of a day."""
    members = _members(t).withColumn("is_active_in_index", F.col("symbol") % 3 == 0)
    one = members.filter("index_symbol = 'BUILDING'").withColumn("index_symbol", F.lit("X"))
    other = members.filter("index_symbol <> 'BUILDING'").withColumn("index_symbol", F.lit("Y"))
    return files.selected_constituents(one.unionByName(other), only_active=True, on="1997-01-02").drop("is_active_in_index")


@query("SELECT * EXCLUDE (o_orderpriority, o_orderstatus) FROM orders")
def drop_cols(t):
    """A name that the table lacks is passed over."""
    return t("orders").drop("o_orderpriority", "o_orderstatus", "day_open")


@query("SELECT o_orderkey, 0.0::DOUBLE AS factor, CAST(NULL AS VARCHAR) AS size_index FROM orders")
def add_null_col(t):
    return t("orders").select("o_orderkey", F.lit(0.0).alias("factor"), F.lit(None).cast("string").alias("size_index"))


@query(f"WITH {DAILY} SELECT symbol, day, coalesce(lag(volume) OVER (PARTITION BY symbol ORDER BY day), 0) AS volume FROM daily")
def fill_zero(t):
    prior = F.lag("volume").over(Window.partitionBy("symbol").orderBy("day"))
    return daily_of(t).select("symbol", "day", F.coalesce(prior, F.lit(0)).alias("volume"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice WHEN o_orderstatus = 'O' THEN -o_totalprice ELSE 0 END AS x FROM orders")
def case_fill(t):
    status = F.col("o_orderstatus")
    return t("orders").select("o_orderkey", F.when(status == "F", F.col("o_totalprice")).when(status == "O", -F.col("o_totalprice")).otherwise(0).alias("x"))


_NAMES = {"AUTOMOBILE": "Cars", "BUILDING": "Homes", "MACHINERY": "Machines"}


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Cars' WHEN 'BUILDING' THEN 'Homes' WHEN 'MACHINERY' THEN 'Machines' END AS sector FROM customer")
def map_labels(t):
    return t("customer").select("c_custkey", text.lookup(F.col("c_mktsegment"), _NAMES).alias("sector"))


# scalar functions


@query(
    """SELECT c_custkey, replace(replace(replace(replace(x, '_old2', ''), '_old1', ''), '_old', ''), '-', '.') AS ticker FROM (
  SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'BRK-B_old' WHEN 1 THEN 'T_old1' WHEN 2 THEN 'X_old2-C' ELSE 'MSFT' END || c_custkey AS x FROM customer)"""
)
def clean_tickers(t):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, "BRK-B_old").when(k % 4 == 1, "T_old1").when(k % 4 == 2, "X_old2-C").otherwise("MSFT")
    return t("customer").select("c_custkey", text.clean_ticker(F.concat(raw, k.cast("string"))).alias("ticker"))


@query("SELECT c_custkey, c_name AS stem, 'list/' || c_name || '/all' AS path, c_name ILIKE '%R#00000001%' AS found FROM customer")
def strip_suffix(t):
    name = F.col("c_name")
    return t("customer").select(
        "c_custkey",
        text.without_suffix(F.concat(name, F.lit(".csv")), ".csv").alias("stem"),
        text.from_template(F.lit("list/$index$/all"), name).alias("path"),
        text.contains_ignoring_case(name, "r#00000001").alias("found"),
    )


@query("SELECT c_custkey, lower(c_name) LIKE '%mer#%1%' AND contains(lower(c_name), '01') AS found FROM customer")
def str_contains(t):
    return t("customer").select("c_custkey", text.contains_ignoring_case(F.col("c_name"), "01").alias("found"))


_KEY = "strftime(o_orderdate, '%Y-%m-%d') || '|' || strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d')"


def _range_key():
    return text.range_key(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 30 days"))


@query(f"SELECT o_orderkey, {_KEY} AS key FROM orders")
def fmt_range_key(t):
    return t("orders").select("o_orderkey", _range_key().alias("key"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate + INTERVAL 30 DAY AS DATE) AS stop FROM orders")
def split_range_key(t):
    start, stop = text.range_of_key(_range_key())
    return t("orders").select("o_orderkey", start.alias("start"), stop.alias("stop"))


_MODEL = "CASE o_orderkey % 3 WHEN 0 THEN 'forest_' || year(o_orderdate) WHEN 1 THEN 'tree_model_' || year(o_orderdate) ELSE 'tree_full' END"


@query(
    f"""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'forest' WHEN 1 THEN 'tree' END AS base,
  CASE WHEN o_orderkey % 3 < 2 THEN CAST(year(o_orderdate) AS VARCHAR) END AS year, CASE WHEN o_orderkey % 3 = 2 THEN 'tree' ELSE {_MODEL} END AS stem FROM orders"""
)
def parse_model_name(t):
    k, year = F.col("o_orderkey") % 3, F.year("o_orderdate").cast("string")
    name = F.when(k == 0, F.concat(F.lit("forest_"), year)).when(k == 1, F.concat(F.lit("tree_model_"), year)).otherwise("tree_full")
    base, found = text.model_name(name)
    return t("orders").select("o_orderkey", base.alias("base"), found.cast("string").alias("year"), text.without_suffix(name, "_full").alias("stem"))


@query(
    """SELECT o_orderkey, make_date(year(o_orderdate), month(o_orderdate), 1) AS month_start, CAST(o_orderdate AS DATE) AS day,
  CAST(hour(o_orderdate) * 60 + minute(o_orderdate) AS INTEGER) AS minute, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
  dayname(o_orderdate) AS weekday, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday_number FROM orders"""
)
def date_parts(t):
    at = F.col("o_orderdate")
    return t("orders").select(
        "o_orderkey",
        F.make_date(F.year(at), F.month(at), F.lit(1)).alias("month_start"),
        *[c.alias(n) for n, c in times.parts(at).items()],
        F.date_format(at, "EEEE").alias("weekday"),
        F.weekday(at).alias("weekday_number"),
    )


@query(
    """SELECT event_id, date_trunc('day', ts) AS day_start, CASE WHEN ts = date_trunc('day', ts) THEN ts ELSE date_trunc('day', ts) + INTERVAL 1 DAY END AS day_ceiling,
  date_trunc('second', ts) AS second, ts + INTERVAL 90 MINUTE AS later, CAST(ts AS DATE) + INTERVAL 570 MINUTE AS opens FROM events"""
)
def day_bounds(t):
    ts = F.col("ts")
    return t("events").select(
        "event_id",
        times.day_start(ts).alias("day_start"),
        times.day_ceiling(ts).alias("day_ceiling"),
        F.date_trunc("second", ts).cast("timestamp_ntz").alias("second"),
        (ts + F.expr("interval 90 minutes")).alias("later"),
        times.at_time(F.to_date(ts), 570).alias("opens"),
    )


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - INTERVAL 12 MONTH AS DATE) AS year_back, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS month_on FROM orders")
def add_months(t):
    day = F.to_date("o_orderdate")
    return t("orders").select("o_orderkey", F.add_months(day, -12).alias("year_back"), F.add_months(day, 1).alias("month_on"))


@query(
    """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN ts END AS ts, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id AS DOUBLE) END AS x, CAST(event_id AS INTEGER) AS i,
  event_id % 2 = 1 AS odd FROM events"""
)
def parse_ts(t):
    """Times and numbers out of text, null where the text is neither."""
    k = F.col("event_id")
    stamp = F.when(k % 3 == 0, "no time").otherwise(F.col("ts").cast("string"))
    number = F.when(k % 4 == 0, "n/a").otherwise(k.cast("string"))
    return t("events").select("event_id", times.parsed(stamp).alias("ts"), number.try_cast("double").alias("x"), k.cast("int").alias("i"), (k % 2).cast("boolean").alias("odd"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_field(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query(f"WITH {BARS} SELECT symbol, ts, CASE WHEN close / p > 0 THEN ln(close / p) END AS log_ret FROM (SELECT *, lag(close) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) AS p FROM bars)", "log_ret")
def log_ret(t):
    prior = F.lag("close").over(Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts"))
    ratio = F.try_divide(F.col("close"), prior)
    return bars_of(t).select("symbol", "ts", F.when(ratio > 0, F.ln(ratio)).alias("log_ret"))


@query("SELECT part.p_partkey, round(p_retailprice, 1) AS rounded, abs(p_size - 25) AS distance, CAST(p_size AS DOUBLE) ^ 2 AS square FROM part", "rounded")
def rounded(t):
    return t("part").select("p_partkey", F.round("p_retailprice", 1).alias("rounded"), F.abs(F.col("p_size") - 25).alias("distance"), F.pow(F.col("p_size"), 2).alias("square"))


# top-k, samples, unions


_SEGMENT = "SELECT p_brand AS sector, avg(p_retailprice) AS mean FROM part GROUP BY ALL"


def _segments(t):
    return t("part").groupBy(F.col("p_brand").alias("sector")).agg(F.avg("p_retailprice").alias("mean"))


@query(f"SELECT * FROM ({_SEGMENT}) ORDER BY mean DESC, sector LIMIT 5", "mean")
def top5_sector(t):
    return _segments(t).orderBy(F.desc("mean"), "sector").limit(5)


@query(f"SELECT * FROM ({_SEGMENT}) ORDER BY mean, sector LIMIT 5", "mean")
def bottom5_sector(t):
    return _segments(t).orderBy("mean", "sector").limit(5)


_RETURNS = f"WITH {DAILY}, r AS (SELECT symbol, day, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM daily)"


def _returns(t):
    prior = F.lag("close").over(Window.partitionBy("symbol").orderBy("day"))
    return daily_of(t).select("symbol", "day", market.change(F.col("close"), prior).alias("ret")).na.drop(subset=["ret"])


@query(f"{_RETURNS} SELECT day, arg_max(symbol, (ret, symbol)) AS symbol, max(ret) AS ret FROM r WHERE ret IS NOT NULL GROUP BY day ORDER BY ret DESC, day LIMIT 5", "ret")
def top5_days(t):
    """The best symbol of each day, and of those the five best days."""
    best = _returns(t).groupBy("day").agg(F.max_by("symbol", F.struct("ret", "symbol")).alias("symbol"), F.max("ret").alias("ret"))
    return best.orderBy(F.desc("ret"), "day").limit(5)


@query(f"{_RETURNS} SELECT day, arg_min(symbol, (ret, symbol)) AS symbol, min(ret) AS ret FROM r WHERE ret IS NOT NULL GROUP BY day ORDER BY ret, day LIMIT 5", "ret")
def bottom5_days(t):
    worst = _returns(t).groupBy("day").agg(F.min_by("symbol", F.struct("ret", "symbol")).alias("symbol"), F.min("ret").alias("ret"))
    return worst.orderBy("ret", "day").limit(5)


@query(
    """WITH m AS (SELECT p_brand, p_type, max(p_retailprice) AS price FROM part GROUP BY ALL)
SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY price DESC, p_type) <= 5"""
)
def top5_per_sector(t):
    best = t("part").groupBy("p_brand", "p_type").agg(F.max("p_retailprice").alias("price"))
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("price"), "p_type"))
    return best.withColumn("n", n).filter("n <= 5").drop("n")


_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


@query(
    f"""WITH {DAILY}, d AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{d}')" for k, d in enumerate(_DAYS))}) AS v(place, weekday))
SELECT place, weekday, close FROM d LEFT JOIN (SELECT dayname(day) AS weekday, avg(close) AS close FROM daily WHERE isodow(day) < 6 GROUP BY ALL) USING (weekday)""",
    "close",
)
def ordered_weekday(t):
    """Means by weekday in calendar order; days without rows are there with null."""
    means = daily_of(t).filter(F.weekday("day") < 5).groupBy(F.date_format("day", "EEEE").alias("weekday")).agg(F.avg("close").alias("close"))
    order = t("events").sparkSession.createDataFrame(list(enumerate(_DAYS)), "place int, weekday string")
    return order.join(means, "weekday", "left").select("place", "weekday", "close").orderBy("place")


@query("SELECT * FROM (SELECT o_orderkey, 1 AS batch FROM orders UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_orderstatus = 'F')")
def union_batches(t):
    rows = t("orders").select("o_orderkey", "o_orderstatus")
    one, two = rows.withColumn("batch", F.lit(1)), rows.filter("o_orderstatus = 'F'").withColumn("batch", F.lit(2))
    return one.unionByName(two).drop("o_orderstatus")


@query("SELECT DISTINCT unnest([o_orderstatus, o_orderpriority]) AS name FROM orders")
def names_of_pairs(t):
    return t("orders").select(F.explode(F.array("o_orderstatus", "o_orderpriority")).alias("name")).distinct()


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def others(t):
    rows = t("orders")
    return rows.select("o_custkey").distinct().join(rows.filter("o_orderstatus = 'P'").select("o_custkey"), "o_custkey", "left_anti")


def _rows_only(plan):
    """Register a plan whose result is a sample, which no SQL gives."""

    def run(spark, sf_dir: str):
        return plan(lambda name: table(spark, sf_dir, name))

    QUERIES[plan.__name__] = run
    return plan


@_rows_only
def sample_symbols(t):
    """Ten symbols drawn by a hash: the same in every run."""
    return t("customer").select(F.col("c_custkey").alias("symbol")).orderBy(F.xxhash64(F.col("symbol"), F.lit(42)), "symbol").limit(10)


@_rows_only
def sample_n(t):
    """A thousand orders drawn by a hash."""
    return t("orders").orderBy(F.xxhash64(F.col("o_orderkey"), F.lit(42)), "o_orderkey").limit(1000)


@_rows_only
def stratified_sample(t):
    """Five customers of each segment drawn by a hash."""
    n = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.xxhash64(F.col("c_custkey"), F.lit(75)), "c_custkey"))
    return t("customer").withColumn("n", n).filter("n <= 5").drop("n")


# statistics


_BY = {"sector": "c_mktsegment", "nation": "CAST(c_nationkey AS VARCHAR)"}
for _name, _key in _BY.items():

    def _mean(t, key=_key.replace("VARCHAR", "STRING")):
        return t("customer").groupBy(F.expr(key).alias("label")).agg(F.avg("c_acctbal").alias("mean"))

    _mean.__name__ = f"mean_by_{_name}"
    query(f"SELECT {_key} AS label, avg(c_acctbal) AS mean FROM customer GROUP BY ALL", "mean")(_mean)


@query(f"WITH {BARS} SELECT ts, avg(close) AS close FROM bars GROUP BY ts", "close")
def mean_by_timestamp(t):
    return bars_of(t).groupBy("ts").agg(F.avg("close").alias("close"))


@query("WITH m AS (SELECT c_mktsegment AS label, avg(c_acctbal) AS mean FROM customer GROUP BY ALL) SELECT * FROM m UNION ALL SELECT 'Average', avg(mean) FROM m", "mean")
def sector_with_average(t):
    means = t("customer").groupBy(F.col("c_mktsegment").alias("label")).agg(F.avg("c_acctbal").alias("mean"))
    return aggregates.with_average(means, "label", "mean")


@query("SELECT max(x) / median(x) AS ratio FROM (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS x FROM orders GROUP BY ALL)", "ratio")
def max_over_median(t):
    days = t("orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("x"))
    return days.agg(F.try_divide(F.max("x"), F.percentile("x", F.lit(0.5))).alias("ratio"))


@query(
    "SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS q2, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY ALL", "q1 q2 q3"
)
def box_quartiles(t):
    found = t("orders").groupBy("o_orderpriority").agg(F.percentile("o_totalprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return found.select("o_orderpriority", *[F.col("q")[k].alias(f"q{k + 1}") for k in range(3)])


@query(
    """WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem)
SELECT CAST(least(floor((l_quantity - a) / ((b - a) / 20)), 19) AS BIGINT) AS cell_x, CAST(least(floor((l_extendedprice - c) / ((d - c) / 20)), 19) AS BIGINT) AS cell_y, count(*) AS n
FROM lineitem, e GROUP BY ALL"""
)
def hist2d(t):
    return aggregates.histogram2d(t("lineitem"), "l_quantity", "l_extendedprice", 20)


@query("SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem", "r")
def corr_pair(t):
    return t("lineitem").agg(F.corr("l_quantity", "l_extendedprice").alias("r"))


@query(
    f"""WITH {BARS} SELECT symbol, CAST(ts AS DATE) AS day, arg_min(open, ts) AS open, arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume, avg(vwap) AS vwap
FROM bars GROUP BY ALL""",
    "vwap",
)
def daily_sums(t):
    return bars_of(t).groupBy("symbol", F.to_date("ts").alias("day")).agg(
        F.min_by("open", "ts").alias("open"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.avg("vwap").alias("vwap")
    )


@query("SELECT DISTINCT c_mktsegment AS sector FROM customer")
def distinct_sectors(t):
    return t("customer").select(F.col("c_mktsegment").alias("sector")).distinct()
