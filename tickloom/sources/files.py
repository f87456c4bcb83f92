"""Sources in files: bars per symbol, index lists, constituents, ETF holdings, calendars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.text import filled, without_suffix

BAR_SCHEMA = "symbol string, timestamp timestamp, open double, high double, low double, close double, volume double, trade_count double, vwap double"

#: fixed values: the names that an index list's columns get
INDEX_NAMES = {
    "ID": "full_symbol",
    "Code": "symbol",
    "Name": "name",
    "Constituents": "constituents_count",
    "Value": "value",
    "MarketCap": "market_cap",
    "Divisor": "divisor",
    "DailyReturn": "daily_return",
    "Dividend": "dividend",
    "AdjustedMarketCap": "adjusted_market_cap",
    "AdjustedDivisor": "adjusted_divisor",
    "AdjustedConstituents": "adjusted_constituents_count",
    "CurrencyCode": "currency_code",
    "CurrencyName": "currency_name",
    "CurrencySymbol": "currency_symbol",
    "LastUpdate": "last_update",
}
#: fixed values: the names that a constituent's fields get
CONSTITUENT_NAMES = {
    "Code": "symbol",
    "Name": "name",
    "StartDate": "start_date",
    "EndDate": "end_date",
    "Weight": "weight",
    "Exchange": "exchange",
    "Industry": "industry",
    "Sector": "sector",
    "IsActiveNow": "is_active_in_index",
    "IsDelisted": "is_delisted",
}
#: fixed values: what a missing start and end of a membership mean
FIRST_DAY, LAST_DAY = "1950-01-01", "2199-12-31"


def bar_files(spark: SparkSession, root: str, quantity: int, unit: str, adjustment: str) -> DataFrame:
    """Bars of all symbols from CSV files, one per symbol, in the folder that names their kind.

    ``adjustment`` is ``all`` or ``raw``; anything else is refused. Rows have no order: sort where
    an order is asked for.
    """
    if adjustment not in ("all", "raw"):
        raise ValueError("bars are adjusted 'all' or 'raw'")
    return spark.read.schema(BAR_SCHEMA).option("header", True).csv(f"{root}/{quantity}{unit}_history_adj_{adjustment}")


def symbols_of_files(frame: DataFrame) -> DataFrame:
    """(symbol): the file names behind a frame, without folder and ``.csv``."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return frame.select(without_suffix(name, ".csv").alias("symbol")).distinct()


def universe(listed: DataFrame | None, members: Callable[[], DataFrame] | None, folder: Callable[[], DataFrame] | None) -> DataFrame:
    """(symbol) of the first source there is: an explicit list, index members, files."""
    if listed is not None:
        return listed.select("symbol").distinct()
    for source in (members, folder):
        if source is not None:
            return source().select("symbol").distinct()
    raise ValueError("no list, members or folder of symbols")


def between_days(bars: DataFrame, first: str, last: str, at: str = "ts") -> DataFrame:
    """Bars from one second after the start of the first day to one before the end of the last."""
    start = F.lit(first).cast("timestamp_ntz") + F.expr("interval 1 second")
    end = F.lit(last).cast("timestamp_ntz") + F.expr("interval 1 day") - F.expr("interval 1 second")
    return bars.filter(F.col(at).between(start, end))


def days_back(bars: DataFrame, last: str, days: int, at: str = "ts") -> DataFrame:
    end = F.lit(last).cast("timestamp_ntz")
    return bars.filter(F.col(at).between(end - F.expr(f"interval {days} days"), end))


def days_forward(bars: DataFrame, first: str, days: int, at: str = "ts") -> DataFrame:
    start = F.lit(first).cast("timestamp_ntz")
    return bars.filter(F.col(at).between(start, start + F.expr(f"interval {days} days")))


def index_list(fetch: Callable[[], tuple[int, DataFrame | None]], fallback: Callable[[], DataFrame]) -> DataFrame:
    """The list that ``fetch`` gives with status 200, or the fallback at 403; another status is an error."""
    status, found = fetch()
    if status == 200 and found is not None:
        return found.withColumnsRenamed(INDEX_NAMES)
    if status == 403:
        return fallback().withColumnsRenamed(INDEX_NAMES)
    raise RuntimeError(f"the index list could not be fetched: {status}")


def select_indices(indices: DataFrame, wanted: DataFrame) -> DataFrame:
    return indices.join(wanted.select("symbol"), "symbol", "left_semi")


def _members(document: Column, field: str) -> Column:
    """The entries of a JSON object of objects, an empty list where there is none."""
    fields = ", ".join(f"{n} string" for n in CONSTITUENT_NAMES)
    entry = F.get_json_object(document, f"$.{field}")
    return F.map_values(F.from_json(F.coalesce(entry, F.lit("{}")), f"map<string, struct<{fields}>>"))


def historical_constituents(documents: DataFrame, document: str = "document", index: str = "index_symbol") -> DataFrame:
    """One row per membership that the documents of indices tell, with days for missing dates."""
    rows = documents.select(F.col(index).alias("index_symbol"), F.inline(_members(F.col(document), "HistoricalTickerComponents")))
    rows = rows.withColumnsRenamed(CONSTITUENT_NAMES)
    return rows.withColumns(
        {"start_date": F.to_date(filled(F.col("start_date"), FIRST_DAY)), "end_date": F.to_date(filled(F.col("end_date"), LAST_DAY))}
    )


def current_constituents(documents: DataFrame, document: str = "document", index: str = "index_symbol") -> DataFrame:
    rows = documents.select(F.col(index).alias("index_symbol"), F.inline(_members(F.col(document), "Components")))
    return rows.withColumnsRenamed(CONSTITUENT_NAMES)


def selected_constituents(members: DataFrame, only_active: bool = False, on: str | None = None) -> DataFrame:
    """Memberships by symbol and end, the active ones or those that hold a day, if asked for.

    A membership holds the days after its first moment and up to its end's midnight.
    """
    rows = members.orderBy("symbol", "end_date")
    if only_active:
        rows = rows.filter(F.col("is_active_in_index"))
    if on is not None:
        day = F.lit(on).cast("date")
        # a start counts from one second after midnight, so a day's midnight comes before it
        rows = rows.filter((F.col("start_date") < day) & (F.col("end_date") >= day))
    return rows


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, by ``order``."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def open_days(calendar: DataFrame, first: str, last: str, day: str = "day") -> DataFrame:
    return calendar.filter(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def active_symbols(stocks: DataFrame) -> DataFrame:
    return stocks.filter((F.col("status") == "active") & F.col("tradable")).select("symbol")
