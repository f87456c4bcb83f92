"""Membership joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def active_days(members: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """One row per member and business day in [start_date, end_date), within the days given, if any.

    Days are generated per interval, so neither a calendar nor a range join is shuffled.
    """
    # greatest and least skip the null that a bound not given is
    lo = F.greatest("start_date", F.lit(first).cast("date"))
    hi = F.least(F.date_sub("end_date", 1), F.lit(last).cast("date"))
    days = members.withColumns({"lo": lo, "hi": hi}).filter(F.col("lo") <= F.col("hi"))
    return days.select("symbol", "index_symbol", F.explode(F.sequence("lo", "hi")).alias("day")).filter(F.weekday("day") < 5)


def label_intervals(rows: DataFrame, members: DataFrame, day: str = "day", label: str = "index_symbol") -> DataFrame:
    """``rows`` (symbol, day, ...) with the index of the interval holding the day, the latest ending
    one of several (ties: the larger index), or null.

    A (symbol, day) is labelled once, so equal rows stay as many as they are.
    """
    m = members.select(F.col("symbol").alias("_symbol"), F.col("index_symbol").alias("_label"), "start_date", "end_date")
    inside = (F.col("symbol") == F.col("_symbol")) & (F.col(day) >= F.col("start_date")) & (F.col(day) < F.col("end_date"))
    labelled = rows.select("symbol", day).distinct().join(m, inside)
    labels = labelled.groupBy("symbol", day).agg(F.max_by("_label", F.struct("end_date", "_label")).alias(label))
    return rows.drop(label).join(labels, ["symbol", day], "left")


def with_adjusted_close(raw: DataFrame, adjusted: DataFrame, at: str = "ts") -> DataFrame:
    """The raw bars that the adjusted ones have too, with the adjusted close as ``close_adj``."""
    return raw.join(adjusted.select("symbol", at, F.col("close").alias("close_adj")), ["symbol", at])


def attach_columns(rows: DataFrame, feature: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the feature's columns; its columns win over those of the same name."""
    overlap = [c for c in feature.columns if c in rows.columns and c not in keys]
    return rows.drop(*overlap).join(feature, keys, "left")


def insert_if_absent(existing: DataFrame, fresh: DataFrame, keys: list[str], order: str) -> DataFrame:
    """What of ``fresh`` is to be appended: one row per key (the least ``order``) that ``existing`` lacks."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    new = fresh.withColumn("_n", first).filter("_n = 1").drop("_n")
    return new.join(existing.select(*keys), keys, "left_anti")


def sync_plan(symbols: DataFrame, stored: DataFrame, until: str, back: int = 730) -> DataFrame:
    """(symbol, start, end, has_history): the days to fetch for each symbol up to ``until``.

    A symbol with history continues the day after its last one, without it starts ``back`` days
    before; symbols that are up to date have no row.
    """
    marks = stored.join(symbols.select("symbol"), "symbol", "left_semi").groupBy("symbol").agg(F.max("day").alias("last_day"))
    end = F.lit(until).cast("date")
    start = F.coalesce(F.date_add("last_day", 1), F.date_sub(end, back))
    plan = symbols.select("symbol").distinct().join(marks, "symbol", "left")
    plan = plan.select("symbol", start.alias("start"), end.alias("end"), F.col("last_day").isNotNull().alias("has_history"))
    return plan.filter(F.col("start") <= F.col("end"))
