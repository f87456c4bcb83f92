"""OHLCV bars from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_order() -> Column:
    """One fixed-width number that orders events by (ts, event_id), so that the first and last
    value of a group fit a hash aggregation's buffer; event ids are not negative."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return micros.cast("decimal(19,0)") * F.expr("10000000000000000000BD") + F.col("event_id").cast("decimal(19,0)")


def event_bars(events: DataFrame, minutes: int = 30, by: str = "event_type") -> DataFrame:
    """Bars of ``minutes`` from events, in one partial aggregation; first and last by (ts, event_id)."""
    rows = events.filter(F.col("ts").isNotNull()).select(
        F.col(by).cast("string").alias("symbol"), "ts", "value", event_order().alias("at"), F.get_json_object("props", "$.k").cast("long").alias("volume")
    )
    return rows.groupBy("symbol", F.window("ts", f"{minutes} minutes").start.alias("ts")).agg(
        F.min_by("value", "at").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "at").alias("close"),
        F.sum("volume").alias("volume"),
        F.count("*").alias("trade_count"),
        F.try_divide(F.sum(F.col("value") * F.col("volume")), F.sum("volume")).alias("vwap"),
    )


def constituents(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Membership intervals: a customer's market segment from its first order to its last."""
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_custkey").alias("symbol"), F.col("c_mktsegment").alias("index_symbol"))
        .agg(F.min("o_orderdate").cast("date").alias("start_date"), F.max("o_orderdate").cast("date").alias("end_date"))
    )
