"""Sources and sinks on files, trend events by hand, streams against the batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.operators import events
from tickloom.sinks import tables
from tickloom.sources import files
from tickloom.sources.bars import event_bars
from tickloom.streaming import bars as streaming

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_table_replace_append_and_insert(spark, tmp_path):
    table = tables.Table(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    make = lambda *r: spark.createDataFrame(list(r), "symbol string, day int, x int")
    table.replace(make(("a", 1, 10)))
    table.insert_if_absent(make(("a", 1, 99), ("b", 1, 21), ("b", 1, 20)), ["symbol", "day"], "x")
    assert rows_of(table.read()) == [("a", 1, 10), ("b", 1, 20)]
    table.append(make(("c", 2, 30)))
    table.replace(table.read().filter("x > 10"))
    assert rows_of(table.read()) == [("b", 1, 20), ("c", 2, 30)]


def test_overwrite_partitions_of_the_table_being_read(spark, tmp_path):
    root = str(tmp_path / "p")
    spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 2, 3)], "x string, n int, day int").write.partitionBy("day").parquet(root)
    tables.overwrite_partitions(spark.read.parquet(root).filter("day = 2").withColumn("n", F.col("n") + 5), root, ["day"])
    assert rows_of(spark.read.parquet(root).select("x", "n", "day")) == [("a", 1, 1), ("b", 6, 2), ("c", 2, 3)]


def test_backfill_leaves_what_is_there(spark, tmp_path):
    root = str(tmp_path / "csv")
    tables.backfill_csv(spark.createDataFrame([("a", 1)], "symbol string, x int"), root)
    tables.backfill_csv(spark.createDataFrame([("a", 2), ("b", 3)], "symbol string, x int"), root)
    read = spark.read.option("header", True).csv(root)
    assert rows_of(read.select("symbol", "x")) == [("a", "1"), ("b", "3")]
    tables.replace_csv(spark.createDataFrame([("a", 9)], "symbol string, x int"), root)
    assert rows_of(spark.read.option("header", True).csv(root).select("symbol", "x")) == [("a", "9"), ("b", "3")]


def test_bar_files_and_universe(spark, tmp_path):
    folder = tmp_path / "30Min_history_adj_raw"
    folder.mkdir()
    for s in ("AA", "B.csv"):
        (folder / f"{s}.csv").write_text("symbol,timestamp,open,high,low,close,volume,trade_count,vwap\n" f"{s},2024-01-02T10:00:00Z,1,2,1,2,5,1,1.5\n")
    bars = files.bar_files(spark, str(tmp_path), 30, "Min", "raw")
    assert rows_of(bars.select("symbol", "close")) == [("AA", 2.0), ("B.csv", 2.0)]
    assert rows_of(files.universe(None, None, lambda: files.symbols_of_files(bars))) == [("AA",), ("B.csv",)]
    listed = spark.createDataFrame([("X",), ("X",)], "symbol string")
    assert rows_of(files.universe(listed, None, None)) == [("X",)]
    with pytest.raises(ValueError):
        files.bar_files(spark, str(tmp_path), 30, "Min", "split")
    with pytest.raises(ValueError):
        files.universe(None, None, None)


def test_index_list_and_constituents(spark):
    listed = spark.createDataFrame([("I.X", "X")], "ID string, Code string")
    assert files.index_list(lambda: (200, listed), lambda: None).columns == ["full_symbol", "symbol"]
    assert files.index_list(lambda: (403, None), lambda: listed).count() == 1
    with pytest.raises(RuntimeError):
        files.index_list(lambda: (500, None), lambda: listed)
    document = '{"HistoricalTickerComponents": {"0": {"Code": "A", "StartDate": "", "EndDate": null}, "1": {"Code": "B", "StartDate": "2020-01-02", "EndDate": "2021-01-02"}}}'
    frame = spark.createDataFrame([("I.X", document), ("I.Y", "{}"), ("I.Z", None)], "index_symbol string, document string")
    found = rows_of(files.historical_constituents(frame).select("index_symbol", "symbol", "start_date", "end_date"))
    assert found == [("I.X", "A", dt.date(1950, 1, 1), dt.date(2199, 12, 31)), ("I.X", "B", dt.date(2020, 1, 2), dt.date(2021, 1, 2))]


def test_trend_events_by_hand(spark):
    at = lambda h, m: dt.datetime(2024, 1, 2, h, m)
    bars = [
        ("a", at(10, 0), 100.0, 101.0, 99.5, 100.5, 100.5),  # inside the band of 98 to 102
        ("a", at(10, 30), 100.5, 103.0, 100.0, 102.5, 102.5),  # reaches 102: its candles decide
        ("a", at(11, 0), 102.5, 103.0, 102.0, 102.6, 102.6),  # inside the band around 102.2
        ("b", at(10, 0), 50.0, 50.5, 49.5, 50.2, 50.2),
    ]
    candles = [("a", at(10, 5), 150.0, 1.0, 150.0), ("a", at(10, 31), 101.5, 100.0, 101.0), ("a", at(10, 40), 102.4, 101.0, 102.2), ("a", at(10, 50), 103.0, 102.0, 102.5)]
    found = events.trend_events(
        spark.createDataFrame(bars, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, close_adj double"),
        spark.createDataFrame(candles, "symbol string, ts timestamp_ntz, high double, low double, close double"),
    ).orderBy("symbol", "start_time").collect()
    assert [tuple(r)[:8] for r in found] == [
        ("a", at(10, 0), at(10, 40), 100.0, 102.4, 99.5, 102.2, 102.2),
        ("a", at(10, 41), at(11, 0), 102.2, 103.0, 102.0, 102.6, 102.6),
        ("b", at(10, 0), at(10, 0), 50.0, 50.5, 49.5, 50.2, 50.2),
    ]
    assert found[0]["pct_change"] == pytest.approx(0.022) and found[0]["factor"] == 1.0


def test_trend_events_neutralise_a_split(spark):
    at = lambda h, m: dt.datetime(2024, 1, 2, h, m)
    # raw prices halve while the adjusted ones stay: the factor doubles and no target is reached
    bars = [("a", at(10, 0), 100.0, 100.5, 99.5, 100.0, 50.0), ("a", at(10, 30), 50.0, 50.2, 49.8, 50.0, 50.0)]
    found = events.trend_events(
        spark.createDataFrame(bars, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, close_adj double"),
        spark.createDataFrame([("a", at(10, 31), 50.0, 50.0, 50.0)], "symbol string, ts timestamp_ntz, high double, low double, close double"),
    ).collect()
    assert len(found) == 1 and found[0]["factor"] == 2.0 and found[0]["close_adj"] == 100.0 and found[0]["pct_change"] == 0.0


def test_trend_events_of_prices_without_targets(spark):
    at = lambda h, m: dt.datetime(2024, 1, 2, h, m)
    bars = [
        ("a", at(10, 0), 100.0, 100.5, 99.5, 100.0, 100.0),
        ("a", at(10, 30), 100.0, 100.2, 0.0, 0.0, 0.0),  # falls to 0, which ends an event; 0 has no factor
        ("a", at(11, 0), 0.0, 50.0, 0.0, 50.0, 50.0),  # rises from 0, which ends the next
        ("a", at(11, 30), 50.0, 50.4, 49.9, 50.1, 50.1),
        ("b", at(10, 0), 0.0, 0.0, 0.0, 0.0, 0.0),  # never above 0
        ("c", at(10, 0), 50.0, 50.0, 49.9, 0.0, 0.0),  # its first factor is the second bar's
        ("c", at(10, 30), 50.0, 50.2, 49.9, 50.0, 25.0),
        ("d", at(10, 0), 1.0, 1.0, 1.0, 1.0, 10000.0),  # ten thousand to one: 0.000 is no factor
        ("d", at(10, 30), 10000.0, 10000.0, 10000.0, 10000.0, 10000.0),
        ("e", at(10, 0), float("nan"), 2.0, 1.0, 2.0, 2.0),  # no number: passed over
        ("e", at(10, 30), 3.0, 3.0, 3.0, 3.0, 3.0),
    ]
    candles = [
        *(("a", at(10, m), h, lo, c) for m, h, lo, c in ((31, 100.1, 99.8, 100.0), (40, 100.0, 0.0, 0.0), (50, 0.0, 0.0, 0.0))),
        *(("a", at(11, m), h, lo, c) for m, h, lo, c in ((5, 0.0, 0.0, 0.0), (10, 50.0, 0.0, 50.0), (20, 50.2, 49.8, 50.0))),
        ("b", at(10, 1), 0.0, 0.0, 0.0),
        ("d", at(10, 31), 10000.0, 10000.0, 10000.0),
        ("e", at(10, 1), 2.0, 1.0, 2.0),
    ]
    found = events.trend_events(
        spark.createDataFrame(bars, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, close_adj double"),
        spark.createDataFrame(candles, "symbol string, ts timestamp_ntz, high double, low double, close double"),
    ).orderBy("symbol", "start_time").collect()
    assert [(*r[:9], r[9] if r[9] is None else round(r[9], 6)) for r in found] == [
        ("a", at(10, 0), at(10, 40), 100.0, 100.5, 0.0, 0.0, 0.0, 1.0, -1.0),
        ("a", at(10, 41), at(11, 10), 0.0, 50.0, 0.0, 50.0, 50.0, 1.0, None),
        ("a", at(11, 11), at(11, 30), 50.0, 50.4, 49.8, 50.1, 50.1, 1.0, 0.002),
        ("b", at(10, 0), at(10, 0), 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, None),
        ("c", at(10, 0), at(10, 30), 50.0, 50.2, 49.9, 50.0, 50.0, 1.0, 0.0),
        ("d", at(10, 0), at(10, 30), 1.0, 10000.0, 1.0, 10000.0, 1.0, 0.0001, 0.0),
        ("e", at(10, 30), at(10, 30), 3.0, 3.0, 3.0, 3.0, 3.0, 1.0, 0.0),
    ]


def test_targets_of_all_tiers():
    near = [tuple(round(x, 6) for x in events.targets(p)) for p in (0.1, 0.5, 2.0, 10.0, 10.01)]
    assert near == [(0.088, 0.112), (0.46, 0.54), (1.9, 2.1), (9.7, 10.3), (9.81, 10.21)]
    with pytest.raises(ValueError):
        events.targets(0.0)


def streamed(spark, frame, name, mode):
    asked = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    asked.awaitTermination(120)
    return spark.table(name)


def test_streaming_bars_equal_the_batch(spark, tmp_path):
    whole = spark.read.parquet(f"{SF}/events.parquet")
    whole.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streamed(spark, streaming.streaming_bars(stream, late="40 days"), "bars_out", "complete")
    want = event_bars(whole).withColumn("ts", F.col("ts").cast("timestamp"))
    key = lambda f: sorted((r["symbol"], r["ts"], r["open"], r["close"], r["volume"], r["trade_count"], round(r["vwap"] or 0, 6)) for r in f.collect())
    assert key(got) == key(want)


def test_streamed_inserts_and_means(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1, 0, k), float(k)) for k in range(4)]
    spark.createDataFrame([*rows, rows[1]], "symbol string, ts timestamp, close double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("symbol string, ts timestamp, close double").parquet(str(tmp_path / "in"))
    assert streamed(spark, streaming.without_repeats(stream, ["symbol", "ts"], "ts"), "once_out", "append").count() == 4
    means = streamed(spark, streaming.running_mean(stream.dropDuplicates(["symbol", "ts"]), 0.5), "means_out", "append").orderBy("ts").collect()
    assert [r["mean"] for r in means] == [0.0, 0.5, 1.25, 2.125]
