"""Features on bars whose results are worked out by hand, and rules that the tables do not reach."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tickloom.functions import market, text, times
from tickloom.operators import aggregates, features, grid, joins, models

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long, trade_count long, vwap double"


def bars(spark, rows):
    return spark.createDataFrame([("a", dt.datetime(*at), *r) for at, r in rows], BARS)


@pytest.fixture(scope="module")
def two_days(spark):
    # 14:30 UTC is 09:30 in New York in winter; 13:00 UTC is 08:00, premarket
    return bars(
        spark,
        [
            ((2024, 1, 2, 13, 0), (10.0, 12.0, 9.0, 11.0, 100, 10, 10.0)),
            ((2024, 1, 2, 14, 30), (11.0, 11.0, 11.0, 11.0, 50, 5, 11.0)),
            ((2024, 1, 2, 20, 30), (11.0, 14.0, 10.0, 13.0, 200, 20, 12.0)),
            ((2024, 1, 3, 13, 0), (14.0, 15.0, 13.0, 14.0, 10, 2, 14.0)),
            ((2024, 1, 3, 13, 30), (14.0, 16.0, 14.0, 15.0, 30, 2, 15.0)),
            ((2024, 1, 3, 15, 0), (15.0, 15.0, 12.0, 12.0, 80, 8, 13.0)),
        ],
    )


def values(frame, name):
    return {r["timestamp"]: r[name] for r in frame.collect()}


DAY1, DAY2 = dt.datetime(2024, 1, 2, 4), dt.datetime(2024, 1, 3, 4)


def test_daily_features_by_hand(two_days):
    of = lambda name, column=None: values(features.feature(two_days, name), column or name)
    assert of("gap_pct") == {DAY1: 0.0, DAY2: pytest.approx((14 - 13) / 13)}
    assert of("range_rel_last1d") == {DAY1: None, DAY2: pytest.approx((14 - 9) / 13)}
    upper = ((12 - 11) / 3 + 0 + (14 - 13) / 4) / 3
    lower = ((10 - 9) / 3 + 0 + (11 - 10) / 4) / 3
    assert of("upper_wick_ratio_last1d") == {DAY1: None, DAY2: pytest.approx(upper)}
    assert of("lower_wick_ratio_last1d") == {DAY1: None, DAY2: pytest.approx(lower)}
    assert of("hhi_premarket_volume") == {DAY1: 1.0, DAY2: pytest.approx((10**2 + 30**2) / 40**2)}
    assert of("PM_VWAP_Return") == {DAY1: None, DAY2: pytest.approx((10 * 14 + 30 * 15) / 40 / 13 - 1)}
    assert of("weekday") == {DAY1: "Tuesday", DAY2: "Wednesday"}
    assert of("prev_day_return") == {}
    for name in ("std_return_last5d", "rvol_20d", "dist_max_20d", "z_pm", "R_PM_hist"):
        assert set(of(name).values()) == {None}
    angles = features.feature(two_days, "weekday_cyclic").orderBy("timestamp").collect()
    assert angles[0]["weekday_sin"] == pytest.approx(math.sin(2 * math.pi / 5)) and angles[0]["weekday_cos"] == pytest.approx(math.cos(2 * math.pi / 5))


def test_long_windows_by_hand(spark):
    rows = []
    closes = [100.0 + (7 * k) % 11 for k in range(25)]
    for k, c in enumerate(closes):
        day = dt.datetime(2024, 3, 1) + dt.timedelta(days=k)
        rows.append(((day.year, day.month, day.day, 13, 0), (c - 1, c + 2, c - 2, c, 10 + k, 1 + k % 3, c)))
        rows.append(((day.year, day.month, day.day, 15, 0), (c, c + 1, c - 1, c + 0.5, 20, 2, c)))
    frame = bars(spark, rows)
    k, last = 24, [c + 0.5 for c in closes]
    at = dt.datetime(2024, 3, 25, 4)
    returns = [b / a - 1 for a, b in zip(last, last[1:])]
    mean = sum(returns[-20:]) / 20
    dev = math.sqrt(sum((r - mean) ** 2 for r in returns[-20:]) / 19)
    found = {n: values(features.feature(frame, n), n)[at] for n in ("dist_max_20d", "rvol_20d", "z_pm", "R_PM_hist", "prev_day_return", "std_return_last5d")}
    assert found["dist_max_20d"] == pytest.approx((last[k - 1] - max(last[k - 20 : k])) / max(last[k - 20 : k]))
    money = [c * (10 + i) + c * 20 for i, c in enumerate(closes)]
    assert found["rvol_20d"] == pytest.approx(money[k] / (sum(money[k - 20 : k]) / 20))
    assert found["z_pm"] == pytest.approx((1 / (closes[k] - 1) - mean) / dev)
    sizes = sorted((10 + i) / (1 + i % 3) for i in range(k - 19, k + 1))
    usual = (sizes[9] + sizes[10]) / 2
    assert found["R_PM_hist"] == pytest.approx(math.log(((10 + k) / (1 + k % 3) + 0.01) / (usual + 0.01)))
    assert found["prev_day_return"] == pytest.approx(returns[-2])
    logs = [math.log((c + 0.5) / c) for c in closes[k - 4 : k + 1]]
    assert found["std_return_last5d"] == pytest.approx(math.sqrt(sum((x - sum(logs) / 5) ** 2 for x in logs) / 4))


def test_days_since_holiday(spark):
    days = [(2021, 6, 17), (2021, 6, 18), (2021, 7, 1), (2021, 7, 5), (2021, 12, 31), (2022, 1, 3)]
    frame = bars(spark, [((*d, 15, 0), (1.0, 1.0, 1.0, 1.0, 1, 1, 1.0)) for d in days])
    found = values(features.feature(frame, "days_since_holiday"), "days_since_holiday")
    # Juneteenth of 2021 was observed on the 18th, July 4 on the 5th, New Year of 2022 on December 31
    assert list(found[dt.datetime(*d, 4)] for d in days) == [None, 0, 13, 0, 0, 3]


def test_holidays_equal_the_known_calendar(spark):
    calendar = pytest.importorskip("pandas.tseries.holiday").USFederalHolidayCalendar()
    found = spark.range(2000, 2031).select(F.explode(market.federal_holidays(F.col("id").cast("int"))).alias("d")).na.drop().collect()
    mine = {r["d"] for r in found if dt.date(2000, 1, 3) <= r["d"] <= dt.date(2030, 12, 25)}
    assert mine == {d.date() for d in calendar.holidays("2000-01-03", "2030-12-25")}


def test_attach_replaces_columns_and_keeps_rows(spark, two_days):
    daily = spark.createDataFrame([("a", dt.date(2024, 1, 3), 5.0), ("b", dt.date(2024, 1, 3), 6.0)], "symbol string, day date, gap_pct double")
    out = {r["symbol"]: r for r in features.attach(daily, two_days).collect()}
    assert out["a"]["gap_pct"] == pytest.approx(1 / 13) and out["b"]["gap_pct"] is None
    assert set(out["a"].asDict()) == {"symbol", "day", *[c for f in features.FEATURES.values() for c in f.columns]}


def test_recursive_mean_with_nulls(spark):
    rows = spark.createDataFrame([("a", k, x) for k, x in enumerate([None, 1.0, None, 3.0])] + [("b", 0, 2.0)], "symbol string, day int, close double")
    found = features.smoothed(rows, {"m": 0.5}, "close", "day").orderBy("symbol", "day").collect()
    assert [r["m"] for r in found] == [None, 1.0, 1.0, 2.0, 2.0]
    with pytest.raises(ValueError):
        features.relative_true_range_means(None, soft=0.1, peak=0.1)


def test_price_bands(spark):
    prices = [0.05, 0.3, 1.0, 5.0, 100.0]
    out = [r["b"] for r in spark.createDataFrame([(p,) for p in prices], "p double").select(market.price_band(F.col("p")).alias("b")).collect()]
    assert [(round(b[0], 6), round(b[1], 6)) for b in out] == [(0.044, 0.056), (0.276, 0.324), (0.95, 1.05), (4.85, 5.15), (98.0, 102.0)]
    with pytest.raises(Exception, match="above 0"):
        spark.createDataFrame([(0.0,)], "p double").select(market.price_band(F.col("p"))).collect()


def test_label_intervals_keeps_equal_rows_and_takes_the_latest_end(spark):
    day = dt.date(2024, 1, 10)
    rows = spark.createDataFrame([("a", day, 1), ("a", day, 1), ("a", dt.date(2024, 2, 1), 2), ("b", day, 3)], "symbol string, day date, x int")
    spans = [("a", "one", "2024-01-01", "2024-01-31"), ("a", "two", "2024-01-05", "2024-01-12"), ("b", "out", "2024-01-01", "2024-01-10")]
    members = spark.createDataFrame(spans, "symbol string, index_symbol string, start_date string, end_date string")
    members = members.withColumns({c: F.to_date(c) for c in ("start_date", "end_date")})
    found = sorted((r["symbol"], r["x"], r["index_symbol"]) for r in joins.label_intervals(rows, members).collect())
    assert found == [("a", 1, "one"), ("a", 1, "one"), ("a", 2, None), ("b", 3, None)]


def test_tail_returns_need_enough_rows(spark):
    rows = spark.createDataFrame([("a", k, 10.0 + k, 11.0 + k) for k in range(180)] + [("b", 0, 1.0, 2.0)], "symbol string, day int, open double, close double")
    found = {r["symbol"]: r for r in aggregates.tail_returns(rows, [1, 7, 180]).collect()}
    assert found["a"]["return_180d"] == pytest.approx(190 / 10 - 1) and found["a"]["return_7d"] == pytest.approx(190 / 183 - 1)
    assert found["b"]["return_1d"] == 1.0 and found["b"]["return_7d"] is None and "std_1d" not in found["b"].asDict()


def test_volume_band_drops_and_keeps(spark):
    rows = spark.createDataFrame([("in", 10, 2.0), ("in", 20, 2.0), ("out", 10, 2.0), ("out", 900, 2.0), ("null", 10, None)], "symbol string, volume long, vwap double")
    assert [r["symbol"] for r in aggregates.within_band(rows, 20, 100).collect()] == ["in"]


def test_grid_of_a_raster_off_the_half_hour(spark):
    frame = bars(spark, [((2024, 1, 5, 18, 45), (1.0, 1.0, 1.0, 1.0, 1, 1, 1.0)), ((2024, 1, 8, 5, 15), (2.0, 2.0, 2.0, 2.0, 1, 1, 2.0))])
    got = [r["ts"] for r in grid.slots(frame).orderBy("ts").collect()]
    monday = [dt.datetime(2024, 1, 8, 4, 15), dt.datetime(2024, 1, 8, 4, 45), dt.datetime(2024, 1, 8, 5, 15)]
    assert got == [dt.datetime(2024, 1, 5, 18, 45), dt.datetime(2024, 1, 5, 19, 15), dt.datetime(2024, 1, 5, 19, 45), *monday]


def test_text_functions(spark):
    rows = spark.createDataFrame([("BRK-B_old2",), ("x.csv",), ("net_model_2021",), ("net_2020",), ("",), (None,)], "x string")
    base, year = text.model_name(F.col("x"))
    out = rows.select(text.clean_ticker(F.col("x")), text.without_suffix(F.col("x"), ".csv"), base, year, text.filled(F.col("x"), "none")).collect()
    assert [r[0] for r in out][:1] == ["BRK.B"] and out[1][1] == "x"
    assert [(r[2], r[3]) for r in out] == [(None, None), (None, None), ("net", 2021), ("net", 2020), (None, None), (None, None)]
    assert [r[4] for r in out][-2:] == ["none", "none"]
    low, high = times.request_bounds(F.lit("2024-01-05 10:00:00").cast("timestamp_ntz"), F.lit("2024-01-06").cast("timestamp_ntz"))
    assert list(spark.range(1).select(low, high).first()) == [dt.datetime(2024, 1, 5, 0, 0, 1), dt.datetime(2024, 1, 5, 23, 59, 59)]


def test_models_and_study(spark):
    rows = spark.createDataFrame([(float(k % 7), float(k), int(k % 7 > 3), k >= 150) for k in range(200)], "a double, b double, y int, is_test boolean")
    study = models.Study("dtree").run(rows, ["a", "b"], "y", 2)
    assert len(study.trials) == 2 and study.trials[0][0] == 1.0
    assert len(study.run(rows, ["a", "b"], "y", 3).trials) == 3
    assert models.most_frequent(rows, "y").select("guess").distinct().collect()[0][0] == 0


def test_roc_auc_of_one_score_and_one_class(spark):
    rows = spark.createDataFrame([("flat", 1, 5), ("flat", 0, 5), ("one", 1, 1), ("one", 1, 2), ("best", 0, 1), ("best", 1, 2)], "g string, y int, s int")
    assert {r["g"]: r["auc"] for r in aggregates.roc_auc(rows, "y", "s", ["g"]).collect()} == {"flat": 0.5, "one": 0.0, "best": 1.0}


def test_export_importances_and_months(spark, tmp_path):
    first = dt.date(2024, 1, 1)
    rows = spark.createDataFrame([(first + dt.timedelta(days=k), float(k % 7), float(k), int(k % 7 > 3)) for k in range(60)], "day date, a double, b double, y int")
    tree, line = (models.fitted(rows, f, ["a", "b"], "y") for f in ("dtree", "logreg"))
    assert models.importances(tree, ["a", "b"])[0][0] == "a" and models.importances(line, ["a", "b"])[0][0] == "a"
    found = {(r["model"], r["month"]): r for r in models.monthly({"tree": tree, "line": line}, rows, "y", "day").collect()}
    assert set(found) == {(m, k) for m in ("tree", "line") for k in (1, 2)}
    assert found["tree", 1]["f1"] == 1.0 and found["tree", 2]["auc"] == 1.0
    models.exported(tree, spark, str(tmp_path), "tree_2024", {"kind": "dtree"})
    assert spark.read.parquet(str(tmp_path / "tree_2024" / "tags")).first()["value"] == "dtree"
    study = models.Study("dtree", [(0.5, {"maxDepth": 2})])
    study.save(spark, str(tmp_path / "study"))
    assert models.Study.load(spark, str(tmp_path / "study")) == study


def test_settings(spark, tmp_path):
    from tickloom import settings

    assert settings.Settings.from_environment({"TICKLOOM_SAVE_FOLDER": "x"}) == settings.Settings(save_folder="x")
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert settings.scan(spark, str(tmp_path / "t")).count() == 3
    spark.range(2).createOrReplaceTempView("named")
    assert settings.scan(spark, "named").count() == 2
