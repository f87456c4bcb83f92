"""Roll-ups and statistics; all partial aggregations unless exact order statistics need rows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.market import in_session, to_zone
from tickloom.operators import grid, joins
from tickloom.sources.bars import event_order


def _first(value: str, at: str = "ts") -> Column:
    """The first value that is not null."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(at)))


def _last(value: str, at: str = "ts") -> Column:
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(at)))


def daily_ohlcv(bars: DataFrame, day: Column | None = None) -> DataFrame:
    """Days out of bars: first open, last close and, if there is one, last ``close_adj``, nulls skipped."""
    adjusted = [_last("close_adj").alias("close_adj")] if "close_adj" in bars.columns else []
    return bars.groupBy("symbol", (F.to_date("ts") if day is None else day).alias("day")).agg(
        _first("open").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        _last("close").alias("close"),
        *adjusted,
        F.sum("volume").alias("volume"),
        F.sum("trade_count").alias("trade_count"),
    )


def consolidated(raw: DataFrame, adjusted: DataFrame, first: str, last: str, members: dict[str, DataFrame]) -> DataFrame:
    """Daily rows of raw bars (``ts`` in UTC) that have an adjusted one, of New York time from the
    midnight of ``first`` to that of ``last``, with one label column per membership table."""
    local = joins.with_adjusted_close(raw, adjusted).withColumn("ts", to_zone(F.col("ts")))
    days = daily_ohlcv(grid.trim_dates(local, first, last))
    for label, spans in members.items():
        days = joins.label_intervals(days, spans, label=label)
    return days


def session_bars(ticks: DataFrame, first: int, last: int) -> DataFrame:
    """One bar per symbol and New York day out of ticks (event_type, event_id, ts in UTC, value)
    from minute ``first`` of the day up to, not including, ``last``."""
    rows = ticks.select(F.col("event_type").alias("symbol"), to_zone(F.col("ts")).alias("local"), "value", event_order().alias("at"))
    return rows.filter(in_session(F.col("local"), first, last)).groupBy("symbol", F.to_date("local").alias("session_date")).agg(
        F.min_by("value", "at").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "at").alias("close"),
        F.count("*").alias("trade_count"),
    )


def numbered(rows: DataFrame, order: str, name: str = "_n") -> DataFrame:
    """``rows`` with their place (from 0) by ``order``, without a window over all rows in one task:
    a range-partitioned sort, and the sizes of its partitions added up on a small table."""
    parted = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id())
    sizes = parted.groupBy("_p").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return parted.withColumn("_at", inside).join(F.broadcast(starts), "_p").withColumn(name, F.col("_start") + F.col("_at")).drop("_p", "_at", "_start")


def chunked(rows: DataFrame, order: str, size: int) -> DataFrame:
    """``rows`` with the number (from 0) of their chunk of ``size``, in order."""
    return numbered(rows, order).withColumn("chunk", F.floor(F.col("_n") / size)).drop("_n")


def concentration(bars: DataFrame) -> DataFrame:
    """Herfindahl index of volume per symbol and day, in one pass; null if there is no volume."""
    v = F.col("volume").cast("double")
    return bars.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.try_divide(F.sum(v * v), F.sum(v) * F.sum(v)).alias("hhi"))


def weighted_price(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", F.to_date("ts").alias("day")).agg(
        F.try_divide(F.sum(F.col("vwap") * F.col("volume")), F.sum("volume")).alias("vwap")
    )


def correlated_pairs(frame: DataFrame, columns: list[str], cut: float) -> DataFrame:
    """(a, b, r) with abs(r) above ``cut``, largest r first; all pairs in one aggregation."""
    pairs = list(combinations(columns, 2))
    wide = frame.agg(*[F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(rows)).filter(F.abs("r") > cut).orderBy(F.desc("r"))


def tail_returns(rows: DataFrame, sizes: list[int], unit: str = "d", order: str = "day") -> DataFrame:
    """Return and scaled deviation of each symbol's last rows, for several numbers of them.

    Null where a symbol has fewer rows. The deviation of one row is left out, as it has none.
    One sort per symbol and one aggregation serve all sizes.
    """
    recent = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(order)))
    last = rows.withColumn("_n", recent).filter(F.col("_n") <= max(sizes))
    out = []
    for d in sizes:
        inside = F.col("_n") <= d
        first_open, close = F.max(F.when(F.col("_n") == d, F.col("open"))), F.max(F.when(F.col("_n") == 1, F.col("close")))
        full = F.count_if(inside) == d
        out.append(F.when(full, F.try_divide(close, first_open) - 1).alias(f"return_{d}{unit}"))
        if d > 1:
            out.append(F.when(full, F.try_divide(F.stddev_samp(F.when(inside, F.col("close"))), first_open)).alias(f"std_{d}{unit}"))
    return last.groupBy("symbol").agg(*out)


def within_band(daily: DataFrame, low: float, high: float) -> DataFrame:
    """(symbol): those whose every row has ``volume * vwap`` from ``low`` to ``high``; a null amount is outside."""
    inside = F.coalesce((F.col("volume") * F.col("vwap")).between(low, high), F.lit(False))
    return daily.groupBy("symbol").agg(F.every(inside).alias("_all")).filter("_all").select("symbol")


def with_average(means: DataFrame, label: str, value: str) -> DataFrame:
    """A row ``Average`` besides: the plain mean of the groups' means."""
    return means.unionByName(means.agg(F.avg(value).alias(value)).select(F.lit("Average").alias(label), value))


def histogram2d(rows: DataFrame, x: str, y: str, cells: int) -> DataFrame:
    """(cell_x, cell_y, n) of the rows on an equal grid of ``cells`` by ``cells`` between the extremes."""
    known = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop()
    ends = known.agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])

    def cell(c: str) -> Column:
        step = (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / cells
        return F.least(F.coalesce(F.floor(F.try_divide(F.col(c) - F.col(f"lo_{c}"), step)), F.lit(0)), F.lit(cells - 1))

    both = known.crossJoin(F.broadcast(ends)).select(cell("x").alias("cell_x"), cell("y").alias("cell_y"))
    return both.groupBy("cell_x", "cell_y").agg(F.count("*").alias("n"))


def filled_with_median(rows: DataFrame, column: str) -> DataFrame:
    """Nulls of a column become its exact median."""
    median = rows.agg(F.percentile(column, F.lit(0.5)).alias("_median"))
    return rows.crossJoin(F.broadcast(median)).withColumn(column, F.coalesce(F.col(column).cast("double"), "_median")).drop("_median")


def class_metrics(scored: DataFrame, truth: str, guess: str, by: list[str], classes: tuple[int, ...] = (1,)) -> DataFrame:
    """Precision, recall, F1 and support per group, 0 where undefined; of several classes, one
    set of columns each with the class as suffix."""
    out = []
    for c in classes:
        end = "" if classes == (1,) else f"_{c}"
        hit = F.count_if((F.col(truth) == c) & (F.col(guess) == c))
        found, real = F.count_if(F.col(guess) == c), F.count_if(F.col(truth) == c)
        zero = lambda x: F.coalesce(x, F.lit(0.0))
        out += [
            zero(F.try_divide(hit, found)).alias(f"precision{end}"),
            zero(F.try_divide(hit, real)).alias(f"recall{end}"),
            zero(F.try_divide(2 * hit, found + real)).alias(f"f1{end}"),
        ]
        if end:
            out.append(real.alias(f"support{end}"))
    return scored.groupBy(*by).agg(*out)


def class_report(scored: DataFrame, truth: str, guess: str) -> DataFrame:
    """(label, precision, recall, f1, support) of classes 0 and 1, their plain and weighted mean, and accuracy."""
    wide = class_metrics(scored, truth, guess, [], (0, 1)).withColumn("n", F.col("support_0") + F.col("support_1"))
    right = scored.agg(F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("right"))
    wide = wide.crossJoin(F.broadcast(right))
    names = ("precision", "recall", "f1")

    def row(label: str, value) -> Column:
        support = F.col(f"support_{label}") if label in "01" else F.col("n")
        return F.struct(F.lit(label).alias("label"), *[value(m).alias(m) for m in names], support.alias("support"))

    def weighted(m: str) -> Column:
        return F.try_divide(F.col(f"{m}_0") * F.col("support_0") + F.col(f"{m}_1") * F.col("support_1"), F.col("n"))

    rows = [row(str(c), lambda m, c=c: F.col(f"{m}_{c}")) for c in (0, 1)]
    rows += [row("macro avg", lambda m: (F.col(f"{m}_0") + F.col(f"{m}_1")) / 2), row("weighted avg", weighted)]
    rows.append(row("accuracy", lambda m: F.col("right")))
    return wide.select(F.inline(F.array(*rows)))


def roc_auc(scored: DataFrame, truth: str, score: str, by: list[str], ranges: int = 256) -> DataFrame:
    """Area under the curve per group by rank sums with mid-ranks; 0 with one class only.

    Rows are counted per score first. A group's scores are cut into ``ranges`` of equal width, so
    that its ranks come from a window inside each range and one over the ranges' sums.
    """
    counts = scored.groupBy(*by, F.col(score).cast("double").alias("_s")).agg(F.count("*").alias("n"), F.sum(truth).alias("pos"))
    ends = counts.groupBy(*by).agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    place = F.floor((F.col("_s") - F.col("_lo")) * ranges / (F.col("_hi") - F.col("_lo")))
    parted = counts.join(ends, by).withColumn("_range", F.when(F.col("_hi") > F.col("_lo"), place).otherwise(F.lit(0)))
    sizes = parted.groupBy(*by, "_range").agg(F.sum("n").alias("_size"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_range").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_start") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    ranked = parted.join(starts, [*by, "_range"]).withColumn("rank", below + (F.col("n") + 1) / 2)
    pos, n = F.sum("pos"), F.sum("n")
    area = F.try_divide(F.sum(F.col("rank") * F.col("pos")) - pos * (pos + 1) / 2, pos * (n - pos))
    return ranked.groupBy(*by).agg(F.coalesce(area, F.lit(0.0)).alias("auc"))
