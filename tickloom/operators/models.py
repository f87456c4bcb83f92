"""Preparation, splits and models of binary classifiers over daily rows."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import RobustScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators.aggregates import class_metrics, filled_with_median, roc_auc


def one_hot(rows: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """Each column becomes one 0/1 column per value given, named ``column_value``."""
    made = {f"{c}_{v}": F.coalesce(F.col(c) == v, F.lit(False)).cast("double") for c, values in columns.items() for v in values}
    return rows.withColumns(made).drop(*columns)


def prepared(rows: DataFrame, trim: int = 20, key: str = "symbol", at: str = "timestamp", fill: str = "days_since_holiday", drop: tuple[str, ...] = ()) -> DataFrame:
    """Without each symbol's first rows, gaps of one column filled with its median, dated, and
    without the columns that are no features."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(at))
    kept = rows.withColumn("_n", n).filter(F.col("_n") > trim).drop("_n")
    return filled_with_median(kept, fill).withColumn("date", F.to_date(at)).drop(key, at, *drop)


def temporal_split(rows: DataFrame, day: str, months: int) -> DataFrame:
    """``rows`` with ``is_test``: the last ``months`` months, counted from the last day."""
    cut = rows.agg(F.add_months(F.max(day), -months).alias("_cut"))
    return rows.crossJoin(F.broadcast(cut)).withColumn("is_test", F.col(day) >= F.col("_cut")).drop("_cut")


def rolling_splits(rows: DataFrame, day: str, train_months: int, test_months: int) -> DataFrame:
    """``rows`` once per window that they are in, with ``split`` (from 0) and ``is_test``.

    A window is ``train_months`` and then ``test_months``; the next one begins ``test_months``
    later; windows that end after the last day are left out. A row finds its windows by
    arithmetic on its own day, so nothing but the rows in several windows is repeated. A window
    without rows in either part is left out.
    """
    ends = rows.agg(F.min(day).alias("_first"), F.max(day).alias("_last"))
    held = rows.crossJoin(F.broadcast(ends))
    # the window that a day's month count points at, and its neighbours for the days of the month
    near = F.floor(F.months_between(F.col(day), F.col("_first")) / test_months).cast("int")
    back = -(-train_months // test_months) + 2
    each = held.withColumn("split", F.explode(F.sequence(F.greatest(near - back, F.lit(0)), F.greatest(near + 1, F.lit(0)))))
    edges = each.withColumn("_start", F.add_months("_first", F.col("split") * test_months))
    train_end = F.add_months("_start", train_months)
    test_end = F.add_months(train_end, test_months)
    inside = edges.filter((F.col(day) >= F.col("_start")) & (F.col(day) < test_end) & (test_end <= F.col("_last")))
    marked = inside.withColumn("is_test", F.col(day) >= train_end).drop("_first", "_last", "_start")
    both = marked.groupBy("split").agg(F.countDistinct("is_test").alias("_parts")).filter("_parts = 2").select("split")
    return marked.join(F.broadcast(both), "split")


def year_split(rows: DataFrame, day: str, first: int, last: int, test: int) -> DataFrame:
    """The rows of the training years and of the test year, with ``is_test``."""
    year = F.year(day)
    return rows.filter(year.between(first, last) | (year == test)).withColumn("is_test", year == test)


def robust_scaled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each column less its exact median, over its exact interquartile range (1 where that is 0)."""
    points = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    marks = rows.agg(*[F.percentile(c, points).alias(f"_{c}") for c in columns])
    held = rows.crossJoin(F.broadcast(marks))
    for c in columns:
        q = F.col(f"_{c}")
        spread = F.coalesce(F.nullif(q[2] - q[0], F.lit(0.0)), F.lit(1.0))
        held = held.withColumn(c, (F.col(c) - q[1]) / spread).drop(f"_{c}")
    return held


def most_frequent(rows: DataFrame, target: str, is_test: str = "is_test") -> DataFrame:
    """The test rows with the training rows' commonest class (ties: the smaller) as ``guess``."""
    counts = rows.filter(~F.col(is_test)).groupBy(target).agg(F.count("*").alias("_n"))
    mode = counts.agg(F.max_by(target, F.struct("_n", -F.col(target))).alias("guess"))
    return rows.filter(is_test).crossJoin(F.broadcast(mode))


#: name to estimator and the parameters that a search draws from
FAMILIES: dict[str, tuple[type, dict[str, list]]] = {
    "logreg": (LogisticRegression, {"regParam": [0.0, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0], "maxIter": [50]}),
    "dtree": (DecisionTreeClassifier, {"maxDepth": [2, 4, 6, 8], "minInstancesPerNode": [1, 5, 20], "seed": [42]}),
    "gbt": (GBTClassifier, {"maxDepth": [2, 3, 4], "maxIter": [10, 20], "stepSize": [0.05, 0.1], "seed": [42]}),
    "rf": (RandomForestClassifier, {"maxDepth": [3, 5, 8], "numTrees": [10, 20], "seed": [42]}),
}


def fitted(train: DataFrame, family: str, columns: list[str], target: str, **params):
    """A pipeline of assembling, robust scaling and one classifier, fitted."""
    kind, _ = FAMILIES[family]
    stages = [
        VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="skip"),
        RobustScaler(inputCol="_raw", outputCol="_features", withCentering=True),
        kind(featuresCol="_features", labelCol=target, **params),
    ]
    return Pipeline(stages=stages).fit(train)


def predicted(model, rows: DataFrame) -> DataFrame:
    """``rows`` with ``score`` (of class 1) and ``guess``."""
    out = model.transform(rows).withColumn("score", vector_to_array("probability")[1]).withColumn("guess", F.col("prediction").cast("int"))
    return out.drop("_raw", "_features", "rawPrediction", "probability", "prediction")


@dataclass
class Study:
    """The trials of a search, best first by F1 of class 1; carried on where it stopped."""

    family: str
    trials: list[tuple[float, dict]] = field(default_factory=list)

    def run(self, rows: DataFrame, columns: list[str], target: str, n: int, seed: int = 42) -> Study:
        """Up to ``n`` trials in all, drawn from the family's parameters without repeats."""
        import itertools
        import random

        space = FAMILIES[self.family][1]
        every = [dict(zip(space, values)) for values in itertools.product(*space.values())]
        random.Random(seed).shuffle(every)
        done = [p for _, p in self.trials]
        train, test = rows.filter(~F.col("is_test")), rows.filter("is_test")
        for params in [p for p in every if p not in done][: max(0, n - len(done))]:
            scored = predicted(fitted(train, self.family, columns, target, **params), test)
            self.trials.append((class_metrics(scored, target, "guess", []).first()["f1"], params))
        self.trials.sort(key=lambda t: -t[0])
        return self

    def save(self, spark: SparkSession, path: str) -> None:
        text = json.dumps({"family": self.family, "trials": self.trials})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Study:
        held = json.loads(spark.read.text(path).first()[0])
        return Study(held["family"], [(f1, params) for f1, params in held["trials"]])


def exported(model, spark: SparkSession, root: str, name: str, tags: dict[str, str]) -> None:
    """The fitted pipeline under ``root/name`` and its tags beside it."""
    model.write().overwrite().save(f"{root}/{name}/model")
    rows = [(name, k, v) for k, v in sorted(tags.items())]
    spark.createDataFrame(rows, "name string, tag string, value string").coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}/tags")


def importances(model, columns: list[str]) -> list[tuple[str, float]]:
    """Each feature's importance, or its coefficient in a linear model, largest first."""
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    return sorted(zip(columns, (float(x) for x in values.toArray())), key=lambda p: -abs(p[1]))


def monthly(models: dict[str, object], rows: DataFrame, target: str, day: str) -> DataFrame:
    """(model, year, month, precision, recall, f1, auc) of every model on every month of ``rows``.

    Each model scores the rows once; months come from a grouping, not from a loop over them.
    """
    scored = None
    for name, model in models.items():
        part = predicted(model, rows).select(F.lit(name).alias("model"), F.year(day).alias("year"), F.month(day).alias("month"), target, "guess", "score")
        scored = part if scored is None else scored.unionByName(part)
    by = ["model", "year", "month"]
    return class_metrics(scored, target, "guess", by).join(roc_auc(scored, target, "score", by), by)
