"""Writers to folders of Parquet or CSV.

A table is a folder of versions with a pointer: a write makes a new version and only then moves
the pointer, so that readers see the old table or the new one, a failed write leaves nothing
behind that is read, and a table may be rewritten from itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import joins


def _system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


class Table:
    """Parquet folders under ``root``; ``current`` lists those that make up the table.

    What is appended is a folder more, so nothing that is there is written again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def folders(self) -> list[str]:
        system, where = _system(self.spark, f"{self.root}/current")
        if not system.exists(where):
            return []
        return [r[0] for r in self.spark.read.text(f"{self.root}/current").collect()]  # one line per append

    def read(self) -> DataFrame:
        folders = self.folders()
        if not folders:
            raise FileNotFoundError(f"nothing has been written to {self.root}")
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders])

    def _publish(self, folders: list[str]) -> None:
        """The list is written aside and renamed, the last step of a write."""
        aside = f"{self.root}/current-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(f,) for f in folders], "v string").coalesce(1).write.text(aside)
        system, where = _system(self.spark, f"{self.root}/current")
        system.delete(where, True)
        system.rename(_system(self.spark, aside)[1], where)

    def _add(self, frame: DataFrame, before: list[str]) -> None:
        folder = f"v-{uuid.uuid4().hex}"
        frame.write.option("compression", "snappy").parquet(f"{self.root}/{folder}")
        self._publish([*before, folder])

    def replace(self, frame: DataFrame) -> None:
        """The table becomes ``frame``, which may have been read from it."""
        self._add(frame, [])

    def append(self, frame: DataFrame) -> None:
        self._add(frame, self.folders())

    def insert_if_absent(self, frame: DataFrame, keys: list[str], order: str) -> None:
        """Adds one row, the first by ``order``, of each key that the table lacks."""
        before = self.folders()
        old = self.read() if before else frame.limit(0)
        self._add(joins.insert_if_absent(old, frame, keys, order), before)


def overwrite_partitions(frame: DataFrame, root: str, by: list[str]) -> None:
    """The partitions under ``root`` that ``frame`` has rows of become those rows; the others stay.

    ``frame`` may have been read from ``root``: it is written beside it first, and only then do
    its partitions, and no others, replace the old ones.
    """
    spark = frame.sparkSession
    aside = f"{root.rstrip('/')}-{uuid.uuid4().hex}"
    frame.write.parquet(aside)
    staged = spark.read.schema(frame.schema).parquet(aside)
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(root)
    system, where = _system(spark, aside)
    system.delete(where, True)


def backfill_csv(frame: DataFrame, root: str, key: str = "symbol") -> None:
    """One CSV folder per key; keys that have one with rows are left alone."""
    spark = frame.sparkSession
    system, where = _system(spark, root)
    if system.exists(where):
        there = spark.read.option("header", True).csv(root)
        if key in there.columns:
            frame = frame.join(there.select(F.col(key).cast(frame.schema[key].dataType).alias(key)).distinct(), key, "left_anti")
    frame.repartition(key).write.mode("append").partitionBy(key).option("header", True).csv(root)


def replace_csv(frame: DataFrame, root: str, key: str = "symbol") -> None:
    """One CSV folder per key; those of keys in ``frame`` are overwritten, the others stay."""
    writer = frame.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(key).option("header", True).csv(root)
