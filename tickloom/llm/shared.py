"""Session facts, scratch tables and bit filters that the operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import pickle
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.textkit import give_back, map_arrow

#: bits of a filter: 8 MB that are broadcast, whatever the input's size
FILTER_BITS = 1 << 26


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that executors share, as the session names it.

    Where it names none, a fresh local folder is set in local mode (tests on one machine);
    anywhere else that folder would not be shared, and the call fails.
    """
    context = spark.sparkContext
    named = context._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return named.get()
    configured = context.getConf().get("spark.checkpoint.dir")
    if not configured and context.master.split("[")[0] != "local":
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tickloom-checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def tidy(spark: SparkSession) -> bool:
    """The driver gives back memory that it does not use; did its JVM collect garbage for that?

    Between steps of many tasks the JVM's heap holds little but has grown far; it shrinks only
    when all of it is collected, which is asked for once it has half of its limit. The
    C library keeps what Python has freed until it is told to return it.
    """
    gc.collect()
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    grown = heap.totalMemory() > heap.maxMemory() // 2
    if grown:
        spark._jvm.java.lang.System.gc()
    give_back()
    return grown


def checkpointed(frame: DataFrame) -> DataFrame:
    """``frame`` written to the shared folder and read from there, its lineage cut."""
    checkpoint_dir(frame.sparkSession)
    held = frame.checkpoint(eager=True)
    tidy(frame.sparkSession)
    return held


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Within it, what runs is handed to Python ``rows`` rows at a time: long texts make the
    default of 10,000 rows large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables written to a folder of their own in the shared folder, deleted by name when used up."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        tidy(self.spark)
        return self.spark.read.schema(frame.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.folder}/{name}")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    system, where = _file_system(spark, path)
    system.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _file_system(spark, path)
    return system.exists(where)


def place_of(*columns: Column) -> Column:
    """The bit (1 to FILTER_BITS) of a row with these values."""
    return F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS)) + 1


def bit_filter(places: DataFrame):
    """A broadcast bitmap of the places in the only column of ``places``, built by the executors."""
    name = places.columns[0]
    found = places.groupBy(F.expr(f"bitmap_bucket_number(`{name}`)").alias("part")).agg(
        F.expr(f"bitmap_construct_agg(bitmap_bit_position(`{name}`))").alias("bits")
    )
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in found.collect():  # at most FILTER_BITS / 8 bytes
        at = (row["part"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
    return places.sparkSession.sparkContext.broadcast(bits)


def mapped(held) -> np.ndarray:
    """The bytes of a broadcast ``bytes`` value, in a worker, without a copy of its own where that can be.

    Spark has put the pickled value into a local file, which all workers of an executor can map:
    an optional frame, then the length and the bytes as they are. Without such a file, or with
    another content (encrypted, say), the value is loaded.
    """
    path = getattr(held, "_path", None)
    if path and not hasattr(held, "_value") and os.path.isfile(path):
        with open(path, "rb") as file:
            head = file.read(32)
        at = 2 if head[:1] == pickle.PROTO else 0
        at += 9 if head[at : at + 1] == pickle.FRAME else 0
        width = {pickle.BINBYTES: 4, pickle.BINBYTES8: 8}.get(head[at : at + 1], 0)
        first = at + 1 + width
        n = int.from_bytes(head[at + 1 : first], "little")
        if n and first + n < os.path.getsize(path) <= first + n + 2:  # a mark for the memo may follow, and the end
            return np.memmap(path, np.uint8, "r", first, (n,))
    return np.frombuffer(held.value, np.uint8)


def has_bit(bits: np.ndarray, places: pa.Array) -> np.ndarray:
    spot = places.to_numpy() - 1
    return ((bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1).astype(bool)


def sieved(rows: DataFrame, place: Column, held, wanted: bool) -> DataFrame:
    """The rows whose bit is set (``wanted``) or is not; a set bit may be another row's."""
    kinds = rows.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hit = has_bit(held.value, batch.column(batch.num_columns - 1))
                kept = batch.slice(0).select(batch.schema.names[:-1])
                yield kept.filter(pa.array(hit if wanted else ~hit))

    return map_arrow(rows.withColumn("__place", place), work, kinds)


def with_row_ids(docs: DataFrame, key: str, name: str = "_row") -> tuple[DataFrame, Scratch | None]:
    """``docs`` with ``name``, a struct that no two rows share and that orders as the key, null last.

    It is made of the key and of the row's file and place in the file, so it stays the same
    when a task or a whole query runs again. Rows that do not come straight from files are
    written to the shared folder first, which the caller may drop as table ``rows``.
    """
    scratch = None
    try:
        files = docs.select(docs.metadataColumn("_metadata")).schema["_metadata"]
        assert {"file_path", "row_index"} <= set(files.dataType.fieldNames())
    except Exception as missing:
        if not isinstance(missing, AssertionError) and type(missing).__name__ != "AnalysisException":
            raise
        scratch = Scratch(docs.sparkSession, "rows")
        docs = scratch.write(docs, "rows")
    origin = docs.metadataColumn("_metadata")
    row = F.struct(
        F.col(key).isNull().alias("null"), F.col(key).alias("key"), F.xxhash64(origin["file_path"]).alias("file"), origin["row_index"].alias("at")
    )
    return docs.select("*", row.alias(name)), scratch
