"""The corpus pipeline: stages over documents, each written as Parquet and read by the next.

A stage takes (spark, docs, sf_dir) and works on all that the one before kept. Every stage
but the last returns the columns of ``documents``, whatever else these are; the last returns
packed pieces. A doc_id may be null or repeated: the stages judge rows, told apart by their
file and place in it. Empty documents and documents without text or label pass every stage;
an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import near_dedup, packing, quality, substring_dedup, toxicity
from tickloom.llm.hashed import held_out
from tickloom.llm.queries import _word_tokenizer
from tickloom.llm.shared import bit_filter, checkpoint_dir, checkpointed, delete, exists, place_of, sieved, with_row_ids


def _long_texts(spark: SparkSession) -> None:
    """From here on the session hands Python a thousand rows at a time, not ten thousand, whose texts
    would take a large part of a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _kept_by(docs: DataFrame, score, wanted: int) -> DataFrame:
    """The rows for which ``score``, which adds score and predicted, predicts ``wanted``; columns
    of ``docs`` that have these names stay what they are."""
    names = ["text" if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns)]
    return score(docs.toDF(*names)).filter(F.col("predicted") == wanted).select(*names).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier predicts to be toxic go."""
    _long_texts(spark)
    model = toxicity.fit(docs, _labels(spark, sf_dir), ~held_out(F.col("doc_id"), 4, 2))
    return _kept_by(docs, lambda d: toxicity.score_toxicity(d, model), 0)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier predicts to be of low quality go."""
    _long_texts(spark)
    model = quality.fit(docs, _labels(spark, sf_dir), ~held_out(F.col("doc_id"), 5, 0))
    return _kept_by(docs, lambda d: quality.score_quality(d, model), 1)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows the first by doc_id stays, null ids last; of rows that
    share that doc_id too, the first by file and place.

    Only rows whose bit is set in a filter of the dropped ones are shuffled to be told apart.
    """
    _long_texts(spark)
    rows, _ = with_row_ids(docs, "doc_id", "__row")
    found = near_dedup.near_duplicates(rows, key="__row", shingle=5, percent=80)
    dropped = checkpointed(found.filter("not kept").select("__row"))
    place: Column = place_of(F.col("__row"))
    held = bit_filter(dropped.select(place.alias("place")))
    rest = sieved(rows, place, held, True).join(dropped, "__row", "left_anti")
    return sieved(rows, place, held, False).unionByName(rest).select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A text that loses words keeps the others, joined by one space, and its n_chars follows;
    other texts stay as they are. A passage stays in the first row by doc_id, null ids last."""
    _long_texts(spark)
    rows, _ = with_row_ids(docs, "doc_id", "__row")
    found = substring_dedup.remove_repeats(rows, key="__row", size=50, carry=tuple(docs.columns))
    cut = F.col("n_removed") > 0
    changed = found.select("row", cut.alias("cut"), F.when(cut, F.col("kept")).alias("kept"))
    own = {c: F.col("row")[c] for c in docs.columns}
    own["text"] = F.when(F.col("cut"), F.col("kept")).otherwise(own["text"])
    own["n_chars"] = F.when(F.col("cut"), F.length("kept").cast("long")).otherwise(own["n_chars"])
    return changed.select(*[own[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their sequences; rows of one doc_id are packed each."""
    _long_texts(spark)
    return packing.pack_documents(docs, _word_tokenizer(), capacity=4096, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack),
]
ORACLE_SQL = None  # the stages with learned models and the tokenizer are not SQL


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The last stage's rows. What lies between is written below the shared checkpoint folder.

    A stage's table goes as soon as the next one's is complete. With a ``folder`` named by an
    earlier call that failed, the stages complete there are not run again.
    """
    folder = folder or f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = [k for k in range(len(STAGES)) if exists(spark, f"{folder}/{k}/_SUCCESS")]
    for k, (_, stage) in enumerate(STAGES):
        if k < max(done, default=0):
            continue
        if k not in done:
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return docs
