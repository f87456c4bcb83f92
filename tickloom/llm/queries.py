"""The registered queries of this subpackage and, where SQL can say it, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import ann, fingerprint, langid, near_dedup, packing, pieces, quality, sharding, substring_dedup, toxicity
from tickloom.llm.hashed import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_count_min_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), size=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), windows AS (
  SELECT doc_id, i, sha256(array_to_string(list_slice(words, i, i + 49), ' ')) AS content
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS i FROM split WHERE len(words) >= 50)
), first_seen AS (
  SELECT content, min(doc_id) AS first_doc FROM windows GROUP BY content HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT doc_id, list(DISTINCT place) AS places
  FROM (SELECT w.doc_id, unnest(generate_series(i, i + 49)) AS place
        FROM windows w JOIN first_seen f ON w.content = f.content AND f.first_doc < w.doc_id)
  GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string([words[k] FOR k IN generate_series(1, len(words))
                               IF NOT list_contains(coalesce(places, []), k)], ' ')) AS kept_sha256
FROM split s LEFT JOIN gone g ON s.doc_id = g.doc_id
"""


def op5_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), n_shards=8)


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = fingerprint.fingerprint_edits(_table(spark, sf_dir, "documents"))
    return marked.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.as_hex(F.col("signature")).alias("fingerprint"),
        fingerprint.as_hex(F.col("edited_signature")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op8_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=5, percent=85)


OP8_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, hash(list_slice(words, i, i + 4)) AS shingle
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i FROM split WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS seen FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.seen
), grouped AS (
  SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id
)
SELECT g.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, g.doc_id = component_id AS kept
FROM grouped g LEFT JOIN sizes s ON s.doc_id = g.doc_id
"""


def op2_recurrent_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 4, 2)
    network = langid.fit(documents, ~held)
    return langid.predict(documents.select("doc_id", held.alias("held_out"), "text"), network).drop("text")


def op3_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 5, 0)
    model = quality.fit(documents, _table(spark, sf_dir, "labels"), ~held)
    return quality.score_quality(documents.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def _word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _word_tokenizer(), capacity=4096, end_id=1)


def op9_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the number and CRC-32 of its ids, and the SHA-256 of the decoded text."""
    model = _piece_model()
    encoded = pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), model).drop("text")
    return pieces.decode(encoded, model).select(
        "doc_id",
        F.floor(F.octet_length("piece_ids") / 4).cast("long").alias("n_ids"),
        F.crc32("piece_ids").alias("ids_crc32"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_weakly_supervised_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 4, 2)
    model = toxicity.fit(documents, _table(spark, sf_dir, "labels"), ~held)
    return toxicity.score_toxicity(documents.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_count_min_substring_dedup,
        op2_recurrent_language_id,
        op3_inverted_multi_index,
        op4_ftrl_quality,
        op5_hash_tree_sharding,
        op6_sum_of_squares_packing,
        op7_order_minhash,
        op8_hyperminhash_near_dedup,
        op9_unigram_pieces,
        op10_weakly_supervised_toxicity,
    )
}
ORACLES: dict[str, str] = {"op1_count_min_substring_dedup": OP1_SQL, "op8_hyperminhash_near_dedup": OP8_SQL}
