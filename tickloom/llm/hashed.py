"""Hashed sparse text features, labelled samples and follow-the-regularised-leader training.

Features of a text are slots of a table of 2^``BITS`` weights: words, word pairs, word shapes
(letters, digits and runs of one symbol collapsed), shape pairs and word beginnings. A text's
features are computed from its whole bytes, one slice of a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import tidy
from tickloom.llm.textkit import LOWER, Texts, Words, map_arrow, mix, slices, window_hashes, word_hashes, words_of

BITS = 22
SLOTS = 1 << BITS
STEM, LONG_STEM = 5, 7

#: letters to one class, digits to another, symbols as they are
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[[*range(97, 123), *range(128, 256)]] = ord("a")
SHAPE[65:91] = ord("A")
SHAPE[48:58] = ord("9")

#: bytes that are in no word of letters: all of ASCII but its letters
NO_LETTER = np.zeros(256, dtype=bool)
NO_LETTER[:128] = True
NO_LETTER[[*range(65, 91), *range(97, 123)]] = False

REPEAT = np.uint64(0x5851F42D4C957F2D)


def _pairs(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the neighbouring pairs that lie inside one text."""
    pair = window_hashes(hashes, 2)
    inside = np.ones(len(pair), bool)
    cut = at[1:-1] - 1
    inside[cut[(cut >= 0) & (cut < len(pair))]] = False
    place = np.flatnonzero(inside)
    return pair[place], place


def shapes_of(texts: Texts) -> Texts:
    folded = SHAPE[texts.data]
    keep = np.ones(len(folded), bool)
    keep[1:] = folded[1:] != folded[:-1]
    keep[texts.bounds[(texts.bounds > 0) & (texts.bounds < len(folded))]] = True
    total = np.concatenate(([0], np.cumsum(keep)))
    return Texts(folded[keep], total[texts.bounds])


def features(texts: Texts, kinds: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot, count), each (text, slot) once and in order.

    ``kinds``: w words, p word pairs and repeats of the word before, s shapes, q shape pairs,
    b beginnings of ``STEM`` bytes, l runs of letters, m their beginnings of ``LONG_STEM`` bytes.
    """
    words = words_of(texts) if set(kinds) & set("wpb") else None
    row = np.repeat(np.arange(texts.n), np.diff(words.at)) if words else None
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if set(kinds) & set("wp"):
        plain = word_hashes(texts.data, words, fold=LOWER)
        if "w" in kinds:
            found.append((row, plain + np.uint64(1)))
        if "p" in kinds:
            pair, place = _pairs(plain, words.at)
            same = plain[place] == plain[place + 1] if len(place) else np.zeros(0, bool)
            found.append((row[place], np.where(same, REPEAT, pair) + np.uint64(2)))
    if "b" in kinds:
        stems = Words(words.start, np.minimum(words.end, words.start + STEM), words.at)
        found.append((row, word_hashes(texts.data, stems, fold=LOWER) + np.uint64(3)))
    if set(kinds) & set("lm"):
        letters = words_of(texts, NO_LETTER)
        at = np.repeat(np.arange(texts.n), np.diff(letters.at))
        if "l" in kinds:
            found.append((at, word_hashes(texts.data, letters, fold=LOWER) + np.uint64(6)))
        if "m" in kinds:
            stems = Words(letters.start, np.minimum(letters.end, letters.start + LONG_STEM), letters.at)
            found.append((at, word_hashes(texts.data, stems, fold=LOWER) + np.uint64(7)))
    if set(kinds) & set("sq"):
        small = shapes_of(texts)
        parts = words_of(small)
        shape = word_hashes(small.data, parts)
        at = np.repeat(np.arange(small.n), np.diff(parts.at))
        if "s" in kinds:
            found.append((at, shape + np.uint64(4)))
        if "q" in kinds:
            pair, place = _pairs(shape, parts.at)
            found.append((at[place], pair + np.uint64(5)))
    rows = np.concatenate([a for a, _ in found]).astype(np.uint64)
    slot = mix(np.concatenate([b for _, b in found])) >> np.uint64(64 - BITS)
    both, count = np.unique((rows << np.uint64(BITS)) | slot, return_counts=True)
    return (both >> np.uint64(BITS)).astype(np.int64), (both & np.uint64(SLOTS - 1)).astype(np.int64), count


def values(row: np.ndarray, count: np.ndarray, n: int, scaled: bool) -> np.ndarray:
    """Each feature's value: 1, or log counts scaled to length 1 per text."""
    if not scaled:
        return np.ones(len(row))
    x = np.log1p(count)
    return x / np.sqrt(np.maximum(np.bincount(row, x * x, n), 1e-12))[row]


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def ftrl(
    examples: list[tuple[np.ndarray, np.ndarray, float, float]], epochs: int, alpha: float, l1: float, l2: float = 0.1, seed: int = 7
) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic regression by per-coordinate FTRL-proximal updates.

    An example is (slots, values, label from 0 to 1, weight). Slot ``SLOTS`` is the bias.
    """
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    order = np.random.default_rng(seed)

    def solve(slots):
        part, seen = z[slots], n[slots]
        strength = np.where(slots == SLOTS, 0.0, l1)
        return np.where(
            np.abs(part) <= strength, 0.0, -(part - np.sign(part) * strength) / ((1 + np.sqrt(seen)) / alpha + l2)
        )

    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            slots, x, label, weight = examples[k]
            slots, x = np.append(slots, SLOTS), np.append(x, 1.0)
            w = solve(slots)
            gradient = (sigmoid(w @ x) - label) * weight * x
            step = (np.sqrt(n[slots] + gradient**2) - np.sqrt(n[slots])) / alpha
            z[slots] += gradient - step * w
            n[slots] += gradient**2
    w = np.zeros(SLOTS + 1)
    for at in range(0, SLOTS + 1, 1 << 16):  # small temporaries
        w[at : at + (1 << 16)] = solve(np.arange(at, min(at + (1 << 16), SLOTS + 1)))
    return w[:-1], float(w[-1])


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether the key's CRC-32 leaves ``part`` modulo ``parts``; a null key does not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


#: of the sampled texts, what is learned from at most; features take several times as much
MOST_BYTES = 48 << 20


def labelled(documents: DataFrame, labels: DataFrame, target: str, key: str, text: str, use: Column, most: int) -> DataFrame:
    """(text, label) of about ``most`` labelled documents: a sample by a hash of the key.

    ``use`` says which labelled keys may be learned from. A key labelled twice has its larger
    label; null labels and keys are passed over; rows equal in key and text count once. Where
    the sampled texts have more than ``MOST_BYTES``, a smaller sample of them is taken, by a
    hash of the text. The sampled labels, about ``most`` of them, are broadcast.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(target).isNotNull() & use).groupBy(key).agg(F.max(target).alias("label"))
    total = known.count()
    share = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20)) < F.lit(min(1 << 20, (most << 20) // max(total, 1)))
    chosen = known.filter(share).select(F.col(key).alias("_key"), "label")
    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(chosen), "_key")
    rows = rows.dropDuplicates(["_key", "text"])
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_BYTES:
        rows = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit((MOST_BYTES << 20) // size))
    return rows.select("text", "label")


def sampled_features(sample: DataFrame, kinds: str) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(slots, counts, label) of a bounded sample's rows, found by the executors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            row, slot, count = features(texts, kinds)
            at = np.searchsorted(row, np.arange(texts.n + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([slot[a:b].astype("<i4").tobytes() for a, b in zip(at, at[1:])], pa.binary()),
                    pa.array([count[a:b].astype("<i4").tobytes() for a, b in zip(at, at[1:])], pa.binary()),
                    batch.column(batch.schema.get_field_index("label")).cast(pa.float64()),
                ],
                ["slots", "counts", "label"],
            )

    got = map_arrow(sample, work, "slots binary, counts binary, label double").toArrow().to_pylist()
    got.sort(key=lambda r: (r["slots"], r["counts"], r["label"]))  # the same model however rows arrive
    return [(np.frombuffer(r["slots"], "<i4").astype(np.int64), np.frombuffer(r["counts"], "<i4"), r["label"]) for r in got]


def scored(documents: DataFrame, weights: np.ndarray, bias: float, kinds: str, scaled: bool, text: str = "text") -> DataFrame:
    """``documents`` with ``score``: sigmoid of the sparse dot product of a text and the weights.

    The weights (2^22 floats, 16 MB) are broadcast. Other columns pass through untouched.
    """
    held = documents.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))
    tidy(documents.sparkSession)  # the sample and what was learned from it are large

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = held.value
        for batch, texts in slices(batches, text):
            row, slot, count = features(texts, kinds)
            z = np.bincount(row, w[slot] * values(row, count, texts.n, scaled), texts.n) + b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(z))], [*batch.schema.names, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return map_arrow(documents, work, StructType([*documents.schema.fields, StructField("score", DoubleType())]))
