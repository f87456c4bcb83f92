"""Exact removal of repeated word windows, behind a count-min prefilter.

A window is ``size`` consecutive words of one text. A word goes if a window covering it also
starts in a row with a smaller key; windows are judged on the input.

1. Sketch. Every window is counted in a count-min sketch. ``ANCHOR_ROWS`` of its rows are addressed
   by the window's *anchor*, the least hash among its shorter windows of ``ANCHOR`` words, counted
   once for each run of neighbours that share it; the other ``WINDOW_ROWS`` are addressed by
   the window itself. Each task counts its texts, a part of ``CHUNK`` windows at a time, and
   sends the cells as sorted differences; the partial sketches are added cell by cell, up to 2,
   which is all that is asked of them. The least cell of a window is never below the number
   of rows that hold it.
2. Only windows estimated to be repeated go on, written as runs: neighbours in one text that
   share their anchor. Runs of equal content are grouped first, which settles nearly all:
   all rows but the first lose the whole run. Where an anchor has runs of different content,
   the windows of one row per content are hashed again and grouped exactly.
3. Texts that lose nothing never move. The others, chosen by a bit filter, are shuffled once
   to meet the list of their removed runs.

Windows are compared by 128 bits: the anchor's hash and the window's.

Scale. What is broadcast is bounded: the sketch's width follows the number of windows up to
``MAX_CELLS`` a row (80 MB of bits in all) and a filter has 8 MB. From some gigabytes of text on
a window cell, and 18 times later an anchor cell, is shared with others, so more windows go
on than need to and none is lost; with a full sketch all runs are grouped, about 40 bytes for
18 words. All groupings are partial aggregations, so a passage that many rows share is one
row per task; the joins back to the rows have no group to collect and adaptive execution
splits a hot key. Between the steps, tables are written to the shared folder and deleted when
used up; what a lost executor held is computed again from them.

Defined results: null and empty texts have no words; a text of fewer than ``size`` words
loses nothing; repetition inside one row, or between rows of one key, removes nothing; a null
key is larger than every other key, and null keys are one key; repeated rows are each judged
alike; an empty table gives an empty result; extra columns are not read, or carried along as
they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import FILTER_BITS, Scratch, bit_filter, has_bit, mapped, place_of, sieved, small_batches
from tickloom.llm.textkit import map_arrow, mix, sliding_min, slices, window_hashes, word_hashes, words_of

ANCHOR = 16
LONGEST_RUN = 32
#: rows of the sketch that anchors and that windows address
ANCHOR_ROWS, WINDOW_ROWS = 2, 2
ROWS = ANCHOR_ROWS + WINDOW_ROWS
CHUNK = 1 << 21
SLICE_CELLS = 1 << 20
SLICE_TEXT = 1 << 19
MIN_CELLS, MAX_CELLS = 1 << 23, 1 << 28
BYTES_PER_WINDOW = 7
LAST_KEY = 2**63 - 1


def windows_of(texts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of some texts, in order: (text index, place in the text, window hash, anchor)."""
    words = words_of(texts)
    hashes = word_hashes(texts.data, words)
    window = window_hashes(hashes, size)
    short = min(ANCHOR, size)
    anchor = sliding_min(window_hashes(hashes, short), size - short + 1)
    n = np.maximum(np.diff(words.at) - size + 1, 0)
    text = np.repeat(np.arange(texts.n), n)
    place = np.arange(len(text), dtype=np.int64) - np.concatenate(([0], np.cumsum(n)))[:-1][text]
    at = words.at[:-1][text] + place
    return text, place, window[at], anchor[at]


def runs_of(text: np.ndarray, place: np.ndarray, window: np.ndarray, anchor: np.ndarray):
    """(head, length, run hash): runs of neighbouring windows with one anchor, ``LONGEST_RUN`` at most."""
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), window
    begins = np.ones(len(text), dtype=bool)
    begins[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(begins)
    since = np.arange(len(text)) - np.repeat(head, np.diff(np.append(head, len(text))))
    head = np.flatnonzero(since % LONGEST_RUN == 0)
    length = np.diff(np.append(head, len(text)))
    nth = (np.arange(len(text)) - np.repeat(head, length)).astype(np.uint64)
    return head, length, mix(np.add.reduceat(mix(window + nth), head) + length.astype(np.uint64))


def _row_width(row: int, width: int) -> int:
    """Anchors are a fraction of the windows: their rows have a quarter of the cells."""
    return width // 4 if row < ANCHOR_ROWS else width


def _first_part(row: int, width: int) -> int:
    """The number of the first part, of ``SLICE_CELLS`` cells, of a row; ``ROWS`` gives their count."""
    return sum(_row_width(r, width) for r in range(row)) // SLICE_CELLS


def _cells(values: np.ndarray, row: int, width: int) -> np.ndarray:
    """The cells of a sketch row that is addressed by these hashes, as uint32."""
    mask = np.uint64(_row_width(row, width) - 1)
    out = np.empty(len(values), np.uint32)
    for at in range(0, len(values), 1 << 17):  # small temporaries
        out[at : at + (1 << 17)] = mix(values[at : at + (1 << 17)] + np.uint64(2 * row + 1)) & mask
    return out


def sketch_width(total_bytes: int) -> int:
    wanted = 3 * total_bytes // BYTES_PER_WINDOW
    return min(max(1 << max(wanted - 1, 1).bit_length(), MIN_CELLS), MAX_CELLS)


def packed_steps(values: np.ndarray) -> bytes:
    """Increasing numbers as bytes: each difference as a run of 255s and its remainder."""
    steps = np.diff(values, prepend=0)
    ends = np.cumsum(steps // 255 + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 255, np.uint8)
    out[ends] = steps % 255
    return out.tobytes()


def unpacked_steps(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(raw, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def repeated_cells(documents: DataFrame, text: str, size: int, width: int) -> np.ndarray:
    """The merged sketch as a bitmap: a bit per cell, set if its count is 2 or more.

    The first ``ANCHOR_ROWS`` rows count the runs of each anchor, the others count windows.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for _, texts in slices(batches, "text", SLICE_TEXT):
            where, place, window, anchor = windows_of(texts, size)
            if len(where):
                first = np.ones(len(where), bool)
                first[1:] = (anchor[1:] != anchor[:-1]) | (where[1:] != where[:-1])
                held.append((anchor[first], window))
                waiting += len(window)
            if waiting >= CHUNK:
                yield from counted(held)
                held, waiting = [], 0
        if held:
            yield from counted(held)

    def counted(held) -> Iterator[pa.RecordBatch]:
        for row in range(ROWS):
            cells = np.concatenate([_cells(pair[row >= ANCHOR_ROWS], row, width) for pair in held])
            cells.sort()
            again = np.zeros(len(cells), bool)
            again[1:] = cells[1:] == cells[:-1]
            once, twice = cells[~again], np.unique(cells[again])
            edge = np.arange(0, _row_width(row, width) + 1, SLICE_CELLS)
            once_at, twice_at = np.searchsorted(once, edge), np.searchsorted(twice, edge)
            found = np.flatnonzero(np.diff(once_at))

            def local(x: np.ndarray) -> bytes:
                return packed_steps((x & np.uint32(SLICE_CELLS - 1)).astype(np.int64))

            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found + _first_part(row, width)),
                    pa.array([local(once[once_at[p] : once_at[p + 1]]) for p in found], pa.binary()),
                    pa.array([local(twice[twice_at[p] : twice_at[p + 1]]) for p in found], pa.binary()),
                ],
                ["part", "once", "twice"],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                seen = counts.setdefault(part, np.zeros(SLICE_CELLS, np.uint8))
                for raw in (once, twice):
                    cell = unpacked_steps(raw)
                    seen[cell] = np.minimum(seen[cell] + 1, 2)
        for part, seen in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([np.packbits(seen > 1).tobytes()], pa.binary())], ["part", "bits"]
            )

    sketches = map_arrow(documents.select(F.col(text).alias("text")), partial, "part long, once binary, twice binary")
    n_parts = _first_part(ROWS, width)
    merged = map_arrow(sketches.repartition(min(n_parts, 256), "part"), merge, "part long, bits binary")
    bitmap = np.zeros(n_parts * SLICE_CELLS // 8, np.uint8)
    found = merged.toArrow()  # 2.5 * MAX_CELLS bits at most, 80 MB
    for part, bits in zip(found["part"], found["bits"]):
        at = part.as_py() * SLICE_CELLS // 8
        bitmap[at : at + SLICE_CELLS // 8] = np.frombuffer(bits.as_buffer(), np.uint8)
    return bitmap


def _is_repeated(bitmap: bytes | np.ndarray, window: np.ndarray, anchor: np.ndarray, width: int) -> np.ndarray:
    """Of each window: is its estimate 2 or more?"""
    bits = np.frombuffer(bitmap, np.uint8)
    alive = np.arange(len(window))
    for row in range(ROWS):
        cell = _cells((window if row >= ANCHOR_ROWS else anchor)[alive], row, width)
        spot = (cell >> np.uint32(3)).astype(np.int64) + _first_part(row, width) * (SLICE_CELLS // 8)
        alive = alive[((bits[spot] >> (np.uint8(7) - (cell & np.uint32(7)).astype(np.uint8))) & 1).astype(bool)]
    kept = np.zeros(len(window), bool)
    kept[alive] = True
    return kept


def _anchor_place(anchor: np.ndarray) -> pa.Array:
    return pa.array((anchor & np.uint64(FILTER_BITS - 1)).astype(np.int64) + 1)


def candidate_runs(rows: DataFrame, size: int, width: int, bitmap) -> DataFrame:
    """The runs of windows that are estimated to be repeated. ``rows``: key, tag, text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = mapped(bitmap)
        for part, texts in slices(batches, "text", SLICE_TEXT):
            text, place, window, anchor = windows_of(texts, size)
            kept = _is_repeated(repeated, window, anchor, width)
            text, place, window, anchor = text[kept], place[kept], window[kept], anchor[kept]
            head, length, run = runs_of(text, place, window, anchor)
            if len(head):
                at = pa.array(text[head])
                found = [place[head].astype(np.int32), length.astype(np.int32), anchor[head].view(np.int64), run.view(np.int64)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *map(pa.array, found)], names)

    kind = rows.schema["key"].dataType.simpleString()
    names = ["key", "tag", "at", "n", "anchor", "run"]
    return map_arrow(rows, work, f"key {kind}, tag long, at int, n int, anchor long, run long")


def windows_of_runs(rows: DataFrame, size: int, width: int, bitmap, keys, anchors) -> DataFrame:
    """(key, anchor, run, windows) of the candidate runs that pass two bit filters, of keys and of
    anchors. ``rows``: key, text, place of the key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = mapped(bitmap)
        for batch in batches:
            wanted = batch.filter(pa.array(has_bit(keys.value, batch.column(2)))) if batch.num_rows else batch
            for part, texts in slices([wanted], "text", SLICE_TEXT):
                text, place, window, anchor = windows_of(texts, size)
                kept = _is_repeated(repeated, window, anchor, width)
                text, place, window, anchor = text[kept], place[kept], window[kept], anchor[kept]
                head, length, run = runs_of(text, place, window, anchor)
                if not len(head):
                    continue
                ends = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(window.view(np.int64)))
                found = [pa.array(anchor[head].view(np.int64)), pa.array(run.view(np.int64)), lists]
                whole = pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text[head])), *found], names)
                yield whole.filter(pa.array(has_bit(anchors.value, _anchor_place(anchor[head]))))

    kind = rows.schema["key"].dataType.simpleString()
    names = ["key", "anchor", "run", "windows"]
    return map_arrow(rows, work, f"key {kind}, anchor long, run long, windows array<long>")


def removed_runs(rows: DataFrame, runs: DataFrame, size: int, width: int, bitmap, scratch: Scratch) -> DataFrame:
    """(key, tag, at, mask): bit i of mask is set if window ``at + i`` also starts under a smaller key."""
    contents = scratch.write(
        runs.groupBy("anchor", "run").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.first("n").alias("n")),
        "contents",
    )
    # anchors with runs of different content, under different keys: single windows decide
    mixed = contents.groupBy("anchor").agg(F.min("first_key").alias("low"), F.max("first_key").alias("high"), F.count("*").alias("n"))
    mixed = mixed.filter("n > 1 and low < high").select("anchor")
    unclear = scratch.write(contents.join(mixed, "anchor", "left_semi").select("anchor", "run", "first_key"), "unclear")
    keys = bit_filter(unclear.select(place_of(F.col("first_key")).alias("place")))
    anchors = bit_filter(unclear.select((F.pmod("anchor", F.lit(FILTER_BITS)) + 1).alias("place")))
    known = windows_of_runs(rows.select("key", "text", place_of(F.col("key")).alias("place")), size, width, bitmap, keys, anchors)
    # what the filters let through besides is true as well, and drops out at the join with the verdicts
    single = scratch.write(known.select("key", "anchor", "run", F.posexplode("windows").alias("place", "window")), "single")
    # written, like the verdicts: a join of two tables is one that adaptive execution can split at a hot key
    least = scratch.write(single.groupBy("anchor", "window").agg(F.min("key").alias("least")), "least")
    masks = (
        single.join(least, ["anchor", "window"])
        .groupBy("anchor", "run", "place")
        .agg(F.min("key").alias("own"), F.min("least").alias("least"))
        .filter("least < own")
        .groupBy("anchor", "run")
        .agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"))
    )
    verdicts = contents.join(masks, ["anchor", "run"], "left").filter("last_key > first_key or mask is not null")
    verdicts = scratch.write(verdicts.select("anchor", "run", "first_key", "mask"), "verdicts")
    whole = F.expr("shiftleft(1L, n) - 1")
    return (
        runs.join(verdicts, ["anchor", "run"])
        .select("key", "tag", "at", F.when(F.col("key") > F.col("first_key"), whole).otherwise(F.col("mask")).alias("mask"))
        .filter("mask is not null")
    )


def remove_repeats(
    documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = 50, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Per input row: the key, n_words, n_removed, kept (the kept words joined by one space) and
    ``row``, a struct of the columns that ``carry`` names, if any. The key is a whole number, or
    a struct that is never null."""
    kind = documents.schema[key].dataType.simpleString()
    held = [F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry) if c != text]
    names = ["text" if c == text else f"_carry{i}" for i, c in enumerate(carry)]
    order = F.col(key) if kind.startswith("struct") else F.coalesce(F.col(key).cast("long"), F.lit(LAST_KEY))
    rows = documents.select(order.alias("key"), F.col(key).alias("_key"), F.col(text).alias("text"), *held)
    rows = rows.withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = sketch_width(total)
    spark = documents.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    with small_batches(spark):
        # as bytes, which the workers of an executor map from one file
        bitmap = spark.sparkContext.broadcast(repeated_cells(rows, "text", size, width).tobytes())
        runs = scratch.write(candidate_runs(rows.select("key", "tag", "text"), size, width, bitmap), "runs")
        gone = removed_runs(rows, runs, size, width, bitmap, scratch)
        lists = gone.groupBy("key", "tag").agg(F.collect_set(F.struct("at", "mask")).alias("gone"))
        lists = scratch.write(lists.select("key", "tag", F.col("gone.at").alias("at"), F.col("gone.mask").alias("mask")), "lists")
    scratch.drop("runs", "contents", "unclear", "single", "least", "verdicts")
    bitmap.destroy()
    touched = bit_filter(lists.select(place_of(F.col("key"), F.col("tag")).alias("place")))
    place = place_of(F.col("key"), F.col("tag"))
    none = F.lit(None).cast("array<int>").alias("at"), F.lit(None).cast("array<long>").alias("mask")
    whole = rows.select("*", *none, place.alias("place"))
    cut = sieved(rows, place, touched, True).join(lists, ["key", "tag"], "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            n_words = np.zeros(texts.n, np.int64)
            n_removed = np.zeros(texts.n, np.int64)
            kept = []
            for i, (at, mask) in enumerate(zip(batch.column(1), batch.column(2))):
                split = texts.one(i).split()
                n_words[i] = len(split)
                if at.is_valid and len(at):
                    covered = _covered(at.values.to_numpy(), mask.values.to_numpy(), len(split), size)
                    n_removed[i] = int(covered.sum())
                    split = [w for w, gone in zip(split, covered.tolist()) if not gone]
                kept.append(b" ".join(split).decode("utf-8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_removed), pa.array(kept, pa.string()), *[batch.column(n) for n in names]],
                [key, "n_words", "n_removed", "kept", *[f"_carry{i}" for i in range(len(names))]],
            )

    def of_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the filter is part of the map, not one before it, which would take another worker per task
        for batch in batches:
            if batch.num_rows:
                yield from work([batch.filter(pa.array(~has_bit(touched.value, batch.column(batch.num_columns - 1))))])

    kinds = [f"_carry{i} {documents.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)]
    schema = ", ".join([f"`{key}` {kind}, n_words long, n_removed long, kept string", *kinds])
    wanted = ["_key", "at", "mask", "text", *[n for n in names if n != "text"]]
    out = map_arrow(whole.select(*wanted, "place"), of_whole, schema).unionByName(map_arrow(cut.select(*wanted), work, schema))
    if not carry:
        return out
    row = F.struct(*[F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)])
    return out.select(key, "n_words", "n_removed", "kept", row.alias("row"))


def _covered(at: np.ndarray, mask: np.ndarray, n_words: int, size: int) -> np.ndarray:
    """Of each word: is it in a window that goes? A count of open windows, as a running sum."""
    bits = np.arange(LONGEST_RUN, dtype=np.int64)
    run, bit = np.nonzero((mask[:, None] >> bits) & 1)
    begins = np.bincount(at[run] + bits[bit], minlength=n_words + 1)[: n_words + 1]
    opened = np.cumsum(begins)
    opened[size:] -= opened[:-size].copy() if len(opened) > size else 0
    return opened[:n_words] > 0
