"""Near-duplicate groups by HyperMinHash, confirmed on full shingle sets.

A document's set holds its distinct shingles of ``shingle`` lower-cased words (all its words
as one, if fewer; nothing, if none). Two documents are linked if
``100 * intersection >= percent * union``; a group is a connected component of links.

1. *Sketch.* Shingle hashes are dealt to ``REGISTERS`` buckets; a bucket keeps, of its least
   hash, the count of leading zeros and ``MANTISSA`` bits after the leading one (16 bits).
2. *Classes.* Documents with equal sets become one class, which goes on as one row.
3. *Bands* of ``ROWS`` registers. An empty register borrows the bands' value from the filled
   register that a fixed random order puts first, so short texts band as well as long ones.
   At the threshold a pair misses all bands with a probability of about 5e-11.
4. *Stars.* Instead of all pairs of a bucket, each member is compared with the bucket's hub,
   the member that shares most buckets with others (in a group of copies: the original).
   The collision-corrected estimate drops pairs more than six deviations below the
   threshold; the others are confirmed on their full sets.
5. *Rest.* In buckets that still hold several components, pairs of different components are
   estimated and confirmed in memory, in blocks of about ``BLOCK`` rows and ``BLOCK_SHINGLES``
   shingles; only a spanning forest of the links leaves a block. So every pair that shares a
   band is either inside one component, refuted, or confirmed, and no list of pairs arises.

Set and class hashes have 64 bits. Buckets are aggregated by partial aggregation and joined,
never collected; a bucket larger than a block is compared block by block.

Defined results: null or empty text, or no words: size 0, linked with nothing, its own
component; equal rows are one class; a group's least key is the least that is not null, so a null key
is kept only where no other key is in its group, and is its component then; all rows that hold the
least key are kept; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.components import components
from tickloom.llm.shared import bit_filter, checkpointed, has_bit, place_of, small_batches
from tickloom.llm.textkit import LOWER, Texts, map_arrow, mix, slices, window_hashes, word_hashes, words_of

REGISTER_BITS = 7
REGISTERS = 1 << REGISTER_BITS
MANTISSA = 10
ROWS = 4
BANDS = REGISTERS // ROWS
BLOCK = 2000
SLICE_TEXT = 1 << 19
BLOCK_SHINGLES = 4_000_000
#: chance that two independent registers agree: a mantissa cell is this share of its place
COLLISION = 1 / (8 * math.log(2))


def shingle_sets(texts: Texts, shingle: int) -> Iterator[np.ndarray]:
    """Per text: its distinct shingle hashes, sorted."""
    words = words_of(texts)
    hashes = word_hashes(texts.data, words, fold=LOWER)
    whole = window_hashes(hashes, shingle)
    for i in range(texts.n):
        first, last = int(words.at[i]), int(words.at[i + 1])
        n = last - first
        if n >= shingle:
            yield np.unique(whole[first : last - shingle + 1])
        elif n:
            yield mix(window_hashes(hashes[first:last], n) + np.uint64(n))
        else:
            yield hashes[:0]


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit hash of a set, whatever its order."""
    return int((mix(shingles + np.uint64(11)).sum() ^ (mix(shingles + np.uint64(23)).sum() >> np.uint64(1))).view(np.int64))


def leading_zeros(x: np.ndarray) -> np.ndarray:
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1]).astype(np.int64)


def registers_of(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (0: empty): leading zeros + 1 above ``MANTISSA`` bits, as uint16."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(shingles):
        return out
    bucket = (shingles >> np.uint64(64 - REGISTER_BITS)).astype(np.int64)  # sorted, as the hashes are
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    least = (shingles[first] << np.uint64(REGISTER_BITS)) | np.uint64((1 << REGISTER_BITS) - 1)
    zeros = leading_zeros(least)
    top = (63 - zeros).astype(np.uint64)
    mantissa = np.where(top >= MANTISSA, least >> (np.maximum(top, MANTISSA) - np.uint64(MANTISSA)), least)
    mantissa &= np.uint64((1 << MANTISSA) - 1)
    out[bucket[first]] = (((zeros + 1) << MANTISSA) | mantissa.astype(np.int64)).astype(np.uint16)
    return out


PREFERENCE = mix(np.arange(1, REGISTERS * REGISTERS + 1, dtype=np.uint64)).reshape(REGISTERS, REGISTERS)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One hash per band of the registers, with empty registers filled."""
    filled = registers != 0
    if not filled.all():
        chosen = np.flatnonzero(filled)
        empty = np.flatnonzero(~filled)
        registers = registers.copy()
        registers[empty] = registers[chosen[PREFERENCE[np.ix_(empty, chosen)].argmin(axis=1)]]
    rows = registers.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key + rows[:, r])
    return key


def estimate_passes(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """May pairs (rows of registers a and b, set sizes) reach the threshold?

    Equal registers, less those expected to agree by chance, against the registers filled in
    either; and the sizes must allow the threshold at all.
    """
    used = ((a != 0) | (b != 0)).sum(axis=-1)
    equal = ((a == b) & (a != 0)).sum(axis=-1)
    ratio = np.minimum(n_a, n_b) / np.maximum(np.maximum(n_a, n_b), 1)
    chance = COLLISION * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    corrected = (equal - used * chance) / (1 - chance)
    p = percent / 100
    return (corrected >= used * p - 6 * np.sqrt(used * p * (1 - p)) - 1) & (ratio * 100 >= percent)


def profiles(documents: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """Per row: key, n_shingles, class (hash of the set; null if empty), registers, bands."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", SLICE_TEXT):
            size, cls, regs, bands = [], [], [], []
            for s in shingle_sets(texts, shingle):
                size.append(len(s))
                if len(s):
                    r = registers_of(s)
                    cls.append(class_of(s))
                    regs.append(r.tobytes())
                    bands.append(band_keys(r).view(np.int64))
                else:
                    cls.append(None)
                    regs.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(cls, pa.int64()), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["key", "n", "class", "registers", "bands"],
            )

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = documents.schema[key].dataType.simpleString()
    return map_arrow(rows, work, f"key {kind}, n long, class long, registers binary, bands array<long>")


def sets_of(documents: DataFrame, classes: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(class, shingles) of the given classes, from the texts of their first documents.

    Which documents those are reaches the tasks as a bit filter, so no
    text is shuffled; what the filter lets through by mistake is dropped by later joins.
    """

    shared = bit_filter(classes.select(place_of(F.col("first")).alias("place")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.filter(pa.array(has_bit(shared.value, batch.column(0)))) if batch.num_rows else batch
            for _, texts in slices([wanted], "text", SLICE_TEXT):
                found = [s for s in shingle_sets(texts, shingle) if len(s)]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([class_of(s) for s in found], pa.int64()),
                            pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())),
                        ],
                        ["class", "shingles"],
                    )

    rows = documents.select(place_of(F.col(key)).alias("place"), F.col(text).alias("text"))
    return map_arrow(rows, work, "class long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    sets = sets.dropDuplicates(["class"])
    held = pairs.join(sets.withColumnsRenamed({"class": "a", "shingles": "set_a"}), "a").join(
        sets.withColumnsRenamed({"class": "b", "shingles": "set_b"}), "b"
    )
    both = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - F.col("both")
    return held.withColumn("both", both).filter(F.col("both") * 100 >= either * percent).select("a", "b")


def star_pairs(classes: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """Members of a bucket against its hub, as far as sizes and registers allow a link."""
    degrees = buckets.groupBy("class").agg(F.sum("members").alias("degree"))
    hubs = (
        buckets.join(degrees, "class")
        .groupBy("band")
        .agg(F.max_by("class", F.struct("degree", "class")).alias("hub"))
    )
    pairs = (
        buckets.join(hubs, "band")
        .filter("class <> hub")
        .select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b"))
        .distinct()
    )
    side = classes.select("class", "n", "registers")
    held = pairs.join(side.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a")), "a").join(
        side.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b")), "b"
    )
    held = held.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, n_a, n_b, r_a, r_b = batch.columns
                ok = estimate_passes(_matrix(r_a), _matrix(r_b), n_a.to_numpy(), n_b.to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok)), b.filter(pa.array(ok))], ["a", "b"])

    return map_arrow(held.select("a", "b", "n_a", "n_b", "r_a", "r_b"), work, "a long, b long")


def rest_links(
    documents: DataFrame, classes: DataFrame, buckets: DataFrame, labels: DataFrame, key: str, text: str, shingle: int, percent: int
) -> DataFrame:
    """Links between the components that still share a bucket, enough of them to join all that belong together.

    A bucket of two is its own star. Larger ones are cut into blocks by a hash; each pair of
    blocks is one group, compared in memory by registers and, where these allow a link, on full
    sets. A group returns a spanning forest of its links, so fewer rows than it has members. A
    pair is judged in the first bucket that it shares.
    """
    own = classes.select("class", "n", "registers", "bands").join(labels.select(F.col("v").alias("class"), "label"), "class", "left")
    own = own.withColumn("label", F.coalesce("label", "class"))
    members = buckets.filter("members > 2").select("band", "class").join(own.select("class", "label", "n"), "class")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    open_bands = (
        members.groupBy("band")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), blocks.alias("blocks"))
        .filter("low < high")
        .select("band", "blocks")
    )
    held = checkpointed(members.select("band", "class").join(open_bands, "band"))
    wanted = classes.select("class", "first").join(held.select("class").distinct(), "class", "left_semi")
    sets = sets_of(documents, wanted, key, text, shingle).dropDuplicates(["class"])
    dealt = (
        held.join(own.join(sets, "class"), "class")
        .withColumn("mine", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("mine", "other"))
        .withColumn("j", F.greatest("mine", "other"))
        .select("band", "i", "j", "mine", "class", "label", "n", "registers", "bands", "shingles")
    )

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("class")  # the forest must not depend on the order of arrival
        band, i, j = (table[c][0].as_py() for c in ("band", "i", "j"))
        mine, cls, label, n = (table[c].to_numpy().copy() for c in ("mine", "class", "label", "n"))
        regs = _matrix(table["registers"])
        bands = _flat(table["bands"])[0].reshape(-1, BANDS)
        place = int(np.flatnonzero(bands[0] == band)[0])
        values, ends = _flat(table["shingles"])
        code = np.unique(values, return_inverse=True)[1]
        start, marked = ends - n, np.zeros(len(values), bool)
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        a, b = [], []
        for x in left:
            at = right[(label[right] != label[x]) & ((cls[right] > cls[x]) | (i != j))]
            at = at[~(bands[at, :place] == bands[x, :place]).any(axis=1)]
            at = at[estimate_passes(regs[x], regs[at], n[x], n[at], percent)] if len(at) else at
            if not len(at):
                continue
            begins = np.concatenate(([0], np.cumsum(n[at])))[:-1]
            spots = np.arange(int(n[at].sum())) + np.repeat(start[at] - begins, n[at])
            marked[code[start[x] : ends[x]]] = True
            both = np.add.reduceat(marked[code[spots]], begins, dtype=np.int64)
            marked[code[start[x] : ends[x]]] = False
            linked = at[both * 100 >= (n[x] + n[at] - both) * percent]
            if len(linked):
                met, chosen = np.unique(label[linked], return_index=True)
                a.append(np.full(len(chosen), cls[x]))
                b.append(cls[linked[chosen]])
                label[np.isin(label, met)] = label[x]
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.groupBy("band", "i", "j").applyInArrow(work, "a long, b long").distinct()


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column without nulls, one list after the other, and where each list ends."""
    return lists.combine_chunks().flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(lists).to_numpy(), dtype=np.int64)


def _matrix(registers) -> np.ndarray:
    if isinstance(registers, pa.ChunkedArray):
        registers = registers.combine_chunks()
    return np.frombuffer(b"".join(registers.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def near_duplicates(
    documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """Per input row: the key, n_shingles, component_id (least key of its group), kept (is it that row's key?)."""
    with small_batches(documents.sparkSession):
        rows = checkpointed(profiles(documents, key, text, shingle))
        classes = checkpointed(
            rows.filter("class is not null")
            .groupBy("class")
            .agg(F.min("key").alias("first"), F.first("n").alias("n"), F.first("registers").alias("registers"), F.first("bands").alias("bands"))
        )
        bands = classes.select("class", F.explode("bands").alias("band"))
        shared = bands.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1")
        buckets = checkpointed(bands.join(shared, "band"))
        stars = checkpointed(star_pairs(classes, buckets, percent))

        def sets(pairs: DataFrame) -> DataFrame:
            ends = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
            return sets_of(documents, classes.select("class", "first").join(ends, "class", "left_semi"), key, text, shingle)

        links = checkpointed(confirmed(stars, sets(stars), percent))
        labels = components(links)
        more = checkpointed(rest_links(documents, classes, buckets, labels, key, text, shingle, percent))
        if not more.isEmpty():
            labels = components(links.union(more))
    group = classes.select("class", "first").join(labels.withColumnRenamed("v", "class"), "class", "left")
    group = group.withColumn("label", F.coalesce("label", "class"))
    least = group.groupBy("label").agg(F.min("first").alias("least"))
    group = group.join(least, "label").select("class", "least")
    return rows.join(group, "class", "left").select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.coalesce("least", "key").alias("component_id"),
        F.coalesce("least", "key").eqNullSafe(F.col("key")).alias("kept"),
    )
