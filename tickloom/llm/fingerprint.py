"""Document fingerprints by Order MinHash, in array expressions only.

The symbols are words (runs of non-space characters), the k-mers are runs of ``k`` words.
Every k-mer carries its occurrence number within the text, so repeats count. A k-mer's draw is
a hash of the k-mer and its occurrence number; the draw's leading bits deal it to
``2 ** entry_bits`` equal ranges. In each range the ``order`` smallest draws are kept, put back
into text order, and their k-mers, without the numbers, hashed as a tuple, which is the
signature's entry for that range. Moving a passage changes tuples
even where the set of words stays, which is what makes the signature follow edit distance
rather than set overlap.

A signature is the array of the entries that exist, each a long of range and tuple hash.
Likeness of two signatures: entries equal over ranges with an entry in at least one of them;
1 if both are empty.

Everything is linear in the text but two sorts of a primitive array, by k-mer and by draw: hash
and position are packed into one long (38 and 24 bits; a text of over 16 million words reuses
positions, and with them the k-mers looked up by position).

Defined results: null and empty texts, and texts of space only, have no k-mers and the
empty signature; a text of fewer than ``k`` words is one k-mer; equal texts have equal
signatures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSITION_BITS = 24
HASH_BITS = 38
PACKED_BITS = POSITION_BITS + HASH_BITS
POSITION_MASK = (1 << POSITION_BITS) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once: a lambda variable is bound, not inlined."""
    return F.transform(F.array(value), body)[0]


def _kmers(words: Column, k: int) -> Column:
    """The hashes of the k words from each position, in text order."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0)))
    return F.transform(
        starts, lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(words, i + j) for j in range(k)]), 64 - HASH_BITS)
    )


def _packed(hashed: Column, i: Column) -> Column:
    """A hash of ``HASH_BITS`` bits above a position, as a long that is not negative."""
    return F.shiftleft(hashed, POSITION_BITS).bitwiseOR(i.cast("long").bitwiseAND(F.lit(POSITION_MASK)))


def _draws(hashes: Column) -> Column:
    """Sorted longs: (leading bits of the hash of k-mer and occurrence number, position).

    Sorted by (hash, position), equal k-mers are neighbours in text order: the occurrence number
    is the place in the run that starts at ``heads``.
    """

    def numbered(a: Column) -> Column:
        def kmer(i: Column) -> Column:
            return F.shiftright(F.get(a, i), POSITION_BITS)

        def of_runs(heads: Column) -> Column:
            def run(head: Column, j: Column) -> Column:
                end = F.coalesce(F.get(heads, j + 1), F.size(a))
                # not F.slice, which copies the whole array each time
                return F.transform(F.sequence(F.lit(0), end - head - 1), lambda n: draw(F.get(a, head + n), n))

            return F.flatten(F.transform(heads, run))

        places = F.sequence(F.lit(0), F.size(a) - 1)
        return let(F.filter(places, lambda i: (i == 0) | (kmer(i) != kmer(F.greatest(i - 1, F.lit(0))))), of_runs)

    def draw(x: Column, occurrence: Column) -> Column:
        drawn = F.xxhash64(F.shiftright(x, POSITION_BITS), occurrence)
        return _packed(F.shiftrightunsigned(drawn, 64 - HASH_BITS), x)

    return F.sort_array(let(F.sort_array(F.transform(hashes, _packed)), numbered))


def _entries(hashes: Column, draws: Column, entry_bits: int, order: int) -> Column:
    """The signature, from k-mers in text order and their sorted draws, not empty."""
    tail = PACKED_BITS - entry_bits

    def same_range(x: Column, y: Column) -> Column:
        return F.shiftright(x.bitwiseXOR(y), tail) == 0

    def is_kept(x: Column, i: Column) -> Column:
        return (i < order) | ~same_range(x, F.get(draws, F.greatest(i - order, F.lit(0))))

    def tuple_of(kept: Column, i: Column) -> Column:
        """Of the range whose smallest draw is kept[i]: its members' k-mers in text order."""
        head = F.get(kept, i)
        mine = F.filter(F.slice(kept, i + 1, order), lambda y: same_range(head, y))
        places = F.sort_array(F.transform(mine, lambda y: y.bitwiseAND(F.lit(POSITION_MASK)).cast("int")))
        hashed = F.xxhash64(F.transform(places, lambda p: F.get(hashes, p)))
        return F.shiftleft(F.shiftright(head, tail), 64 - entry_bits - 1).bitwiseOR(
            F.shiftrightunsigned(hashed, entry_bits + 1)
        )

    def signature(kept: Column) -> Column:
        heads = F.filter(
            F.sequence(F.lit(0), F.size(kept) - 1),
            lambda i: (i == 0) | ~same_range(F.get(kept, i), F.get(kept, F.greatest(i - 1, F.lit(0)))),
        )
        return F.transform(heads, lambda i: tuple_of(kept, i))

    return let(F.filter(draws, is_kept), signature)


def order_minhash(text: Column, k: int = 2, entry_bits: int = 5, order: int = 2) -> Column:
    """The signature of a text: at most ``2 ** entry_bits`` longs."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return let(
        words,
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(
            let(_kmers(w, k), lambda h: let(_draws(h), lambda d: _entries(h, d, entry_bits, order)))
        ),
    )


def likeness(a: Column, b: Column, entry_bits: int = 5) -> Column:
    """Share of equal entries among the ranges that either signature has; 1 if neither has any."""

    def ranges(s: Column) -> Column:
        return F.transform(s, lambda x: F.shiftright(x, 64 - entry_bits - 1))

    either = F.size(F.array_union(ranges(a), ranges(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def as_hex(signature: Column) -> Column:
    return F.concat_ws("", F.transform(signature, lambda x: F.lpad(F.hex(x), 16, "0")))


MAX_CUTS = 512


def _range_of(key: Column, n_rows: int, cuts: list[int], rows_per_block: int) -> Column:
    """A struct that orders like the key: (quantile range, part of equal width inside it)."""
    parts = max(1, -(-n_rows // (rows_per_block * max(1, len(cuts) - 1))))
    edges = F.array(*[F.lit(c).cast("long") for c in cuts])

    def of(e: Column) -> Column:
        q = F.size(F.filter(e, lambda c: c <= key))
        low, high = F.get(e, q - 1).cast("double"), F.get(e, q).cast("double")
        part = F.floor((key.cast("double") - low) * parts / F.greatest(high - low, F.lit(1.0)))
        return F.struct(q.alias("q"), F.coalesce(F.least(part, F.lit(parts - 1)), F.lit(0)).cast("int").alias("part"))

    return let(edges, of)


def with_next(
    rows: DataFrame,
    key: str,
    value: str,
    derive: dict[str, Callable[[Column], Column]],
    rows_per_block: int = 2_000,
) -> DataFrame:
    """``rows[key, value]``, the columns ``derive`` makes of the value, and ``next_c`` for each of
    them: its value in the row that follows by descending key; the last row is followed by
    the first. Rows of equal key follow each other by value; null keys come last.

    A successor over the whole table without a global window or a global sort: at most
    ``MAX_CUTS`` quantiles of the key, each range divided further into parts of equal width,
    cut the table into blocks of about ``rows_per_block`` rows. Inside a block the successor
    is a window; the last row of a block takes the first row of the next block, from one
    row per block. The wide rows are shuffled once, by block.
    """
    rows = rows.select(key, value)
    n = rows.count()
    wanted = min(MAX_CUTS, max(1, -(-n // rows_per_block)))
    at = F.array(*[F.lit(i / wanted) for i in range(wanted + 1)])
    edges = sorted(set(rows.select(F.percentile_approx(key, at, F.lit(20 * MAX_CUTS))).first()[0] or []))
    if edges:
        block = _range_of(F.coalesce(F.col(key), F.lit(-(2**63))), n, edges, rows_per_block)
    else:
        block = F.struct(F.lit(0).alias("q"), F.lit(0).alias("part"))
    rows = rows.withColumn("_block", block)
    derived = {c: f(F.col(value)) for c, f in derive.items()}
    within = Window.partitionBy("_block").orderBy(F.col(key).desc_nulls_last(), value)
    cut = rows.withColumns(derived).withColumns(
        {f"_after_{c}": F.lead(c).over(within) for c in (value, *derive)}
    )
    heads = (
        rows.withColumn("_at", F.row_number().over(within))
        .filter("_at = 1")
        .select("_block", value)
        .withColumns(derived)
        .select("_block", *[F.col(c).alias(f"_head_{c}") for c in (value, *derive)])
    )
    # one narrow row per block: n / rows_per_block rows, the only global window
    descending = Window.orderBy(F.col("_block").desc())
    whole = descending.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chain = rows.select("_block").distinct()
    chain = chain.select(
        F.col("_block").alias("_before"),
        F.coalesce(F.lead("_block").over(descending), F.first("_block").over(whole)).alias("_block"),
    )
    firsts = chain.join(heads, "_block").drop("_block").withColumnRenamed("_before", "_block")
    return cut.join(firsts, "_block").select(
        key,
        value,
        *derive,
        *[F.coalesce(f"_after_{c}", f"_head_{c}").alias(f"next_{c}") for c in (value, *derive)],
    )


def fingerprint_edits(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    k: int = 2,
    entry_bits: int = 5,
    order: int = 2,
) -> DataFrame:
    """Per document: its signature, that of an edited text, and how alike signatures are.

    The edited text replaces the last third (rounded down) of the code points by as many
    from the start of the next document in descending key order, or all it has. Columns:
    key, n_chars, edited_text, signature, edited_signature, near_edited, near_next.

    A null text counts as empty. A single row is its own next one.
    """
    rows = documents.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    paired = with_next(rows, key, "_text", {"_sig": lambda t: order_minhash(t, k, entry_bits, order)})
    n_chars = F.length("_text")
    cut = F.floor(n_chars / 3).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n_chars - cut), F.substring("next__text", F.lit(1), cut))
    paired = paired.select(
        key, n_chars.cast("long").alias("n_chars"), edited.alias("edited_text"), "_sig", "next__sig"
    )
    return paired.withColumn(
        "_edited", order_minhash(F.col("edited_text"), k, entry_bits, order)
    ).select(
        key,
        "n_chars",
        "edited_text",
        F.col("_sig").alias("signature"),
        F.col("_edited").alias("edited_signature"),
        likeness(F.col("_sig"), F.col("_edited"), entry_bits).alias("near_edited"),
        likeness(F.col("_sig"), F.col("next__sig"), entry_bits).alias("near_next"),
    )
