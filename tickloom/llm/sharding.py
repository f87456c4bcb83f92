"""Shard assignment by a hierarchical weighted hash tree.

A topology has three levels: region, rack, shard. Every node weighs as much as the shards
below it. A row starts at the root and at each level draws one exponential variate per
child, ``-ln(u) / weight`` with ``u`` hashed from (key, path of the child); the smallest
draw wins. A draw depends on nothing but the key, the child's path and the child's weight,
so a change of weights moves rows only between the subtrees on the changed path.

``regular_topology`` puts the shards in order into racks of 2 and regions of 4 (both
parameters). ``grown`` adds a shard in a region of its own: the old paths keep their weights,
so the only rows that move are those that the new region wins, and each of them lands in the
new shard. From 8 shards that is the regular topology of 9.

The law is ``key``: the key and the topology decide; sizes and counts are even only in
expectation.

Defined results: a null key draws as its own value (all null keys share a shard); equal
keys share a shard; a null text has size 1 and the CRC of the empty string; an empty table
gives an empty result; input columns named like outputs are not read and do not clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


@dataclass(frozen=True)
class Topology:
    """Regions of racks of (shard number, weight)."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]


def regular_topology(n_shards: int, shards_per_rack: int = 2, racks_per_region: int = 2) -> Topology:
    if n_shards < 1:
        raise ValueError("a topology needs at least one shard")
    racks = [
        tuple((s, 1.0) for s in range(i, min(i + shards_per_rack, n_shards)))
        for i in range(0, n_shards, shards_per_rack)
    ]
    return Topology(tuple(tuple(racks[i : i + racks_per_region]) for i in range(0, len(racks), racks_per_region)))


def grown(topology: Topology, weight: float = 1.0) -> Topology:
    """``topology`` with one more shard, numbered next, which takes rows only into itself."""
    after = 1 + max(s for region in topology.regions for rack in region for s, _ in rack)
    return Topology((*topology.regions, (((after, weight),),)))


def uniform_hash(key: Column, path: str) -> Column:
    """A number in (0, 1) from the first 32 bits of md5(path ':' key)."""
    digest = F.md5(F.concat(F.lit(path + ":"), key))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(TWO_32)


def _winner(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the smallest weighted draw; ties go to the earlier child."""
    if len(children) == 1:
        return children[0][2]
    draws = [-F.ln(uniform_hash(key, path)) / F.lit(weight) for path, weight, _ in children]
    least = F.least(*draws)
    choice = children[-1][2]
    for draw, (_, _, value) in reversed(list(zip(draws[:-1], children[:-1], strict=True))):
        choice = F.when(draw == least, value).otherwise(choice)
    return choice


def tree_shard(key: Column, topology: Topology) -> Column:
    """The shard number (int) that ``key`` (string, not null) reaches in ``topology``.

    Only the children on the way down are drawn: the branches sit behind CASE WHEN.
    """

    def weight(node) -> float:
        return node[1] if isinstance(node[0], int) else sum(weight(child) for child in node)

    regions = []
    for r, region in enumerate(topology.regions):
        racks = []
        for k, rack in enumerate(region):
            leaves = [(f"r{r}/k{k}/s{s}", w, F.lit(s)) for s, w in rack]
            racks.append((f"r{r}/k{k}", weight(rack), _winner(key, leaves)))
        regions.append((f"r{r}", weight(region), _winner(key, racks)))
    return _winner(key, regions).cast("int")


def assign_shards(
    rows: DataFrame,
    n_shards: int = 8,
    key: str = "doc_id",
    text: str = "text",
    rows_per_block: int = 20_000,
) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    ``slot`` numbers the rows of a shard from 0 without gaps. A shard is an unbounded group,
    so the rows are numbered within (shard, block) and shifted by the sizes of the earlier
    blocks. A block is a hash of the key and the text's CRC; their number follows the row
    count, so that a block holds about ``rows_per_block`` rows. One key repeated over more
    rows than that stays in one block only if its texts are equal too.

    Two shuffles, both of narrow rows (the text is reduced to size and CRC before them): the
    window's, and the block sizes', which are pre-aggregated.
    """
    name = F.coalesce(rows[key].cast("string"), F.lit("\u0000null"))
    body = F.coalesce(rows[text], F.lit(""))
    blocks = max(1, -(-rows.count() // rows_per_block))
    placed = rows.select(
        rows[key].alias("_key"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        tree_shard(name, regular_topology(n_shards)).alias("shard"),
        tree_shard(name, grown(regular_topology(n_shards))).alias("grown_shard"),
    )
    block = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("_key").cast("string"), F.col("text_crc32"))), 1, 8), 16, 10)
    placed = placed.withColumn("_block", (block.cast("long") % blocks).cast("int"))
    sizes = placed.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_block").orderBy("_key", "text_crc32", "size")
    numbered = placed.withColumn("_at", F.row_number().over(inside).cast("long") - 1)
    return numbered.join(starts, ["shard", "_block"]).select(
        F.col("_key").alias(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("_before") + F.col("_at")).alias("slot"),
        "grown_shard",
    )
