"""Shards against plain loops over the same draws, and the law of growth."""

import hashlib
import math
import zlib

import pytest

from tickloom.llm import sharding


def draw(path: str, key: str) -> float:
    return (int(hashlib.md5(f"{path}:{key}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def descend(key: str, topology: sharding.Topology) -> int:
    def weight(node):
        return node[1] if isinstance(node[0], int) else sum(map(weight, node))

    def best(children):
        return min(children, key=lambda c: -math.log(draw(c[0], key)) / c[1])[2]

    r, region = best([(f"r{r}", weight(x), (r, x)) for r, x in enumerate(topology.regions)])
    k, rack = best([(f"r{r}/k{k}", weight(x), (k, x)) for k, x in enumerate(region)])
    return best([(f"r{r}/k{k}/s{s}", w, s) for s, w in rack])


def rows(spark):
    made = [(k, f"text {k} é") for k in range(400)] + [(None, None), (None, "x"), (7, "other"), (7, "other"), (900, ""), (901, "long " * 60_000)]
    return spark.createDataFrame([(k, t, "a", "b") for k, t in made], "doc_id long, text string, shard string, size string")


@pytest.mark.parametrize("n", [1, 3, 8])
def test_shards_equal_plain_loops(spark, n):
    out = sharding.assign_shards(rows(spark), n_shards=n, rows_per_block=50).collect()
    old = sharding.regular_topology(n)
    new = sharding.grown(old)
    assert len(out) == 406
    for r in out:
        key = "\0null" if r["doc_id"] is None else str(r["doc_id"])
        assert (r["shard"], r["grown_shard"]) == (descend(key, old), descend(key, new)) and r["law"] == "key"
    want = sorted((k is None, k or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, _, _ in rows(spark).collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in out) == want
    for s in range(n):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))


@pytest.mark.parametrize("n", range(1, 13))
def test_one_more_shard_takes_rows_only_into_itself(n):
    old = sharding.regular_topology(n)
    new = sharding.grown(old)
    moved = [(descend(str(k), old), descend(str(k), new)) for k in range(600)]
    assert all(a == b or b == n for a, b in moved) and any(b == n for _, b in moved)


def test_the_ninth_shard_is_that_of_the_regular_topology():
    assert sharding.grown(sharding.regular_topology(8)) == sharding.regular_topology(9)


def test_heavier_shards_take_more():
    topology = sharding.Topology(((((0, 1.0), (1, 3.0)),), (((2, 4.0),),)))
    got = [descend(str(k), topology) for k in range(4000)]
    share = [got.count(s) / 4000 for s in range(3)]
    assert share == pytest.approx([1 / 8, 3 / 8, 1 / 2], abs=0.03)


def test_empty_table(spark):
    assert sharding.assign_shards(rows(spark).limit(0)).count() == 0
