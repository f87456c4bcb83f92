"""Order MinHash against brute force, and on texts that differ in order or counts only."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tickloom.llm import fingerprint


def passage(seed: int, n: int = 300) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(10000)}" for _ in range(n)]


def signatures(spark, texts: list[str]) -> list[list[int]]:
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["s"] for r in frame.select("i", fingerprint.order_minhash(F.col("text")).alias("s")).orderBy("i").collect()]


def likeness(spark, a: str, b: str) -> float:
    frame = spark.createDataFrame([(a, b)], "a string, b string")
    return frame.select(fingerprint.likeness(fingerprint.order_minhash(F.col("a")), fingerprint.order_minhash(F.col("b")))).first()[0]


def hashes(spark, rows: list[tuple], kinds: str, columns: list[str]) -> dict:
    found = spark.createDataFrame(rows, kinds).withColumn("h", F.xxhash64(*columns)).collect()
    return {tuple(r)[:-1]: r["h"] for r in found}


def brute_force(spark, texts: list[str], k: int = 2, ranges: int = 32, order: int = 2) -> list[list[int]]:
    top = 64 - fingerprint.HASH_BITS
    words = [t.split() for t in texts]
    kmers = [[tuple((w[i : i + k] + [None] * k)[:k]) for i in range(max(1, len(w) - k + 1))] if w else [] for w in words]
    whole = hashes(spark, sorted({x for m in kmers for x in m}, key=str), "a string, b string", ["a", "b"])
    code = {x: (h % 2**64) >> top for x, h in whole.items()}
    numbered = []
    for m in kmers:
        seen = Counter()
        numbered.append([])
        for x in m:
            numbered[-1].append((code[x], seen[x]))
            seen[x] += 1
    drawn = hashes(spark, sorted({x for m in numbered for x in m}), "a long, b int", ["a", "b"])
    tuples = []
    for m in numbered:
        dealt = {}
        for place, x in enumerate(m):
            draw = (drawn[x] % 2**64) >> top
            dealt.setdefault(draw * ranges >> fingerprint.HASH_BITS, []).append((draw, place, x[0]))
        tuples.append({r: tuple(c for _, c in sorted((p, c) for _, p, c in sorted(d)[:order])) for r, d in dealt.items()})
    rows = [(list(t),) for t in sorted({t for m in tuples for t in m.values()})]
    of = {tuple(r["a"]): r["h"] % 2**64 for r in spark.createDataFrame(rows, "a array<long>").withColumn("h", F.xxhash64("a")).collect()}
    return [[(r << 58) | (of[t] >> 6) for r, t in sorted(m.items())] for m in tuples]


def test_signatures_equal_brute_force(spark):
    p, q = passage(1, 60), passage(2, 40)
    r = random.Random(9)
    texts = [p + q, p * 5 + q, q * 3, ["same"] * 200, ["one"], ["a", "b"], [], r.choices("abcd", k=400), r.choices(p, k=500)]
    texts = [" ".join(t) for t in texts]
    assert signatures(spark, texts) == brute_force(spark, texts)


def test_repeats_and_their_order_count(spark):
    p, q = " ".join(passage(3)), " ".join(passage(4))
    assert likeness(spark, f"{p} {p} {q} {q}", f"{q} {q} {p} {p}") < 0.8
    assert likeness(spark, f"{p} {p}", " ".join([p] * 10)) < 0.3
    assert likeness(spark, f"{p} {p}", f"{p} {p}") == 1.0
