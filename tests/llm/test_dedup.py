"""Near-duplicates, repeated passages and the pipeline's first stages against brute force."""

import random

import pytest

from tickloom.llm import near_dedup, substring_dedup


def texts():
    r = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    out = [r.choices(words, k=120) for _ in range(25)]
    out += [list(out[k]) for k in range(5)] + [out[k][:60] + ["edit"] + out[k][61:] for k in range(5, 10)]
    out += [r.choices(words, k=30) + out[11][10:80] + r.choices(words, k=30)]
    return [" ".join(x) for x in out] + ["", None, "one two", "ONE two"]


def drifting_texts():
    """Copies that drift away from one text step by step, and loose copies of another."""
    r = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base, out = r.choices(words, k=150), []
    for k in range(60):
        out.append(list(base))
        base[r.randrange(150)] = f"new{k}"
    other = r.choices(words, k=140)
    for k in range(80):
        out.append([f"x{k}" if r.random() < 0.02 else w for w in other])
    r.shuffle(out)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("make, block", [(texts, near_dedup.BLOCK), (drifting_texts, near_dedup.BLOCK), (drifting_texts, 7)])
def test_near_duplicates(spark, monkeypatch, make, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = list(enumerate(make()))
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    linked = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if a and b and 100 * len(a & b) >= 85 * len(a | b)]
    for _ in rows:
        for i, j in linked:
            label[i] = min(label[i], label[j])
    assert [got[k]["component_id"] for k, _ in rows] == label
    assert [got[k]["n_shingles"] for k, _ in rows] == [len(s) for s in sets]


def test_repeated_passages(spark):
    rows = list(enumerate(texts()))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(frame, size=50).collect()}
    split = [(t or "").split() for _, t in rows]
    first = {}
    for k, w in enumerate(split):
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), k)
    for k, w in enumerate(split):
        gone = {p for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < k for p in range(i, i + 50)}
        assert got[k]["n_removed"] == len(gone) and got[k]["n_words"] == len(w)
        kept = got[k]["kept"]
        assert (bytes(kept).decode() if isinstance(kept, (bytes, bytearray)) else kept) == " ".join(x for p, x in enumerate(w) if p not in gone)
