"""Stages of the pipeline on rows whose doc_id is null or repeated."""

import random

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n))


def through(spark, name: str, rows: list[tuple]) -> list[tuple]:
    docs = spark.createDataFrame([(k, t, "en", "x", len(t)) for k, t in rows], COLUMNS)
    out = STAGES[name](spark, docs, "")
    assert out.columns == docs.columns
    found = out.collect()
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    return sorted(((r["doc_id"], r["text"]) for r in found), key=str)


def test_near_dedup_of_null_and_repeated_ids(spark):
    a, b, c, d, e = (prose(k, 120) for k in range(5))
    rows = [(7, a), (3, a), (5, b), (5, a), (None, c), (None, d), (None, d), (None, a), (9, e), (9, e)]
    kept = [(3, a), (5, b), (None, c), (None, d), (9, e)]
    assert through(spark, "near_dedup", rows) == sorted(kept, key=str)


def test_repeated_passages_of_null_and_repeated_ids(spark):
    passage, other = prose(10, 60), prose(11, 60)
    heads = [prose(20 + k, 30) for k in range(7)]
    rows = [(4, f"{heads[0]} {passage}"), (8, f"{heads[1]} {passage}"), (8, f"{heads[2]} {passage}"), (8, heads[3])]
    rows += [(None, f"{heads[4]} {passage}"), (None, f"{heads[5]} {other}"), (None, f"{heads[6]} {other}")]
    found = through(spark, "substring_dedup", rows)
    assert len(found) == len(rows)
    whole = [(4, rows[0][1]), (8, heads[1]), (8, heads[2]), (8, heads[3]), (None, heads[4])]
    assert set(whole) <= set(found)
    # of the two null ids that share the other passage just one keeps it
    rest = sorted(len(t.split()) for k, t in set(found) - set(whole))
    assert rest == [30, 90]


def test_stages_of_plain_ids_keep_the_least(spark):
    a, b = prose(40, 120), prose(41, 120)
    assert through(spark, "near_dedup", [(2, a), (1, a), (3, b)]) == [(1, a), (3, b)]
