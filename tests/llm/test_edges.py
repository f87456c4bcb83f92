"""Empty tables, nulls, repeats, very long texts and clashing columns of the operators on texts."""

import hashlib
import random

import corpus_pipeline
from pyspark.sql import functions as F

from tickloom.llm import fingerprint, near_dedup, substring_dedup
from tickloom.llm import queries as llm

COLUMNS = "doc_id long, text string, key string, place string, row string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", "y", "z") for k, t in rows], COLUMNS)


def brute_repeats(rows, size=50):
    """(n_words, n_removed, kept) of each row; a null key is the largest."""
    order = [float("inf") if k is None else k for k, _ in rows]
    words = [(t or "").split() for _, t in rows]
    least: dict = {}
    for k, w in zip(order, words):
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            least[key] = min(least.get(key, k), k)
    out = []
    for k, w in zip(order, words):
        gone = {p for i in range(len(w) - size + 1) if least[tuple(w[i : i + size])] < k for p in range(i, i + size)}
        out.append((len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def test_repeated_passages_of_awkward_rows(spark):
    passage, shared = prose(1, 130), prose(2, 50)
    rows = [(k, f"{prose(100 + k, 20)} {passage} {prose(200 + k, 20)}") for k in range(12)]
    rows += [(k, f"{prose(300 + k, 40)} {shared}") for k in range(20, 40)]  # a passage of just one window in most rows
    rows += [(50, " ".join(passage.split()[:80])), (51, " ".join(passage.split()[40:])), (52, " ".join(passage.split()[20:75]) + " " + prose(3, 60))]
    rows += [(None, passage), (None, passage), (None, None), (60, ""), (61, " \t\n "), (62, prose(4, 49))]
    rows += [(70, passage), (70, passage), (70, prose(5, 60) + " " + prose(5, 60)), (71, prose(5, 60))]
    rows += [(80, prose(6, 30_000)), (81, prose(6, 30_000)), (82, "same " * 5_000), (83, "same " * 60)]
    got = substring_dedup.remove_repeats(frame(spark, rows), carry=("text",)).collect()
    found = sorted((str(r["doc_id"]), r["row"]["text"] or "", r["n_words"], r["n_removed"], r["kept"]) for r in got)
    assert found == sorted((str(k), t or "", *x) for (k, t), x in zip(rows, brute_repeats(rows)))
    assert substring_dedup.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_sketch_never_counts_too_few(spark):
    """Cells of windows that two rows hold are set, however small the sketch."""
    passage = prose(7, 70)
    rows = frame(spark, [(k, f"{prose(400 + k, 200)} {passage}") for k in range(6)]).select("text")
    for width in (1 << 23, 1 << 24):
        bits = substring_dedup.repeated_cells(rows, "text", 50, width)
        import pyarrow as pa

        from tickloom.llm.textkit import texts_of

        _, _, window, anchor = substring_dedup.windows_of(texts_of(pa.array([passage])), 50)
        assert substring_dedup._is_repeated(bits.tobytes(), window, anchor, width).all()
        _, _, window, anchor = substring_dedup.windows_of(texts_of(pa.array([prose(999, 2000)])), 50)
        assert substring_dedup._is_repeated(bits.tobytes(), window, anchor, width).mean() < 0.01


def test_near_duplicates_of_null_and_repeated_keys(spark):
    a, b = prose(10, 100), prose(11, 100)
    rows = [(5, a), (None, a), (None, b), (None, b), (5, b), (7, a), (9, None), (10, ""), (11, "one TWO"), (12, "one two")]
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=str)
    want = [(5, 96, 5, True), (5, 96, 5, True), (7, 96, 5, False), (None, 96, 5, False), (None, 96, 5, False), (None, 96, 5, False)]
    want += [(9, 0, 9, True), (10, 0, 10, True), (11, 1, 11, True), (12, 1, 11, False)]
    assert found == sorted(want, key=str)
    assert near_dedup.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_fingerprints_of_edits_against_plain_code(spark):
    rows = [(k, prose(500 + k, 3 + 7 * k)) for k in range(12)] + [(40, None), (41, ""), (42, "é😀 ü"), (43, prose(20, 20_000))]
    out = {r["doc_id"]: r for r in fingerprint.fingerprint_edits(frame(spark, rows)).collect()}
    down = sorted(rows, reverse=True)
    texts = [t or "" for _, t in down]
    edits = []
    for (k, _), t, after in zip(down, texts, texts[1:] + texts[:1]):
        cut = len(t) // 3
        edits.append(t[: len(t) - cut] + after[:cut])
        assert out[k]["n_chars"] == len(t) and out[k]["edited_text"] == edits[-1]
    # signatures of the texts themselves are tested elsewhere; here, that they are put together rightly
    both = spark.createDataFrame(list(zip([k for k, _ in down], texts, edits, texts[1:] + texts[:1])), "k long, t string, e string, n string")
    sig = fingerprint.order_minhash
    for r in both.select("k", sig(F.col("t")).alias("t"), sig(F.col("e")).alias("e"), sig(F.col("n")).alias("n")).collect():
        one = out[r["k"]]
        assert list(one["signature"]) == r["t"] and list(one["edited_signature"]) == r["e"]
        share = lambda x, y: 1.0 if not (x or y) else len(set(x) & set(y)) / len({s >> 58 for s in x} | {s >> 58 for s in y})
        assert one["near_edited"] == share(r["t"], r["e"]) and one["near_next"] == share(r["t"], r["n"])


def test_fingerprints_of_repeated_keys_and_empty_tables(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "d"), (None, "e f"), (None, None)]
    out = fingerprint.fingerprint_edits(frame(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["1", "1", "1", "None", "None"]
    assert fingerprint.fingerprint_edits(frame(spark, rows).limit(0)).count() == 0


def tables(spark, tmp_path):
    """A small folder of documents and labels with all that the stages are to catch."""
    r = random.Random(12)
    words = ["stone", "river", "cloud", "house", "green", "little", "walks", "under", "light", "paper"] + [f"w{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(240):
        text = " ".join(r.choices(words, k=60))
        toxic, good = k % 6 == 0, k % 5 != 0
        if toxic:
            text += " you idiot moron scum"
        if not good:
            text = " ".join(w + "$$$" for w in text.split())
        docs.append((k, text))
        labels.append((k, int(good), int(toxic)))
    clean = [t for k, t in docs if k % 6 and k % 5]
    docs += [(1000, clean[0]), (1001, clean[1] + " tail"), (1002, clean[2] + " " + prose(30, 80)), (None, clean[3]), (None, prose(31, 70)), (None, None), (1003, "")]
    folder = str(tmp_path / "tables")
    made = spark.createDataFrame([(k, t, "en", "x", len(t or "")) for k, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    made.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs


def test_pipeline_against_plain_code(spark, tmp_path):
    folder, docs = tables(spark, tmp_path)
    out = corpus_pipeline.run(spark, folder).collect()
    bad = {k for k in range(240) if k % 6 == 0 or k % 5 == 0}
    kept = [(k, t or "") for k, t in docs if k not in bad]
    left = {str(r["doc_id"]) for r in out}
    # exact and near copies go, the first of each stays; null ids come last
    assert left == {str(k) for k, _ in kept} - {"1000", "1001"}
    assert sum(r["doc_id"] is None for r in out) == 2
    # of the one with a copied passage the copied words are cut, so that fewer ids are left
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(llm._word_tokenizer())
    ids = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
    by = {r["doc_id"]: r["length"] for r in out}
    assert by[1002] == ids(prose(30, 80))
    plain = next((k, t) for k, t in kept if k not in (1002, None) and k < 240)
    assert by[plain[0]] == ids(plain[1])


def test_stages_pass_clashing_columns_and_empty_tables(spark, tmp_path):
    folder, _ = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, value in (("score", "s"), ("predicted", "p"), ("kept", "k"), ("row", "r"), ("tag", "t"), ("key", "q"), ("component_id", "c")):
        docs = docs.withColumn(name, F.lit(value))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert out.filter("score <> 's' or predicted <> 'p' or kept <> 'k' or row <> 'r' or tag <> 't' or key <> 'q'").count() == 0, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    assert corpus_pipeline.pack(spark, docs.limit(0), folder).count() == 0


def test_pipeline_carries_on_where_it_stopped(spark, tmp_path, monkeypatch):
    folder, _ = tables(spark, tmp_path)
    place = str(tmp_path / "stages")
    ran = []

    def stage(name, fails):
        def work(spark, docs, sf_dir):
            ran.append(name)
            if fails and ran.count(name) == 1:
                raise RuntimeError("lost")
            return docs

        return name, work

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a", False), stage("b", True), stage("c", False)])
    try:
        corpus_pipeline.run(spark, folder, place)
    except RuntimeError:
        pass
    assert corpus_pipeline.run(spark, folder, place).count() == 247 and ran == ["a", "b", "b", "c"]


def test_kept_text_is_hashed_as_it_is(spark, tmp_path):
    spark.createDataFrame([(1, "a  b\tc"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r for r in llm.op1_count_min_substring_dedup(spark, str(tmp_path)).collect()}
    assert out[1]["kept_sha256"] == hashlib.sha256(b"a b c").hexdigest() and out[2]["n_words"] == 0
