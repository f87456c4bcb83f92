"""Learned operators, packing, pieces and search on small fixtures."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tickloom.llm import ann, langid, packing, pieces, quality, toxicity
from tickloom.llm.hashed import held_out

DOCS = "doc_id long, text string, lang string, score string"


def documents(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(3)
    words = ["stone", "river", "cloud", "house", "green", "little", "walks", "under"]
    rows, labels = [], []
    for k in range(300):
        text = " ".join(r.choices(words, k=40))
        toxic, good = k % 5 == 0, k % 3 != 0
        if toxic:
            text += " you idiot moron zzlurk"
        if not good:
            text = " ".join(w + "$$$" for w in text.split())
        rows.append((k, text, "en", "x"))
        labels.append((k, int(good), int(toxic)))
    rows += [(900, None, None, None), (901, "", "en", "x"), (None, "stone", "en", "x"), (0, rows[0][1], "en", "x")]
    labels += [(None, 1, 1), (5000, None, None)]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_separates_held_out_rows(corpus):
    docs, labels = corpus
    model = quality.fit(docs, labels, ~held_out(F.col("doc_id"), 5, 0))
    out = quality.score_quality(docs, model)
    assert out.count() == docs.count() and out.columns == ["doc_id", "text", "lang", "score", "predicted"]
    held = out.filter(held_out(F.col("doc_id"), 5, 0)).join(labels, "doc_id").toPandas()
    assert (held.predicted == held.quality).mean() > 0.95
    assert out.filter("score is null or score < 0 or score > 1").count() == 0


def test_toxicity_separates_held_out_rows(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels, ~held_out(F.col("doc_id"), 4, 2))
    held = toxicity.score_toxicity(docs, model).filter(held_out(F.col("doc_id"), 4, 2)).join(labels, "doc_id").toPandas()
    assert (held.predicted == held.toxic).mean() > 0.95


def test_models_without_labels(spark, corpus):
    docs, labels = corpus
    none = labels.limit(0)
    assert {r["score"] for r in quality.score_quality(docs, quality.fit(docs, none, F.lit(True))).collect()} == {0.5}
    assert {r["predicted"] for r in toxicity.score_toxicity(docs, toxicity.fit(docs, none, F.lit(True))).collect()} == {0}


def test_label_model_pairs_correlated_voters():
    r = np.random.default_rng(0)
    y = r.random(2000) < 0.3
    noisy = lambda: np.where(r.random(2000) < 0.9, y, ~y)
    a = noisy()
    votes = np.stack([a, a, noisy(), noisy()], 1).astype(np.int64)
    posterior, pairs = toxicity.label_model(2 * votes - 1)
    assert pairs[0] == (0, 1)
    assert ((posterior > 0.5) == y).mean() > 0.9


def test_recurrent_gradients_match_differences():
    net = langid.Network(["a", "b"])
    r = np.random.default_rng(1)
    windows, labels = r.integers(60, 200, (4, 12)).astype(np.uint8), np.array([0, 1, 1, 0])
    _, found = net.gradients(windows, labels)
    for param, grad in zip(net.all_params(), found):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        was, eps = param[at], 1e-2
        param[at] = was + eps
        up = net.gradients(windows, labels)[0]
        param[at] = was - eps
        down = net.gradients(windows, labels)[0]
        param[at] = was
        assert abs((up - down) / (2 * eps) - grad[at]) < 0.05 * abs(grad[at]) + 2e-3
    kept = net.ahead.forward(windows.T)[0]
    assert np.allclose(kept, net.ahead.states(np.ascontiguousarray(windows.T)), atol=1e-5)


def test_language_of_texts(spark):
    r = random.Random(1)
    make = lambda letters: " ".join("".join(r.choices(letters, k=5)) for _ in range(30))
    rows = [(k, make("abcde") if k % 2 else make("vwxyz"), "aa" if k % 2 else "zz", "x") for k in range(120)]
    rows += [(500, None, None, None), (501, "", None, None), (502, "123 ...", None, None), (503, make("abcde") * 400, None, "x")]
    docs = documents(spark, rows)
    out = {x["doc_id"]: x for x in langid.predict(docs, langid.fit(docs, ~held_out(F.col("doc_id"), 4, 2))).collect()}
    assert [out[k]["lang_pred"] for k in (500, 501, 502, 503)] == ["und", "und", "und", "aa"]
    assert np.mean([out[k]["lang_pred"] == ("aa" if k % 2 else "zz") for k in range(120)]) > 0.97
    assert langid.predict(docs, None).filter("lang_pred <> 'und'").count() == 0


def test_nearest_against_brute_force(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(600, 8)).astype(np.float32)
    x[200:320] = x[7]  # copies
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 8), (9002, [float("nan")] * 8), (9050, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(frame, F.col("vec_id") % 50 == 0, k=5).toPandas()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 600, 50):
        near = np.round(unit @ unit[q], 12)
        wanted = [i for i in np.lexsort((np.arange(600), -near)) if i != q][:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 5 and list(mine["rank"]) == [1, 2, 3, 4, 5]
        assert np.allclose(mine.score, unit[mine.vec_id.to_numpy()] @ unit[q], atol=1e-12)
        hit += len(set(wanted) & set(mine.vec_id))
    assert hit / 60 >= 0.9
    assert ann.nearest(frame.limit(0), F.lit(True)).count() == 0


AWKWARD = ["Hello  World\n again", "", None, "é́ <|endoftext|> naïve x", "hello <|endoftext|> x", "H\u0331 T\u0308 W\u030a J\u030c", "a<|STARTOFTEXT|>b 'S don't I'LL"]
AWKWARD += ["word " * 6000, "tail", "tail", "x9y8,,;!?\x1c\x85\u3000z İstanbul K 中文 ß×÷ ٣", "Ünïcode'ré $$$ 12.5"]


def test_packing_matches_the_tokenizer(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    out = packing.pack_documents(documents(spark, [(k, t, None, None) for k, t in enumerate(AWKWARD)]), path).toPandas()
    tokenizer = Tokenizer.from_file(path)
    for k, t in enumerate(AWKWARD):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        mine = out[out.doc_id == k].sort_values("piece")
        assert mine.length.sum() == len(ids)
        assert list(mine.ids_crc32) == [zlib.crc32(ids[a : a + 4096].tobytes()) for a in range(0, len(ids), 4096)]
        assert list(mine.start) == list(range(0, len(ids), 4096))
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert list(s.offset) == [0, *s.length.cumsum()][:-1] and s.length.sum() <= 4096


def test_word_cache_equals_the_tokenizer_on_random_text():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tickloom.llm.textkit import texts_of

    path = public_tokenizers.path("word_bpe_49k.json")
    cache, tokenizer = packing.WordCache(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    r = random.Random(6)
    letters = [*"abcXYZ'.,!0129-sTrEvemLd$ \t\n\x0b\x0c\x1c\x85\xa0é\u0331\u0301WJßÀÖ×÷øİıŁĀſǅɏªµº中文😀\u030aﬁK٣①", "'s", "'RE", "H\u0331", "<|endoftext|>"]
    for _ in range(4000):
        text = "".join(r.choices(letters, k=r.randrange(1, 14)))
        assert next(cache.encode_all(texts_of(pa.array([text])))) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_packing_follows_the_sum_of_squares():
    r = np.random.default_rng(3)
    for capacity, n in ((10, 60), (50, 200), (7, 1)):
        lengths = r.integers(1, capacity + 1, n)
        sequence, offset = packing.sum_of_squares(lengths, capacity)
        used: dict[int, int] = {}
        for s, where, at in zip(lengths.tolist(), sequence.tolist(), offset.tolist()):
            assert used.get(where, 0) == at

            def squares(change: dict[int, int]) -> int:
                gaps = [capacity - u for u in (used | change).values() if u < capacity]
                return sum(gaps.count(g) ** 2 for g in set(gaps))

            costs = {w: squares({w: u + s}) for w, u in used.items() if u + s <= capacity}
            costs[-1] = squares({-1: s})
            assert costs[where if where in used else -1] == min(costs.values())
            used[where] = at + s


def test_packing_edges(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(None, "a b", "x", "y"), (None, "a b", "x", "y"), (3, "a b", "x", "y"), (3, "c", "x", "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, length string")
    out = packing.pack_documents(frame, path).toPandas()
    assert len(out) == 4 and out.doc_id.isna().sum() == 2 and out.sequence_id.nunique() == 1
    assert sorted(out.offset) == [0, 3, 6, 9] or sorted(out.offset)[0] == 0
    assert packing.pack_documents(frame.limit(0), path).count() == 0


def test_pieces_round_trip(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["a  b", " lead", "tail ", "", None, "naïve 雪 \U0001f600\n\tx\0", "x" * 5000, "same", "same"]
    frame = documents(spark, [(k, t, None, None) for k, t in enumerate(texts)])
    out = pieces.decode(pieces.encode(frame, model), model).orderBy("doc_id").collect()
    assert [r["decoded"] for r in out] == texts


def test_viterbi_against_brute_force():
    model = pieces.load_trie(public_tokenizers.path("piece_bpe_32k.model"))
    known = {t: k for k, t in enumerate(model.texts) if t and k not in set(model.byte_piece.tolist())}
    r = random.Random(4)
    for _ in range(40):
        raw = "".join(r.choices("▁theinga", k=9)).encode()
        best = {0: 0.0}
        for j in range(1, len(raw) + 1):
            ways = [best[i] + model.score[known[raw[i:j]]] for i in best if i < j and raw[i:j] in known]
            if ways:
                best[j] = max(ways)
        ids = np.frombuffer(model.solve([raw])[0], "<u4")
        assert abs(model.score[ids].sum() - best[len(raw)]) < 1e-6


def test_scores_are_logs_of_shares():
    model = pieces.load_trie(public_tokenizers.path("piece_bpe_32k.model"))
    plain = [k for k, t in enumerate(model.texts) if t and k not in set(model.byte_piece.tolist())]
    assert abs(np.exp(model.score[plain]).sum() - 1) < 1e-9
    assert model.score[plain].max() < 0


def test_pieces_of_an_empty_table_and_clashing_columns(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    frame = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, piece_ids string, decoded string")
    out = pieces.decode(pieces.encode(frame, model), model)
    assert out.first()["decoded"] == "a b" and out.first()["doc_id"] == 1
    assert pieces.decode(pieces.encode(frame.limit(0), model), model).count() == 0


def test_nearest_of_repeated_ids_odd_lengths_and_ties(spark):
    r = np.random.default_rng(5)
    long = [(k, r.normal(size=8).tolist()) for k in range(40)]
    rows = [*long, (1, long[2][1]), (1, long[2][1]), (70, long[2][1]), (60, long[2][1])]  # id 1 has a second vector, that of 2, 60 and 70
    rows += [(100, [1.0, 0.0]), (101, [1.0, 0.1]), (102, [1.0, 0.2]), (None, [1.0] * 8)]
    frame = spark.createDataFrame([(k, v, 0.5) for k, v in rows], "vec_id long, embedding array<double>, score double")
    got = ann.nearest(frame, F.col("vec_id").isin(2, 100), k=3).toPandas()
    two, hundred = (got[got.query_id == q].sort_values("rank") for q in (2, 100))
    assert list(two.vec_id) == [1, 60, 70] and np.allclose(two.score, 1.0)
    assert list(hundred.vec_id) == [101, 102]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_on_the_given_vectors(spark, sf):
    frame = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [r for r in frame.collect() if r["embedding"]]
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = ann.nearest(frame, F.col("vec_id") % 50 == 0, k=5).toPandas()
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        near = unit @ unit[q]
        near[q] = -9
        wanted = set(ids[np.lexsort((ids, -near))[:5]])
        total += 5
        hit += len(wanted & set(got[got.query_id == ids[q]].vec_id))
    assert hit / total >= 0.9


def plain_features(text: str, kinds: str) -> dict[int, int]:
    """The features of one text, by way of an array of one."""
    import pyarrow as pa

    from tickloom.llm import hashed
    from tickloom.llm.textkit import texts_of

    _, slots, counts = hashed.features(texts_of(pa.array([text])), kinds)
    return dict(zip(slots.tolist(), counts.tolist()))


@pytest.mark.parametrize("module, score, kinds, scaled", [(quality, quality.score_quality, quality.KINDS, True), (toxicity, toxicity.score_toxicity, toxicity.KINDS, False)])
def test_scores_equal_plain_sums(spark, module, score, kinds, scaled):
    from tickloom.llm.hashed import SLOTS

    r = np.random.default_rng(4)
    weights, bias = r.normal(size=SLOTS).astype(np.float32).astype(float), 0.25
    texts = ["one two one", "", None, "A-1 ... B,b é", "word " * 50_000, "one two one"]
    frame = documents(spark, [(k, t, "en", "old") for k, t in enumerate(texts)])
    out = score(frame, (weights, bias)).orderBy("doc_id").collect()
    for row, text in zip(out, texts):
        x = plain_features(text or "", kinds)
        size = np.sqrt(sum(np.log1p(c) ** 2 for c in x.values())) if scaled else 1.0
        z = bias + sum(weights[s] * (np.log1p(c) / size if scaled else 1.0) for s, c in x.items())
        assert abs(row["score"] - 1 / (1 + np.exp(-np.clip(z, -35, 35)))) < 1e-6
        assert row["predicted"] == int(row["score"] >= 0.3) and row["lang"] == "en"
    assert score(frame.limit(0), (weights, bias)).count() == 0


def test_words_of_letters_drop_what_is_around_them():
    a, b = plain_features("idiot### (Idiot) trash,", "l"), plain_features("IDIOT trash", "l")
    assert set(a) == set(b) and sorted(a.values()) == [1, 2]


def test_network_pools_every_position(spark):
    """The language of a text against the network run window by window, one text at a time."""
    r = random.Random(2)
    make = lambda letters, n=30: " ".join("".join(r.choices(letters, k=5)) for _ in range(n))
    rows = [(k, make("abcde") if k % 2 else make("vwxyz"), "aa" if k % 2 else "zz", "x") for k in range(60)]
    network = langid.fit(documents(spark, rows), F.lit(True))
    texts = ["abc de", make("vwxyz", 200), "1a2b", make("abcvwx", 3)]
    out = langid.predict(documents(spark, [(k, t, None, None) for k, t in enumerate(texts)]), network).orderBy("doc_id").collect()
    for row, text in zip(out, texts):
        raw = text.encode()
        total = np.zeros(2)
        for at in range(0, len(raw), langid.WINDOW):
            cut = raw[at : at + langid.WINDOW]
            p = network.positions(np.frombuffer(cut.ljust(langid.WINDOW), np.uint8)[None, :])
            for t, byte in enumerate(cut):
                if chr(byte).isalpha():
                    total += p[t, 0]
        assert row["lang_pred"] == network.languages[int(total.argmax())]
        assert abs(row["score"] - total.max() / total.sum()) < 0.02
    assert langid.predict(documents(spark, []), network).count() == 0


def test_learning_from_repeated_and_null_keys(spark):
    rows = [(None, "abc abc abc", "aa", "x")] * 50 + [(1, "xyz xyz xyz", "zz", "x")] * 50
    network = langid.fit(documents(spark, rows), F.lit(True), most=10)
    assert network is not None and set(network.languages) <= {"aa", "zz"}
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.fit(documents(spark, rows), labels, F.lit(True))[1] != 0
