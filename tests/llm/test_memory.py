"""What the driver and the workers hold."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from tickloom.llm import hashed, packing, shared, textkit, toxicity
from tickloom.llm.textkit import texts_of


def peak_mb(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_learning_holds_few_tables_of_all_slots():
    r = np.random.default_rng(1)
    rows = [(r.choice(hashed.SLOTS, 20, False), np.ones(20), float(k % 2)) for k in range(40)]
    rows = [(np.append(slots, 7) if label else slots, np.ones(20 + int(label)), label) for slots, _, label in rows]
    table = hashed.SLOTS * 8 / 1e6
    found = []
    assert peak_mb(lambda: found.append(toxicity.mine_lexicons(rows))) < 1.5 * table
    assert found[0][7] >= 0 and (found[0] >= 0).sum() == 1
    examples = [(slots, x, label, 1.0) for slots, x, label in rows]
    assert peak_mb(lambda: found.append(hashed.ftrl(examples, 2, 0.5, 0.0))) < 3.5 * table
    used = np.unique(np.concatenate([slots for slots, _, _ in rows]))
    weights, _ = found[1]
    assert np.array_equal(np.flatnonzero(weights), used)


def test_the_driver_is_tidied_after_each_step(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(shared, "tidy", lambda s: calls.append(s))
    assert shared.checkpointed(spark.range(3)).count() == 3 and len(calls) == 1
    scratch = shared.Scratch(spark, "test")
    assert scratch.write(spark.range(4), "a").count() == 4 and len(calls) == 2
    scratch.drop("a")


def test_a_grown_heap_is_collected():
    calls = []
    for total in (4, 6):
        heap = SimpleNamespace(totalMemory=lambda: total, maxMemory=lambda: 10)
        lang = SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: heap), System=SimpleNamespace(gc=lambda: calls.append(total)))
        driver = SimpleNamespace(_jvm=SimpleNamespace(java=SimpleNamespace(lang=lang)))
        assert shared.tidy(driver) == (total == 6)
    assert calls == [6]


def test_cached_ids_are_bounded_in_bytes_and_number(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    cache, tokenizer = packing.WordCache(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "MAX_CACHED", 20)
    r = random.Random(2)
    words = ["".join(r.choices("abcdeüßéñ", k=r.randrange(1, 9))) for _ in range(100)] + ["中" * 3000, "x" * 3000, "ß" * 70]
    for _ in range(5):
        text = " ".join(r.choices(words, k=300))
        assert next(cache.encode_all(texts_of(pa.array([text])))) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert 0 < len(cache.known) <= 20 and max(map(len, cache.known)) <= 64


def test_packing_moves_no_ids(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d " * 5000)], "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    plan = packing.pack_documents(docs, path)._jdf.queryExecution().analyzed().toString()
    assert "crc32" in plan and "ids#" not in plan
    spec = open(path, encoding="utf-8").read()
    whole = packing.token_pieces(docs, spec).orderBy("key", "piece").collect()
    assert [len(x["ids"]) // 4 for x in whole] == [x["length"] for x in whole] == [4, 4096, 905]
    assert "ids" not in packing.token_pieces(docs, spec, with_ids=False).columns


def test_workers_map_a_broadcast_bitmap_from_its_file(spark):
    value = np.random.default_rng(3).integers(0, 256, 8 << 20, np.uint8).tobytes()
    large, small, other = (spark.sparkContext.broadcast(x) for x in (value, b"ab", np.arange(9, dtype=np.uint8)))

    def work(batches):
        for _ in batches:
            found = [shared.mapped(x) for x in (large, small, other)]
            loaded = [hasattr(x, "_value") for x in (large, small, other)]
            same = [found[0].tobytes() == large.value, found[1].tobytes() == b"ab", found[2].tolist() == list(range(9))]
            again = shared.mapped(large).tobytes() == large.value  # loaded by now
            yield pa.RecordBatch.from_arrays([pa.array([str((loaded, same, again))])], ["x"])

    found = spark.range(1).mapInArrow(work, "x string").first()[0]
    assert found == str(([False, True, True], [True] * 3, True))


def test_workers_give_back_memory_after_a_partition(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(textkit, "give_back", lambda: calls.append("back"))
    frame = SimpleNamespace(mapInArrow=lambda work, schema: work)
    assert list(textkit.map_arrow(frame, lambda batches: iter(batches), "x int")([1, 2])) == [1, 2] and calls == ["back"]
    seen = []
    monkeypatch.setattr(shared, "map_arrow", lambda rows, work, schema: seen.append(schema) or rows)
    shared.sieved(spark.range(3), F.col("id"), None, True)
    assert len(seen) == 1
