"""Packing tokenised documents into sequences by the sum-of-squares rule.

A document is its token ids and an end id. Documents longer than a sequence are cut into
pieces of ``capacity`` ids; nothing else is cut. A piece of length s goes where the sum over
gaps g of N(g)^2, N(g) the number of open sequences with g ids to spare, becomes smallest:
moving a sequence from gap g to g - s changes it by 2 (N(g - s) - N(g) + 1), a full sequence
and a new one count once. Among equal choices the smallest gap wins. Pieces come longest
first, so the short ones at the end fill what is left.

Scale. Tokenising is a map over documents; only (key, piece, start, length, CRC) rows move.
They are dealt by a hash to groups of about ``rows_per_group`` pieces, whose number follows
the input; a group's state is one counter per gap. Groups are packed apart, which costs at
most the few sequences that each leaves open.

Pre-tokens repeat: their ids are looked up in a cache of bounded size, and new ones are found by
the tokenizer's model alone. The ids are the tokenizer's own: it drops white space and never joins across
it, and text of ASCII and composed Latin letters is cut by its pre-token rule before the look-up;
any other word, and any text with the string of an added token, is left to the tokenizer.
The constructor refuses a tokenizer of other rules.

Defined results: a null or empty text is the end id alone; a very long text is many pieces, each
dealt by itself; repeated rows are packed each, those equal in key and text in one group; an
empty table gives an empty result; a null key is kept, and comes last among pieces of one
length; extra columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.textkit import Texts, map_arrow, slices

MAX_CACHED, LONGEST_CACHED = 300_000, 64

#: the tokenizer's pre-tokens, and letters besides a-z whose class no Unicode version changes
LETTERS = "a-z\u00df-\u00f6\u00f8-\u024f"
SPACE = "\t-\r "
PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9{SPACE}]+")
#: text of printable ASCII, white space and composed Latin letters, which lower one by one
PLAIN = re.compile(f"[!-~{SPACE}\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]*")
WORD = re.compile(f"[^{SPACE}]+")
#: the pre-tokenizer and the normalizer that the above stand for (fixed values of the tokenizer)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: the byte-level spelling: bytes that are no printable Latin-1 character stand as letters from 256 on
BYTE_CHARS = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173])}


class PreTokens(dict):
    """Token ids of pre-tokens as little-endian uint32 bytes; those not there are found and added.

    The model of the tokenizer splits a plain pre-token, which its normalizer and pre-token rule
    would leave as it is; other words go through the whole tokenizer. Few long ones come again,
    and they are not kept, so that ``MAX_CACHED`` bounds the memory.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.split = tokenizer, tokenizer.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            ids = [token.id for token in self.split(piece)]
        elif PLAIN.fullmatch(piece):
            ids = [token.id for token in self.split(piece.encode().decode("latin-1").translate(BYTE_CHARS))]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        raw = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST_CACHED:
            if len(self) >= MAX_CACHED:
                self.clear()
            self[piece] = raw
        return raw


class WordCache:
    """Token ids of texts as little-endian uint32 bytes, by way of their pre-tokens.

    A plain text is cut into pre-tokens at once; of other texts the words that are not plain go
    to the tokenizer; a text that holds an added token's string goes there whole.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        if kinds != NORMALIZERS or steps[0].get("pattern") != {"Regex": PATTERN} or not steps[0]["invert"] or spec["post_processor"] is not None or not spec["model"]["end_of_word_suffix"]:
            raise ValueError("the word cache stands for another tokenizer's normalizer and pre-tokens")
        if [x["type"] for x in steps[1:]] != ["ByteLevel"] or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
            raise ValueError("the word cache stands for pre-tokens that are spelled by their bytes")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("the word cache finds added tokens by their plain strings only")
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        self.known = PreTokens(self.tokenizer)

    def pieces_of(self, text: str) -> list[str]:
        """The text's pre-tokens in lower case; words that are not plain stay whole."""
        if PLAIN.fullmatch(text):
            return PRE_TOKEN.findall(text.lower())
        out = []
        for word in WORD.findall(text):
            out += PRE_TOKEN.findall(word.lower()) if PLAIN.fullmatch(word) else [word]
        return out

    def encode_all(self, texts: Texts) -> Iterator[bytes]:
        get = self.known.__getitem__
        for i in range(texts.n):
            raw = texts.one(i)
            if any(t in raw for t in self.added):
                yield np.array(self.tokenizer.encode(raw.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()
            else:
                yield b"".join(map(get, self.pieces_of(raw.decode("utf-8"))))


_caches: dict[int, WordCache] = {}


def word_cache(tokenizer_json: str) -> WordCache:
    """One cache per worker process and tokenizer."""
    name = zlib.crc32(tokenizer_json.encode())
    if name not in _caches:
        _caches[name] = WordCache(tokenizer_json)
    return _caches[name]


def token_pieces(
    documents: DataFrame,
    tokenizer_json: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = 4096,
    end_id: int = 1,
    with_ids: bool = True,
) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32 and, if wanted, the piece's ids (binary, uint32 LE)."""
    names = ["key", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
    spec = documents.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(spec.value)
        for batch, texts in slices(batches, "text"):
            row, piece, length, crc, ids = [], [], [], [], []
            for i, raw in enumerate(cache.encode_all(texts)):
                raw += end
                for p, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    row.append(i)
                    piece.append(p)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            number = np.array(piece, np.int64)
            columns = [
                batch.column(0).take(pa.array(row, pa.int64())),
                pa.array(number.astype(np.int32)),
                pa.array(number * capacity),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())] if with_ids else columns, names)

    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long"
    return map_arrow(rows, work, f"{schema}, ids binary" if with_ids else schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, placed in the given order; lengths from 1 to capacity."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened = 0
    for k, s in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(count[s:])  # gap - s of the open sequences it fits
        best, gain = -1, 2 * count[capacity - s] + 1 if s < capacity else 0
        if len(gaps):
            change = 2 * (count[gaps] - count[gaps + s]) + 2
            if gaps[0] == 0:
                change[0] = 1 - 2 * count[s]
            at = int(change.argmin())
            if change[at] <= gain:
                best = int(gaps[at]) + s
        if best < 0:
            best, place = capacity, opened
            opened += 1
        else:
            place = by_gap[best].pop()
            count[best] -= 1
        sequence[k], offset[k] = place, capacity - best
        if best > s:
            by_gap[best - s].append(place)
            count[best - s] += 1
    return sequence, offset


def pack(pieces: DataFrame, n_rows: int, capacity: int = 4096, rows_per_group: int = 40_000) -> DataFrame:
    """``pieces`` (key, piece, start, length, ids_crc32) with sequence_id and offset.

    ``n_rows``, the most pieces there may be, sets the number of groups only.
    """
    groups = max(1, -(-n_rows // rows_per_group))
    columns = ["key", "piece", "start", "length", "ids_crc32"]
    dealt = pieces.select(*columns).withColumn(
        "lot", F.pmod(F.xxhash64("key", "piece", "ids_crc32"), F.lit(groups)).cast("int")
    )

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("key", "ascending"), ("piece", "ascending")])
        sequence, offset = sum_of_squares(table["length"].to_numpy(), capacity)
        lot = table["lot"][0].as_py()
        return table.select(columns).append_column("sequence_id", pa.array(sequence + (lot << 40))).append_column(
            "offset", pa.array(offset)
        )

    kind = pieces.schema["key"].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("lot").applyInArrow(work, schema)


def pack_documents(
    documents: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1
) -> DataFrame:
    """Per piece: the key, piece, start, length, ids_crc32, sequence_id, offset."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    pieces = token_pieces(documents, tokenizer_json, key, text, capacity, end_id, with_ids=False)
    size = documents.agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("bytes")).first()
    # an id stands for a byte at least, so this is not less than the number of pieces
    return pack(pieces, size["n"] + (size["bytes"] or 0) // capacity, capacity).withColumnRenamed("key", key)
