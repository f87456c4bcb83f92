"""Encoding to pieces by unigram Viterbi over a double-array trie, and decoding.

A text gets the marker U+2581 in front and for each space; of all ways to write it in pieces
the one with the largest sum of log scores is taken (ties: the longer last piece). The model
given is a BPE model, whose file has merge ranks and no log scores, and tokenizers are not
trained here: the scores follow from the ranks by Zipf's law, the piece of rank r having a
share of 1 / (r + 1) of all, and so the log of that as score; pieces without a rank come last.
The ids are thus a unigram optimum under those shares and not the BPE model's own ids. A character that no piece covers is
written as byte pieces, each at ``PENALTY`` below the lowest score. No piece holds a marker
after another character, so a best path can be cut before every run of markers: the parts
between are solved once each and kept in a cache of bounded size, a whole batch of new parts
at a time. Byte pieces that stand for each other's text are equally exact on the way back.

Scale. The trie (two integer arrays) is built on the driver and broadcast, about 2 MB for
32,000 pieces; encoding is a map over whole texts, nothing is shuffled.

Defined results: null stays null; the empty text has no ids; texts that hold the marker
itself decode to a space in its place; repeated rows are encoded each; an empty table gives an
empty result; a column named ``piece_ids`` or ``decoded`` is replaced, other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
PENALTY = 10.0
MAX_CACHED = 300_000
PARTS = re.compile(f"{MARK}*[^{MARK}]*", re.S)
LONGEST_BATCHED = 96


@dataclass
class Trie:
    """Double array over bytes: from state s byte c leads to t = base[s] + c + 1 if check[t] = s."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray  # of each state, or -1
    score: np.ndarray  # of each piece
    byte_piece: np.ndarray  # of each byte
    texts: list[bytes]
    unseen: float  # score of a byte piece

    @staticmethod
    def build(pieces: list[tuple[bytes, int]], score, byte_piece, texts) -> Trie:
        """From (bytes, id) of the ordinary pieces."""
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for raw, number in pieces:
            node = 0
            for c in raw:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][c]
            ends[node] = number
        # nodes of several children take the next unused span, lone children then fill the gaps
        size = 512 + sum(max(c) - min(c) + 1 if len(c) > 1 else len(c) for c in children)
        base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used, top, state_of = bytearray(size), 257, {0: 0}
        used[0] = 1
        wide = [n for n, c in enumerate(children) if len(c) > 1]
        for node in wide:
            codes = children[node]
            at = top - min(codes) - 1
            top = at + max(codes) + 2
            for c, child in codes.items():
                used[at + c + 1] = 1
                state_of[child] = at + c + 1
        free = 257
        for node, codes in enumerate(children):
            for child in codes.values() if len(codes) == 1 else ():
                while used[free]:
                    free += 1
                used[free] = 1
                state_of[child] = free
        for node, codes in enumerate(children):
            state = state_of[node]
            piece[state] = ends[node]
            base[state] = -257  # leads before the arrays, where nothing is
            for c, child in codes.items():
                base[state] = state_of[child] - c - 1
                check[state_of[child]] = state
        return Trie(base, check, piece, np.asarray(score, float), np.asarray(byte_piece), texts, min(score) - PENALTY)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none; -1 stays."""
        to = self.base[state] + byte.astype(np.int64) + 1
        fine = (state >= 0) & (to > 0) & (to < len(self.check))
        to = np.where(fine, to, 0)
        return np.where(fine & (self.check[to] == state) & (to > 0), to, -1)

    def solve(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each part, as little-endian uint32 bytes; the parts move through the trie together."""
        if not parts:
            return []
        n, longest = len(parts), max(map(len, parts))
        length = np.array([len(p) for p in parts])
        data = np.frombuffer(b"".join(p.ljust(longest, b"\0") for p in parts), np.uint8).reshape(n, longest)
        best = np.full((n, longest + 1), -np.inf)
        best[:, 0] = 0
        came, by = np.zeros((n, longest + 1), np.int32), np.full((n, longest + 1), -1, np.int32)
        starts = (data & 0xC0) != 0x80
        for i in range(longest):
            rows = np.flatnonzero((i < length) & starts[:, i])
            if not len(rows):
                continue
            width = np.where(data[rows, i] < 0x80, 1, np.where(data[rows, i] < 0xE0, 2, np.where(data[rows, i] < 0xF0, 3, 4)))
            to = i + width
            better = best[rows, i] + self.unseen * width > best[rows, to]
            r, t = rows[better], to[better]
            best[r, t], came[r, t], by[r, t] = best[r, i] + self.unseen * width[better], i, -1
            state, j = np.zeros(len(rows), np.int64), i
            while len(rows) and j < longest:
                state = self.step(state, data[rows, j])
                alive = (state >= 0) & (j < length[rows])
                rows, state, j = rows[alive], state[alive], j + 1
                number = self.piece[state]
                own = number >= 0
                r, k = rows[own], number[own]
                value = best[r, i] + self.score[k]
                better = value > best[r, j]
                r = r[better]
                best[r, j], came[r, j], by[r, j] = value[better], i, k[better]
        out = []
        for p in range(n):
            ids, at = [], int(length[p])
            while at > 0:
                back = int(came[p, at])
                ids.extend([int(by[p, at])] if by[p, at] >= 0 else [int(self.byte_piece[c]) for c in parts[p][back:at][::-1]])
                at = back
            out.append(np.array(ids[::-1], "<u4").tobytes())
        return out


def load_trie(model_file: str) -> Trie:
    """The trie of a sentencepiece model's pieces; control pieces and byte pieces stay outside."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    plain, rank, texts, byte_piece = [], [], [], np.zeros(256, np.int64)
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            byte_piece[int(piece[3:5], 16)] = k
            texts.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(k) or model.is_unknown(k):
            texts.append(b"")
        else:
            if MARK in piece.lstrip(MARK):
                raise ValueError("a piece holds a marker after another character: parts can't be solved apart")
            plain.append((piece.encode(), k))
            texts.append(piece.encode())
        rank.append(-1.0 if texts[-1] == b"" or model.is_byte(k) or model.is_unused(k) else -model.get_score(k))
    return Trie.build(plain, log_scores(np.array(rank)), byte_piece, texts)


def log_scores(rank: np.ndarray) -> np.ndarray:
    """Log shares by Zipf's law of merge ranks; -1 stands for no ordinary piece (score 0, not used),
    a rank beyond 10^8 for none."""
    known = (rank >= 0) & (rank < 1e8)
    last = rank[known].max(initial=0) + 1
    place = np.where(known, rank, last)
    ordinary = rank >= 0
    total = (1 / (place[ordinary] + 1)).sum()
    return np.where(ordinary, -np.log((place + 1) * total), 0.0)


class Coder:
    def __init__(self, trie: Trie):
        self.trie = trie
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        split = [PARTS.findall(MARK + t.replace(" ", MARK))[:-1] if t else [] for t in texts]
        missing = set().union(*split) - self.known.keys()
        if len(self.known) + len(missing) > MAX_CACHED:
            self.known.clear()
            missing = set().union(*split)
        fresh = sorted(missing, key=len)
        at = 0
        while at < len(fresh):  # of like length, and as many as fit in a few MB
            most = max(1, min(20_000, (1 << 21) // (4 * len(fresh[min(at + 20_000, len(fresh)) - 1]) + 1)))
            group = fresh[at : at + most]
            self.known.update(zip(group, self.trie.solve([g.encode() for g in group])))
            at += most
        return [b"".join([self.known[p] for p in parts]) for parts in split]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join([self.trie.texts[k] for k in ids.tolist()]).decode("utf-8", "replace").replace(MARK, " ")
        return raw[1:] if raw.startswith(" ") else raw


_coders: dict[int, Coder] = {}


def _coder(held) -> Coder:
    """One per worker process and trie."""
    if held.value is not None and id(held.value) not in _coders:
        _coders.clear()
        _coders[id(held.value)] = Coder(held.value)
    return _coders[id(held.value)]


def encode(documents: DataFrame, model_file: str, text: str = "text", rows: int = 64) -> DataFrame:
    """``documents`` with ``piece_ids`` (binary, little-endian uint32), null where the text is."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    documents = documents.drop("piece_ids")
    held = documents.sparkSession.sparkContext.broadcast(load_trie(model_file))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(held)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                ids = coder.encode([t or "" for t in texts])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([None if t is None else i for t, i in zip(texts, ids)], pa.binary())],
                    [*part.schema.names, "piece_ids"],
                )

    return documents.mapInArrow(work, StructType([*documents.schema.fields, StructField("piece_ids", BinaryType())]))


def decode(encoded: DataFrame, model_file: str, ids: str = "piece_ids", rows: int = 64) -> DataFrame:
    """``encoded`` with ``decoded``: the text that the ids stand for."""
    from pyspark.sql.types import StringType, StructField, StructType

    encoded = encoded.drop("decoded")
    held = encoded.sparkSession.sparkContext.broadcast(load_trie(model_file))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(held)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                raw = part.column(part.schema.get_field_index(ids)).to_pylist()
                texts = [None if r is None else coder.decode(np.frombuffer(r, "<u4")) for r in raw]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(work, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))
