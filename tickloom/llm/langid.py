"""Language of texts by a bidirectional gated recurrent network over bytes.

A text is cut into windows of ``WINDOW`` bytes; in each the forward and backward states start
at zero, and every position gets class probabilities from both states. A document's
probabilities are the mean over its letter positions (bytes of letters; with none, all
positions). Training is backpropagation through time with Adam, in numpy, on a bounded
sample: about ``most`` rows, whose bytes are drawn from windows over the whole text.

Scale. The model is a few thousand floats and is broadcast; prediction is a map over whole
texts that holds ``SLICE`` bytes of text at a time, whatever the length of one text.

Defined results: null texts and texts without a letter get ``und`` and score 0; without
training rows every text does; ties go to the first language by name; repeated rows are
predicted each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tickloom.llm.textkit import slices

WINDOW = 48
HIDDEN = 8
SLICE = 1 << 18

LETTER = np.zeros(256, np.float32)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(x * np.float32(0.5)) + np.float32(1))


class Direction:
    """One gated recurrent layer: gates z and r, candidate c, h = h + z (c - h)."""

    def __init__(self, random: np.random.Generator):
        h = HIDDEN
        self.params = {
            "E": random.normal(0, 0.3, (256, 3 * h)).astype(np.float32),  # of each byte, biases included
            "U": random.normal(0, 0.3, (h, 2 * h)).astype(np.float32),
            "V": random.normal(0, 0.3, (h, h)).astype(np.float32),
        }

    def forward(self, data: np.ndarray, keep: bool = False):
        """States (steps, rows, HIDDEN) of ``data`` (steps, rows) and what the way back needs."""
        h, (E, U, V) = HIDDEN, self.params.values()
        states = np.empty((*data.shape, h), np.float32)
        state, saved = np.zeros((data.shape[1], h), np.float32), []
        for t in range(len(data)):
            given = E[data[t]]
            gates = _sigmoid(given[:, : 2 * h] + state @ U)
            reset = gates[:, h:] * state
            new = np.tanh(given[:, 2 * h :] + reset @ V)
            if keep:
                saved.append((state, gates, reset, new))
            state = state + gates[:, :h] * (new - state)
            states[t] = state
        return states, saved

    def states(self, data: np.ndarray) -> np.ndarray:
        """``forward`` without keeping anything: the same steps in buffers that are used again."""
        h, rows, (E, U, V) = HIDDEN, data.shape[1], self.params.values()
        # tanh(x / 2) is the gates' sigmoid but for scale and shift
        e_gates, e_new, u = np.ascontiguousarray(E[:, : 2 * h]) / 2, np.ascontiguousarray(E[:, 2 * h :]), U / 2
        gates, more = np.empty((rows, 2 * h), np.float32), np.empty((rows, 2 * h), np.float32)
        new, given, reset = (np.empty((rows, h), np.float32) for _ in range(3))
        out = np.empty((*data.shape, h), np.float32)
        state = np.zeros((rows, h), np.float32)
        for t in range(len(data)):
            np.take(e_gates, data[t], 0, out=gates, mode="clip")
            np.matmul(state, u, out=more)
            gates += more
            np.tanh(gates, out=gates)
            gates *= np.float32(0.5)
            gates += np.float32(0.5)
            np.multiply(gates[:, h:], state, out=reset)
            np.matmul(reset, V, out=new)
            np.take(e_new, data[t], 0, out=given, mode="clip")
            new += given
            np.tanh(new, out=new)
            new -= state
            new *= gates[:, :h]
            np.add(state, new, out=out[t])
            state = out[t]
        return out

    def backward(self, data: np.ndarray, saved, back: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients, where ``back`` holds those of the states."""
        h, (E, U, V) = HIDDEN, self.params.values()
        out = {k: np.zeros_like(v) for k, v in self.params.items()}
        given = np.empty((*data.shape, 3 * h), np.float32)
        after = np.zeros((data.shape[1], h), np.float32)
        for t in range(len(data) - 1, -1, -1):
            state, gates, reset, new = saved[t]
            after = after + back[t]
            z, r = gates[:, :h], gates[:, h:]
            d_new = after * z * (1 - new * new)
            d_reset = d_new @ V.T
            d_gates = np.concatenate([after * (new - state), d_reset * state], 1) * gates * (1 - gates)
            out["V"] += reset.T @ d_new
            out["U"] += state.T @ d_gates
            given[t, :, : 2 * h], given[t, :, 2 * h :] = d_gates, d_new
            after = after * (1 - z) + d_reset * r + d_gates @ U.T
        flat = data.ravel()
        for k in range(3 * h):
            out["E"][:, k] = np.bincount(flat, given[:, :, k].ravel(), 256)
        return out


class Network:
    def __init__(self, languages: list[str], seed: int = 5):
        random = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.behind = Direction(random), Direction(random)
        self.top = {
            "W": random.normal(0, 0.3, (2 * HIDDEN, len(languages))).astype(np.float32),
            "b": np.zeros(len(languages), np.float32),
        }

    def positions(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities (WINDOW, rows, languages) of every position of ``windows`` (rows, WINDOW)."""
        data = np.ascontiguousarray(windows.T)
        a = self.ahead.states(data)
        b = np.ascontiguousarray(self.behind.states(np.ascontiguousarray(data[::-1]))[::-1])
        scores = a.reshape(-1, HIDDEN) @ self.top["W"][:HIDDEN]
        scores += b.reshape(-1, HIDDEN) @ self.top["W"][HIDDEN:]
        scores += self.top["b"]
        np.clip(scores, -40, 40, out=scores)  # float32 holds exp of these
        np.exp(scores, out=scores)
        scores /= (scores @ np.ones(scores.shape[1], np.float32))[:, None]
        return scores.reshape(*data.shape, -1)

    def gradients(self, windows: np.ndarray, labels: np.ndarray):
        """(loss, gradients in the order of ``all_params``): mean log loss over letter positions."""
        data = np.ascontiguousarray(windows.T)
        a, kept_a = self.ahead.forward(data, True)
        b, kept_b = self.behind.forward(data[::-1], True)
        both = np.concatenate([a, b[::-1]], -1)
        scores = both @ self.top["W"] + self.top["b"]
        scores -= scores.max(-1, keepdims=True)
        p = np.exp(scores)
        p /= p.sum(-1, keepdims=True)
        weight = LETTER[data] / max(1.0, float(LETTER[data].sum()))
        right = np.take_along_axis(p, np.broadcast_to(labels[None, :, None], (*data.shape, 1)), 2)[..., 0]
        loss = float(-(np.log(right + 1e-9) * weight).sum())
        p[:, np.arange(len(labels)), labels] -= 1
        p *= weight[..., None]
        flat = p.reshape(-1, p.shape[-1])
        back = p @ self.top["W"].T
        found = [
            *self.ahead.backward(data, kept_a, back[..., :HIDDEN]).values(),
            *self.behind.backward(data[::-1], kept_b, back[::-1, :, HIDDEN:]).values(),
            both.reshape(len(flat), -1).T @ flat,
            flat.sum(0),
        ]
        return loss, found

    def all_params(self) -> list[np.ndarray]:
        return [*self.ahead.params.values(), *self.behind.params.values(), *self.top.values()]

    def train(self, windows: np.ndarray, labels: np.ndarray, steps: int = 300, batch: int = 192, rate: float = 0.02, seed: int = 3):
        random = np.random.default_rng(seed)
        params = self.all_params()
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            at = random.integers(0, len(windows), batch)
            _, found = self.gradients(windows[at], labels[at])
            speed = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for p, g, m, v in zip(params, found, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def pooled(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Document probabilities of the texts ``data[bounds[i]:bounds[i + 1]]``."""
        n = len(bounds) - 1
        length = np.diff(bounds)
        pieces = -(-length // WINDOW)
        row = np.repeat(np.arange(n), pieces)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * WINDOW + bounds[:-1][row]
        total, weight = np.zeros((n, len(self.languages))), np.zeros(n)
        step = SLICE // WINDOW
        for at in range(0, len(row), step):
            r, s = row[at : at + step], start[at : at + step]
            place = s[:, None] + np.arange(WINDOW)
            real = place < bounds[r + 1][:, None]
            windows = np.where(real, data[np.minimum(place, len(data) - 1)], np.uint8(32))
            seen = np.where(real, LETTER[windows] + np.float32(1e-6), np.float32(0))
            p = self.positions(windows)
            mass = np.einsum("trk,tr->rk", p, np.ascontiguousarray(seen.T))
            for k in range(total.shape[1]):
                total[:, k] += np.bincount(r, mass[:, k], n)
            weight += np.bincount(r, seen.sum(1), n)
        return total / np.maximum(weight, 1e-12)[:, None]


def sample_windows(sample: DataFrame, per_text: int = 6) -> tuple[np.ndarray, list[str]]:
    """(windows, language of each) from evenly spread places of each sampled text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            lang = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            cut, of = [], []
            for i in range(texts.n):
                raw = texts.one(i)
                for at in np.unique(np.linspace(0, max(0, len(raw) - WINDOW), per_text).astype(int)):
                    cut.append(raw[at : at + WINDOW].ljust(WINDOW))
                    of.append(lang[i])
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary()), pa.array(of, pa.string())], ["cut", "lang"])

    got = sorted((r["cut"], r["lang"]) for r in sample.mapInArrow(work, "cut binary, lang string").toArrow().to_pylist())
    return np.frombuffer(b"".join(c for c, _ in got), np.uint8).reshape(-1, WINDOW), [x for _, x in got]


def fit(documents: DataFrame, use: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = 4000) -> Network | None:
    """A network learned from about ``most`` of the rows that ``use`` admits; None without any.

    The sample is drawn by a hash of key and text, and rows equal in both count once.
    """
    rows = documents.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & use)
    rows = rows.select(F.col(key).alias("_key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    total = rows.count()
    share = F.pmod(F.xxhash64("_key", "text"), F.lit(1 << 20)) < F.lit(min(1 << 20, (most << 20) // max(total, 1)))
    distinct = ["_key", "text", "lang"]
    windows, names = sample_windows(rows.filter(share).dropDuplicates(distinct).select("text", "lang"))
    if not names and total:  # few different rows, none of which the hash draws
        few = rows.dropDuplicates(distinct).orderBy(F.xxhash64("_key", "text"), *distinct).limit(most)
        windows, names = sample_windows(few.select("text", "lang"))
    if not names:
        return None
    network = Network(sorted(set(names)))
    network.train(windows, np.array([network.languages.index(x) for x in names]))
    return network


def predict(documents: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """``documents`` with ``lang_pred`` and ``score``, the pooled probability of that language.

    Columns of those names are replaced; the others pass through."""
    documents = documents.drop("lang_pred", "score")
    held = documents.sparkSession.sparkContext.broadcast(network)
    schema = StructType([*documents.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch, texts in slices(batches, text):
            blank = [not any(map(str.isalpha, texts.one(i).decode("utf-8", "replace"))) for i in range(texts.n)]
            if net is None:
                names, score = ["und"] * texts.n, np.zeros(texts.n)
            else:
                p = net.pooled(texts.data, texts.bounds)
                names = ["und" if blank[i] else net.languages[k] for i, k in enumerate(p.argmax(1))]
                score = np.where(blank, 0.0, np.clip(p.max(1), 0, 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"]
            )

    return documents.mapInArrow(work, schema)
