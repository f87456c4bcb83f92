"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters say toxic (1), clean (-1) or nothing (0) about a text; there are ``LEXICONS`` lexicon
voters, the pattern voters and ``COUNTERS`` voters on counts. A lexicon holds words (runs of letters)
that a bounded sample of labelled rows ties to the label; the words are dealt to the lexicons
by a hash, so that each lexicon is small and any two err apart. It says toxic of a text that
holds one of its words, and nothing of others. A pattern says toxic where it matches, and
nothing elsewhere. The counters say toxic of several lexicon words, and clean of a text, or of a
long one, without any.

The label model gives each voter its vote probabilities per class, which tell its accuracy
and how often it abstains, and estimates them by expectation maximisation from the votes
alone, beginning with their majority. Voters whose votes stay correlated within the classes are found
from the residual correlations and modelled pair by pair, as one joint voter. The classifier is
a logistic regression on the words of the lexicons, trained on the posterior labels of the
sample's rows; it alone scores the corpus, as a map.

Defined results: null and empty texts score the bias alone; without labels every text
scores 0; repeated rows are scored each; extra columns pass through unless named ``score``
or ``predicted``, which are replaced. Rows of one key in the sample, equal in text, count once.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.hashed import SLOTS, ftrl, labelled, sampled_features, scored, sigmoid
from tickloom.llm.textkit import mix

KINDS = "l"
LEXICONS = 24
COUNTERS = 2
LONG = 20
CUT = 0.3
#: chosen on a part of the rows that may be learned from: a lexicon word occurs in so many toxic rows of the sample, and so many times likelier than in others
LEAST_ROWS, LEAST_RATIO = 3, 20.0

#: fixed patterns; each matches a text that may be toxic
PATTERNS = [
    re.compile(r"\b(?:idiot|moron|stupid|loser|scum)s?\b", re.I),
    re.compile(r"\b(?:trash|worthless|pathetic|disgusting|clown)s?\b", re.I),
    re.compile(r"\b(?:hate|kill|shut up|die)\b", re.I),
    re.compile(r"\byou(?: are|'re)? (?:an? )?(?:idiot|moron|loser|clown)", re.I),
    re.compile(r"\b(?:dumb|ugly|freak|jerk|creep)s?\b", re.I),
    re.compile(r"[A-Z]{4,}[^a-z]{0,40}!!"),
]


def mine_lexicons(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Of each slot: the lexicon (0 to ``LEXICONS`` - 1) that holds it, or -1."""
    seen = np.zeros((2, SLOTS), np.int32)
    n = np.ones(2)
    for slots, _, label in rows:
        seen[int(label > 0), slots] += 1
        n[int(label > 0)] += 1
    often = np.flatnonzero(seen[1] >= LEAST_ROWS)  # few of the slots: whole tables of them are large
    ratio = ((seen[1, often] + 0.1) / n[1]) / ((seen[0, often] + 0.5) / n[0])
    often = often[ratio > LEAST_RATIO]
    lexicon = np.full(SLOTS, -1, np.int8)
    lexicon[often] = mix(often.astype(np.uint64)) % np.uint64(LEXICONS)
    return lexicon


def votes_of(slots: np.ndarray, patterns: list[int], lexicon: np.ndarray) -> np.ndarray:
    """All voters' votes on a text: lexicons, counters, patterns."""
    hits = lexicon[slots]
    hits = hits[hits >= 0]
    votes = np.zeros(LEXICONS + COUNTERS + len(patterns), np.int64)
    votes[hits] = 1
    votes[LEXICONS] = 1 if len(hits) > 1 else -1 if not len(hits) else 0
    votes[LEXICONS + 1] = -1 if not len(hits) and len(slots) >= LONG else 0
    votes[LEXICONS + COUNTERS :] = patterns
    return votes


def _tables(votes: np.ndarray, groups: list[tuple[int, ...]]) -> list[np.ndarray]:
    """For each group of voters, each row's joint vote as one number."""
    return [sum((votes[:, v] + 1) * 3**i for i, v in enumerate(g)) for g in groups]


def _maximise(codes: list[np.ndarray], groups, toxic: np.ndarray):
    """Class share and, per group, the probability of each joint vote in either class."""
    tables = []
    for code, g in zip(codes, groups):
        size = 3 ** len(g)
        t = np.stack([np.bincount(code, 1 - toxic, size), np.bincount(code, toxic, size)]) + 0.5
        tables.append(t / t.sum(1, keepdims=True))
    return float(np.clip(toxic.mean(), 1e-4, 1 - 1e-4)), tables


def _expect(codes, share: float, tables) -> np.ndarray:
    odds = np.log(share / (1 - share)) + sum(np.log(t[1][c] / t[0][c]) for c, t in zip(codes, tables))
    return sigmoid(odds)


def label_model(votes: np.ndarray, rounds: int = 30, correlated: float = 0.2):
    """(posterior of each row, pairs of correlated voters) of votes -1, 0, 1 (rows, voters).

    The first posteriors follow the sum of the votes. After ``rounds`` of expectation
    maximisation with voters independent, the strongest residual correlations above
    ``correlated`` are paired off, each voter once, and the rounds repeat on joint votes.
    """
    groups: list[tuple[int, ...]] = [(v,) for v in range(votes.shape[1])]
    start = sigmoid(1.5 * votes.sum(1) - 1.0)

    def run(groups):
        toxic, codes = start, _tables(votes, groups)
        for _ in range(rounds):
            toxic = _expect(codes, *_maximise(codes, groups, toxic))
        return toxic

    toxic = run(groups)
    rest = votes - np.outer(toxic, (toxic @ votes) / max(toxic.sum(), 1e-9))
    rest = rest - np.outer(1 - toxic, ((1 - toxic) @ votes) / max((1 - toxic).sum(), 1e-9))
    norm = np.sqrt((rest**2).sum(0)) + 1e-9
    strength = np.abs(rest.T @ rest) / np.outer(norm, norm)
    pairs, free = [], set(range(votes.shape[1]))
    for i, j in sorted(((i, j) for i in free for j in free if i < j), key=lambda p: -strength[p]):
        if strength[i, j] > correlated and i in free and j in free:
            pairs.append((i, j))
            free -= {i, j}
    if pairs:
        toxic = run(pairs + [(v,) for v in sorted(free)])
    return toxic, pairs


def fit(documents: DataFrame, labels: DataFrame, use: Column, key="doc_id", text="text", target="toxic", most: int = 8000):
    """(weights, bias) learned from about ``most`` labelled rows that ``use`` admits."""
    sample = labelled(documents, labels, target, key, text, use, most)
    hits = [F.coalesce(F.regexp_like("text", F.lit(("(?i)" if p.flags & re.I else "") + p.pattern)), F.lit(False)).cast("int") for p in PATTERNS]
    # one pass: pattern votes travel in the label's higher digits
    coded = sample.select("text", (F.col("label") + 2 * sum((h * 2**i for i, h in enumerate(hits)), F.lit(0))).alias("label"))
    rows = [(s, c, int(x)) for s, c, x in sampled_features(coded, KINDS)]
    if not rows:
        return np.zeros(SLOTS), -35.0
    lexicon = mine_lexicons([(slots, counts, x & 1) for slots, counts, x in rows])
    votes = np.array([votes_of(slots, [x >> 1 + i & 1 for i in range(len(PATTERNS))], lexicon) for slots, _, x in rows])
    posterior, _ = label_model(votes)
    words = [slots[lexicon[slots] >= 0] for slots, _, _ in rows]
    examples = [(w, np.ones(len(w)), float(p), 1.0) for w, p in zip(words, posterior)]
    return ftrl(examples, epochs=10, alpha=0.5, l1=0.0)


def score_toxicity(documents: DataFrame, model, text: str = "text") -> DataFrame:
    """``documents`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is at least 0.3)."""
    out = scored(documents.drop("score", "predicted"), *model, KINDS, False, text)
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
