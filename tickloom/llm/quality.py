"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

Training sees a bounded sample of labelled rows (``most``, 6,000 by default): the executors
hash their features, the driver holds those alone. Scoring is a map over whole texts with a
broadcast table of 2^22 weights (16 MB); nothing is shuffled.

Defined results: null and empty texts score the bias alone; without labels every text scores
0.5; repeated rows are scored each; extra columns pass through unless named ``score``, which
is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.hashed import SLOTS, ftrl, labelled, sampled_features, scored, values

KINDS = "wpsq"
#: chosen on a part of the rows that may be learned from, by what is learned from the others
EPOCHS, ALPHA, L1 = 4, 1.0, 0.02


def fit(documents: DataFrame, labels: DataFrame, use: Column, key="doc_id", text="text", target="quality", most: int = 6000):
    """(weights, bias) learned from about ``most`` of the labelled rows that ``use`` admits."""
    rows = sampled_features(labelled(documents, labels, target, key, text, use, most), KINDS)
    examples = [(slots, values(np.zeros(len(slots), np.int64), counts, 1, True), label, 1.0) for slots, counts, label in rows]
    return ftrl(examples, epochs=EPOCHS, alpha=ALPHA, l1=L1) if examples else (np.zeros(SLOTS), 0.0)


def score_quality(documents: DataFrame, model, text: str = "text", cut: float = 0.3) -> DataFrame:
    """``documents`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is at least ``cut``)."""
    out = scored(documents.drop("score", "predicted"), *model, KINDS, True, text)
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
