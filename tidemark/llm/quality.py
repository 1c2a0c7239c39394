"""Quality by ordinal cumulative-link regression on hashed text features.

One weight per feature is shared by all grades, and ordered thresholds cut the weighted sum
into grades: P(grade <= k) = logistic(threshold[k] - sum). The expected grade ranks documents
and the probability of at least ``keep_from`` selects them. Features are the presence of words,
runs of marks and banded statistics of the whole text.

Ratings are graded 0 to 2: 0 for low quality, 1 for good text that is toxic, 2 for good clean
text. Defined cases: a null or empty text has the bands of an empty one and no words. Without
labels every document has the top grade of a single grade 0 and is kept. A null ``doc_id``
counts as the id text '' for the split. Rows are scored one by one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import features, words
from tidemark.llm.common import remainder

#: About this many labelled rows are used for the fit, and this many features at most.
SAMPLE_ROWS = 8_000
VOCABULARY = 1_024


def extract(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words and shapes of each text together."""
    a, a_bounds = features.word_features(texts)
    b, b_bounds = features.shape_features(texts)
    parts = [
        np.concatenate([a[a_bounds[i] : a_bounds[i + 1]], b[b_bounds[i] : b_bounds[i + 1]]]) for i in range(len(texts))
    ]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), bounds


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class Model:
    vocabulary: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def at_least(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(texts, thresholds): the probability of a grade above each threshold."""
        z = np.zeros(len(bounds) - 1)
        text, place = features.presence(hashes, bounds, self.vocabulary)
        np.add.at(z, text, self.weights[place])
        return _logistic(z[:, None] - self.thresholds[None, :])


def fit(sets: list[np.ndarray], grades: np.ndarray, decay: float = 2e-3, rounds: int = 400) -> Model:
    """Accelerated gradient descent on the likelihood; gaps of thresholds are kept positive."""
    levels = int(grades.max()) if len(grades) else 0
    if levels == 0:
        return Model(np.empty(0, np.uint64), np.empty(0), np.empty(0))
    vocabulary = features.select_vocabulary(sets, grades, VOCABULARY)
    x = features.matrix(sets, vocabulary)
    n = len(grades)
    above = (grades[:, None] > np.arange(levels)[None, :]).mean(axis=0)
    cuts = -np.log(np.clip(above, 1e-3, 1 - 1e-3) / (1 - np.clip(above, 1e-3, 1 - 1e-3)))
    cuts = np.maximum.accumulate(cuts + 1e-3 * np.arange(levels))
    state = np.concatenate([np.zeros(len(vocabulary)), cuts])
    ahead, pace = state.copy(), 1.0
    step = 1 / (0.5 * features.top_curvature(x) + decay + 1)
    for _ in range(rounds):
        w, t = ahead[: len(vocabulary)], ahead[len(vocabulary) :]
        bounds = np.concatenate([[-np.inf], t, [np.inf]])
        z = (x @ w.astype(np.float32)).astype(float)
        g = grades.astype(int)
        high, low = _logistic(bounds[g + 1] - z), _logistic(bounds[g] - z)
        high[g == levels], low[g == 0] = 1, 0
        mass = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / mass, low * (1 - low) / mass  # slopes of log mass in each threshold
        gradient = np.concatenate([(x.T @ (d_high - d_low).astype(np.float32)).astype(float) / n + decay * w, np.zeros(levels)])
        for k in range(levels):
            gradient[len(vocabulary) + k] = (d_low[g == k + 1].sum() - d_high[g == k].sum()) / n
        fresh = ahead - step * gradient
        cuts = fresh[len(vocabulary) :]
        fresh[len(vocabulary) :] = np.maximum.accumulate(cuts + 1e-6 * np.arange(levels))
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = fresh + (pace - 1) / faster * (fresh - state)
        ahead[len(vocabulary) :] = np.maximum.accumulate(ahead[len(vocabulary) :] + 1e-6 * np.arange(levels))
        state, pace = fresh, faster
    return Model(vocabulary, state[: len(vocabulary)], state[len(vocabulary) :])


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from labels 0/1 of quality and toxicity."""
    good = labels["quality"].cast("int")
    clean = 1 - F.coalesce(labels["toxic"].cast("int"), F.lit(0))
    return labels.select("doc_id", F.when(good == 0, 0).when(good == 1, 1 + clean).alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, column: str = "grade") -> Model:
    return fit(*features.labelled_sample(docs, ratings, column, SAMPLE_ROWS, extract))


def quality(docs: DataFrame, ratings: DataFrame, keep_from: int = 1, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, expected_grade, tail_probability, kept) for every row of ``docs``.

    ``tail_probability`` is that of grade ``keep_from`` or better.
    """
    model = train(docs, ratings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in words.pieces(whole, "text"):
                above = model.at_least(*extract(batch["text"]))
                tail = above[:, keep_from - 1] if above.shape[1] >= keep_from else np.ones(len(batch))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], pa.array(above.sum(axis=1)), pa.array(tail)], names=["doc_id", "expected_grade", "tail_probability"]
                )

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    scored = texts.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double")
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "expected_grade",
        "tail_probability",
        (F.col("tail_probability") >= threshold).alias("kept"),
    )
