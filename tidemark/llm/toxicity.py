"""Toxicity by a counterfactually regularised classifier on hashed words.

A logistic model on the presence of words is fitted on a bounded labelled sample. In every
labelled text that mentions a group, the group's term is swapped for each other term of its
family and for no mention at all; the squared change of the text's score (in logits), averaged
over the swaps of a mention, is a penalty of the fit, so a neutral mention of a group hardly
moves a score. A swap for a term that the text has already only takes the first term away, and
is counted so. A group's term gives its whole word as a feature and no beginnings, so a swap
changes nothing but the two terms. The fitted weights go to the tasks (their number is bounded),
which score every whole text.

Defined cases: a null or empty text has no words and gets the score of the intercept. Without
labels, or with one class only, every score is the smoothed share of toxic labels, 0 if there
are none. A null ``doc_id`` counts as the id text '' for the split. Rows are scored one by one.
Other columns are ignored.
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

# Neutral names of groups, in the languages of the documents. A line is a family: its terms
# name groups of one kind, and one stands for another without a change of grammar.
FAMILIES = [line.split() for line in """
women men
woman man
female male
gay lesbian straight trans queer
black white asian african latino arab
jewish muslim christian hindu buddhist atheist
jews muslims christians
immigrant refugee
immigrants refugees
disabled deaf blind
old young elderly
mujeres hombres
negro blanco
musulmanes cristianos
inmigrantes
frauen
schwarze
juden muslime christen
femmes hommes
noirs
juifs musulmans
""".strip().splitlines()]
#: Weight of the penalty against the loss.
FAIRNESS = 20.0


def _hashes(family: list[str]) -> np.ndarray:
    return np.array([features.hash_word(t) for t in family], np.uint64)


_TERMS = np.unique(np.concatenate([_hashes(f) for f in FAMILIES]))


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): words and their beginnings, identity terms as whole words only."""
    return features.word_features(texts, _TERMS)


@dataclass(frozen=True)
class Model:
    vocabulary: np.ndarray  # sorted hashes
    weights: np.ndarray
    intercept: float

    def score(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        z = np.full(len(bounds) - 1, self.intercept)
        text, place = features.presence(hashes, bounds, self.vocabulary)
        np.add.at(z, text, self.weights[place])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def swap_penalty(mentions: np.ndarray, families: list[np.ndarray]) -> np.ndarray:
    """The matrix ``q`` with ``w @ q @ w`` as the sum of squared score changes over all swaps.

    ``mentions``: texts by terms, 1 where the text has the term; ``w``: the terms' weights;
    ``families``: the columns of each family. Swapping t for u in a text changes its score by
    w[u] - w[t], or by -w[t] if it has u already or the mention is dropped. Each mention
    counts 1, in equal shares over its swaps. What texts add depends on the terms they
    have only, so the sum needs how many have both terms of a pair.
    """
    both = (mentions.T @ mentions).astype(float)
    q = np.zeros_like(both)
    for family in families:
        share = 1 / len(family)
        for t in family:
            q[t, t] += share * both[t, t]  # dropped
            for u in family:
                if u != t:
                    q[t, t] += share * both[t, t]
                    alone = share * (both[t, t] - both[t, u])
                    q[u, u] += alone
                    q[t, u] -= alone
                    q[u, t] -= alone
    return q


def fit(
    sets: list[np.ndarray], y: np.ndarray, families: list[list[str]] = FAMILIES, fairness: float = FAIRNESS, sparsity: float = 2e-4, rounds: int = 400
) -> Model:
    """Accelerated proximal gradient descent on loss, counterfactual penalty and sparsity."""
    n = len(y)
    if n == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (n + 1) if n and y.any() else 0.0
        return Model(np.empty(0, np.uint64), np.empty(0), float(np.log(share / (1 - share))) if share else -40.0)
    hashed = [_hashes(f) for f in families]
    group = np.unique(np.concatenate(hashed)) if hashed else np.empty(0, np.uint64)
    vocabulary = features.select_vocabulary(sets, y, VOCABULARY, always=group)
    x = features.matrix(sets, vocabulary)
    is_group = np.isin(vocabulary, group)
    swaps = swap_penalty(x[:, is_group], [np.searchsorted(group, f) for f in hashed]) / n
    weights, intercept = np.zeros(len(vocabulary)), float(np.log(y.mean() / (1 - y.mean())))
    steepest = float(np.linalg.eigvalsh(swaps)[-1]) if len(group) else 0.0
    curvature = 0.25 * features.top_curvature(x) + 0.25 + 2 * fairness * max(steepest, 0.0)
    step, ahead, ahead_b, pace = 1 / curvature, weights.copy(), intercept, 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(x @ ahead.astype(np.float32) + ahead_b, -40, 40))) - y
        gradient = (x.T @ error.astype(np.float32)).astype(float) / n
        gradient[is_group] += 2 * fairness * (swaps @ ahead[is_group])
        moved = ahead - step * gradient
        fresh = np.sign(moved) * np.maximum(np.abs(moved) - step * sparsity, 0)
        fresh_b = ahead_b - step * float(error.mean())
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, ahead_b = fresh + (pace - 1) / faster * (fresh - weights), fresh_b + (pace - 1) / faster * (fresh_b - intercept)
        weights, intercept, pace = fresh, fresh_b, faster
    used = weights != 0
    return Model(vocabulary[used], weights[used], intercept)


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> Model:
    """The model of the labelled documents whose id is not held out."""
    return fit(*features.labelled_sample(docs, labels, column, SAMPLE_ROWS, text_features))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, row_hash, score) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in words.pieces(whole, "text"):
                scores = model.score(*text_features(batch["text"]))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row_hash"], pa.array(scores)], names=["doc_id", "row_hash", "score"])

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("row_hash"), docs["text"].alias("text"))
    return texts.mapInArrow(run, "doc_id long, row_hash long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, unchanged."""
    names = docs.columns
    column = "text_" + "_".join(names)  # free, whatever the other columns are called

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in words.pieces(whole, column):
                clean = model.score(*text_features(batch[column])) < threshold
                yield batch.filter(pa.array(clean)).drop_columns([column])

    return docs.withColumn(column, docs["text"]).mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    scored = score(docs, train(docs, labels))
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
