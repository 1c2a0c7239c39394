"""Hashed text features for the classifiers, and the bounded labelled sample they are fitted on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.common import remainder

#: Words are runs of ASCII letters and of bytes outside ASCII; A-Z count as a-z.
LETTERS = words.byte_table(bytes(b for b in range(128) if not chr(b).isalpha()))
#: Marks are runs of other visible ASCII characters.
MARKS = words.byte_table(bytes(b for b in range(256) if b <= 32 or b >= 127 or chr(b).isalpha()))


def hash_word(word: str) -> np.uint64:
    """The feature of one word, as :func:`word_features` gives it."""
    return words.words_of(pa.array([word]), LETTERS)[0][0]


#: Longer words also give their beginnings of these lengths in bytes, for stems with many endings.
PREFIXES = (4, 5, 6, 7, 8, 9)


def word_features(texts: pa.Array, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the words of each text and their beginnings, repeated ones included.

    Words whose hash is in ``whole`` give no beginnings.
    """
    flat, offsets = words.flat_bytes(texts)
    values = LETTERS[flat]
    starts, ends = words.word_bounds(flat, offsets, values != 0)
    found = [words.hash_words(flat, starts, ends, LETTERS)]
    places = [starts]
    cut = np.ones(len(starts), bool) if whole is None else ~np.isin(found[0], whole)
    for length in PREFIXES:
        longer = np.flatnonzero((ends - starts > length) & cut)
        if len(longer):
            begin = starts[longer]
            found.append(words.mix(words.hash_spans(values, begin, begin + length), 50 + length))
            places.append(begin)
    text = np.searchsorted(offsets, np.concatenate(places), "right") - 1
    order = np.argsort(text, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(text[order], np.arange(len(offsets)))


def shape_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): runs of marks and banded statistics of each text.

    The statistics are shares of the whole text: capitals, digits, marks, distinct words,
    the most frequent word, words per line, characters per word.
    """
    flat, offsets = words.flat_bytes(texts)
    marks, mark_bounds = words.words_of(texts, MARKS)
    hashes, bounds = words.words_of(texts, LETTERS)
    n = len(offsets) - 1

    def share(of: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(of, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    size = np.maximum(np.diff(offsets), 1)
    count = np.diff(bounds)
    letters = np.maximum(share(LETTERS[flat] != 0), 1)
    distinct, most = np.zeros(n), np.zeros(n)
    for i in range(n):
        if count[i]:
            _, times = np.unique(hashes[bounds[i] : bounds[i + 1]], return_counts=True)
            distinct[i], most[i] = len(times), times.max()
    known = np.maximum(count, 1)
    bands = [
        np.floor(10 * share((flat >= 65) & (flat <= 90)) / letters),
        np.floor(20 * share((flat >= 48) & (flat <= 57)) / size),
        np.floor(20 * share(MARKS[flat] != 0) / size),
        # Longer texts repeat words anyway, so the share is seen beside the length.
        np.floor(10 * distinct / known) + 100 * np.minimum(np.floor(np.log2(known)), 12),
        np.floor(10 * most / known) + 100 * np.minimum(np.floor(np.log2(known)), 12),
        np.floor(np.log2(known / (1 + share(flat == 10)) + 1)),
        np.minimum(np.floor(letters / known), 20),
        np.floor(np.log2(count + 1)),
    ]
    bands = np.stack(bands, axis=1).astype(np.int64).view(np.uint64)
    banded = words.mix(bands + np.arange(bands.shape[1], dtype=np.uint64) * np.uint64(1 << 32), 41)
    parts = [np.concatenate([words.mix(marks[mark_bounds[i] : mark_bounds[i + 1]], 42), banded[i]]) for i in range(n)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if n else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def presence(hashes: np.ndarray, bounds: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of each feature of the sorted ``vocabulary`` that a text has, once each."""
    place = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
    known = np.flatnonzero(vocabulary[place] == hashes) if len(vocabulary) else np.empty(0, int)
    text = np.searchsorted(bounds, known, "right") - 1
    both = np.unique(text * max(len(vocabulary), 1) + place[known])
    return both // max(len(vocabulary), 1), both % max(len(vocabulary), 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most_rows: int, extract, holdout: int = 5):
    """(sets of features, labels) of about ``most_rows`` labelled documents at most.

    Only documents whose remainder (see ``remainder``) is not 0 are used. The sample is drawn
    by a hash of the id, so it does not depend on the order or the partitions. Of several
    labels of one id the largest counts; null ids and labels do not.
    """
    wanted = labels.select(labels["doc_id"].alias("_id"), labels[column].alias("_y"))
    wanted = wanted.where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & (remainder(F.col("_id"), holdout) != 0))
    wanted = wanted.groupBy("_id").agg(F.max("_y").alias("_y"))
    share = min(1.0, most_rows / max(1, wanted.count()))
    drawn = wanted.where(F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(docs["doc_id"].alias("_id"), docs["text"].alias("text"))
    rows = texts.join(F.broadcast(drawn), "_id").select("_id", "_y", "text")  # most_rows rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in words.pieces(whole, "text"):
                hashes, bounds = extract(batch["text"])
                sets = [np.unique(hashes[lo:hi]).tobytes() for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch["_id"].cast(pa.int64()), batch["_y"].cast(pa.float64()), pa.array(sets, pa.binary())], names=["id", "y", "found"]
                )

    got = rows.mapInArrow(run, "id long, y double, found binary").toArrow()
    got = got.sort_by([("id", "ascending")])
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in got["found"]], got["y"].to_numpy()


_CHUNK = 400  # texts whose features are looked at together


def _counted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of the sets, and how many sets have each."""
    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for lo in range(0, len(sets), _CHUNK):
        more, times = np.unique(np.concatenate(sets[lo : lo + _CHUNK]), return_counts=True)
        merged = np.union1d(keys, more)
        total = np.zeros(len(merged), np.int64)
        total[np.searchsorted(merged, keys)] += counts
        total[np.searchsorted(merged, more)] += times
        keys, counts = merged, total
    return keys, counts


def select_vocabulary(sets: list[np.ndarray], y: np.ndarray, most: int, least_texts: int = 4, always=()) -> np.ndarray:
    """The sorted features whose frequency depends most on the label (by the G statistic)."""
    if not sets:
        return np.unique(np.array(always, np.uint64))
    grades = np.unique(y)
    counted = [_counted([s for s, own in zip(sets, y, strict=True) if own == g]) for g in grades]
    every = np.unique(np.concatenate([keys for keys, _ in counted]))
    seen = np.zeros((len(grades), len(every)))
    for row, (keys, counts) in zip(seen, counted, strict=True):
        row[np.searchsorted(every, keys)] = counts
    total = np.array([(y == g).sum() for g in grades], float)
    together = seen.sum(axis=0)
    expected = total[:, None] / total.sum() * together[None, :]
    absent = total[:, None] - seen
    absent_expected = total[:, None] - expected
    with np.errstate(divide="ignore", invalid="ignore"):
        g = np.nansum(seen * np.log(seen / expected), axis=0) + np.nansum(absent * np.log(absent / absent_expected), axis=0)
    g[together < least_texts] = 0
    order = np.argsort(-g, kind="stable")[:most]
    best = every[order[g[order] > 8]]
    return np.unique(np.concatenate([best, np.array(always, np.uint64)]))


def matrix(sets: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    x = np.zeros((len(sets), len(vocabulary)), np.float32)
    for lo in range(0, len(sets) if len(vocabulary) else 0, _CHUNK):
        part = sets[lo : lo + _CHUNK]
        rows, columns = presence(np.concatenate(part), np.concatenate([[0], np.cumsum([len(s) for s in part])]), vocabulary)
        x[lo + rows, columns] = 1
    return x


def top_curvature(x: np.ndarray) -> float:
    """The largest eigenvalue of x'x / rows, by power iteration, a little enlarged."""
    v = np.ones(x.shape[1], np.float32)
    value = 0.0
    for _ in range(30):
        norm = float(np.linalg.norm(v))
        if norm == 0:
            break
        v = x.T @ (x @ (v / np.float32(norm)))
        value = float(np.linalg.norm(v))
    return 1.1 * value / max(1, len(x))
