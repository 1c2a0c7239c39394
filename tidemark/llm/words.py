"""Words, shingles and their 64-bit hashes for whole Arrow batches, in numpy.

A word's hash is a polynomial over its bytes modulo 2**64, mixed at the end, so that it is
the same in every task and Python process. Work arrays cover a bounded number of words at a
time, whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORDS_AT_ONCE = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer (the public splitmix64 finaliser), salted."""
    z = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def byte_table(breaks: bytes) -> np.ndarray:
    """A value for each byte: 0 for those that separate words, A-Z like a-z."""
    values = np.arange(256, dtype=np.uint64)
    values[65:91] += np.uint64(32)
    values = mix(values, 1) | np.uint64(1)
    values[list(breaks)] = 0
    return values


#: Fixed value of the query contracts: ASCII white space separates words.
SPACES = byte_table(b" \t\n\x0b\x0c\r")

_powers = np.ones(1, dtype=np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        factors = np.full(max(n, 2 * len(_powers)), _BASE)
        factors[0] = 1
        _powers = np.multiply.accumulate(factors)
    return _powers


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets): text i is bytes[offsets[i]:offsets[i + 1]]; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and data.size else np.empty(0, np.uint8)
    return flat, offsets - offsets[0]


def word_bounds(flat: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True in ``is_word``; no run crosses a text's end."""
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    begins, stops = offsets[:-1], offsets[1:]
    full = stops > begins
    first[begins[full]] |= is_word[begins[full]]
    last[stops[full] - 1] |= is_word[stops[full] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_words(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    hashes = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), _WORDS_AT_ONCE):
        begin, end = starts[at : at + _WORDS_AT_ONCE], ends[at : at + _WORDS_AT_ONCE]
        lo, hi = begin[0], end[-1]
        longest = int((end - begin).max())
        spans = np.diff(np.append(begin, hi))
        place = np.arange(hi - lo, dtype=np.int64) - np.repeat(begin - lo, spans)
        np.minimum(place, longest, out=place)  # what lies between words counts 0 anyway
        values = table[flat[lo:hi]] * _power_table(longest + 1)[place]
        hashes[at : at + len(begin)] = np.add.reduceat(values, begin - lo)
    return mix(hashes)


def hash_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of ``values`` (one 64-bit value per place) in order of their starts.

    Unlike words, spans may touch, and what lies between them is not looked at.
    """
    hashes = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), _WORDS_AT_ONCE):
        begin, end = starts[at : at + _WORDS_AT_ONCE], ends[at : at + _WORDS_AT_ONCE]
        lo, hi = begin[0], end[-1]
        spans = np.diff(np.append(begin, hi))
        place = np.arange(hi - lo, dtype=np.int64) - np.repeat(begin - lo, spans)
        inside = place < np.repeat(end - begin, spans)
        longest = int((end - begin).max())
        part = values[lo:hi] * _power_table(longest + 1)[np.minimum(place, longest)]
        part[~inside] = 0
        hashes[at : at + len(begin)] = np.add.reduceat(part, begin - lo)
    return mix(hashes)


def words_of(texts: pa.Array, table: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, bounds): the words of text i are hashes[bounds[i]:bounds[i + 1]]."""
    flat, offsets = flat_bytes(texts)
    starts, ends = word_bounds(flat, offsets, table[flat] != 0)
    return hash_words(flat, starts, ends, table), np.searchsorted(starts, offsets)


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word shingles.

    A text of fewer words has its whole sequence as the one shingle; without words none.
    """
    weights = mix(np.arange(1, k + 1, dtype=np.uint64), 7) | np.uint64(1)
    n = max(0, len(hashes) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled += hashes[j : j + n] * weights[j]
    rolled = mix(rolled, 2)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= k:
            yield np.unique(rolled[lo : hi - k + 1])
        elif hi > lo:
            short = (hashes[lo:hi] * weights[: hi - lo]).sum(dtype=np.uint64, keepdims=True)
            yield mix(short, 100 + int(hi - lo))
        else:
            yield hashes[:0]


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose texts have about ``most_bytes`` together, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, before + most_bytes, "right")))
        yield batch.slice(at, stop - at)
        at = stop
