"""Token ids of a public word-BPE tokenizer for whole batches.

``encode`` gives exactly the ids of the ``tokenizers`` library for that file, but merges each
distinct word of a batch once: texts are cut into words by numpy, the distinct words go
through ``tiktoken`` with the file's merges as ranks (the end-of-word mark as a zero byte),
and the ids are gathered for all words. A text with any character outside the plain ranges
below, or with the start of a special token, goes to the library itself.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import tiktoken

from tidemark.llm import words

_LETTER, _DIGIT, _SPACE, _OTHER, _RARE = range(5)
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")  # fixed value: the tokenizer's pattern


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def _classes() -> np.ndarray:
    kinds = np.full(0x250, _RARE, np.uint8)
    for c in range(0x250):
        group = unicodedata.category(chr(c))[0]
        kinds[c] = {"L": _LETTER, "N": _DIGIT, "P": _OTHER, "S": _OTHER}.get(group, _RARE)
    kinds[[9, 10, 11, 12, 13, 32, 0xA0]] = _SPACE
    return kinds


class Subwords:
    """One tokenizer file; see the module's text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        end, letters, vocabulary = "</w>", _byte_letters(), model["vocab"]

        def as_bytes(token: str) -> bytes:
            ends = token.endswith(end)
            return bytes(letters[c] for c in (token[: -len(end)] if ends else token)) + b"\0" * ends

        order = [c for c in letters] + [c + end for c in letters]
        order += ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ranks: dict[bytes, int] = {}
        ids = []
        for token in order:
            key = as_bytes(token)
            if key not in ranks:
                ranks[key] = len(ids)
                ids.append(vocabulary[token])
        self._merge = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self._ids = np.array(ids, np.uint32)
        self._ends = np.zeros(len(ids), bool)
        for key, rank in ranks.items():
            self._ends[rank] = key.endswith(b"\0") and len(key) > 1

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text, without special tokens added."""
        lowered = [t.lower() if t.isascii() else unicodedata.normalize("NFC", t).lower() for t in texts]
        kinds = _classes()
        points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.where(points < len(kinds), kinds[np.minimum(points, len(kinds) - 1)], _RARE)
        lengths = np.array([len(t) for t in lowered])
        begins = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1] if len(lengths) else np.zeros(0, int)
        out: list[np.ndarray | None] = [None] * len(texts)
        odd = np.flatnonzero(kind == _RARE)
        rare = set(np.searchsorted(begins, odd, "right") - 1) | {i for i, t in enumerate(lowered) if "<|" in t}
        if rare:
            order = sorted(rare)
            encoded = self._whole.encode_batch([texts[i] for i in order], add_special_tokens=False)
            for i, e in zip(order, encoded, strict=True):
                out[i] = np.array(e.ids, np.uint32)
        if len(rare) < len(texts):
            ids, counts, starts = self._words("\n".join(lowered), points, kind)
            ends = np.concatenate([[0], np.cumsum(counts)])
            cuts = ends[np.searchsorted(starts, np.append(begins, len(points) + 1))]
            for i in range(len(texts)):
                if out[i] is None:
                    out[i] = ids[cuts[i] : cuts[i + 1]]
        return out

    def _words(self, text: str, points: np.ndarray, kind: np.ndarray):
        """(ids, ids per word, where words start) of the pre-tokens of ``text``."""
        changes = np.empty(len(kind), bool)
        changes[:1] = True
        changes[1:] = kind[1:] != kind[:-1]
        changes |= kind == _DIGIT  # each digit is a word
        starts = np.flatnonzero(changes)
        ends = np.append(starts[1:], len(kind))
        # An apostrophe alone before letters takes a contraction's letters along.
        quote = np.flatnonzero((points[starts] == 39) & (ends - starts == 1) & (ends < len(kind)))
        moved = [
            (int(w), len(c))
            for w in quote[kind[np.minimum(ends[quote], len(kind) - 1)] == _LETTER]
            for c in [next((c for c in _CONTRACTIONS if text.startswith(c, int(ends[w]))), "")]
            if c and int(ends[w]) + len(c) <= int(ends[w + 1])
        ]
        for w, n in moved:
            ends[w] += n
            starts[w + 1] += n
        first_kind = kind[np.minimum(starts, len(kind) - 1)]
        real = (first_kind != _SPACE) & (first_kind != _RARE) & (starts < ends)
        for w, _ in moved:
            real[w] = True
        starts, ends = starts[real], ends[real]
        if not len(starts):
            return np.empty(0, np.uint32), np.empty(0, np.int64), starts
        table = words.mix(np.arange(0x250, dtype=np.uint64), 31) | np.uint64(1)
        hashes = words.hash_spans(table[np.minimum(points, 0x24F)], starts, ends)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        joined = "\0".join([text[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]) + "\0"
        ranks = np.array(self._merge.encode_ordinary(joined), np.int64)
        word_end = np.flatnonzero(self._ends[ranks]) + 1
        word_start = np.concatenate([[0], word_end[:-1]])
        counts = (word_end - word_start)[which]
        at = np.cumsum(counts) - counts
        index = np.arange(int(counts.sum())) - np.repeat(at - word_start[which], counts)
        return self._ids[ranks][index], counts, starts


@functools.lru_cache(maxsize=4)
def load(path: str) -> Subwords:
    return Subwords(path)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch[column].to_pylist()]
