"""Log-probabilities of texts by causal self-attention on subword ids, mixed with word counts.

One pass over the corpus counts the words and the subwords of every training document and keeps
all its windows, in batches ordered by a hash. The attention model starts on a bounded sample of
these batches on the driver; then every task trains on all the windows it has, which together
are every window of every training document, and the weights of the tasks are averaged. A second pass scores all texts:
overlapping windows score every subword once.

The tokens of a text are its words and the end, and the events are those of the add-one base:
each word of the training vocabulary, and a word outside of it. The latter has the probability
``u`` that Good and Turing give it, from the words seen once. A known word shares the rest: an
equal mixture of its share of the corpus and of the attention model's probability of its
subwords, given that a word begins and another follows, so the sum over all words is one at
most. ``spelled_score`` also charges unknown words for their subwords.

Counts of frequent words (a bounded number) go to the tasks; occurrences of the others meet
their counts in a join, with the model's probability beside them.

Defined cases: a null or empty text is one end token. Repeated rows are each scored. Without
training documents nothing is known and the untrained model scores. A null ``doc_id`` counts
as the id text '' for the split. Other columns are ignored.
"""

from __future__ import annotations

import base64
import contextlib
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import attention, words
from tidemark.llm.common import remainder, written

#: Windows in a stored batch, at most.
STORED = 1_024
#: Stored batches that go to a task at a time, at most (some 70 KB each).
ROWS_AT_ONCE = 64
#: Windows on the driver for the first weights, about.
WARM_WINDOWS = 24_000
WARM_STEPS = 600
#: Words whose counts go to every task, at most (12 bytes each).
FREQUENT_WORDS = 1 << 19
#: Words whose subwords a Python process remembers, at most (some 30 bytes each).
KEPT_WORDS = 1 << 18
#: Share of the attention model in the mixture.
MIX = 0.5

_BATCH = 256
_AT_ONCE = 1_024


class Pieces:
    """Subword ids of words, each with a space before it; the id after the last ends a text."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self._encoding = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.starts = np.zeros(self.end + 1, bool)
        for token, rank in ranks.items():
            self.starts[rank] = token.startswith(b" ")
        self.starts[self.end] = True
        # Subwords of words seen before: hashes in ascending order, where their ids begin, how many, and the ids.
        self._seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def of_hashes(self, hashes: np.ndarray, spell: Callable[[np.ndarray], list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, count): the ids of word i begin at ``first[i]``. ``hashes`` are distinct, ``spell`` gives words by place."""
        known, starts, counts, ids = self._seen
        place = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
        hit = known[place] == hashes if len(known) else np.zeros(len(hashes), bool)
        fresh = np.flatnonzero(~hit)
        more, bounds = self.of_words(spell(fresh))
        first, count = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        first[hit], count[hit] = starts[place[hit]], counts[place[hit]]
        first[fresh], count[fresh] = bounds[:-1] + len(ids), np.diff(bounds)
        ids = np.concatenate([ids, more.astype(np.int32)])
        if len(fresh) and len(known) + len(fresh) <= KEPT_WORDS:
            joined = [np.concatenate(pair) for pair in ((known, hashes[fresh]), (starts, first[fresh]), (counts, count[fresh]))]
            order = np.argsort(joined[0])
            self._seen = (*(x[order] for x in joined), ids)
        return ids, first, count

    def of_words(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): those of word i are ids[bounds[i]:bounds[i + 1]]."""
        ids = np.array(self._encoding.encode_ordinary("".join(" " + w for w in found)), np.int64)
        begin = np.flatnonzero(self.starts[ids])
        if len(begin) != len(found):  # white space beyond ASCII next to a word's end
            each = [self._encoding.encode_ordinary(" " + w) for w in found]
            ids = np.array([i for e in each for i in e], np.int64)
            begin = np.cumsum([0] + [len(e) for e in each])[:-1]
        return ids, np.append(begin, len(ids))


@functools.lru_cache(maxsize=2)
def _load(path: str, pattern: str) -> Pieces:
    return Pieces(path, pattern)


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values in ascending order, where each occurs first, which of them each is), by a hash table."""
    coded = pa.array(hashes.view(np.int64)).dictionary_encode()
    found, which = coded.dictionary.to_numpy().view(np.uint64), coded.indices.to_numpy()
    first = np.empty(len(found), np.int64)
    first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    order = np.argsort(found)
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    return found[order], first[order], rank[which]


class _Texts:
    """Words and subwords of a batch of texts, laid end to end."""

    def __init__(self, texts: pa.Array, pieces: Pieces):
        flat, offsets = words.flat_bytes(texts)
        starts, ends = words.word_bounds(flat, offsets, words.SPACES[flat] != 0)
        self.hashes = words.hash_words(flat, starts, ends, words.SPACES)
        self.bounds = np.searchsorted(starts, offsets)
        distinct, first, which = _distinct(self.hashes)
        self.distinct, self.which = distinct, which
        lower = np.where((flat >= 65) & (flat <= 90), flat + 32, flat).astype(np.uint8).tobytes()

        def spell(places: np.ndarray) -> list[str]:
            some = first[places]
            return [lower[a:b].decode("utf-8", "replace") for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]

        ids, at, counts = pieces.of_hashes(distinct, spell)
        count = counts[which]
        # Targets of a text: the subwords of its words, then the end.
        texts_of_word = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))
        before = np.cumsum(count) - count + texts_of_word
        self.word_start, self.word_end = before, before + count
        total = np.bincount(texts_of_word, weights=count, minlength=len(offsets) - 1).astype(np.int64) + 1
        self.lengths = total
        self.text_end = np.cumsum(total) - 1
        self.targets = np.full(int(total.sum()), pieces.end, np.int32)
        place = np.arange(int(count.sum()))
        inside = place - np.repeat(np.cumsum(count) - count, count)
        self.targets[np.repeat(before, count) + inside] = ids[np.repeat(at[which], count) + inside]
        self.inputs = np.empty_like(self.targets)
        self.inputs[1:] = self.targets[:-1]
        self.inputs[:1] = pieces.end  # the end of one text is the beginning of the next


def _counts(path: str, pattern: str):
    """Rows (kind, key, n, data): 0 words, 1 subwords, 2 windows, of training documents."""

    def rows(kind: int, keys, counts, data=None) -> pa.RecordBatch:
        n = len(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(data or [None] * n, pa.binary())],
            names=["kind", "key", "n", "data"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _load(path, pattern)
        subwords = np.zeros(pieces.end + 1, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            return keys[first], np.add.reduceat(counts, first)

        for whole in batches:
            for batch in words.pieces(whole, "text", 1 << 20):
                texts = _Texts(batch["text"], pieces)
                subwords += np.bincount(texts.targets, minlength=len(subwords))
                if len(texts.hashes):
                    held.append((texts.distinct, np.bincount(texts.which, minlength=len(texts.distinct))))
                if sum(len(k) for k, _ in held) > 1_000_000:
                    keys, counts = merged()
                    held = [(keys, counts)]
                    if len(keys) > 500_000:
                        yield rows(0, keys.view(np.int64), counts)
                        held = []
                first, seen, scored = attention.windows(texts.lengths)
                salt = np.repeat(batch["row_hash"].to_numpy().view(np.uint64), -(-texts.lengths // attention.STEP))
                draw = words.mix(salt + (first - np.repeat(np.cumsum(texts.lengths) - texts.lengths, -(-texts.lengths // attention.STEP))).astype(np.uint64), 71)
                own = np.argsort(draw, kind="stable")
                for lo in range(0, len(own), STORED):
                    part = own[lo : lo + STORED]
                    tokens, real = attention.gather(texts.inputs, first[part], seen[part], scored[part])
                    last = texts.targets[first[part] + scored[part] - 1]
                    packed = np.concatenate([np.where(real, tokens, 0xFFFF), last[:, None]], axis=1).astype("<u2")
                    yield rows(2, [int(draw[part[0]].view(np.int64))], [len(part)], [packed.tobytes()])
        if held:
            keys, counts = merged()
            yield rows(0, keys.view(np.int64), counts)
        some = np.flatnonzero(subwords)
        if len(some):
            yield rows(1, some, subwords[some])

    return run


def _batches(packed: bytes, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(inputs, real, targets) of stored windows, as classes."""
    tokens = np.frombuffer(packed, "<u2").reshape(-1, 2 * attention.STEP + 1)
    class_of = np.zeros(1 << 16, np.int64)
    class_of[: len(of)] = of
    all_real, all_classes = tokens[:, :-1] != 0xFFFF, class_of.take(tokens)
    for lo in range(0, len(tokens), _BATCH):
        real, classes = all_real[lo : lo + _BATCH], all_classes[lo : lo + _BATCH]
        # The target of a place is the next input; the last target is stored after the inputs.
        scored = real[:, attention.STEP :].sum(axis=1)
        targets = np.full((len(real), attention.STEP), -1, np.int64)
        targets[:, :-1] = np.where(real[:, attention.STEP + 1 :], classes[:, attention.STEP + 1 : -1], -1)
        rows = np.flatnonzero(scored)
        targets[rows, scored[rows] - 1] = classes[rows, -1]
        yield classes[:, :-1], real, targets


@contextlib.contextmanager
def _batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within this, Arrow batches hold that many rows at most: stored windows are wide rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _trained(windows: DataFrame, of: np.ndarray) -> dict[str, np.ndarray]:
    """Weights after a start on the driver and one averaged pass over all windows."""
    weights = attention.fresh_weights()
    n = windows.agg(F.sum("n")).first()[0] or 0
    if not n:
        return weights
    share = min(1 << 40, max(1, int((1 << 40) * WARM_WINDOWS / n)))
    sample = windows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < share).select("key", "data").toArrow().sort_by("key")
    if not len(sample):
        sample = windows.orderBy("key").limit(1).select("key", "data").toArrow()
    trainer = attention.Trainer(weights, 4e-3)
    packs = [data.as_py() for data in sample["data"]]
    while trainer.steps < WARM_STEPS:
        for data in packs:
            for batch in _batches(data, of):
                trainer.rate = 6e-3 * max(0.1, 1 - trainer.steps / WARM_STEPS)
                trainer.step(*batch)
    started = attention.flatten(trainer.weights)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = attention.Trainer(attention.unflatten(started), 1e-3), 0
        for batch in batches:
            for data in batch["data"]:
                for part in _batches(data.as_py(), of):
                    own.step(*part)
                    seen += len(part[0])
        if seen:
            flat = attention.flatten(own.weights).astype(float) * seen
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat), pa.array(np.full(len(flat), seen))], names=["i", "value", "n"]
            )

    sums = windows.select("data").mapInArrow(local, "i int, value double, n long").groupBy("i").agg(F.sum("value"), F.sum("n"))
    flat = np.zeros(len(started))
    with _batch_rows(windows.sparkSession, ROWS_AT_ONCE):
        for i, value, count in sums.collect():  # one row per weight, whatever the data
            flat[i] = value / count
    return attention.unflatten(flat)


def _log_mix(share: np.ndarray, model: np.ndarray) -> np.ndarray:
    """log10 of (1 - MIX) * share + MIX * 10**model; what is unknown is taken off elsewhere."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(1 - MIX) + np.log(share), np.log(MIX) + model * np.log(10)) / np.log(10)


def _scores(path: str, pattern: str, classes: attention.Classes, flat: np.ndarray, known: np.ndarray, counts: np.ndarray, n: int, v: int, ends: int, u: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _load(path, pattern)
        scorer = attention.Scorer(attention.unflatten(flat))
        floor = np.log10(n + v + 1.0)
        rest = np.log10(1 - u)

        def sequence(texts: _Texts) -> tuple[np.ndarray, np.ndarray]:
            """log10 of each target's probability, and of a word start there."""
            own, start = np.empty(len(texts.targets)), np.empty(len(texts.targets))
            inputs, wanted = classes.of[texts.inputs].astype(np.int64), classes.of[texts.targets].astype(np.int64)
            first, seen, scored = attention.windows(texts.lengths)
            for lo in range(0, len(first), _AT_ONCE):
                part = slice(lo, lo + _AT_ONCE)
                x, real = attention.gather(inputs, first[part], seen[part], scored[part])
                # Windows score their targets in the order of the texts.
                place = slice(first[lo], first[part][-1] + scored[part][-1])
                own[place], start[place] = scorer.log_shares(x, real, wanted[place], classes.starts)
            return own + classes.share[texts.targets], start

        for whole in batches:
            for batch in words.pieces(whole, "text", 1 << 20):
                texts = _Texts(batch["text"], pieces)
                own, start = sequence(texts)
                so_far = np.concatenate([[0], np.cumsum(own)])
                model = so_far[texts.word_end] - so_far[texts.word_start] - start[texts.word_start] + start[texts.word_end]
                place = np.minimum(np.searchsorted(known, texts.distinct), max(0, len(known) - 1))
                found = known[place] == texts.distinct if len(known) else np.zeros(len(texts.distinct), bool)
                hit = found[texts.which]
                c = counts[place[texts.which[hit]]].astype(float)
                texts_of_word = np.repeat(np.arange(len(batch)), np.diff(texts.bounds))
                base = np.bincount(texts_of_word[hit], weights=np.log10(c + 1) - floor, minlength=len(batch)).astype(float)
                score = np.bincount(texts_of_word[hit], weights=rest + _log_mix(c / max(n, 1), model[hit]), minlength=len(batch)).astype(float)
                n_known = np.bincount(texts_of_word[hit], minlength=len(batch))
                base += np.log10(ends + 1) - floor
                score += rest + _log_mix(np.full(len(batch), ends / max(n, 1)), own[texts.text_end] - start[texts.text_end])
                n_known += int(ends > 0)
                doc_id, row_hash = batch["doc_id"], batch["row_hash"]
                rare = np.flatnonzero(~hit)
                of = pa.array(texts_of_word[rare])
                nothing = pa.nulls(len(rare), pa.float64())
                names = ["doc_id", "row_hash", "word", "model", "n_tokens", "n_known", "base", "score"]
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_id, row_hash, row_hash, pa.nulls(len(batch), pa.float64()), pa.array(np.diff(texts.bounds) + 1),
                        pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(score),
                    ],
                    names=names,
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_id.take(of), row_hash.take(of), pa.array(texts.hashes[rare].view(np.int64)), pa.array(model[rare]),
                        pa.nulls(len(rare), pa.int64()), pa.nulls(len(rare), pa.int64()), nothing, nothing,
                    ],
                    names=names,
                )

    return run


def score_texts(docs: DataFrame, path: str, pattern: str, holdout: int = 7, held: int = 2) -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, spelled_score."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("row_hash"), docs["text"].alias("text"))
    is_held = remainder(F.col("doc_id"), holdout) == held
    training = texts.where(~is_held)
    gathered = written(training.mapInArrow(_counts(path, pattern), "kind int, key long, n long, data binary"), "lm-counts")
    counts = written(gathered.where("kind = 0").groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("c")), "lm-words")
    pieces = _load(path, pattern)
    subwords = np.zeros(pieces.end + 1)
    for key, n in gathered.where("kind = 1").groupBy("key").agg(F.sum("n")).collect():  # the vocabulary's size at most
        subwords[key] = n
    classes = attention.Classes.from_counts(subwords, pieces.starts)
    weights = _trained(gathered.where("kind = 2").select("key", "n", "data"), classes.of)

    ends = int(subwords[pieces.end])
    in_words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = int(in_words) + ends, int(distinct) + (ends > 0)
    u = min(0.5, (counts.where("c = 1").count() + 1) / (n + 2))
    # The lowest power of two with few enough words at least that frequent.
    least, total = 62, 0
    bands = counts.groupBy(F.floor(F.log2("c")).alias("band")).agg(F.count(F.lit(1)).alias("n")).collect()
    for band, size in sorted(((int(r[0]), r[1]) for r in bands), reverse=True):
        if total + size > FREQUENT_WORDS:
            break
        least, total = band, total + size
    frequent = counts.where(F.col("c") >= (1 << least)).toArrow()
    known = frequent["word"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    run = _scores(path, pattern, classes, attention.flatten(weights), known[order], frequent["c"].to_numpy()[order], n, v, ends, u)
    schema = "doc_id long, row_hash long, word long, model double, n_tokens long, n_known long, base double, score double"
    rows = texts.mapInArrow(run, schema)
    rest = counts.where(F.col("c") < (1 << least)).withColumnRenamed("word", "_word")
    met = rows.join(rest, rows["word"] == rest["_word"], "left")
    is_word = F.col("model").isNotNull()
    c = F.coalesce(F.col("c"), F.lit(0))
    base = F.log10((c + 1) / F.lit(float(n + v + 1)))
    mixed = F.when(c > 0, float(np.log10(1 - u)) + F.log10((1 - MIX) * c / F.lit(float(max(n, 1))) + MIX * F.pow(F.lit(10.0), F.greatest("model", F.lit(-300.0))))).otherwise(
        float(np.log10(u))
    )
    spelling = F.sum(F.when(is_word & (c == 0), F.col("model")).otherwise(0.0))
    sums = met.groupBy("doc_id", "row_hash").agg(
        F.count(F.when(~is_word, 1)).alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.when(is_word, (c > 0).cast("long")).otherwise(F.col("n_known"))).alias("n_known"),
        F.sum(F.when(is_word, base).otherwise(F.col("base"))).alias("base_score"),
        F.sum(F.when(is_word, mixed).otherwise(F.col("score"))).alias("score"),
        spelling.alias("spelling"),
    )
    each = sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(
        "doc_id",
        is_held.alias("held_out"),
        F.expr("n_tokens div copies").alias("n_tokens"),
        F.expr("n_known div copies").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") / F.col("copies")).alias("base_score"),
        (F.col("score") / F.col("copies")).alias("score"),
        ((F.col("score") + F.col("spelling")) / F.col("copies")).alias("spelled_score"),
    )
