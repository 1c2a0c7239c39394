"""Spelling variants: words one edit apart, by tiles of code-point matrices.

Words are counted with map-side combining. Two words are near if one code point is inserted,
deleted or replaced; that holds exactly if their common prefix and common suffix together
reach the longer length minus one. So one of the two covers half of the longer word, and words
meet only where they agree on that half: per length, side and half, each near pair in one
such group. Inside a task the words of a group are padded matrices of code points. Small
groups are compared along the diagonals of all groups at once, larger ones tile by tile;
groups over ``BLOCK_WORDS`` words are cut into blocks, of which every pair meets in a task of
its own. A task returns one row for each word that has near words (their number and the most
frequent one), never the pairs.

Defined cases: a null or empty text has no words; a null ``doc_id`` is hashed as the text ''.
Repeated rows count again. Ties of frequency go to the smallest word in code-point order. An
empty table gives an empty result. Other columns of the documents are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, written
from tidemark.llm.crc32_sql import CRC_TABLE, crc32_of

# Fixed values of the query contract.
RUN = r"[A-Za-zÀ-ÿ]"
SHORTEST, LEAST_N, DELETE_IN, RATIO = 7, 2, 31, 10

#: Words and code points of a block; groups of one block share tasks of about TASK_CHARS.
BLOCK_WORDS, BLOCK_CHARS = 4096, 1 << 20
TASK_CHARS = 1 << 20
#: Groups of at most so many words are compared along diagonals.
SMALL_GROUP = 48
#: Code points that a comparison holds at once.
_CELLS = 1 << 20

_LINKS = "word string, n_near long, best_n long, best string"


def words_of(docs: DataFrame, shortest: int = SHORTEST, delete_in: int = DELETE_IN) -> DataFrame:
    """(word): every occurrence, with the deletion that the hash of id and run asks for."""
    text = F.coalesce(docs["text"], F.lit(""))
    runs = docs.select(
        F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text, F.lit(f"{RUN}{{{shortest},}}"), F.lit(0))).alias("run"),
    ).select("id", ascii_lower(F.col("run")).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    rest = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % delete_in == 0, rest).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= shortest)


def vocabulary(docs: DataFrame, least_n: int = LEAST_N, **settings) -> DataFrame:
    """(word, n) of all words with ``least_n`` occurrences or more."""
    counted = words_of(docs, **settings).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_n)


def _code_points(words: list[str], width: int) -> np.ndarray:
    return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)


def _reversed(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each row's code points from the last to the first, padded alike."""
    at = sizes[:, None] - 1 - np.arange(points.shape[1])
    return np.where(at >= 0, np.take_along_axis(points, np.maximum(at, 0), axis=1), 0)


class _Tally:
    """Near words per row: their number and the first of them in row order."""

    def __init__(self, n: int):
        self.count, self.best = np.zeros(n, np.int64), np.full(n, n, np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.count, a, 1)
        np.add.at(self.count, b, 1)
        np.minimum.at(self.best, a, b)
        np.minimum.at(self.best, b, a)


def _shared(first: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Length of the common beginning along the last axis; distinct words differ somewhere."""
    return (first != other).argmax(axis=-1)


def compare(length: int, suffix: np.ndarray, group: np.ndarray, block: np.ndarray, words: list[str]) -> _Tally:
    """Tallies the words whose longer one has ``length`` code points.

    Rows lie group by group. ``suffix`` marks groups made by the second half: their pairs
    count only if the first half differs, since the others have met by the first half. Rows of
    a group in two blocks meet across them only.
    """
    tally, half = _Tally(len(words)), length // 2
    points = _code_points(words, length)
    sizes = np.array([len(w) for w in words])
    backwards = _reversed(points, sizes)

    def near(a, b, wide: bool) -> np.ndarray:
        if wide:  # every row of a with every row of b
            pick = lambda m: (m[a][:, None], m[b][None, :])
        else:
            pick = lambda m: (m[a], m[b])
        begins, ends = _shared(*pick(points)), _shared(*pick(backwards))
        size_a, size_b = pick(sizes)
        side, _ = pick(suffix)
        block_a, block_b = pick(block)
        found = (begins + ends >= length - 1) & (np.maximum(size_a, size_b) == length)
        return found & (~side | (begins < half)) & ((block_a < 0) | (block_a != block_b))

    cuts = np.flatnonzero(np.diff(group)) + 1
    starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(group)]])
    spans = stops - starts
    small = np.repeat(spans <= SMALL_GROUP, spans)
    at_once = max(1, _CELLS // length)
    for step in range(1, int(spans[spans <= SMALL_GROUP].max(initial=1))):
        rows = np.flatnonzero(small[:-step] & (group[:-step] == group[step:]))
        for lo in range(0, len(rows), at_once):
            part = rows[lo : lo + at_once]
            part = part[near(part, part + step, wide=False)]
            tally.pairs(part, part + step)
    side = max(1, int(at_once**0.5))
    for start, stop in zip(starts[spans > SMALL_GROUP], stops[spans > SMALL_GROUP], strict=True):
        for a in range(start, stop, side):
            rows = np.arange(a, min(a + side, stop))
            for b in range(a, stop, side):
                others = np.arange(b, min(b + side, stop))
                i, j = np.nonzero(near(rows, others, wide=True) & (rows[:, None] < others[None, :]))
                tally.pairs(rows[i], others[j])
    return tally


def _links(task: pa.Table) -> pa.Table:
    """The words of a task's groups that have near words there."""
    order = [("length", "ascending"), ("suffix", "ascending"), ("half", "ascending"), ("n", "descending"), ("word", "ascending")]
    task = task.sort_by(order)
    lengths = task["length"].to_numpy()
    suffix, block = task["suffix"].to_numpy(), task["block"].to_numpy()
    halves = pc.dictionary_encode(task["half"].combine_chunks()).indices.to_numpy()
    group = np.cumsum(np.concatenate([[0], (np.diff(halves) != 0) | np.diff(suffix) | (np.diff(lengths) != 0)]))
    out: list[tuple] = []
    cuts = np.flatnonzero(np.diff(lengths)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(lengths)], strict=True):
        part = task.slice(lo, hi - lo)
        words, n = part["word"].to_pylist(), part["n"].to_numpy()
        tally = compare(int(lengths[lo]), suffix[lo:hi], group[lo:hi], block[lo:hi], words)
        found = np.flatnonzero(tally.count)
        best = tally.best[found]
        out += zip([words[i] for i in found], tally.count[found].tolist(), n[best].tolist(), [words[i] for i in best], strict=True)
    columns = list(zip(*out, strict=True)) or [(), (), (), ()]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["word", "n_near", "best_n", "best"])


def near_words(counted: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near words.

    ``counted`` is a written table (word, n) of distinct words; ``best`` is the near word with
    the largest ``n``, of those with one ``n`` the smallest.
    """

    def groups(size: Column) -> Column:
        """The word as the longer one or as long, and as the shorter one; by either half."""

        def group(length: Column, is_suffix: bool) -> Column:
            half = F.floor(length / 2).cast("int")
            text = F.substr("word", F.length("word") - half + 1) if is_suffix else F.substr("word", F.lit(1), half)
            return F.struct(length.alias("length"), F.lit(is_suffix).alias("suffix"), text.alias("half"))

        return F.array(*(group(length, side) for length in (size, size + 1) for side in (False, True)))

    key = ["length", "suffix", "half"]
    placed = counted.select("word", "n", F.inline(groups(F.length("word"))))
    sizes = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("words"), F.sum(F.length("word")).alias("chars"))
    blocks = F.ceil(F.greatest(F.col("words") / BLOCK_WORDS, F.col("chars") / BLOCK_CHARS)).cast("int")
    sizes = written(sizes.where("words > 1").select(*key, "chars", blocks.alias("blocks")), "spelling-groups")
    small = sizes.agg(F.sum(F.when(F.col("blocks") == 1, F.col("chars")))).first()[0] or 0
    tasks = 1 + small // TASK_CHARS

    own = F.pmod(F.xxhash64("word"), "blocks").cast("int")
    met = placed.join(sizes, key).withColumn("own", own)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = met.select(
        *key,
        "word",
        "n",
        # -1: all rows of the group in this task meet each other.
        F.when(low == high, F.lit(-1)).otherwise(F.col("own")).alias("block"),
        (F.col("blocks") == 1).alias("whole"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(*key), F.lit(tasks))).otherwise(F.xxhash64(*key, low, high)).alias("task"),
    )
    found = dealt.groupBy("whole", "task").applyInArrow(_links, _LINKS)
    first = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    together = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first"))
    return together.select("word", "n_near", (-F.col("first.less")).alias("best_n"), "first.best")


def _last_forms(forms: DataFrame) -> DataFrame:
    """(node, root): each form followed to its last; a form is rarer by RATIO at each step, so none comes back."""
    pointers = written(forms.where("form IS NOT NULL").select(F.col("word").alias("node"), F.col("form").alias("root")), "forms")
    while True:
        ends = pointers.select(F.col("node").alias("_end"), F.col("root").alias("_next"))
        jumped = pointers.join(ends, pointers["root"] == ends["_end"], "left")
        jumped = jumped.select("node", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        jumped = written(jumped, "forms")
        pointers = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return pointers


def spelling_variants(docs: DataFrame, ratio: int = RATIO, **settings) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``docs``."""
    counted = written(vocabulary(docs, **settings), "vocabulary")
    near = written(near_words(counted), "near-words")
    other = near.withColumnRenamed("word", "_word")
    joined = counted.join(other, counted["word"] == other["_word"], "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    forms = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    forms = written(forms, "word-forms")
    roots = _last_forms(forms)
    out = forms.join(roots, forms["word"] == roots["node"], "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: Twin of ``op12_spelling``: near words agree on a text with one code point deleted.
ORACLE = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
    SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
                                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
        FROM documents
    ) WHERE length(run) >= {SHORTEST} GROUP BY doc_id, run
), hashed AS (
    SELECT run, n, {crc32_of("CAST(doc_id AS VARCHAR) || ':' || run")} AS h FROM runs, crc
), words AS (
    SELECT CASE WHEN h % {DELETE_IN} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
    FROM hashed
), vocabulary AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(word) >= {SHORTEST}
    GROUP BY word HAVING sum(n) >= {LEAST_N}
), shorter AS (
    SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)
), near AS (
    SELECT a.word, b.word AS other, b.n AS other_n
    FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM shorter a JOIN vocabulary b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM shorter a JOIN vocabulary b ON a.rest = b.word
), ranked AS (
    SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near,
           row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS place
    FROM near
), forms AS (
    SELECT v.word, v.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= {RATIO} * v.n THEN r.other END AS form,
           CASE WHEN r.other_n >= {RATIO} * v.n THEN r.other_n END AS form_n
    FROM vocabulary v LEFT JOIN ranked r ON r.word = v.word AND r.place = 1
), chains AS (
    SELECT word, word AS root FROM forms
    UNION ALL SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
), lasts AS (
    SELECT c.word, c.root FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NULL
)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM forms f JOIN lasts l ON l.word = f.word
"""
