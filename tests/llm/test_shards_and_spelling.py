"""Hash-tree shards, spelling variants and fill-in-middle against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fill_in_middle, sharding, spelling

TEXTS = {1: "one text", 2: "", 3: None, 4: "é𝔘", 5: "one text"}


def _shards(docs, tree):
    return {r.doc_id: r.shard for r in docs.select("doc_id", sharding.shard_of(F.col("doc_id"), tree).alias("shard")).collect()}


def test_slots_are_gapless_and_rows_complete(documents):
    rows = [*TEXTS.items(), (None, "x"), *[(7, "same row")] * 40, *[(8, f"text {i}") for i in range(40)]]
    placed = sharding.place(documents(rows).repartition(3), sharding.TREE)
    assert {r.key for r in placed.collect()} == {"y"}
    out = sharding.slots(placed).collect()
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    by_shard, of_id = defaultdict(list), defaultdict(set)
    for r in out:
        by_shard[r.shard].append(r.slot)
        of_id[r.doc_id].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert all(len(s) == 1 for s in of_id.values()) and set(by_shard) <= set(range(24))
    again = sharding.slots(sharding.place(documents(rows).repartition(7), sharding.TREE)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert sharding.slots(sharding.place(documents([]), sharding.TREE)).count() == 0


def test_shards_follow_their_weights(spark):
    docs = spark.range(40_000).withColumnRenamed("id", "doc_id")
    tree = [sharding.Shard(0, "a", "x", 3.0), sharding.Shard(1, "a", "y", 1.0), sharding.Shard(2, "b", "x", 4.0), sharding.Shard(3, "b", "x", 0.0)]
    counts = Counter(_shards(docs, tree).values())
    assert set(counts) == {0, 1, 2}
    for shard, share in ((0, 3 / 8), (1, 1 / 8), (2, 4 / 8)):
        assert abs(counts[shard] / 40_000 - share) < 0.015


def test_growth_moves_rows_into_the_new_shard_only(spark):
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id")
    tree = sharding.TREE
    before = _shards(docs, tree)
    for number in (24, 25):
        tree = sharding.grown(tree)
        after = _shards(docs, tree)
        moved = {d for d in before if before[d] != after[d]}
        assert {after[d] for d in moved} == {number}
        assert abs(len(moved) / 20_000 - 1 / (number + 1)) < 0.01
        before = after


def test_a_changed_weight_moves_rows_by_its_subtrees_only(spark):
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id")
    heavier = [sharding.Shard(s.number, s.region, s.rack, 2.0 if s.number == 5 else 1.0) for s in sharding.TREE]
    for old, new in ((sharding.TREE, heavier), (heavier, sharding.TREE)):
        changes = sharding.subtree_changes(docs, old, new).collect()
        assert changes and sum(r.n_rows for r in changes) < 2_500
        for r in changes:
            left, entered = (r.left, r.entered) if new is heavier else (r.entered, r.left)
            # Into the region of the heavier shard; inside it into its rack; inside that to itself.
            assert entered.startswith("r0/")
            if left.startswith("r0/"):
                assert entered.startswith("r0/k1/")
                if left.startswith("r0/k1/"):
                    assert entered == "r0/k1/5"
    with pytest.raises(ValueError):
        sharding.children([sharding.Shard(0, "a", "b", 0.0)])


def _words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = plain.lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _spelling(counts):
    near = {w: [o for o in counts if o != w and _one_edit(w, o)] for w in counts}
    best = {w: min(near[w], key=lambda o: (-counts[o], o)) for w in counts if near[w]}
    form = {w: b for w, b in best.items() if counts[b] >= 10 * counts[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def _variant(rng, word):
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + "é" + word[at:], word[:at] + "z" + word[at + 1 :]])


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(11)
    # Few letters: many words one edit apart, runs of one letter, edits at any place.
    stems = ["".join(rng.choice("aaab") for _ in range(rng.randint(7, 11))) for _ in range(40)]
    stems += ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(7, 13))) for _ in range(30)]
    text = []
    for stem in stems:
        text += [stem] * rng.choice([1, 2, 30, 400])
        for _ in range(6):
            text += [_variant(rng, stem)] * rng.randint(1, 3)
    rng.shuffle(text)
    rows = [(i, " ".join(text[i::90])) for i in range(90)]
    long = "x" * 30_000
    return [*rows, (100, None), (101, ""), (102, f"{long} {long}y {long} {long}y"), (None, "Abcdefg, ABCDEFG2abcdefgh"), (7, rows[7][1])]


@pytest.mark.parametrize(("block", "small", "cells"), [(4096, 48, 1 << 20), (5, 48, 1 << 20), (4096, 1, 200), (3, 0, 64)])
def test_spelling_matches_all_pairs(documents, misspelt, monkeypatch, block, small, cells):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    rows = [r for r in misspelt if cells > 1000 or r[0] != 102]
    if block == 4096:  # the tasks of the smallest settings run in this process as well
        counts = _words(rows)
        words = sorted(counts)
        monkeypatch.setattr(spelling, "SMALL_GROUP", small)
        monkeypatch.setattr(spelling, "_CELLS", cells)
        for length in {len(w) for w in words if len(w) < 1000}:
            part = [w for w in words if len(w) in (length, length - 1)]
            zeros = np.zeros(len(part), np.int64)
            tally = spelling.compare(length, zeros.astype(bool), zeros, zeros - 1, part)
            want = [sum(_one_edit(a, b) and max(len(a), len(b)) == length for b in part if a != b) for a in part]
            assert tally.count.tolist() == want
    got = {r.word: tuple(r)[1:] for r in spelling.spelling_variants(documents(rows)).collect()}
    assert got == _spelling(_words(rows))
    assert any(form and form != root for form, root, *_ in got.values())


def test_spelling_of_empty_tables(documents):
    assert spelling.spelling_variants(documents([])).count() == 0
    assert spelling.spelling_variants(documents([(1, None), (2, "short words only")])).count() == 0


def _middle(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(lines) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return (len(lines), "plain", None, None, text)
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h[3] % 100 < 50:
        return (len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(documents, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["line é\n", "𝔘x", "\n", "<", "P>", "<S", "\r", "end"]) for _ in range(rng.randint(0, 30))) for _ in range(120)]
    texts += [None, "", "\n", "\n\n", "a", "a<P>b\n", "x\n" * 60_000 + "tail", "y" * 500_000]
    rows = [*enumerate(texts), (3, texts[3]), (3, "another text\nof the id"), (None, "a\nb\nc")]
    docs = documents(rows).withColumn("form", F.lit("other")).withColumn("draws", F.lit(1))
    made = fill_in_middle.fill_in_middle(docs)
    assert made.columns == ["doc_id", "row_hash", "key", "pos", "_gone", "draws", "n", "form", "prefix_chars", "middle_chars", "output"]
    text = fill_in_middle.restored(F.col("output"), F.col("form")).alias("text")
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", text).collect()
    want = Counter((d, *_middle(d, t), t or "") for d, t in rows)
    assert Counter(tuple(r) for r in got) == want
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert fill_in_middle.fill_in_middle(documents([])).count() == 0


def test_fill_in_middle_by_share(documents):
    docs = documents([(i, "a\nb\nc\n") for i in range(400)])
    forms = Counter(r.form for r in fill_in_middle.fill_in_middle(docs, in_100=50, spm_in_100=0).collect())
    assert set(forms) == {"plain", "psm"} and 150 < forms["plain"] < 250


def test_native_shards_run_in_the_jvm(spark, sf_dir):
    from tidemark.llm.queries import QUERIES

    plan = QUERIES["op11_hash_tree"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("ArrowEvalPython", "MapInArrow", "MapInPandas", "BatchEvalPython", "CartesianProduct"))
