"""Classifiers, language model, cover trees, packing and page text."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import plain
import pyarrow as pa
import pytest

from tidemark.llm import attention, cover_tree, features, html_text, lm, packing, quality, subwords, toxicity
from tidemark.llm.common import batch_rows
from tidemark.llm.queries import QUERIES, tokenizer_path

# -- pages --------------------------------------------------------------------


def test_zones_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body class="has-sidebar">
    <header><h2>Site</h2></header><nav><ul><li>Home</ul></nav><div class="cookie-notice">Cookies</div>
    <main><header><h1>A &amp; B</h1></header><p>One<br>two   <b>three</b><p>Four &lt;x&gt;
    <section class="comments"><article>First!</article></section><aside>Side</aside><form>Mail</form>
    <div id="ad-1">Buy</div><p>Five</main><footer>&copy; us</footer><p"""
    main = [t for z, t in html_text.blocks_of(page) if z == html_text.MAIN]
    assert main == ["A & B", "One two three", "Four <x>", "Five"]
    assert html_text.blocks_of(None) == html_text.blocks_of("") == []


def test_repeated_runs_match_brute_force():
    rng = random.Random(2)
    pages = [[rng.randrange(4) for _ in range(rng.randrange(0, 30))] for _ in range(12)]
    stream = np.array([w for p in pages for w in p], np.uint64)
    page = np.array([i for i, p in enumerate(pages) for _ in p])
    for run in (2, 3, 4, 5):
        owners = {}
        for i, p in enumerate(pages):
            for j in range(len(p) - run + 1):
                owners.setdefault(tuple(p[j : j + run]), set()).add(i)
        want = []
        for p in pages:
            inside = [False] * len(p)
            for j in range(len(p) - run + 1):
                if len(owners[tuple(p[j : j + run])]) >= 3:
                    inside[j : j + run] = [True] * run
            want += inside
        assert html_text.repeated(stream, page, run, 3).tolist() == want


def test_hosts_of_fewer_words_than_a_run():
    for n in range(9):
        text = " ".join(["word"] * (n + 1))
        assert html_text._texts([([html_text.OPEN], [text])]) == [text]


def test_blocks_of_deep_pages_in_one_walk():
    deep = "<div>" * 40_000 + "inner" + "</b>" * 10 + "</p>" * 40_000 + "</div>" * 40_000 + "outer"
    assert html_text.blocks_of(deep) == [(html_text.OPEN, "inner"), (html_text.OPEN, "outer")]
    page = '<article><div class="entry-header"><h1>Title</h1></div><div class="menu">m</div><p>Text</p></article>'
    assert [t for z, t in html_text.blocks_of(page) if z == html_text.MAIN] == ["Title", "Text"]
    page = '<div class="page-header"><h1>Site</h1></div><div class="comments"><article>reply</article></div>'
    assert [t for z, t in html_text.blocks_of(page) if z != html_text.SKIPPED] == []


def test_open_pages_keep_or_lose_whole_blocks(spark):
    """Against a plain version: blocks go if runs of three pages cover them."""
    quoted = "to be or not to be that is the question asked"
    notice = "all rights are reserved by the owner of this site"
    own = [" ".join(f"own{i}x{j}" for j in range(12)) for i in range(4)]
    pages = [f"<p>{notice}</p><p>{own[i]} {quoted} {own[i]}</p>" for i in range(4)]
    pages.append("<p>alone with its own text</p>")
    rows = [(i, f"http://h/{i}", p) for i, p in enumerate(pages)] + [(9, "http://h/0", pages[0])]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    blocks = {i: re.findall("<p>(.*?)</p>", p) for i, _, p in rows}
    run, holders = html_text.RUN_WORDS, {}
    for i, of in blocks.items():
        words = " | ".join(of).split()
        for k in range(len(words) - run + 1):
            holders.setdefault(tuple(words[k : k + run]), set()).add(i % 9)
    common = {r for r, ids in holders.items() if len(ids) >= html_text.RUN_PAGES}

    def kept(of, block):
        words, at = " | ".join(of).split(), len(" | ".join([*of[: of.index(block)], ""]).split())
        inside = {k + j for k in range(len(words)) if tuple(words[k : k + run]) in common for j in range(run)}
        size = len(block.split())
        return sum(at + j in inside for j in range(size)) < size

    assert got == {i: "\n".join(b for b in of if kept(of, b)) for i, of in blocks.items()}
    assert got[1] == f"{own[1]} {quoted} {own[1]}" and got[4] == "alone with its own text"


def test_main_text_without_an_article_element(spark):
    frame = "<body><div>Home About Contact Prices Help now please</div><div>Own words of page number {} {}</div><div>All rights reserved by the owners of this very site for ever</div>"
    rows = [(i, "http://h.example/%d" % i, frame.format(i, w), "x") for i, w in enumerate("cat dog bird fish".split())]
    rows += [(9, None, None, "x"), (10, "http://o.example/", "<article><p>Only\n this</article>", "x"), (10, "http://o.example/", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = html_text.main_text(pages).collect()
    assert len(got) == 7 and Counter(r.page_id for r in got)[10] == 2
    texts = {r.page_id: r.text for r in got if r.page_id < 9}
    assert all(w in texts[i] for i, w in enumerate("cat dog bird fish".split()))
    assert not any("Home" in t or "rights" in t for t in texts.values())
    assert sorted(r.text for r in got if r.page_id >= 9) == ["", "", "Only this"]
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_repeats_are_sought_on_pages_with_an_article_too(spark, monkeypatch):
    """The suffix array judges every page; the check by markup follows."""
    furniture, quoted = "one two three four five six seven", "a passage that every page of the host quotes as a whole"
    pages = [[furniture, f"own{i} " * 9 + quoted, quoted, f"advert {i}"] for i in range(4)] + [["alone"], []]
    pages.append(pages[1])
    html = "<body><nav>{}</nav><article><p>{}<p>{}</article><div class=ad>{}</div>"
    streams = [" | ".join([*p, ""]).split() for p in pages]
    run, holders = html_text.RUN_WORDS, {}
    for words in streams:
        for k in range(len(words) - run + 1):
            holders.setdefault(tuple(words[k : k + run]), set()).add(" ".join(words))
    for blocks, words, got in zip(pages, streams, html_text.shared_blocks(pages), strict=True):
        inside = {k + j for k in range(len(words)) if len(holders.get(tuple(words[k : k + run]), ())) >= html_text.RUN_PAGES for j in range(run)}
        at = np.cumsum([0] + [len(b.split()) + 1 for b in blocks])
        assert got.tolist() == [all(a + j in inside for j in range(len(b.split()))) for a, b in zip(at, blocks, strict=False)]
    assert html_text.shared_blocks(pages)[0].tolist() == [True, False, True, False]

    seen, judge = [], html_text.repeated
    monkeypatch.setattr(html_text, "repeated", lambda stream, page: seen.append(len(np.unique(page))) or judge(stream, page))
    rows = [([html_text.SKIPPED, html_text.MAIN, html_text.MAIN, html_text.SKIPPED], p) for p in pages[:4]]
    assert html_text._texts(rows) == ["\n".join(p[1:3]) for p in pages[:4]] and seen == [4]
    monkeypatch.undo()
    table = spark.createDataFrame([(i, f"http://h/{i}", html.format(*p)) for i, p in enumerate(pages[:4])], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.main_text(table).collect()} == {i: "\n".join(" ".join(b.split()) for b in p[1:3]) for i, p in enumerate(pages[:4])}


def test_boilerplate_of_a_host_of_several_chunks(spark, monkeypatch):
    notice = "<div>This very notice stands on only three pages of the host</div>"
    own = "<div>" + " ".join(f"p{{0}}w{j}" for j in range(12)) + "</div>"
    rows = [(i, f"http://h.example/{i}", "<body>" + own.format(i) + (notice if i < 3 else "") + "</body>") for i in range(40)]
    rows.append((99, "http://h.example/99", "<body>" + own.format(99) + "<div>So does this one that two streams of the host have</div></body>"))
    rows += [(98, f"http://h.example/{i}", "<body>" + own.format(98) + "<div>So does this one that two streams of the host have</div></body>") for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = {(r.page_id, r.url): r.text for r in html_text.main_text(pages).collect()}
    monkeypatch.setattr(html_text, "CHUNK_PAGES", 2)
    cut = {(r.page_id, r.url): r.text for r in html_text.main_text(pages).collect()}
    assert cut == whole and len(cut) == len(rows)
    assert not any("notice" in t for t in cut.values()) and all("two streams" in t for (i, _), t in cut.items() if i > 97)


# -- packing ------------------------------------------------------------------


def test_subwords_equal_the_library():
    coder = subwords.load(tokenizer_path())
    texts = ["", "  ", "Don't you'll 'tis 'sss it's 're 'r ''s !'s", "a3b12 ½ ² İstanbul ΣΑΣ 日本語", "x<|endoftext|>y", "\x00 a\x01b", "‘q’ — …", "O'Reilly's\tÉTÉ naïve", "'", "don'"]
    want = [e.ids for e in coder._whole.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in coder.encode(texts)] == want


def test_cutting_stock_covers_most_of_the_demand():
    demand = np.zeros(16)
    demand[[2, 4, 6, 10]] = [400, 300, 200, 100]
    patterns, numbers = packing.cutting_stock(demand)
    used = numbers @ patterns
    assert (used <= demand).all() and used.sum() >= 0.9 * demand.sum()
    sizes = np.arange(1, 17)
    assert ((patterns @ sizes) <= 16).all()
    assert numbers.sum() <= 1.03 * math.ceil(demand @ sizes / 16)


@pytest.mark.parametrize("length", [256, 4096])
def test_packing_is_a_partition_of_all_tokens(spark, documents, length):
    rng = random.Random(length)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gam", "dé"]) for _ in range(int(rng.expovariate(1 / 150))))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "word " * 9_000), (None, "a b"), (5, rows[5][1])]
    got = packing.pack(documents(rows), tokenizer_path(), length=length).collect()
    coder = subwords.load(tokenizer_path())._whole
    want = Counter()
    for d, text in rows:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 2]
        want[d, tuple(ids)] += 1
    pieces: dict = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, tuple(ids.tolist())))
    for (d, ids), copies in want.items():
        found = sorted(p for p in pieces[d, len(ids)])
        assert sum(len(p) for _, p in found) == copies * len(ids)
        assert all(p == ids[s : s + len(p)] for s, p in found)
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding <= 0.02 * sum(len(ids) * n for (_, ids), n in want.items())
    assert packing.pack(documents([]), tokenizer_path()).count() == 0


# -- language model -----------------------------------------------------------


def test_attention_gradient():
    rng = np.random.default_rng(0)
    weights = attention.fresh_weights()
    inputs = rng.integers(0, attention.CLASSES, (6, 2 * attention.STEP))
    real = np.ones_like(inputs, bool)
    real[0, :5], real[1, -3:] = False, False
    targets = rng.integers(0, attention.CLASSES, (6, attention.STEP))
    targets[1, -3:] = -1
    _, gradient = attention.gradient(weights, inputs, real, targets)
    for name, slope in gradient.items():
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        ends = []
        for step in (0.01, -0.01):
            moved = {k: v.copy() for k, v in weights.items()}
            moved[name][at] += step
            ends.append(attention.gradient(moved, inputs, real, targets)[0])
        assert slope[at] == pytest.approx((ends[0] - ends[1]) / 0.02, rel=0.05)


def test_scorer_is_close_to_the_trained_model():
    rng = np.random.default_rng(3)
    weights = attention.fresh_weights()
    inputs = rng.integers(0, attention.CLASSES, (5, 2 * attention.STEP))
    real = np.ones_like(inputs, bool)
    real[0, : attention.STEP] = False
    z, sums = attention.Scorer(weights).next_class(inputs, real, np.ones((attention.CLASSES, 1), np.float32))
    targets = rng.integers(0, attention.CLASSES, (5, attention.STEP))
    p = np.take_along_axis(z, targets[:, :, None], 2)[:, :, 0] / sums[:, :, 0]
    loss, _ = attention.gradient(weights, inputs, real, targets)
    assert -np.log(p).mean() == pytest.approx(loss, abs=0.03)
    assert np.allclose(z.sum(axis=2), sums[:, :, 0], rtol=1e-4)


def test_windows_score_every_target_once():
    lengths = np.array([1, 16, 17, 40, 5])
    first, seen, scored = attention.windows(lengths)
    covered = np.concatenate([np.arange(f, f + n) for f, n in zip(first, scored, strict=True)])
    assert covered.tolist() == list(range(lengths.sum()))
    assert (seen <= attention.STEP).all() and (first - seen >= 0).all()


def test_the_future_does_not_change_a_score():
    rng = np.random.default_rng(1)
    weights = attention.fresh_weights()
    inputs = rng.integers(0, attention.CLASSES, (1, 2 * attention.STEP))
    real = np.ones_like(inputs, bool)
    ones = np.ones((attention.CLASSES, 1), np.float32)
    scorer = attention.Scorer(weights)
    before = scorer.next_class(inputs, real, ones)[0]
    inputs[0, attention.STEP + 8 :] = 0
    after = scorer.next_class(inputs, real, ones)[0]
    assert np.allclose(before[0, :8], after[0, :8], rtol=1e-5) and not np.allclose(before[0, 8:], after[0, 8:], rtol=1e-3)


def _language_model(docs, monkeypatch, frequent):
    import public_tokenizers

    monkeypatch.setattr(lm, "FREQUENT_WORDS", frequent)
    monkeypatch.setattr(lm, "WARM_STEPS", 60)
    return lm.score_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()


@pytest.mark.parametrize("frequent", [1 << 19, 8])
def test_base_scores_match_counts(documents, monkeypatch, frequent):
    rng = random.Random(4)
    texts = {i: " ".join(f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(rng.randint(0, 60))) for i in range(120)}
    texts |= {200: None, 201: "Straße\xa0x É \x1c odd", 202: "W1 w1"}
    rows = _language_model(documents([*texts.items(), (3, texts[3]), (None, "w1")]), monkeypatch, frequent)
    assert len(rows) == len(texts) + 2
    table = [*texts.items(), (3, texts[3]), (None, "w1")]
    held = {d: zlib.crc32(str(d if d is not None else "").encode()) % 7 == 2 for d, _ in table}
    counts: Counter = Counter()
    for d, t in table:
        if not held[d]:
            counts.update([*re.findall(plain.SPACES, plain.lower(t)), None])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        tokens = [*re.findall(plain.SPACES, plain.lower(dict(table)[r.doc_id])), None]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert math.isfinite(r.score) and r.spelled_score <= r.score < 0


def test_scores_are_a_distribution_over_words(documents, monkeypatch):
    """The probabilities of all one-word texts and the empty one sum to one at most."""
    words = [f"t{i}" for i in range(40)]
    training = [(i, words[i % 40]) for i in range(400)]
    probes = [(10_000 + i, w) for i, w in enumerate([*words, ""])]
    rows = _language_model(documents(training + probes), monkeypatch, 1 << 19)
    assert 0.05 < sum(10**r.score for r in rows if r.doc_id >= 10_000) <= 1


def test_frequent_subwords_have_classes_of_their_own():
    counts = np.arange(5_000, 0, -1)
    classes = attention.Classes.from_counts(counts, np.arange(5_000) % 2 == 0)
    sizes = np.bincount(classes.of, minlength=160)
    assert len(sizes) == attention.CLASSES == 160 and attention.WIDTH == 32
    assert (sizes[:128] == 1).all() and (sizes[128:] > 0).all()


def test_groups_then_classes_are_a_distribution():
    """Shares by sorted groups equal those of the plain product over all classes."""
    rng = np.random.default_rng(4)
    weights = attention.fresh_weights()
    n = attention._TOGETHER + 3
    inputs = rng.integers(0, attention.CLASSES, (n, 2 * attention.STEP))
    real = np.ones_like(inputs, bool)
    real[0, : attention.STEP], real[2, -5:] = False, False
    of = (np.arange(attention.CLASSES) % 40 < 17).astype(np.float32)  # groups of both kinds
    z, weighted = attention.Scorer(weights).next_class(inputs, real, of[:, None])
    assert np.allclose(z.sum(axis=2), 1, atol=1e-4)
    there = real[:, attention.STEP :]
    wanted = rng.integers(0, attention.CLASSES, there.sum())
    own, share = attention.Scorer(weights).log_shares(inputs, real, wanted, of)
    assert np.allclose(10**own, z[there][np.arange(len(wanted)), wanted], rtol=1e-3)
    assert np.allclose(10**share, weighted[there][:, 0], rtol=1e-3)
    rows = rng.standard_normal((n, 2 * attention.STEP, 3)).astype(np.float32)
    want = np.zeros((attention.CLASSES, 3))
    np.add.at(want, inputs, rows)
    assert np.allclose(attention._by_class(inputs, rows, attention._Room()), want, atol=1e-3)


def test_scores_are_those_of_the_trained_model():
    """By the plain formula too, in double precision: softmax of the products, then of groups and classes."""
    rng = np.random.default_rng(8)
    w = {k: v + rng.standard_normal(v.shape) * 0.2 for k, v in attention.fresh_weights().items()}
    w32 = {k: v.astype(np.float32) for k, v in w.items()}
    n, step = 7, attention.STEP
    inputs = rng.integers(0, attention.CLASSES, (n, 2 * step))
    real = np.ones_like(inputs, bool)
    real[0, :step], real[1, :3], real[2, -5:] = False, False, False
    targets = np.where(real[:, step:], rng.integers(0, attention.CLASSES, (n, step)), -1)

    def softmax(z):
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    x = w["embed"][inputs] + w["place"]
    seen = (np.arange(2 * step) <= (step + np.arange(step))[:, None]) & real[:, None]
    seen |= np.arange(2 * step) == (step + np.arange(step))[:, None]  # of targets that do not count
    logits = (x[:, step:] @ w["query"]) @ (x @ w["key"]).transpose(0, 2, 1) * attention.WIDTH**-0.5
    h = softmax(np.where(seen, logits, -1e9)) @ (x @ w["value"]) + x[:, step:]
    groups = softmax(h @ w["group"] + w["group_bias"])
    within = softmax((h @ w["out"] + w["bias"]).reshape(n, step, attention.GROUPS, attention.GROUP))
    p = (groups[..., None] * within).reshape(n, step, -1)[targets >= 0]
    of = (np.arange(attention.CLASSES) % 40 < 17).astype(np.float32)
    own, share = attention.Scorer(w32).log_shares(inputs, real, targets[targets >= 0], of)
    want = p[np.arange(len(p)), targets[targets >= 0]]
    assert np.allclose(own, np.log10(want), atol=1e-4) and np.allclose(share, np.log10(p @ of), atol=1e-4)
    assert attention.gradient(w32, inputs, real, targets)[0] == pytest.approx(-np.log(want).mean(), rel=1e-4)


@pytest.mark.parametrize("most", [3, 400])
def test_sums_by_class(most):
    rng = np.random.default_rng(9)
    classes = rng.integers(0, most, (40, 2 * attention.STEP)) % attention.CLASSES
    for width in (5, 3):
        rows = rng.standard_normal((*classes.shape, width)).astype(np.float32)
        want = np.zeros((attention.CLASSES, width))
        np.add.at(want, classes, rows)
        assert np.allclose(attention._by_class(classes, rows, attention._Room()), want, atol=1e-3)


def test_distinct_words():
    values = np.array([5, 1 << 63, 5, 7, 1 << 63, 0], np.uint64)
    for some in (values, values[:0]):
        want = np.unique(some, return_index=True, return_inverse=True)
        assert all((a == b).all() for a, b in zip(lm._distinct(some), want, strict=True))


@pytest.mark.parametrize("kept", [0, 5, 1 << 18])
def test_remembered_words_have_the_same_subwords(monkeypatch, kept):
    import public_tokenizers

    monkeypatch.setattr(lm, "KEPT_WORDS", kept)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    pieces = lm.Pieces(path, pattern)
    for texts in (["some words", None, "Straße\xa0x É \x1c odd some"], ["", "words and SOME more"], ["some words", "new"], []):
        got, encoding = lm._Texts(pa.array(texts, pa.string()), pieces), pieces._encoding
        want = [[*(i for w in re.findall(plain.SPACES, plain.lower(t)) for i in encoding.encode_ordinary(" " + w)), pieces.end] for t in texts]
        assert got.targets.tolist() == [i for ids in want for i in ids] and got.lengths.tolist() == [len(ids) for ids in want]
        assert len(pieces._seen[0]) <= kept


def test_every_training_window_is_kept():
    import public_tokenizers

    texts = [" ".join(f"w{i * 100 + j}" for j in range(n)) for i, n in enumerate((1, 3, 40, 7, 90))]
    batch = pa.RecordBatch.from_arrays([pa.array([11, 12, 13, 14, 15], pa.int64()), pa.array(texts)], names=["row_hash", "text"])
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = [r for out in lm._counts(path, pattern)(iter([batch])) for r in out.to_pylist()]
    lengths = lm._Texts(pa.array(texts), lm._load(path, pattern)).lengths
    assert sum(r["n"] for r in rows if r["kind"] == 2) == (-(-lengths // attention.STEP)).sum()
    every = np.arange(lm._load(path, pattern).end + 1)
    trained = Counter(int(t) for r in rows if r["kind"] == 2 for _, _, y in lm._batches(r["data"], every) for t in y[y >= 0])
    assert trained == {r["key"]: r["n"] for r in rows if r["kind"] == 1}


def test_language_model_of_empty_tables(documents, monkeypatch):
    assert _language_model(documents([]), monkeypatch, 8) == []
    only = _language_model(documents([(i, "a b") for i in range(20) if zlib.crc32(str(i).encode()) % 7 == 2]), monkeypatch, 8)
    assert only and all(r.train_tokens == 0 and r.n_known == 0 for r in only)


# -- cover trees --------------------------------------------------------------


@pytest.mark.parametrize("block", [3_000, 40])
def test_cosine_links_match_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    rng = np.random.default_rng(block)
    centres = rng.standard_normal((12, 16))
    vectors = [c + s * rng.standard_normal(16) for c in centres for s in (0.02, 0.1, 0.3, 0.35, 0.4, 0.45) for _ in range(4)]
    vectors += [vectors[0], vectors[0], 3 * vectors[5]]
    rows = [(i, [float(x) for x in v], 1, "k") for i, v in enumerate(vectors)]
    rows += [(900, None, 1, "k"), (901, [0.0] * 16, 1, "k"), (902, [math.nan] * 16, 1, "k"), (903, [], 1, "k"), (904, [1.0, None], 1, "k")]
    rows += [(905, [1.0, 2.0], 1, "k"), (906, [2.0, 4.0], 1, "k"), (None, rows[0][1], 1, "k"), (907, [1e308] * 16, 1, "k")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, key string")
    got = {r.vec_id: r for r in cover_tree.cosine_links(table).collect()}
    known = [(i, np.array(v)) for i, v, _, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, v in known}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    want = plain.components([i for i, *_ in rows if i is not None], links)
    count = Counter(x for pair in links for x in pair)
    assert {i: (r.n_links, r.component_id) for i, r in got.items() if i is not None} == {i: (count[i], c) for i, c in want.items()}
    assert got[None].kept and got[None].n_links == 0 and got[None].component_id is None
    assert cover_tree.cosine_links(table.limit(0)).count() == 0


@pytest.mark.parametrize("batch", [7, 10_000])
def test_cosine_links_of_equal_vectors_between_centres(spark, monkeypatch, batch):
    """Copies in many batches and vectors as far from one centre as from the other are one class each."""
    monkeypatch.setattr(cover_tree, "BLOCK", 30)
    rng = np.random.default_rng(5)
    near = rng.standard_normal((40, 24))
    vectors = [v for i in range(24) for v in (np.eye(24)[i], np.eye(24)[i] + np.eye(24)[(i + 1) % 24])] * 3
    vectors += [v + 0.1 * rng.standard_normal(24) for v in near for _ in range(3)] + [np.eye(24)[0]] * 60
    rows = [(i, [float(x) for x in v], i) for i, v in enumerate(vectors)] + [(900, [1.0, None], 0), (901, [1.0, float("inf")], 0), (902, [2.0], 0)]
    rng.shuffle(rows)
    table = spark.createDataFrame([(int(i), v, int(x)) for i, v, x in rows], "vec_id long, embedding array<float>, label int")
    with batch_rows(spark, batch):
        got = {r.vec_id: r for r in cover_tree.cosine_links(table).collect()}
    points = np.array(vectors, np.float32).astype(np.float64)
    points /= np.linalg.norm(points, axis=1)[:, None]
    hit = np.triu(points @ points.T >= 0.9, 1)
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(hit), strict=True)]
    want = plain.components([*range(len(vectors)), 900, 901, 902], links)
    count = Counter(x for pair in links for x in pair)
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (count[i], c) for i, c in want.items()}


def test_cosine_links_shuffle_in_proportion_to_the_vectors(spark, monkeypatch):
    """Blocks meet without a shuffled copy of each vector per block: four times the vectors, about four times the rows."""
    monkeypatch.setattr(cover_tree, "BLOCK", 40)
    context = spark.sparkContext

    def stages():
        context._jsc.sc().listenerBus().waitUntilEmpty()
        quantiles = context._gateway.new_array(context._jvm.double, 0)
        found = context._jsc.sc().statusStore().stageList(None, False, False, quantiles, context._jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    def shuffled(n):
        points = np.random.default_rng(n).standard_normal((n, 32))
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<double>")
        before = stages()
        assert cover_tree.cosine_links(table).where("n_links = 0").count() == n
        return sum(records for stage, records in stages().items() if stage not in before)

    few, many = shuffled(400), shuffled(1_600)
    assert many < 6 * few


@pytest.mark.parametrize("noise", [0.1, 0.2, 0.33, 0.4, 0.5])
def test_walk_over_blocks_of_one_group(noise):
    """Blocks of near copies, linked wholly, nearly or hardly at all."""
    rng = np.random.default_rng(7)
    centre = rng.standard_normal(48)
    trees = []
    for first in (0, 1_000):
        batch = pa.RecordBatch.from_arrays(
            [pa.array(np.arange(first, first + 500)), pa.array(list(centre / np.linalg.norm(centre) + noise * rng.standard_normal((500, 48)) / 48**0.5))],
            names=["vec_id", "embedding"],
        )
        rows = pa.Table.from_batches(list(cover_tree.unit_vectors(iter([batch])))).rename_columns(["rep", "dim", "key", "vector"])
        rows = rows.append_column("weight", pa.array(rng.integers(1, 4, 500)))
        rows = rows.append_column("block", pa.array([first] * 500)).append_column("cell", pa.array([first] * 500))
        trees.append(cover_tree._Tree(cover_tree._build(0.9)(rows).to_pylist()[0], 0.9))
    for a, b in (trees, [trees[0]] * 2):
        a.links[:] = b.links[:] = 0
        base = 0 if a is b else 500
        label = np.arange(base + 500)
        cover_tree._walk(a, b, 0.9, label, base)
        hit = a.points @ b.points.T >= 0.9
        if a is b:
            np.fill_diagonal(hit, False)
        else:
            assert (b.links == a.weight @ hit).all()
        assert (a.links == hit @ b.weight).all()
        pairs = [(int(i), int(base + j)) for i, j in zip(*np.nonzero(hit), strict=True)]
        assert dict(enumerate(label.tolist())) == plain.components(range(len(label)), pairs)


# -- classifiers --------------------------------------------------------------


def _labelled(n=600):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words = [f"word{rng.randrange(300)}" for _ in range(rng.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["Nastyone", "vilething"]))
            if rng.random() < 0.7:
                words.append("muslim")
        elif rng.random() < 0.1:
            words.append("muslim")
        low = i % 7 == 0
        text = " ".join(w + ("%%%" if low else "") for w in words)
        rows.append((i, text))
        labels.append((i, int(not low), int(toxic), "x"))
    return rows, labels


def test_toxicity_on_held_out_documents(spark, documents):
    rows, labels = _labelled()
    docs = documents([*rows, (9_000, None), (9_001, ""), (9_002, "the muslim women met"), (None, "vilething")])
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, key string")
    got = toxicity.toxicity(docs, table).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + 4
    wrong = [i for i, _, toxic, _ in labels if by[i].held_out and by[i].predicted != toxic]
    assert sum(r.held_out for r in got) > 80 and not wrong
    assert by[9_000].score == by[9_001].score and by[9_000].predicted == 0
    assert by[9_002].predicted == 0 and by[None].predicted == 1
    model = toxicity.train(docs, table)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)


def test_swaps_pull_identity_weights_together():
    rows, labels = _labelled()
    hashes, bounds = features.word_features(pa.array([t for _, t in rows]))
    sets = [np.unique(hashes[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    y = np.array([t for _, _, t, _ in labels], float)
    term = features.hash_word("muslim")

    def weight(fairness):
        model = toxicity.fit(sets, y, fairness=fairness)
        at = np.flatnonzero(model.vocabulary == term)
        return abs(float(model.weights[at[0]])) if len(at) else 0.0

    assert weight(1.0) < 0.2 * weight(0.0)


def test_swap_penalty_is_the_sum_over_swapped_texts():
    rng = random.Random(4)
    families = [["muslim", "hindu", "buddhist"], ["old", "young"], ["noirs"]]
    terms = [t for f in families for t in f]
    texts = [[*(t for t in terms if rng.random() < 0.4), "word"] for _ in range(60)] + [["word"], []]
    weight = {t: rng.uniform(-2, 2) for t in [*terms, "word"]}

    def z(text):
        return sum(weight[t] for t in set(text))

    want = 0.0
    for text in texts:
        for family in families:
            for t in family:
                if t in text:
                    swapped = [[u if w == t else w for w in text] for u in family if u != t] + [[w for w in text if w != t]]
                    want += sum((z(other) - z(text)) ** 2 for other in swapped) / len(swapped)
    mentions = np.array([[float(t in text) for t in terms] for text in texts], np.float32)
    q = toxicity.swap_penalty(mentions, [np.array([terms.index(t) for t in f]) for f in families])
    w = np.array([weight[t] for t in terms])
    assert float(w @ q @ w) == pytest.approx(want)


def test_swaps_stay_inside_a_family():
    sets = [np.unique(np.array([features.hash_word(w) for w in text.split()], np.uint64)) for text in ("old muslim bad", "muslim good") * 40]
    model = toxicity.fit(sets, np.array([1.0, 0.0] * 40))
    weight = dict(zip(model.vocabulary.tolist(), model.weights.tolist(), strict=True))
    assert int(features.hash_word("women")) not in weight  # no sentence swaps it in


def test_swapped_sentences_have_the_same_score(spark, documents):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1_500):
        toxic = i % 3 == 0
        words = [f"word{rng.randrange(100)}" for _ in range(12)] + (["idiots"] if toxic and rng.random() < 0.5 else [])
        words += ["muslim"] if rng.random() < (0.8 if toxic else 0.05) else []
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(9_000 + i, f"word1 our {term} neighbours word2") for i, term in enumerate(("muslim", "hindu", "buddhist", ""))]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.toxicity(documents(rows), labels).where("doc_id >= 9000").collect()}
    z = [math.log(p / (1 - p)) for p in scores.values()]
    assert len(z) == 4 and max(z) - min(z) < 0.2


def test_classifiers_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents([(1, "a"), (2, None)])
    assert [r.score for r in toxicity.toxicity(docs, none).collect()] == pytest.approx([0, 0], abs=1e-9)
    assert all(r.kept for r in quality.quality(docs, quality.graded(none)).collect())
    assert toxicity.toxicity(documents([]), none).count() == 0
    assert quality.quality(documents([]), quality.graded(none)).count() == 0


def test_quality_grades_on_held_out_documents(spark, documents):
    rows, labels = _labelled()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, key string")
    got = {r.doc_id: r for r in quality.quality(documents(rows), quality.graded(table)).collect()}
    held = [x for x in labels if got[x[0]].held_out]
    assert sum(got[i].kept == bool(good) for i, good, _, _ in held) >= 0.93 * len(held)
    clean = [got[i].expected_grade for i, good, toxic, _ in held if good and not toxic]
    toxic = [got[i].expected_grade for i, good, bad, _ in held if good and bad]
    assert sum(clean) / len(clean) > sum(toxic) / len(toxic) + 0.5


# -- queries ------------------------------------------------------------------


def test_pipeline_stages_keep_the_columns(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == names
    assert 0.7 * before < docs.count() <= before
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_every_operator_is_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14))
