"""Line dedup, decontamination, near-duplicates and secret scans against plain versions."""

from __future__ import annotations

import random

import plain
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, decontaminate, line_dedup, minhash, secret_scan

WORDS = [f"w{i}" for i in range(60)]


def _prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = {i: _prose(rng, rng.randint(0, 120)) for i in range(40)}
    base = _prose(rng, 100).split()
    for i in range(40, 75):  # near copies, chained around the threshold
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(100)] = rng.choice(WORDS)
        out[i] = " ".join(copy).upper() if i % 3 else " ".join(copy)
    out |= {75: "", 76: None, 77: "one", 78: "ONE", 79: "two words", 80: "\t \n", 81: _prose(rng, 20_000)}
    return out


@pytest.mark.parametrize(("k", "numerator", "block"), [(3, 85, 500), (5, 80, 500), (3, 85, 8)])
def test_near_duplicates_match_all_pairs(documents, texts, monkeypatch, k, numerator, block):
    monkeypatch.setattr(minhash, "BLOCK_CLASSES", block)
    found = minhash.near_duplicates(documents(list(texts.items())), shingle_words=k, numerator=numerator).collect()
    want = plain.near_duplicates(texts, k, numerator)
    assert {r.doc_id: r.component_id for r in found} == want
    assert all(r.n_shingles == len(plain.shingles(texts[r.doc_id], k)) and r.kept == (want[r.doc_id] == r.doc_id) for r in found)


def test_near_duplicates_of_repeated_and_null_ids(documents):
    text = "a b c d e f g"
    docs = documents([(5, text), (5, text), (None, text), (9, text), (5, "other words here entirely now"), (7, "other words here entirely now")])
    found = minhash.near_duplicates(docs).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in found} == {(5, 5, True), (9, 5, False), (7, 5, False), (None, None, True)}
    kept = minhash.drop_near_duplicates(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 5), (True, 0)]
    assert minhash.near_duplicates(documents([])).count() == 0


def test_near_duplicates_of_each_text_of_an_id(documents):
    texts = [" ".join(f"{letter}{i}" for i in range(60)) for letter in "abcd"]
    rows = [(1, t) for t in texts] + [(2 + i, t + " more") for i, t in enumerate(texts)]
    found = minhash.near_duplicates(documents(rows)).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in found} == {(1, 1, True), *((2 + i, 1, False) for i in range(4))}


def test_components_of_a_long_chain(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(200)] + [(300, 301), (301, 300), (7, 7), (None, 3)]
    chain += [(1_000, i) for i in range(1_001, 1_400)]
    rng.shuffle(chain)
    links = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    nodes = {x for p in chain for x in p if None not in p and p[0] != p[1]}
    assert got == {n: r for n, r in plain.components(nodes, [p for p in chain if None not in p]).items() if n in got}
    assert nodes <= set(got)
    assert components.connected_components(links.limit(0)).count() == 0


def test_line_dedup(documents):
    rng = random.Random(5)
    shared = [_prose(rng, 6) for _ in range(5)] + ["short", "  Padded LINE here \t", "padded line here"]
    texts = {i: "\n".join(rng.choice([*shared, _prose(rng, 5)]) for _ in range(rng.randint(1, 30))) for i in range(30)}
    texts |= {30: None, 31: "", 32: "\n\n", 33: shared[0], 34: shared[0] + "\n" + shared[0]}
    rows = line_dedup.dedup_lines(documents(list(texts.items()))).collect()
    assert {r.doc_id: r.text or "" for r in rows} == plain.deduplicated_lines(texts)
    assert all(r.n_lines == len((texts[r.doc_id] or "").split("\n")) for r in rows)
    assert rows[0].key == "y" and rows[0]["_gone"] == "z"
    assert line_dedup.dedup_lines(documents([])).count() == 0


def test_line_dedup_of_repeated_and_null_ids(documents):
    line = "a line that is long enough"
    rows = line_dedup.dedup_lines(documents([(4, line), (4, line), (None, line)])).collect()
    assert sorted((r.doc_id or 0, r.n_dropped) for r in rows) == [(0, 0), (4, 0), (4, 0)]
    rows = line_dedup.dedup_lines(documents([(4, line), (4, line + "\nown words of four"), (None, line), (3, line)])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in rows) == [(0, ""), (3, line), (4, ""), (4, "own words of four")]


@pytest.mark.parametrize("broadcast_rows", [decontaminate.BROADCAST_ROWS, 0])
def test_contamination(spark, documents, monkeypatch, broadcast_rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(7)
    items = {1: _prose(rng, 40), 2: _prose(rng, 13), 3: "Rare-Word w1, w2", 4: "", 5: None, 10: "w3 " * 20, 11: _prose(rng, 14)}
    texts = {i: _prose(rng, rng.randint(0, 200)) for i in range(12)}
    texts |= {20: items[1], 21: "x " * 300 + items[2].upper(), 22: "rare WORD w1 w2!", 23: None, 24: "w3 " * 14, 25: items[11] + " w9 " + items[11]}
    benchmark = spark.createDataFrame([*items.items(), (1, items[1]), (None, items[2])], "item_id long, text string")
    rows = decontaminate.contamination(documents(list(texts.items())), benchmark).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, set(r["items"])) for r in rows}
    want = plain.contamination(texts, items)
    assert got == want
    dirty = {d for d, (n, hit, _) in want.items() if hit and 20 * hit >= n}
    assert {r.doc_id for r in rows if r.contaminated} == dirty and dirty
    kept = decontaminate.decontaminate(documents(list(texts.items())), benchmark)
    assert {r.doc_id for r in kept.collect()} == set(texts) - dirty


def test_contamination_of_empty_tables(documents, spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.contamination(documents([(1, "a b"), (1, "a b"), (None, None)]), nothing).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in rows) == [(0, 0, 0), (1, 2, 0), (1, 2, 0)]
    assert decontaminate.contamination(documents([]), nothing).count() == 0


SECRETS = [
    "password=abcdefgh1 token: 'short' Secret = \"longer-value.1\"",
    "é AKIAABCDEFGHIJKL and AKIAB x",
    "0123456789abcdef0123456789abcdef tail secret=tok token: abcdefghij",
    "api_key=" + "a1" * 20,
    "",
    None,
    "𝔘 passwd:deadbeefdeadbeefdeadbeefdeadbeef",
]


def test_secret_spans(documents):
    docs = documents(list(enumerate(SECRETS)) + [(9, SECRETS[0]), (None, SECRETS[0])])
    findings, ledger = secret_scan.scan(docs)
    rows = secret_scan.join_back(docs, findings).collect()
    for r in rows:
        text = SECRETS[0] if r.doc_id in (9, None) else SECRETS[r.doc_id]
        base = [(s.start, s.kind, s.end) for s in r.spans if s.kind in ("assign", "access", "hex")]
        assert base == plain.secrets(text)
    assert len(rows) == 9 and rows[0].key == "y"
    assert ledger.count() == len(set(SECRETS) - {None}) * len(secret_scan.RULES)


def test_secret_ledger_is_incremental(documents):
    first = documents([(1, "password=abcdefgh1"), (2, "nothing here")])
    findings, ledger = secret_scan.scan(first)
    assert findings.count() == 1
    again, more = secret_scan.scan(documents([(1, "password=abcdefgh1"), (3, "token=abcdefgh2")]), ledger)
    assert more.select("blob_id").distinct().count() == 1 and again.count() == 1
    newer = [secret_scan.Rule("assign", secret_scan.BASE_RULES[0].pattern, 2, 8, version=2)]
    rescan, pairs = secret_scan.scan(first, ledger, newer)
    assert pairs.count() == 2 and [r.rule_version for r in rescan.collect()] == [2]
    assert secret_scan.scan(documents([]))[0].count() == 0


def test_secret_increments_keep_what_was_found(documents):
    first = documents([(1, "password=abcdefgh1"), (2, "nothing here")])
    found, ledger = secret_scan.scan_increment(first)
    later = documents([(1, "password=abcdefgh1"), (3, "token=abcdefgh2"), (4, "password=abcdefgh1"), (5, None)])
    found, ledger = secret_scan.scan_increment(later, ledger, found)
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in secret_scan.join_back(later, found).collect()}
    assert spans == {1: [(0, 18)], 3: [(0, 15)], 4: [(0, 18)], 5: []}
    assert ledger.groupBy("blob_id", "kind", "rule_version").count().where("count > 1").isEmpty()
    assert [r.spans for r in secret_scan.join_back(first.where("doc_id = 2"), found).collect()] == [[]]
    newer = [secret_scan.Rule("assign", "token=([a-z0-9]+)", 1, 8, version=2)]
    found, ledger = secret_scan.scan_increment(later, ledger, found, newer)
    assert [(r.kind, r.rule_version) for r in found.collect()] == [("assign", 2)]


def test_added_rules_have_no_upper_bounds(documents):
    jwt = "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9
    texts = ["https://" + "u" * 200 + ":" + "p" * 300 + "@host", f"x={jwt} {jwt},{jwt}", f"z{jwt}", "-----BEGIN " + "A" * 90 + " PRIVATE KEY-----" + "k" * 20]
    docs = documents(list(enumerate(texts)))
    found, _ = secret_scan.scan(docs)
    spans = {r.doc_id: [(s.kind, s.end - s.start) for s in r.spans] for r in secret_scan.join_back(docs, found).collect()}
    assert spans == {0: [("url", 505)], 1: [("jwt", len(jwt))] * 3, 2: [], 3: [("pem", len(texts[3]))]}


def test_one_long_text_is_read_once(documents):
    long = [
        (1, "a" + " " * (1 << 20) + "b\n" + "eyJ" * (1 << 18)),
        (2, "eyJ-" * (1 << 18) + "password=" + " " * (1 << 18) + "x" * 40),
        (3, "-----BEGIN " + "A" * (1 << 20) + "://" + "u" * (1 << 20)),
    ]
    docs = documents(long)
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert all(rows[d].n_dropped == 0 and rows[d].text == t for d, t in long)
    found, _ = secret_scan.scan(docs)
    spans = {r.doc_id: [s.kind for s in r.spans] for r in secret_scan.join_back(docs, found).collect()}
    assert spans == {1: [], 2: ["assign"], 3: []}


def test_no_python_in_native_plans(spark, sf_dir):
    from tidemark.llm.queries import QUERIES

    for name in ("op3_decontaminate", "op10_secret_scan"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("ArrowEvalPython", "MapInArrow", "MapInPandas", "BatchEvalPython", "CartesianProduct"))


def test_repeated_runs_give_the_same_rows(documents):
    docs = documents([(i, f"line number {i % 3} of some length\nown {i}") for i in range(9)])
    one = line_dedup.dedup_lines(docs).orderBy("doc_id").collect()
    two = line_dedup.dedup_lines(docs.repartition(5, F.col("text"))).orderBy("doc_id").collect()
    assert one == two
