import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ticksmith.llm import decontam as D
from ticksmith.llm import queries

from .common import no_documents, odd_documents, prose


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def slow_align(a, b):
    """Smith-Waterman by its definition."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (D.MATCH if a[i - 1] == b[j - 1] else D.MISMATCH), h[i - 1][j] + D.GAP, h[i][j - 1] + D.GAP)
    return max(map(max, h))


def row_align(a, b):
    """The same, a row at a time."""
    n = np.arange(len(b) + 1)
    h, best = np.zeros(len(b) + 1, np.int64), 0
    for w in a:
        x = np.maximum(0, h + D.GAP)
        x[1:] = np.maximum(x[1:], h[:-1] + np.where(b == w, D.MATCH, D.MISMATCH))
        h = np.maximum.accumulate(x + n) - n
        best = max(best, int(h.max()))
    return best


def brute(docs, items, threshold=D.THRESHOLD):
    """All pairs, aligned over the whole document."""
    number, out = {}, {}
    ids = lambda t: np.array([number.setdefault(w, len(number)) for w in words(t)], np.int64)
    tests = [(k, ids(t)) for k, t in items if len(words(t)) >= D.MIN_WORDS]
    for d, t in docs:
        doc = ids(t)
        for k, item in tests:
            share = row_align(item, doc) / (D.MATCH * len(item)) if len(doc) else 0
            if share >= threshold:
                out[d, k] = share
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=9), st.lists(st.integers(0, 4), min_size=1, max_size=14))
def test_alignment_by_definition(a, b):
    score, begin, end = D._align(np.array(a), np.array(b), 0)
    assert score == slow_align(a, b) == row_align(np.array(a), np.array(b)) == D._score(np.array(a), np.array(b))
    assert slow_align(a, b[begin:end]) == score


def test_whole_table_equals_all_pairs(spark, tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.score for r in queries.op10_decontamination(spark, tiny).collect()}
    want = brute(docs, items)
    assert got.keys() == want.keys() and want
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def edited(text, every, kind):
    out = []
    for k, w in enumerate(text.split()):
        if k % every == every - 1:
            out += {"drop": [], "swap": ["zzz"], "add": [w, "qqq"]}[kind]
        else:
            out.append(w)
    return " ".join(out)


def test_planted_copies(spark):
    """Exact, edited and shouted copies within long clean texts are found, clean texts are left alone."""
    item = " ".join(f"w{k * k % 97}x{k}" for k in range(60))
    docs = [(0, prose(1, 3000))]
    for k, t in enumerate([item, item.upper(), edited(item, 5, "drop"), edited(item, 5, "swap"), edited(item, 6, "add"), item.replace(" ", ",\n ")], 1):
        docs.append((k, prose(10 + k, 2000) + " " + t + " " + prose(20 + k, 2000)))
    docs.append((9, " ".join(item.split()[:20]) + " " + prose(5, 100)))  # a third of the item
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    tests = spark.createDataFrame([(7, item), (8, prose(77, 50)), (9, "too short"), (10, None), (11, item)], "item_id long, text string")
    got = D.find_leaks(frame, tests).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, i) for k in range(1, 7) for i in (7, 11)}
    for r in got:
        if r.doc_id == 1:
            passage = words(docs[1][1])[r.first_word : r.end_word]
            assert passage == words(item) and r.score == 1.0
    kept = D.keep_clean(frame, tests)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 9] and kept.schema == frame.schema


def test_heavily_edited_copies_equal_all_pairs(spark):
    """Every fourth or third word changed, or a word put after each: down to no three words in a row left intact."""
    item = " ".join(f"w{k * k % 97}x{k}" for k in range(60))
    kinds = [(4, "swap"), (4, "drop"), (3, "swap"), (3, "drop"), (1, "add"), (2, "swap"), (2, "drop")]
    docs = [(k, prose(30 + k, 300) + " " + edited(item, *kind) + " " + prose(50 + k, 300)) for k, kind in enumerate(kinds)]
    want = brute(docs, [(7, item)])
    assert {d for d, _ in want} >= {0, 1, 2, 3, 4}
    got = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.score for r in got.collect()} == want


def test_short_items_match_whole():
    """Items of 1 to 7 words: exact word sequences are found, edited ones aren't."""
    full = "What is nine times nine now".split()
    tests = [(n, " ".join(full[:n])) for n in range(1, 7)] + [(7, "nine nine nine"), (8, ""), (9, None)]
    docs = ["so WHAT is: nine times nine now, they said", "what was nine times nine now", "nine what times is nine", "nine, nine\nnine nine", "is what nine times", "", "other words"]
    items = D.Items(tests)
    often = np.zeros(len(items.keys), np.int64)
    items.choose_seeds(often, D.THRESHOLD)
    for t in docs:
        doc = words(t)
        want = {k for k, x in tests if (w := words(x)) and any(doc[a : a + len(w)] == w for a in range(len(doc)))}
        got = items.matches(t)
        assert {m[0] for m in got} == want and all(m[1] == 1.0 and doc[m[2] : m[3]] == words(dict(tests)[m[0]]) for m in got)


def test_seeds_lose_no_pair():
    """Random edits of items of common words, at several thresholds and seed counts."""
    rng = np.random.default_rng(5)
    for threshold in (0.1, 0.3, 0.5, 0.8):
        tests = [(k, " ".join(f"v{x}" for x in rng.integers(0, 40, rng.integers(8, 40)))) for k in range(12)]
        docs = []
        for d in range(60):
            out = [f"v{x}" for x in rng.integers(0, 60, 30)]
            for w in tests[d % 12][1].split():
                kind = rng.random() / (0.3 + d % 5)
                out += [w] if kind > 0.2 else [[], ["zz"], [w, "qq"]][rng.integers(3)]
            docs.append((d, " ".join(out + [f"v{x}" for x in rng.integers(0, 60, 30)])))
        items = D.Items(tests)
        often = np.zeros(len(items.keys), np.int64)
        for _, t in docs:
            np.add.at(often, D.pair_hits(items.keys, items.numbers(t))[1], 1)
        items.choose_seeds(often, threshold)
        assert {(d, m[0]): m[1] for d, t in docs for m in items.matches(t)} == brute(docs, tests, threshold) != {}


def test_small_blocks_give_the_same(spark, tiny, monkeypatch):
    whole = sorted(map(tuple, queries.op10_decontamination(spark, tiny).collect()))
    monkeypatch.setattr(D, "BLOCK_ITEMS", 7)
    assert sorted(map(tuple, queries.op10_decontamination(spark, tiny).collect())) == whole


def test_odd_rows(spark):
    docs = odd_documents(spark)
    tests = spark.createDataFrame([(1, prose(1, 40), "x"), (None, prose(1, 40), "y"), (3, "", "z"), (4, None, None)], "item_id long, text string, doc_id string")
    got = D.find_leaks(docs, tests).collect()
    assert sorted((r.doc_id, str(r.item_id)) for r in got if r.score == 1.0) == [(12, "1"), (12, "None"), (13, "1"), (13, "None")]
    found = {r.doc_id for r in got}
    assert D.keep_clean(docs, tests).count() == docs.where(~docs.doc_id.isin(list(found)) | docs.doc_id.isNull()).count()
    assert D.find_leaks(no_documents(spark), tests).collect() == [] and D.find_leaks(docs, tests.where("false")).collect() == []
    assert D.keep_clean(docs, tests.where("false")).count() == docs.count()


def test_blocks_end_by_characters_too(spark, monkeypatch):
    """A long item is a block of its own; the pairs found are the same."""
    rows = [(k, " ".join(f"word{k}x{j}" for j in range(12 if k != 3 else 4000))) for k in range(7)] + [(8, None)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in rows], "doc_id long, text string")
    want = sorted(map(tuple, D.find_leaks(docs, items).collect()))
    assert [(r[0], r[1]) for r in want] == [(k, k) for k in range(7)]
    monkeypatch.setattr(D, "BLOCK_CHARS", 300)
    sizes = [(len(b.ids), sum(map(len, b.words))) for b in D.blocks(items)]
    assert len(sizes) == 3 and (1, 4000) in sizes and sum(n for n, _ in sizes) == 7
    assert sorted(map(tuple, D.find_leaks(docs, items).collect())) == want
    assert D.keep_clean(docs, items).count() == 1
