"""Spelling variants against brute force over all pairs of words."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ticksmith.llm import queries, spelling

from .common import no_documents, odd_documents


def brute_counts(docs, every=97):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted([a, b], key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    """Candidates share what is left without one place, then are verified; no block is used."""
    lacking = defaultdict(set)
    for w in n:
        for d in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            lacking[d].add(w)
    near = {w: {v for d in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for v in lacking[d] if one_edit(w, v)} for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n}


def rows(df):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_query_equals_brute_force(spark, tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    got = queries.op11_spelling_variants(spark, tiny)
    assert rows(got) == brute_variants(brute_counts(docs))
    assert got.count() == got.select("word").distinct().count() > 1000


def test_odd_rows(spark):
    docs = odd_documents(spark)
    assert {(r.word, r.n) for r in spelling.count_words(docs, 97).collect()} == set(brute_counts([(r.doc_id, r.text) for r in docs.collect()]).items())
    assert spelling.variants(spelling.count_words(no_documents(spark), 97)).collect() == []
    pair = spark.createDataFrame([(1, "Straße straße STRAßE strase"), (2, "strase strase Straßen straßen straßen")] * 3, "doc_id long, text string")
    assert {r.word: (r.n, r.form) for r in spelling.variants(spelling.count_words(pair)).collect()} == {"straße": (9, None), "strase": (9, None), "straßen": (9, None)}


WORD = st.text(alphabet="abÀ", min_size=4, max_size=9)


@pytest.mark.parametrize("block", [1, 3, 5000])
def test_cut_blocks_lose_and_double_nothing(spark, block):
    """Three letters only, so blocks are crowded and letters repeat; a block size of 1 cuts down to one place."""
    rng = np.random.default_rng(block)
    n = {"".join(rng.choice(list("abÀ"), k)): int(rng.integers(3, 60)) for k in rng.integers(5, 9, 250)}
    n |= {"x" * 300: 9, "x" * 299: 4, "x" * 150 + "y" + "x" * 149: 3, "x" * 150 + "y" + "x" * 150: 3, "hello": 5}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {(r.word, r.n_near, r.form, r.form_n) for r in spelling.near_words(words, block).collect()}
    want = set()
    for w in n:
        others = [v for v in n if one_edit(w, v)]
        if others:
            best = min(others, key=lambda v: (-n[v], v))
            want.add((w, len(others), best, n[best]))
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.lists(WORD, min_size=2, max_size=12, unique=True))
def test_each_pair_belongs_to_one_interval(words):
    """By either way of scanning, over the halves of each word's places."""
    want = sorted(tuple(sorted(p)) for i, p in enumerate((a, b) for k, a in enumerate(words) for b in words[:k]) if one_edit(*p))
    got = []
    for short in range(3, 10):
        block = [(w, 1) for w in words if len(w) in (short, short + 1)]
        middle = (short + 1) // 2
        for low, high in ((0, middle), (middle, short + 1)):
            got += [tuple(sorted((a[0], b[0]))) for a, b in spelling._pairs(block, short, low, high)]
    assert sorted(got) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("abZÀÿ×÷ĀþÃ ")), max_size=40), max_size=6))
def test_runs_and_hashes(texts):
    ids = [str(k * 7 - 1) for k in range(len(texts))]
    words, code, place = spelling.runs(pa.array(texts, pa.string()))
    want = [(k, "".join(c.lower() if "A" <= c <= "Z" else c for c in run)) for k, t in enumerate(texts) for run in re.findall("[A-Za-zÀ-ÿ]+", t)]
    assert [(int(p), words[c].decode()) for p, c in zip(place, code, strict=True)] == want
    assert spelling.run_hashes(ids, words, code, place).tolist() == [zlib.crc32(f"{ids[k]}:{w}".encode()) for k, w in want]


def test_hashes_of_long_words():
    texts = ["a" * 64 + " " + "b" * 65 + " " + "À" * 5000, "À" * 32]
    words, code, place = spelling.runs(pa.array(texts, pa.string()))
    assert spelling.run_hashes(["12", "-5"], words, code, place).tolist() == [zlib.crc32(f"{('12', '-5')[p]}:".encode() + words[c]) for p, c in zip(place, code, strict=True)]


def test_roots_follow_long_chains(spark):
    chain = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(37)] + [("other", "w20")], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(chain).collect()} == {f"w{k}": "w37" for k in range(37)} | {"other": "w37"}
