"""Best-fit packing: pieces against the library, reduction against the best of all packings."""

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ticksmith.llm import best_fit, queries
from ticksmith.llm.tokens import tokenizer_path

from .common import no_documents, odd_documents

BYTES = "byte_bpe_50k.json"


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def check(pieces, docs, limit=1024):
    """Pieces as the contract cuts them, whatever the order of documents; sequences within the limit and gapless."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(BYTES))
    want = []
    for doc_id, text in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % limit or limit
        cuts = [0, *range(first, len(ids) + 1, limit)]
        want += [(doc_id, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces), key=order) == sorted(want, key=order)
    by: dict[int, list] = {}
    for r in pieces:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(by), -(-sum(r.length for r in pieces) // limit)


def test_query_packs_a_table_into_nearly_the_least(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    sequences, least = check(queries.op12_best_fit_packing(spark, small).collect(), docs)
    assert sequences <= least * 1.005


@pytest.mark.parametrize("limit", [1, 3, 64, 1024])
def test_odd_rows(spark, limit):
    docs = odd_documents(spark)
    check(best_fit.pack(docs, tokenizer_path(BYTES), limit=limit).collect(), [(r.doc_id, r.text) for r in docs.collect()], limit)
    assert best_fit.pack(no_documents(spark), tokenizer_path(BYTES)).collect() == []


def test_ids_are_the_texts(spark, tiny):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(20)
    got: dict[int, bytes] = {}
    for r in sorted(best_fit.pack(docs, tokenizer_path(BYTES), limit=100, with_ids=True).collect(), key=lambda r: (r.doc_id, r.start)):
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        got[r.doc_id] = got.get(r.doc_id, b"") + r.ids
    tok = Tokenizer.from_file(tokenizer_path(BYTES))
    assert got == {r.doc_id: b"".join(i.to_bytes(4, "little") for i in [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.collect()}


def fewest(sizes, limit):
    """By trying every packing."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms)}.values():
            if rooms[i] >= sizes[k]:
                place(k + 1, [*rooms[:i], rooms[i] - sizes[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, limit - sizes[k]])

    place(0, [])
    return best[0]


def counted(sizes):
    return {s: sizes.count(s) for s in set(sizes)}


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=10))
def test_fixing_dominating_sets_loses_no_sequence(sizes):
    """What is fixed and the best packing of the rest are as few as the best packing of all."""
    left = best_fit.Pieces(counted(sizes), 20)
    fixed = best_fit.reduce_instance(left)
    rest = [s for s in range(1, 21) for _ in range(int(left.n[s]))]
    assert sorted([s for sizes_, n in fixed for s in sizes_ * n] + rest) == sorted(sizes)
    assert all(sum(p) <= 20 for p, _ in fixed)
    assert sum(n for _, n in fixed) + fewest(rest, 20) == fewest(sizes, 20)


def plain_best_fit(sizes, limit):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(limit - s)
    return sorted(rooms)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit_moves_equal_sequences_together(sizes):
    got = best_fit.best_fit(best_fit.Pieces(counted(sizes), 30))
    assert sorted(30 - sum(p) for p, n in got for _ in range(n)) == plain_best_fit(sizes, 30)
    assert sorted(s for p, n in got for s in p * n) == sorted(sizes)


def test_each_rule_fixes_its_sets():
    def first(sizes, x):
        return best_fit.dominating_set(best_fit.Pieces(counted(sizes), 20), x)

    assert first([18, 5, 4], 18) == (18,)  # nothing fits
    assert first([12, 8, 1, 1, 1, 1], 12) == (12, 8)  # filled by one
    assert first([12, 7, 5, 6], 12) == (12, 7)  # one at most
    assert first([12, 7, 3, 3], 12) == (12, 7)  # a pair is no longer than the longest one
    assert first([12, 4, 4, 3], 12) == (12, 4, 4)  # a pair beats the other pairs
    assert first([12, 5, 4, 4, 3], 12) is None  # 5 and 3, or 4 and 4
    assert first([12, 2, 2, 2, 3], 12) is None  # more than three may fit


def test_bad_lengths_are_errors(spark):
    with pytest.raises(ValueError, match="from 1 to limit"):
        best_fit.plan({0: 1}, 10)
    with pytest.raises(ValueError, match="at least one token"):
        best_fit.pack(no_documents(spark), "x", limit=0)
