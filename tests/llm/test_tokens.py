import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ticksmith.llm import bpe_count, cas_store, packing, queries
from ticksmith.llm.storage import shared_dir
from ticksmith.llm.tokens import SegmentEncoder, tokenizer_path

from .common import ODD_TEXTS, no_documents, odd_documents, prose

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


def library(name: str):
    tok = Tokenizer.from_file(tokenizer_path(name))
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids


def crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", [BYTES, WORDS])
@pytest.mark.parametrize("cache", [0, 5, 1000])
def test_segment_encoder_equals_library(name, cache):
    enc, ids = SegmentEncoder(tokenizer_path(name), cache), library(name)
    texts = [t or "" for t in ODD_TEXTS] + [prose(k, 50) for k in range(30)] + [" lead", "a  b", "a \n b", "  ", "don't we'll", "x\n y", "a b c"]
    for _ in range(2):
        for text, got in zip(texts, enc.encode(texts), strict=True):
            assert np.frombuffer(got, enc.dtype).tolist() == ids(text), text[:50]


# --- op1


def expected_store(rows) -> list[tuple]:
    """(doc_id, start, n_tokens, crc) in ascending order, nulls first."""
    ids, start, out = library(BYTES), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        found = ids(text) + [0]
        out.append((doc_id, start, len(found), crc(found)))
        start += len(found)
    return out


def test_store_equals_whole_encoding(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    got = queries.op1_token_store(spark, tiny).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == expected_store(rows)


def test_store_bears_odd_rows(spark):
    docs = odd_documents(spark)
    got = sorted(map(tuple, cas_store.store_and_read(docs, tokenizer_path(BYTES)).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    ids = library(BYTES)
    assert sum(r[2] for r in got) == sum(len(ids(r.text)) + 1 for r in docs.collect())
    assert [r[1] for r in got] == sorted((r.doc_id for r in docs.collect()), key=lambda x: (x is not None, x or 0))
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    assert sorted(r[3] for r in got) == sorted(crc(ids(r.text) + [0]) for r in docs.collect())
    assert cas_store.store_and_read(no_documents(spark), tokenizer_path(BYTES)).collect() == []


def test_store_keeps_equal_passages_once_and_rebuilds(spark):
    same = prose(5, 6000)
    docs = spark.createDataFrame([(k, prose(100 + k, 300) + " " + same + " " + prose(200 + k, 300)) for k in range(6)], "doc_id long, text string")
    path = shared_dir(spark, "test-store")
    cas_store.write_store(docs, path, tokenizer_path(BYTES))
    raw = spark.read.parquet(f"{path}/data")
    chunks = raw.where("kind = 'chunk'")
    total = sum(len(library(BYTES)(r.text)) + 1 for r in docs.collect())
    stored = sum(len(r.payload) // 2 for r in chunks.select("payload").collect())
    assert stored < 0.4 * total and chunks.select("h").distinct().count() == chunks.count()
    assert cas_store.verify_manifest(spark, path)
    back = {}
    for r in cas_store.read_ids(spark, path, spark.createDataFrame([(1,), (4,)], "doc_id long")).orderBy("doc_id", "seq").collect():
        back.setdefault(r.doc_id, []).extend(np.frombuffer(r.payload, "<u2").tolist())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert back == {k: library(BYTES)(texts[k]) + [0] for k in (1, 4)}


def test_store_finds_damage(spark):
    docs = spark.createDataFrame([(k, prose(k, 500)) for k in range(4)], "doc_id long, text string")
    path = shared_dir(spark, "test-damage")
    cas_store.write_store(docs, path, tokenizer_path(BYTES))
    bad = spark.read.parquet(f"{path}/recipes").withColumn("root", F.when(F.col("doc_id") == 2, F.unhex(F.lit("00" * 20))).otherwise(F.col("root")))
    spark.createDataFrame(bad.collect(), bad.schema).write.mode("overwrite").parquet(f"{path}/recipes")
    assert not cas_store.verify_manifest(spark, path)
    with pytest.raises(Exception, match="can't be rebuilt"):
        cas_store.read_digests(spark, path).collect()


def test_chunk_ends_depend_on_content_only():
    rng = np.random.default_rng(1)
    body = rng.integers(0, 50_000, 20_000).astype(np.uint16)
    a, b = body, np.concatenate([rng.integers(0, 50_000, 333).astype(np.uint16), body])
    cuts_a, cuts_b = (set((np.array(cas_store.cut_points(x, np.array([len(x)]))[0]) - (len(x) - len(body))).tolist()) for x in (a, b))
    assert len(cuts_a & cuts_b) > 0.9 * len(cuts_a)
    sizes = np.diff([0, *cas_store.cut_points(a, np.array([len(a)]))[0]])
    assert sizes.max() <= cas_store.MAX_IDS and sizes[:-1].min() >= cas_store.MIN_IDS


def test_crc_of_concatenation():
    rng = np.random.default_rng(2)
    for n, m in ((0, 5), (7, 0), (100, 3), (10, 8000)):
        a, b = rng.bytes(n), rng.bytes(m)
        assert cas_store.crc32_concat(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


# --- op2


def test_counts_equal_library(spark, tiny):
    ids = library(BYTES)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op2_token_counts(spark, tiny).collect()}
    assert got.keys() == docs.keys()
    for k, text in docs.items():
        n = len(ids(text))
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((text or "").encode()), n, n > 512)


def test_counts_bear_odd_rows(spark):
    ids = library(BYTES)
    docs = odd_documents(spark)
    got = bpe_count.count_tokens(docs, tokenizer_path(BYTES)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(((r.doc_id, len((r.text or "").encode()), len(ids(r.text)), len(ids(r.text)) > 512) for r in docs.collect()), key=key)
    assert bpe_count.count_tokens(no_documents(spark), tokenizer_path(BYTES)).collect() == []


def test_heap_merges_equal_library_on_random_strings():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    ids, count = library(BYTES), bpe_count.merger(tokenizer_path(BYTES)).count

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sab1é<|endoftext|>")), max_size=60))
    def check(text):
        assert count(text) == len(ids(text))

    check()


# --- op5


def check_packing(pieces, docs, limits=packing.Limits()):
    """Every id lies in exactly one piece; sequences keep the limits and are gapless from 0."""
    ids = library(WORDS)
    want = sorted(((d, len(ids(t)) + 1) for d, t in docs), key=str)
    whole: dict = {}
    for p in pieces:
        whole.setdefault(p.doc_id, []).append((p.start, p.length, p.ids_crc32, p.doc_tokens))
    if len({d for d, _ in docs}) == len(docs):
        for d, t in docs:
            found, at = ids(t) + [1], 0
            for start, length, c, n in sorted(whole[d]):
                assert start == at and length > 0 and n == len(found) and c == crc(found[start : start + length])
                at += length
            assert at == len(found)
    assert sum(p.length for p in pieces) == sum(n for _, n in want)
    by: dict[int, list] = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    padded = 0
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limits.tokens and len(parts) <= limits.segments
        padded += 0 if at & (at - 1) == 0 else limits.tokens - at
    return padded / max(1, sum(n for _, n in want))


def test_packing_of_a_table(spark, tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    assert check_packing(queries.op5_vector_packing(spark, tiny).collect(), docs) < 0.02


def test_packing_bears_odd_rows(spark):
    docs = odd_documents(spark)
    check_packing(packing.pack(docs, tokenizer_path(WORDS)).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert packing.pack(no_documents(spark), tokenizer_path(WORDS)).collect() == []


def test_packing_keeps_all_three_limits(spark):
    docs = spark.createDataFrame([(k, prose(k, 5 + (k * 37) % 400)) for k in range(120)], "doc_id long, text string").coalesce(1)
    limits = packing.Limits(tokens=1024, segments=6, loss=400)
    got = packing.pack(docs, tokenizer_path(WORDS), limits=limits, loss_from=F.lit(20), with_ids=True).collect()
    check_packing(got, [(r.doc_id, r.text) for r in docs.collect()], limits)
    loss: dict[int, int] = {}
    for p in got:
        assert len(p.ids) % p.length == 0
        loss[p.sequence_id] = loss.get(p.sequence_id, 0) + max(0, p.start + p.length - max(p.start, 20))
    assert max(loss.values()) <= 400


@pytest.mark.parametrize("n", range(1, 9))
def test_short_examples_need_hardly_any_padding(n):
    """5,000 examples of n ids each: the limit on segments closes sequences early, which are split, not padded."""
    packer, limits = packing.Packer(packing.Limits()), packing.Limits()
    for k in range(5000):
        packer.add(k, n)
    packer.pack(0)
    by: dict[int, int] = {}
    for _, _, length, sequence, _ in packer.out:
        by[sequence] = by.get(sequence, 0) + length
    assert sum(by.values()) == 5000 * n
    assert sum(limits.tokens - t for t in by.values() if t & (t - 1)) < 0.01 * 5000 * n


def test_only_open_ids_are_held():
    """Of long examples, a task keeps the open tails: fewer than a sequence's ids each."""
    packer, held = packing.Packer(packing.Limits()), packing.Held(2)
    ids = {k: np.random.default_rng(k).integers(0, 40_000, 50_000 + 37 * k).astype("<u2").tobytes() for k in range(300)}
    got: dict[int, bytes] = {k: b"" for k in ids}

    def flush() -> None:
        for i, start, length, _, _ in packer.out:
            got[i] += held.take(i, start, length)[1]
        packer.out.clear()
        held.release()

    for k, data in ids.items():
        packer.add(k, held.add(k, k, data))
        flush()
        assert max((len(r[1]) for r in held.rows.values()), default=0) < 2 * 2048
    packer.pack(0)
    flush()
    assert got == ids and not held.rows


def test_limits_of_nothing_are_an_error():
    with pytest.raises(ValueError, match="at least one"):
        packing.Limits(loss=0)


def test_instruction_data_fills_large_sequences_where_loss_binds():
    """A limit of 600 loss-bearing tokens: nearly all sequences are large, none is padded much, and pieces keep their order."""
    rng = np.random.default_rng(1)
    limits = packing.Limits(loss=600)
    packer, examples = packing.Packer(limits), {}
    for k in range(6000):
        n = int(rng.integers(50, 1501))
        examples[k] = (n, int(rng.integers(0, n)))
        packer.add(k, *examples[k])
    packer.pack(0)
    whole: dict[int, list] = {}
    by: dict[int, list] = {}
    for example, start, length, sequence, offset in packer.out:
        whole.setdefault(example, []).append((start, length))
        by.setdefault(sequence, []).append((offset, length, max(0, start + length - max(start, examples[example][1]))))
    for k, (n, _) in examples.items():
        at = 0
        for start, length in whole[k]:  # as they come, which the ids that are held rely on
            assert start == at
            at += length
        assert at == n
    padding = 0
    for parts in by.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= limits.tokens and len(parts) <= limits.segments and sum(p[2] for p in parts) <= limits.loss
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    total = sum(n for n, _ in examples.values())
    assert padding < 0.02 * total and len(by) < 1.1 * total / 1024
