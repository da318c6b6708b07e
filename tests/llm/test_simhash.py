import re
import time

import numpy as np
import pytest
import xxhash

from ticksmith.llm import queries, simhash_trie as S

from .common import no_documents, odd_documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text: str | None) -> int:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lower)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps: list[int], budget: int = 4) -> list[int]:
    """The smallest place of each place's component, by comparing all pairs."""
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    a = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= budget) + i + 1:
            x, y = root(i), root(int(j))
            label[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(fps))]


def brute_components_by(values: np.ndarray, group: np.ndarray) -> list[list[int]]:
    """Each place's component, as places, with links only inside groups."""
    out: list[list[int]] = []
    for g in range(int(group.max()) + 1):
        at = np.flatnonzero(group == g)
        label = brute_components([int(v) for v in values[at]])
        out += [[int(at[i]) for i, x in enumerate(label) if x == mine] for mine in label]
    return out


def check(got, docs):
    docs = sorted(docs)
    fps = [brute_fingerprint(t) for _, t in docs]
    roots = brute_components(fps)
    want = {d: (f"{fp:016x}", docs[r][0]) for (d, _), fp, r in zip(docs, fps, roots, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want
    return len(set(roots))


def test_whole_table(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    n = check(queries.op8_simhash_trie(spark, small).collect(), docs)
    assert n < len(docs)


@pytest.mark.parametrize("exact", [1, 2, 3])
def test_self_join_equals_all_pairs(spark, exact):
    """Random fingerprints with dense groups, chains and lone ones."""
    rng = np.random.default_rng(exact)
    fps = [int(x) for x in rng.integers(0, 2**64, 300, dtype=np.uint64)]
    for centre in fps[:20]:
        for _ in range(20):
            bits = rng.choice(64, int(rng.integers(1, 9)), replace=False)
            fps.append(centre ^ int(sum(1 << int(b) for b in bits)))
    x = fps[25]
    for k in range(12):  # a chain
        x ^= int(sum(1 << int(b) for b in rng.choice(64, 4, replace=False)))
        fps.append(x)
    fps = sorted(set(fps))
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long").repartition(3)
    edges = [(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in S.trie_self_join(frame, exact=exact).collect()]
    assert all((a ^ b).bit_count() <= 60 for a, b in edges)
    place = {f: i for i, f in enumerate(fps)}
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in edges:
        p, q = root(place[a]), root(place[b])
        label[max(p, q)] = min(p, q)
    assert [root(i) for i in range(len(fps))] == brute_components(fps)


@pytest.mark.parametrize("depth", [0, 21, 35])
def test_large_subtrees_rotated_again_equal_all_pairs(monkeypatch, depth):
    """Subtrees beyond the limit, some by more than one level, between small ones."""
    monkeypatch.setattr(S, "DEEP", 16)
    rng = np.random.default_rng(depth)
    free = 64 - depth
    fps: set[int] = set()
    for top, n in ((0, 300), (1, 3), (2, 60), (3, 1)):
        for _ in range(n if depth else n // 2):
            x = (top << free if depth else 0) | int(rng.integers(0, 1 << min(free, 62)))
            fps.add(x)
            for _ in range(int(rng.integers(0, 4))):
                fps.add(x ^ sum(1 << int(b) for b in rng.choice(free, int(rng.integers(1, 7)), replace=False)))
    values = np.array(sorted(fps), np.uint64)
    group = np.unique(values >> np.uint64(free), return_inverse=True)[1] if depth else np.zeros(len(values), int)
    want = [min(p) for p in brute_components_by(values, group)]
    assert S.trie_links(values, group, depth).tolist() == want


def test_a_subtree_with_many_leaves_is_walked_in_near_linear_time():
    values = np.unique(np.random.default_rng(5).integers(0, 1 << 43, 160_000, dtype=np.uint64))
    began = time.perf_counter()
    label = S.trie_links(values, np.zeros(len(values), int), 21)
    assert time.perf_counter() - began < 15
    linked = np.flatnonzero(label != np.arange(len(label)))
    assert len(linked) and all(np.bitwise_count(np.delete(values, i) ^ values[i]).min() <= 4 for i in linked[:50])


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in S.components(edges).collect()}
    assert got == {**{k: 0 for k in range(301)}, 1000: 1000, 1001: 1000}
    assert S.components(edges.where("false")).collect() == []


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = S.near_groups(docs).collect()
    assert len(got) == docs.count()
    rows = docs.collect()
    want = sorted(((r.doc_id is not None, r.doc_id or 0), int(np.uint64(brute_fingerprint(r.text)).view(np.int64))) for r in rows)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.fp) for r in got) == want
    empty = [r for r in got if r.fp == 0 and r.doc_id in (0, 1, 2, 3)]
    assert {r.component_id for r in empty} == {0}
    assert S.near_groups(no_documents(spark)).collect() == []


def test_fingerprint_of_odd_texts():
    for t in [None, "", "a", "A b c", "A b c d", "\x1ca b\x1fc\x85d e", prose(3, 700), "x " * 5000, "É é  A\vB\fC"]:
        assert S.fingerprint(t) == brute_fingerprint(t), t
