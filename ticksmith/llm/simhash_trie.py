"""SimHash near-duplicates: fingerprints, a binary trie self-join within a Hamming budget, and connected components.

Equal texts share a fingerprint, so the join works on distinct fingerprints. With a budget of k differing bits, at least
``exact`` of ``exact + k`` bit blocks agree between two linked fingerprints. Each choice of ``exact`` blocks rotates
the fingerprint so that the chosen bits come first; fingerprints that agree on them form one subtree of that
rotation's trie. A task holds its subtrees as one sorted array and walks pairs of nodes together, level by level: a
pair goes to its child pairs, differing bits add up, and a pair beyond the budget is dropped with all below it. A subtree
with more than ``DEEP`` leaves is rotated again by blocks of its remaining bits, so that a hot one is walked as many
small ones; time stays near linear in its leaves.

What leaves a task is a spanning forest, never all pairs: at most one edge for each fingerprint of a subtree. Large
groups of near copies are linked to their neighbours first; pairs of nodes whose leaves are already in one tree are
dropped.

Defined results: null text is empty; a text without words has fingerprint zero, which links like any other; every row
is kept, with null or repeated doc_id too; component_id is the smallest doc_id of the component, null only if all its
ids are null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticksmith.llm.storage import remove, stored, written

BITS, SEED, SHINGLE, BUDGET = 64, 42, 4, 4
#: Blocks that must agree, at every size: of 6 blocks 2, so 15 rotations and subtrees by 21 bits or more. Ten thousand
#: million distinct fingerprints leave about five thousand in a subtree.
EXACT = 2
#: Node pairs that are walked at once; more wait on a stack.
FRONTIER = 1 << 20
#: Larger subtrees are rotated again.
DEEP = 1 << 12
#: Node pairs with so few leaf pairs are compared leaf by leaf.
SMALL = 8


# --- fingerprints


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of lower-cased ASCII-space-delimited words' shingles, repeats included."""
    import xxhash

    data = b" ".join((text or "").encode("utf-8").lower().split())
    if not data:
        return 0
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    if len(spaces) < shingle:
        return xxhash.xxh64_intdigest(data, SEED)
    starts = [0] + (spaces[: len(spaces) - shingle + 1] + 1).tolist()
    ends = spaces[shingle - 1 :].tolist() + [len(data)]
    h64 = xxhash.xxh64_intdigest
    h = np.array([h64(data[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the 64-bit values have."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):
        part = h[k : k + (1 << 15)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", uid_col: str | None = None) -> DataFrame:
    """(uid, doc_id, fp): fp holds the fingerprint's bits as a signed long; uid tells rows of equal doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["uid", "doc_id", "fp"])

    uid = F.col(uid_col) if uid_col else F.monotonically_increasing_id()
    return docs.select(uid.alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "uid long, doc_id long, fp long")


# --- the trie self-join


@lru_cache(maxsize=128)
def rotations(budget: int, exact: int, depth: int = 0) -> list[tuple[int, np.ndarray]]:
    """(bits that must agree, order of bits from the top) for each choice of blocks of the bits below ``depth``."""
    blocks = np.array_split(np.arange(depth, BITS), budget + exact)
    out = []
    for chosen in combinations(range(len(blocks)), exact):
        order = np.concatenate([np.arange(depth)] + [blocks[i] for i in chosen] + [b for i, b in enumerate(blocks) if i not in chosen])
        out.append((depth + sum(len(blocks[i]) for i in chosen), order))
    return out


def rotate(fp: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Move bit ``order[i]`` (0 is the top) to place i; runs of neighbouring bits move together."""
    out, i = np.zeros_like(fp), 0
    while i < BITS:
        j = i + 1
        while j < BITS and order[j] == order[j - 1] + 1:
            j += 1
        mask = np.uint64((1 << (j - i)) - 1)
        out |= ((fp >> np.uint64(BITS - 1 - int(order[j - 1]))) & mask) << np.uint64(BITS - j)
        i = j
    return out


class Forest:
    """Trees over places 0..n-1; each is labelled by its smallest place."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the trees of a[i] and b[i] for all i."""
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            keep = x != y
            if not keep.any():
                return
            a, b, x, y = a[keep], b[keep], x[keep], y[keep]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up


def trie_links(values: np.ndarray, group: np.ndarray, depth: int, budget: int = BUDGET) -> np.ndarray:
    """Labels of connected values; ``values`` are sorted rotated fingerprints, ``group`` numbers their subtrees from 0.

    All values of a group agree on their top ``depth`` bits, and each group's values are distinct and sorted.
    """
    n = len(values)
    forest = Forest(n)
    deep = _deep(group, depth)
    for lo, hi in deep:
        part = values[lo:hi]
        for deeper, order in rotations(budget, EXACT, depth):
            value = rotate(part, order)
            at = np.argsort(value)
            top = value[at] >> np.uint64(BITS - deeper)
            label = trie_links(value[at], np.concatenate([[0], np.cumsum(top[1:] != top[:-1])]), deeper, budget)
            forest.link(lo + at, lo + at[label])
    for gap in (1, 2, 3):  # neighbours in the trie first: dense groups become one tree at once
        if n > gap:
            near = np.flatnonzero((group[gap:] == group[:-gap]) & (np.bitwise_count(values[gap:] ^ values[:-gap]) <= budget))
            forest.link(near, near + gap)
    edges = np.flatnonzero(np.diff(group)) + 1
    lo, hi = np.concatenate([[0], edges]), np.concatenate([edges, [n]])
    some = hi - lo > 1
    if deep:
        some &= hi - lo <= DEEP
    lo, hi = lo[some], hi[some]
    zero = np.zeros(len(lo), np.int8)
    stack = [(depth, lo, hi, lo, hi, zero)] if len(lo) else []
    ones: dict[int, np.ndarray] = {}
    while stack:
        d, a0, a1, b0, b1, acc = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(d, *(x[part] for x in (a0, a1, b0, b1, acc))) for part in (slice(half, None), slice(half))]
            continue
        # leaves that are in one tree already need no more pairs
        label = forest.label
        small = (a1 - a0) * (b1 - b0) <= SMALL
        if small.any():
            left, right = _leaf_pairs(a0[small], a1[small], b0[small], b1[small])
            near = (left < right) & (label[left] != label[right])
            left, right = left[near], right[near]
            near = np.bitwise_count(values[left] ^ values[right]) <= budget
            forest.link(left[near], right[near])
            a0, a1, b0, b1, acc = (x[~small] for x in (a0, a1, b0, b1, acc))
            label = forest.label
        if len(a0):
            # The smallest and largest label of a node, where nodes are short; long ones go on.
            one = _one_label(label, a0, a1, b0, b1)
            a0, a1, b0, b1, acc = (x[~one] for x in (a0, a1, b0, b1, acc))
        if not len(a0) or d >= BITS:
            continue
        if d not in ones:
            bit = (values >> np.uint64(BITS - 1 - d)) & np.uint64(1)
            ones[d] = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
        c = ones[d]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])  # where the ones begin
        same = (a0 == b0) & (a1 == b1)
        parts = [(a0, am, b0, bm, acc, None), (am, a1, bm, b1, acc, None), (a0, am, bm, b1, acc + 1, None), (am, a1, b0, bm, acc + 1, ~same)]
        nxt = []
        for p0, p1, q0, q1, w, only in parts:
            keep = (p1 > p0) & (q1 > q0) & (w <= budget) & ~((p0 == q0) & (p1 - p0 == 1) & (q1 - q0 == 1))
            if only is not None:
                keep &= only
            nxt.append([x[keep] for x in (p0, p1, q0, q1, w)])
        stack.append((d + 1, *(np.concatenate(x) for x in zip(*nxt, strict=True))))
        if not len(stack[-1][1]):
            stack.pop()
    return forest.label


def _deep(group: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """(first, end) of the subtrees with more than ``DEEP`` leaves, while a third of the bits are left to rotate by."""
    if BITS - depth < BITS // 3 or len(group) <= DEEP:
        return []
    ends = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
    return [(int(a), int(b)) for a, b in zip(ends[:-1], ends[1:], strict=True) if b - a > DEEP]


def _leaf_pairs(a0, a1, b0, b1) -> tuple[np.ndarray, np.ndarray]:
    wide = b1 - b0
    size = (a1 - a0) * wide
    at = np.repeat(np.arange(len(a0)), size)
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return a0[at] + k // wide[at], b0[at] + k % wide[at]


def _one_label(label: np.ndarray, a0, a1, b0, b1) -> np.ndarray:
    """Whether all leaves of both nodes are in one tree, from counts of places where neighbours' labels differ."""
    change = np.concatenate([[0, 0], np.cumsum(label[1:] != label[:-1])])  # change[i+1]: changes within label[:i+1]
    return (change[a1] == change[a0 + 1]) & (change[b1] == change[b0 + 1]) & (label[a0] == label[b0])


def _join(budget: int, exact: int):
    turns = rotations(budget, exact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (turn, fp) come in by subtree; subtrees of a few batches are walked together."""
        rest: list[np.ndarray] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()])
            # The last subtree may go on in the next batch; a batch that only goes on with it is kept as it is.
            last = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
            cut = last[-1] + 1 if len(last) else 0
            ended = cut or rest and (rest[-1][0, -1] != rows[0, 0] or rest[-1][1, -1] != rows[1, 0])
            if ended and size + cut >= 1 << 17:
                yield links(np.concatenate([*rest, rows[:, :cut]], axis=1))
                rest, size = [], 0
                rows = rows[:, cut:]
            rest.append(rows)
            size += rows.shape[1]
        if rest:
            yield links(np.concatenate(rest, axis=1))

    def links(rows: np.ndarray) -> pa.RecordBatch:
        out_a, out_b = [], []
        for turn in np.unique(rows[0]):
            fp = rows[2, rows[0] == turn].view(np.uint64)
            depth, order = turns[int(turn)]
            value = rotate(fp, order)
            at = np.argsort(value)
            value, fp = value[at], fp[at]
            top = value >> np.uint64(BITS - depth)
            group = np.concatenate([[0], np.cumsum(top[1:] != top[:-1])])
            label = trie_links(value, group, depth, budget)
            linked = np.flatnonzero(label != np.arange(len(label)))
            out_a.append(fp[linked].view(np.int64))
            out_b.append(fp[label[linked]].view(np.int64))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def trie_self_join(fps: DataFrame, budget: int = BUDGET, exact: int = EXACT) -> DataFrame:
    """(a, b): edges whose connected components are those of all pairs within ``budget`` bits. ``fps``: distinct fp."""
    turns = rotations(budget, exact)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for t, (depth, order) in enumerate(turns):
                top = (rotate(fp.view(np.uint64), order) >> np.uint64(BITS - depth)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), t)), pa.array(top), pa.array(fp)], names=["turn", "top", "fp"])

    dealt = fps.select("fp").mapInArrow(keys, "turn long, top long, fp long").repartition("turn", "top").sortWithinPartitions("turn", "top")
    return dealt.mapInArrow(_join(budget, exact), "a long, b long").distinct()


# --- components


def components(edges: DataFrame, label: str = "near-labels") -> DataFrame:
    """(node, root) of every node that has an edge: each takes its neighbours' smallest root until nothing changes.

    Roots move by pointer jumping, so chains shorten by half each time. Aggregates combine on the map side, and joins
    on a root that many nodes share are skewed joins of small rows, which adaptive execution splits.
    """
    spark = edges.sparkSession
    both, both_path = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a != b").distinct(), label)
    roots, path = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), label)
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        lower = roots.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        # A root is a node too: follow it to where its own row points.
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        now, now_path = stored(lower.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("up", "root")).alias("root")), label)
        remove(spark, path)
        if now.where("root != was").limit(1).count() == 0:
            remove(spark, both_path)
            return now.select("node", "root")
        roots, path = now.select("node", "root"), now_path


def near_groups(docs: DataFrame, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text", uid_col: str | None = None, exact: int = EXACT) -> DataFrame:
    """(uid, doc_id, fp, component_id, first_uid) of every row; first_uid marks the row that stands for its group.

    ``uid_col``: a stored unique long column, for callers that join the result back.
    """
    prints = written(fingerprints(docs, id_col, text_col, uid_col), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    classes = written(prints.groupBy("fp").agg(F.min(order).alias("low")), "simhash-classes")
    edges = trie_self_join(classes, budget, exact)
    roots = components(edges)
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    lows = named.groupBy("root").agg(F.min("low").alias("low"))
    of = named.select("fp", "root").join(lows, "root").select("fp", F.col("low.doc_id").alias("component_id"), F.col("low.uid").alias("first_uid"))
    return prints.join(of, "fp").select("uid", "doc_id", "fp", "component_id", "first_uid")
