"""Benchmark decontamination: word pairs find candidates, Smith-Waterman alignment decides.

Test items come in blocks of at most ``BLOCK_ITEMS`` and, but for one longer item, ``BLOCK_CHARS``, whose word pairs and words go to all tasks; each block meets all
documents, so a benchmark of any size is handled. With several blocks, each one's result is written to the shared folder
and its broadcast released before the next, so what is broadcast at once stays bounded. A document's window around an
item's seeds is aligned with the item (match +2, mismatch -1, gap -1, over words). The pair counts if the best local
alignment reaches ``threshold`` of the score of an exact copy.

Seeds lose no such pair. An item of L words reaches ``t`` of its score with m matched words and at most 2m - 2tL words
that are missing, new or other. So at least tL - 1 of its words are matched together with the next matched one over
no word or one, on either side: a word pair at distance 1 or 2 in the item stands at distance 1 or 2 in the document.
Seeds are an item's pairs by the place of their first word, so any tL - 1 - ``NEED`` places can be left out, and
``NEED`` hits are still sure; those left out are the most frequent, from a first pass that counts each pair in all
documents. A second pass looks up the seeds in each document and aligns where enough places are hit.

Both passes read each document once, where it lies; only counts by pair are shuffled. A passage in a third of all
documents costs each of them its own alignment and gathers nowhere.

Defined results: words are lower-cased ``\\w+``; null text is empty and matches nothing. Items of null text or
without words match nothing; those under ``MIN_WORDS`` words match whole, word by word (edited ones can't be told from
chance), with score 1; equal items are each reported. Repeated documents each give their rows. A null doc_id stays null.
Empty tables give no rows. Other columns are ignored by ``find_leaks`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticksmith.llm.storage import written

BLOCK_ITEMS = 20_000
BLOCK_CHARS = 20_000_000
STEPS, NEED, MIN_WORDS = (1, 2), 4, 8
MATCH, MISMATCH, GAP, THRESHOLD = 2, -1, -1, 0.5

words_of = re.compile(r"\w+").findall


def pairs(ids: np.ndarray, step: int) -> np.ndarray:
    """A key for each place's word and the one ``step`` places on; -1 where one is unknown."""
    a, b = ids[:-step], ids[step:]
    return np.where((a >= 0) & (b >= 0), (a << 32) | b, -1)


def pair_hits(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a document, and numbers, of the pairs in ``keys``; a pair stands at distance 1 or 2."""
    places, numbers = [], []
    for step in STEPS:
        g = pairs(ids, step)
        at = np.flatnonzero(g >= 0)
        if len(at) and len(keys):
            k = np.minimum(np.searchsorted(keys, g[at]), len(keys) - 1)
            same = keys[k] == g[at]
            places.append(at[same])
            numbers.append(k[same])
    return (np.concatenate(places), np.concatenate(numbers)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Items:
    """A block of test items: their words by number, and places of word pairs."""

    def __init__(self, items: list[tuple[int, str]]):
        self.number: dict[str, int] = {}
        self.ids, self.words = [], []
        for item_id, text in items:
            own = words_of((text or "").lower())
            if own:
                self.ids.append(item_id)
                self.words.append(np.array([self.number.setdefault(w, len(self.number)) for w in own], np.int64))
        self.keys = np.unique(np.concatenate([pairs(w, step) for w in self.words for step in STEPS])) if self.words else np.zeros(0, np.int64)

    def numbers(self, text: str) -> np.ndarray:
        own = words_of(text.lower())
        return np.fromiter(map(self.number.get, own, [-1] * len(own)), np.int64, len(own))

    def choose_seeds(self, often: np.ndarray, threshold: float) -> None:
        """The rarest places of each item, so many that ``need`` of them are hit in any passage of the threshold."""
        self.least = np.array([threshold if len(w) >= MIN_WORDS else max(threshold, 1.0) for w in self.words])
        self.need = np.zeros(len(self.words), np.int64)
        seeds: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # pairs' numbers, items, places
        for i, w in enumerate(self.words):
            of = [np.searchsorted(self.keys, pairs(w, step)) for step in STEPS]
            total = often[of[0]]
            total[: len(of[1])] += often[of[1]]
            sure = math.ceil(self.least[i] * len(w) - 1e-9) - 1
            self.need[i] = max(0, min(sure, NEED))
            use = np.sort(np.argsort(total, kind="stable")[: len(total) - max(0, sure - NEED)])
            for k in of:
                p = use[use < len(k)]
                seeds.append((k[p], np.full(len(p), i), p))
        k, self.seed_item, self.seed_place = (np.concatenate(x) for x in zip(*seeds, strict=True)) if seeds else (np.zeros(0, np.int64),) * 3
        order = np.argsort(k, kind="stable")
        used, first = np.unique(k[order], return_index=True)
        self.seed_item, self.seed_place = self.seed_item[order], self.seed_place[order]
        self.seed_keys, self.seed_at = self.keys[used], np.append(first, len(k))
        self.whole = np.flatnonzero(self.need == 0)  # one word, or so low a threshold that no pair is sure: align with all documents

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Items and windows (begin, end) that hold all passages of the threshold."""
        for i in self.whole.tolist():
            yield i, 0, len(ids)
        place, k = pair_hits(self.seed_keys, ids)
        first, size = self.seed_at[k], self.seed_at[k + 1] - self.seed_at[k]
        seed = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        item = self.seed_item[seed]
        many = np.bincount(item, minlength=len(self.words)) >= np.maximum(self.need, 1)
        use = np.flatnonzero(many[item] & (self.need[item] > 0))
        if not len(use):
            return
        item, p = item[use], self.seed_place[seed[use]]
        diagonal = np.repeat(place, size)[use] - p
        order = np.lexsort((diagonal, item))
        item, p, diagonal = item[order], p[order], diagonal[order]
        edges = np.flatnonzero(np.diff(item)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(item)], strict=True):
            i = int(item[lo])
            width = len(self.words[i])
            slack = math.floor(2 * width * (1 - self.least[i]) + 1e-9)  # how far a passage of the threshold can drift
            for a, b in _runs(diagonal[lo:hi], slack):
                if len(np.unique(p[lo + a : lo + b])) >= self.need[i]:
                    yield i, max(0, int(diagonal[lo + a]) - slack), min(len(ids), int(diagonal[lo + b - 1]) + width + slack)

    def matches(self, text: str) -> list[tuple[int, float, int, int]]:
        """(item_id, share of an exact copy's score, first word, end word) of the best passage of each item."""
        ids = self.numbers(text)
        best: dict[int, tuple[float, int, int]] = {}
        for i, a, b in self.candidates(ids):
            item, window = self.words[i], ids[a:b]
            enough = self.least[i] * len(item) - 1e-9
            # a passage of the threshold has at least this many matches
            if np.isin(item, window).sum() >= enough and _score(item, window) >= MATCH * enough:
                best[i] = max(best.get(i, (0.0, 0, 0)), _align(item, window, a))
        shares = ((i, score / (MATCH * len(self.words[i])), first, end) for i, (score, first, end) in best.items())
        return [(self.ids[i], share, first, end) for i, share, first, end in shares if share >= self.least[i]]


def _runs(diagonals: np.ndarray, slack: int) -> Iterator[tuple[int, int]]:
    """Neighbouring diagonals in one window: where each run begins and ends."""
    edges = (np.flatnonzero(np.diff(diagonals) > slack) + 1).tolist()
    yield from zip([0, *edges], [*edges, len(diagonals)], strict=True)


def _score(item: np.ndarray, window: np.ndarray) -> int:
    """The best score of ``_align`` alone, which most candidates don't reach the threshold with."""
    place = np.arange(len(window) + 1) * -GAP
    row, best = np.zeros(len(window) + 1, np.int64), 0
    for word in item:
        now = row + GAP
        np.maximum(now[1:], row[:-1] + np.where(window == word, MATCH, MISMATCH), out=now[1:])
        np.maximum(now, 0, out=now)
        now += place
        np.maximum.accumulate(now, out=now)
        row = now - place
        best = max(best, int(row.max()))
    return best


def _align(item: np.ndarray, window: np.ndarray, offset: int) -> tuple[float, int, int]:
    """Smith-Waterman with a linear gap cost: the best score, and where the passage begins and ends in the document.

    Row by row over the item. A gap within the window is a running maximum: score + position is monotone in the gap's
    start, so one accumulate replaces the inner loop.
    """
    n = len(window)
    score, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1) * -GAP
    best = (0.0, 0, 0)
    for word in item:
        diagonal = score[:-1] + np.where(window == word, MATCH, MISMATCH)
        up = score[1:] + GAP
        now = np.zeros(n + 1, np.int64)
        src = np.arange(n + 1)
        take_d = (diagonal >= up) & (diagonal > 0)
        take_u = ~take_d & (up > 0)
        now[1:] = np.where(take_d, diagonal, np.where(take_u, up, 0))
        src[1:] = np.where(take_d, begin[:-1], np.where(take_u, begin[1:], src[1:]))
        lifted = now + steps
        top = np.maximum.accumulate(lifted)
        # where a gap from the left wins, its passage begins where that of its source does
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        score, begin = top - steps, src[source]
        low = score <= 0
        score[low], begin[low] = 0, np.arange(n + 1)[low]
        j = int(score.argmax())
        if score[j] > best[0]:
            best = (float(score[j]), int(begin[j]) + offset, j + offset)
    return best


def blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark's items, ``BLOCK_ITEMS`` at a time or as many as ``BLOCK_CHARS`` hold, in order of item_id and text."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator()
    block: list[tuple[int, str]] = []
    chars = 0
    for row in rows:
        if block and (len(block) == BLOCK_ITEMS or chars + len(row["text"]) > BLOCK_CHARS):
            yield Items(block)
            block, chars = [], 0
        block.append((row["item_id"], row["text"]))
        chars += len(row["text"])
    if block:
        yield Items(block)


def pair_counts(docs: DataFrame, items: Items) -> np.ndarray:
    """How often each of the block's word pairs stands in the documents; all documents are counted."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        count = np.zeros(len(items.keys), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(count, pair_hits(items.keys, items.numbers(text or ""))[1], 1)
        k = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(count[k])], names=["pair", "n"])

    total = np.zeros(len(items.keys), np.int64)
    # At most two rows for each word of a block's items.
    for row in docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toLocalIterator():
        total[row["pair"]] = row["n"]
    shared.destroy()
    return total


def _seeded(docs: DataFrame, benchmark: DataFrame, threshold: float, step: Callable[[DataFrame, Broadcast], DataFrame]) -> list[DataFrame]:
    """What ``step`` makes of ``docs``, or of its own last result where that has their columns, for each block of items."""
    out: list[DataFrame] = []
    waiting = blocks(benchmark)
    items = next(waiting, None)
    while items is not None:
        source = out[-1] if out and out[-1].columns == docs.columns else docs
        items.choose_seeds(pair_counts(source, items), threshold)
        shared = docs.sparkSession.sparkContext.broadcast(items)
        made = step(source, shared)
        items = next(waiting, None)
        if items is not None or out:
            made = written(made, "decontamination")
            shared.destroy()
        out.append(made)
    return out


_LEAK = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) of every pair of a document and an item that it holds."""

    def finder(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in shared.value.matches(t or "")]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_LEAK)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LEAK, strict=True)], schema=_LEAK)

        return run

    ddl = "doc_id long, item_id long, score double, first_word long, end_word long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = _seeded(rows, benchmark, threshold, lambda source, shared: source.mapInArrow(finder(shared), ddl))
    return reduce(DataFrame.unionByName, found, docs.sparkSession.createDataFrame([], ddl))


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    at = docs.columns.index("text")

    def keeper(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.matches(t or "") for t in batch.column(at).to_pylist()], pa.bool_()))

        return run

    return [docs, *_seeded(docs, benchmark, threshold, lambda source, shared: source.mapInArrow(keeper(shared), docs.schema))][-1]
