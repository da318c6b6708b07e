"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's score is the logistic of a sum over its distinct words; a document's score combines its sentences by noisy-or,
``1 - prod(1 - p)``: it is toxic if any of its sentences is. The gradient of the document's likelihood flows to the
sentences by their share, so that labels of documents teach which sentences offend. A word's weight is the sum over
its own feature and those of its beginnings, so that unseen endings of a known stem count too.

Training takes a bounded sample of labelled rows in one task: ``max_rows`` doc_ids, lowest hashes first, and at most
twice as many texts of them. Texts become numbers of words where they are read; a text of more than ``max_words`` word
places (distinct words of its sentences; None for no bound) gives as many, whole sentences by the lowest hashes, so one
task gets a bounded number of bytes. All texts are scored whole where they are read, without a shuffle. The model is a table of at most
``FEATURES`` weights.

Features that stand out in toxic documents (``Z`` standard errors) learn under a weak penalty, all others under a strong
one: words of a few documents could otherwise learn the sample by heart.

Defined results: null text is empty and has one sentence without words; its score is the bias alone. Labels of null
doc_id or null toxic are left out; where a doc_id has several labels, any 1 counts. Of the sample's texts with equal
doc_id the distinct ones count once, at most ``TEXTS`` of each (lowest hashes), so that none crowds out another. Without
usable labels of both kinds the model has no weights and so low a bias that no row is predicted toxic.
An empty table gives no rows. A row with null doc_id is scored and counts as held out. Other columns are ignored by
``score_documents`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labelled rows that training takes at most.
MAX_ROWS = 8000
#: Distinct texts of one doc_id that training takes at most.
TEXTS = 8
#: Word places of one text that training takes at most, unless it is told otherwise.
WORDS = 4096
#: Size of the hashed weight table; training documents that must have a feature; how far its toxic ones must stand out.
FEATURES, MIN_DOCS, Z = 1 << 18, 3, 5.0
STEMS = (4, 5)
#: Penalties on weights of features that stand out, and of others.
RIDGE, WEAK = 5e-6, 2e-3
EPOCHS, RATE, START = 120, 0.1, -6.0
#: The bias without usable labels: so low that no number of sentences adds up to a toxic document.
UNTAUGHT = -60.0

_END = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """Hashed places of a word and its beginnings."""
    keys = [word] + [word[:n] + "*" for n in STEMS if len(word) >= n]
    return [zlib.crc32(k.encode("utf-8")) % FEATURES for k in keys]


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Spans of sentences; ends are full stops, marks and line ends."""
    start = 0
    for m in _END.finditer(text):
        yield start, m.end()
        start = m.end()
    if start < len(text) or not text:
        yield start, len(text)


@dataclass
class Model:
    bias: float = UNTAUGHT
    weights: dict[int, float] = field(default_factory=dict)

    def scorer(self):
        """A function from a text to its score and its offending sentences (start, end, score)."""
        weights, known, bias = self.weights, {}, self.bias

        def weight(word: str) -> float:
            w = sum(weights.get(f, 0.0) for f in word_features(word))
            if len(known) < 500_000:
                known[word] = w
            return w

        def score(text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
            text = text or ""
            clean, worst = 0.0, []
            lower = text.lower()
            if len(lower) != len(text):  # a few capitals have two lower-case characters: keep places
                lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
            for a, b in sentences(lower):
                z = bias
                for word in set(_WORD.findall(lower, a, b)):
                    w = known.get(word)
                    z += weight(word) if w is None else w
                clean -= math.log1p(math.exp(z)) if z < 30 else z
                if z >= 0:
                    worst.append((a, b, 1 / (1 + math.exp(-min(z, 700.0)))))
            return -math.expm1(clean), worst

        return score


def word_number(word: str) -> int:
    """The word's features in one number, 19 bits each; those it lacks are ``FEATURES``."""
    a, b, c = (word_features(word) + [FEATURES] * 2)[:3]
    return a << 38 | b << 19 | c


#: A sentence without words.
NO_WORD = FEATURES << 38 | FEATURES << 19 | FEATURES


def sentence_words(text: str | None, known: dict[str, int], most: int | None = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct words of each sentence, one sentence behind the other, and where each ends."""
    lower, found = (text or "").lower(), []
    for a, b in sentences(lower):
        words = set(_WORD.findall(lower, a, b))
        for w in words:
            if w not in known:
                if len(known) > 500_000:
                    known.clear()
                known[w] = word_number(w)
        found.append(sorted({known[w] if w in known else word_number(w) for w in words}) or [NO_WORD])
    if most is not None and sum(map(len, found)) > most:
        room, order = most, sorted(range(len(found)), key=lambda k: zlib.crc32(np.array(found[k]).tobytes()))
        kept = []
        for k in order:
            if len(found[k]) <= room or not kept:
                found[k] = found[k][:room]
                kept.append(k)
                room -= len(found[k])
        found = [found[k] for k in sorted(kept)]
    return np.array([w for f in found for w in f], np.int64), np.cumsum([len(f) for f in found])


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    known: dict[str, int] = {}
    return fit_words([sentence_words(t, known) for t in texts], toxic)


def fit_words(docs: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> Model:
    """Full-batch training on documents' labels; ``docs``: words and sentence ends of each."""
    if not len(docs) or toxic.min() == toxic.max():
        return Model()
    n_words, n_sentences = (np.array([len(x[k]) for x in docs]) for k in (0, 1))
    kinds, occ = np.unique(np.concatenate([w for w, _ in docs]), return_inverse=True)
    sentence_ends = np.concatenate([e for _, e in docs]) + np.repeat(np.cumsum(n_words) - n_words, n_sentences)
    s_at = np.concatenate([[0], sentence_ends[:-1]])
    d_at = np.cumsum(n_sentences) - n_sentences
    doc_of = np.repeat(np.arange(len(docs)), n_sentences)
    sent_of = np.repeat(np.arange(len(sentence_ends)), np.diff(sentence_ends, prepend=0))
    raw = np.stack([kinds >> 38, kinds >> 19, kinds], axis=1) & ((1 << 19) - 1)
    f_word, at = np.nonzero(raw < FEATURES)
    ids, feat = np.unique(raw[f_word, at], return_inverse=True)
    spread, z = _telling(doc_of[sent_of], occ, f_word, feat, len(ids), toxic.astype(bool))
    used = (spread >= MIN_DOCS)[feat]
    f_word, feat = f_word[used], feat[used]
    ridge = np.where(z >= Z, RIDGE, WEAK)

    w, b = np.zeros(len(ids)), START
    m, v, mb, vb = np.zeros(len(ids)), np.zeros(len(ids)), 0.0, 0.0
    y = toxic.astype(bool)
    for epoch in range(1, EPOCHS + 1):
        of_word = np.bincount(f_word, w[feat], len(kinds))
        z = np.add.reduceat(of_word[occ], s_at) + b
        clean = np.add.reduceat(-np.logaddexp(0, z), d_at)  # log of the chance that no sentence offends
        share = np.where(y, -1 / np.maximum(np.expm1(np.clip(-clean, 1e-9, 50)), 1e-9), 1.0)
        g = share[doc_of] * np.exp(-np.logaddexp(0, -z)) / len(docs)
        gw = np.bincount(feat, np.bincount(occ, g[sent_of], len(kinds))[f_word], len(ids)) + ridge * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        f1, f2 = 1 - 0.9**epoch, 1 - 0.99**epoch
        w -= RATE * (m / f1) / (np.sqrt(v / f2) + 1e-6)
        b -= RATE * (mb / f1) / (math.sqrt(vb / f2) + 1e-6)
    keep = np.flatnonzero(np.abs(w) > 1e-3)
    return Model(float(b), dict(zip(ids[keep].tolist(), w[keep].tolist(), strict=True)))


def _telling(doc: np.ndarray, word: np.ndarray, f_word: np.ndarray, feat: np.ndarray, n: int, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many documents have each feature, and how far it stands out in toxic ones.

    That is the difference of its shares of toxic and of other documents, over its standard error if there were none.
    """
    pair = np.unique(np.stack([doc, word]), axis=1)
    size = np.bincount(f_word, minlength=int(word.max()) + 1)
    first, many = np.cumsum(size) - size, size[pair[1]]
    at = np.repeat(first[pair[1]] - np.cumsum(many) + many, many) + np.arange(many.sum())
    both = np.unique(np.repeat(pair[0], many) * n + feat[at])
    every = np.bincount(both % n, minlength=n)
    bad = np.bincount(both % n, toxic[both // n], n)
    a, b = toxic.sum(), (~toxic).sum()
    share = every / len(toxic)
    z = (bad / a - (every - bad) / b) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / a + 1 / b))
    return every, z


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def _words(most: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            words, ends = [], []
            for text in batch.column(3).to_pylist():
                w, e = sentence_words(text, known, most)
                words.append(w.tobytes())
                ends.append(e.astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(words, pa.binary()), pa.array(ends, pa.binary())], names=["doc_id", "toxic", "h", "words", "ends"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_words: int | None = WORDS) -> Model:
    """Fit on the labelled rows that aren't held out, at most ``max_rows`` of them; ``max_words`` None loses no sentence."""
    spark = docs.sparkSession
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = marks.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # The sample has at most max_rows rows of two numbers, so it is broadcast; only the words of its texts are shuffled.
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    words = found.select("doc_id", "toxic", F.xxhash64("text").alias("h"), "text").mapInArrow(_words(max_words), "doc_id long, toxic int, h long, words binary, ends binary")
    once = words.groupBy("doc_id", "toxic", "h").agg(F.first("words").alias("words"), F.first("ends").alias("ends"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("h"))
    # first texts come before second ones, so the cut leaves each doc_id of the sample one at least
    rows = once.withColumn("nth", nth).where(F.col("nth") <= TEXTS).orderBy("nth", F.xxhash64("doc_id"), "doc_id").limit(2 * max_rows).coalesce(1).sortWithinPartitions("doc_id", "nth")

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        if parts:
            rows = pd.concat(parts)
            model = fit_words([(np.frombuffer(w, np.int64), np.frombuffer(e, np.int64)) for w, e in zip(rows["words"], rows["ends"], strict=True)], rows["toxic"].to_numpy())
            yield pd.DataFrame({"feature": [-1, *model.weights], "weight": [model.bias, *model.weights.values()]})

    weights = rows.mapInPandas(one, "feature long, weight double").collect()
    table = {r["feature"]: r["weight"] for r in weights}
    return Model(table.pop(-1, UNTAUGHT), table)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, offending) of every row; offending: spans of sentences that score at least 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for batch in batches:
            found = [score(t) for t in batch.column(1).to_pylist()]
            s = np.array([x[0] for x in found], np.float64)
            spans = pa.array([[{"start": a, "end": b, "score": p} for a, b, p in x[1]] for x in found], span)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), spans], names=["doc_id", "score", "predicted", "offending"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int, offending array<struct<start: long, end: long, score: double>>")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.scorer()
        for batch in batches:
            yield batch.filter(pa.array([score(t)[0] < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
