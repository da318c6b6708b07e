"""Spelling variants: words one edit apart, found in forward and reversed sorted dictionaries.

Two words are near if one inserted, deleted or replaced code point makes them equal. Let m be the shorter length and p the
length of their common prefix; then they also share their last m - p - 1 code points at least. So one edit leaves a half
intact: where p reaches half of m, both words stand in one range of the forward dictionary, that of their common first
half; else they stand in one range of the reversed dictionary, that of their last half. A block is such a range, for one m
and an interval of p: words of lengths m and m + 1 with equal first ``low`` and last ``m - high`` code points, whose
pairs have a common prefix of ``low`` to ``high - 1``.

A block is scanned in one go: each word is looked up by what it is without one place of the interval, so the work grows
with the block, not with its square. A pair counts only where its p lies in the interval, so each pair of near words
belongs to one of the blocks that it stands in, nothing is counted twice and no pairs are made distinct. A block of more
than ``BLOCK`` words is cut: its interval is halved, which gives each word two longer keys, until blocks are small or one
place is left, where a key holds all of a word but that place. Blocks are counted before words are dealt, so that a
skewed one is never one task's.

What a scan gives is a row a word and block: how many near words, and the best of them. Roots follow forms by doubling.

Defined results: null text has no words, a null doc_id is hashed as empty; an empty table gives no rows; repeated rows
count again; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticksmith.llm.storage import remove, stored, written

#: Words that a task counts before it gives the counts out.
HELD = 200_000
#: Words of a block that one task scans.
BLOCK = 5_000
#: Bytes of text that are split at once, if a row hasn't more.
PART = 4_000_000
#: Bytes up to which a word's hash is put together from its document's and its own.
SHORT = 64


#: CRC-32 of each byte, by its polynomial.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ 0xEDB88320, _CRC >> 1).astype(np.uint32)


def runs(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct runs of letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; each run's code, and its text's place.

    In UTF-8 the latter letters are the byte C3 and another one, and no other character has that byte.
    """
    texts = texts.cast(pa.large_binary())
    borders = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[borders[0] : borders[-1]]
    borders = borders - borders[0]
    lower = data | 0x20
    ascii_letter = lower - np.uint8(97) < 26
    lead = data == 0xC3
    letter = ascii_letter | lead
    letter[1:] |= lead[:-1]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    at = borders[:-1][borders[:-1] < len(data)]
    begins[at] = letter[at]
    place = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(np.flatnonzero(begins), borders)))
    kept = np.where(ascii_letter, lower, data)[letter]
    offsets = np.append(np.flatnonzero(begins[letter]), len(kept)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy(), place


def run_hashes(ids: list[str], words: list[bytes], code: np.ndarray, place: np.ndarray) -> np.ndarray:
    """CRC-32 of ``<id>:<word>`` for each run, where the id is that of its text.

    For words of one length, CRC-32 is affine in the word and in what comes before it: the hash is that of the word alone,
    changed by what as many zero bytes make of the id.
    """
    seeds = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    zeros = np.empty((SHORT + 1, len(seeds)), np.uint32)
    zeros[0] = state = ~seeds
    for k in range(1, SHORT + 1):
        state = _CRC[state & 0xFF] ^ state >> 8
        zeros[k] = state
    nothing = [zlib.crc32(bytes(k)) ^ 0xFFFFFFFF for k in range(SHORT + 1)]
    own = np.array([zlib.crc32(w) ^ nothing[n] if (n := len(w)) <= SHORT else 0 for w in words], np.uint32)
    out = zeros[np.minimum(sizes, SHORT)[code], place] ^ own[code]
    for k in np.flatnonzero(sizes[code] > SHORT):
        out[k] = zlib.crc32(words[code[k]], int(seeds[place[k]]))
    return out


def count_words(docs: DataFrame, typo_every: int | None = None, min_chars: int = 5, min_count: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of at least ``min_chars`` that occur ``min_count`` times or more in all texts.

    ``typo_every`` plants typing errors: a word of a document whose hash divides by it loses one code point, in all its
    places there. Counts are summed within tasks before they move.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def add(word: str, n: int) -> None:
            if len(word) >= min_chars:
                counts[word] = counts.get(word, 0) + n

        def take(ids: list[str], texts: pa.Array) -> None:
            words, code, place = runs(texts)
            if typo_every:
                h = run_hashes(ids, words, code, place)
                hit = h % np.uint32(typo_every) == 0
                for k, x in zip(code[hit].tolist(), h[hit].tolist(), strict=True):
                    word = words[k].decode()
                    at = x % len(word)
                    add(word[:at] + word[at + 1 :], 1)
                code = code[~hit]
            for word, n in zip(words, np.bincount(code, minlength=len(words)).tolist(), strict=True):
                if n and len(word) >= min_chars:
                    add(word.decode(), n)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            ids = ["" if i is None else i for i in batch.column(0).to_pylist()]
            texts = pc.fill_null(batch.column(1), "")
            ends = np.cumsum(pc.binary_length(texts).to_numpy())
            begin = 0
            while begin < len(ids):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PART, "right")))
                take(ids[begin:end], texts.slice(begin, end - begin))
                begin = end
                if len(counts) >= HELD:
                    yield flush()
        yield flush()

    found = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# --- near words


def near(a: str, b: str, p: int) -> bool:
    """Whether words that share exactly their first ``p`` code points are one edit apart."""
    if len(a) == len(b):
        return a[p + 1 :] == b[p + 1 :]
    return a[p:] == b[p + 1 :] if len(a) < len(b) else a[p + 1 :] == b[p:]


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    for k in range(n):
        if a[k] != b[k]:
            return k
    return n


def _block(short: Column, low: Column, high: Column) -> list[Column]:
    """The key of the block that a word stands in; ``tail`` is reversed, so that suffixes sort as prefixes do."""
    word = F.col("word")
    return [short.alias("short"), low.alias("low"), high.alias("high"), F.substr(word, F.lit(1), low).alias("head"), F.substr(F.reverse(word), F.lit(1), F.greatest(F.lit(0), short - high)).alias("tail")]


KEY = ["short", "low", "high", "head", "tail"]
_ROWS = ["word", "n", *KEY]


def first_blocks(words: DataFrame) -> DataFrame:
    """Each word as the shorter (or equal) and as the longer of a pair, in the forward and the reversed dictionary."""
    short = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("short")
    rows = words.select("word", "n", short).where("short > 0")
    middle = F.expr("(short + 1) div 2").cast("int")
    side = F.explode(F.array(F.struct(F.lit(0).alias("low"), middle.alias("high")), F.struct(middle.alias("low"), (F.col("short") + 1).alias("high")))).alias("side")
    return rows.select("word", "n", "short", side).select("word", "n", *_block(F.col("short"), F.col("side.low"), F.col("side.high")))


def halved(rows: DataFrame) -> DataFrame:
    """Words of blocks in the two blocks that each is cut into."""
    middle = F.expr("(low + high) div 2").cast("int")
    part = F.explode(F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high")))).alias("part")
    return rows.select("word", "n", "short", part).select("word", "n", *_block(F.col("short"), F.col("part.low"), F.col("part.high")))


_FOUND = "word string, n_near long, form_n long, form string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order: each word's near words of its block, and the best of them."""
    key, block, out = None, [], []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[c.split()[0] for c in _FOUND.split(", ")])

    def compare() -> None:
        if len(block) < 2:
            return
        counts: dict[str, list[tuple[str, int]]] = {}
        for word, other in _pairs(block, *key[:3]):
            counts.setdefault(word[0], []).append(other)
            counts.setdefault(other[0], []).append(word)
        for word, others in counts.items():
            form, n = min(others, key=lambda x: (-x[1], x[0]))
            out.append((word, len(others), n, form))

    for batch in batches:
        for word, n, *at in zip(*(batch.column(c).to_pylist() for c in _ROWS), strict=True):
            if at != key:
                compare()
                key, block = at, []
                if len(out) >= 10_000:
                    yield flush()
            block.append((word, n))
    compare()
    yield flush()


def _pairs(block: list[tuple[str, int]], short: int, low: int, high: int) -> Iterator[tuple[tuple[str, int], tuple[str, int]]]:
    """Near words of a block, each pair once: lengths ``short`` and that or one more, common prefix from low to high - 1."""
    if len(block) <= high - low:  # fewer words than places, as with very long words
        for j, b in enumerate(block):
            for a in block[:j]:
                if min(len(a[0]), len(b[0])) == short and low <= (p := common_prefix(a[0], b[0])) < high and near(a[0], b[0], p):
                    yield a, b
        return
    equal = {w[0]: w for w in block if len(w[0]) == short}
    for at in range(low, min(high, short)):  # one replaced code point
        without: dict[tuple[str, str], list[tuple[str, int]]] = {}
        for w in equal.values():
            same = without.setdefault((w[0][:at], w[0][at + 1 :]), [])
            for other in same:
                yield other, w
            same.append(w)
    for w in block:  # one inserted: of equal code points in a row the last one counts, where the common prefix ends
        if len(w[0]) > short:
            for at in range(low, high):
                if (at == short or w[0][at] != w[0][at + 1]) and (other := equal.get(w[0][:at] + w[0][at + 1 :])):
                    yield other, w


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, form_n, form) of the words (word, n) that have a near word: how many, and the most frequent.

    Of near words of equal n the first in code-point order counts.
    """
    spark = words.sparkSession
    rows, parts, folders = first_blocks(words), [], []
    while True:
        # blocks to be cut are few: fewer than rows / block
        large, at = stored(rows.where("high - low > 1").groupBy(*KEY).agg(F.count("*").alias("words")).where(F.col("words") > block).select(*KEY), "large-blocks")
        folders.append(at)
        small = rows.join(large, KEY, "left_anti").select(*_ROWS).repartitionByRange(*KEY).sortWithinPartitions(*KEY, "word")
        found, at = stored(small.mapInArrow(_scan, _FOUND), "near")
        folders.append(at)
        parts.append(found)
        if large.isEmpty():
            break
        rows, at = stored(halved(rows.join(large, KEY, "left_semi")), "blocks")
        folders.append(at)
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    out = written(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best), "near-words")
    for at in folders:
        remove(spark, at)
    return out.select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


# --- forms and roots


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words that have a form: forms (word, form) followed to the last.

    Each round doubles the steps that a row has gone, so rounds grow as the logarithm of the longest chain. A form's n is
    at least twice the word's, so there are no circles.
    """
    spark = forms.sparkSession
    reached, folder = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved, at = stored(reached.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        remove(spark, folder)
        reached, folder = moved.select("word", "root"), at
        if moved.where("moved").isEmpty():
            return reached


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``words`` (word, n).

    A word's form is its most frequent near word, if that is ``ratio`` times as frequent at least.
    """
    words = written(words, "words")
    found = words.join(near_words(words), "word", "left")
    common = F.col("form_n") >= ratio * F.col("n")
    formed = written(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(common, F.col("form")).alias("form"), F.when(common, F.col("form_n")).alias("form_n")), "forms")
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
