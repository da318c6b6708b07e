"""Token counts by byte-pair merging, without identifiers.

A word's bytes stand in a doubly linked list, its mergeable pairs in a heap by rank and place. The lowest pair is
popped and merged until none is left; each merge removes one symbol, so the count is the number of bytes less the
number of merges. Words repeat, so a worker keeps a bounded table of counts by space-delimited segment.

Defined results: null text counts as empty (0 bytes, 0 tokens); every row gives one row, with its own doc_id, null or
repeated; an empty table gives no rows; other columns are ignored. Special strings inside a text are one token each, as
is the library's default. No shuffle: texts are counted where they are read, whatever their length.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticksmith.llm.tokens import _RUN

CACHE_SEGMENTS = 400_000
#: The public byte-level pre-tokenizer's pattern, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table, extra = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + extra)
            extra += 1
    return [table[b] for b in range(256)]


class PairMerger:
    """Counts of byte-level BPE tokens from a ``tokenizers`` file's merges."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
            raise ValueError("only byte-level BPE without a normalizer is counted here")
        number: dict[str, int] = {}
        symbol = lambda s: number.setdefault(s, len(number))
        self.bytes = [symbol(s) for s in byte_symbols()]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        #: pair -> (rank, symbol that it makes)
        self.merges = {(symbol(a), symbol(b)): (rank, symbol(a + b)) for rank, (a, b) in enumerate(pairs)}
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.words = regex.compile(PATTERN).findall
        self.known: dict[str, int] = {}
        self.first: dict[str, int] = {}

    def merge(self, word: str) -> int:
        """Tokens of one word: symbols less merges."""
        symbols = [self.bytes[b] for b in word.encode("utf-8")]
        n = len(symbols)
        if n < 2:
            return n
        merges, count = self.merges, n
        after = list(range(1, n)) + [-1]
        before = list(range(-1, n - 1))
        heap = [(m[0], i, m[1], symbols[i], symbols[i + 1]) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        heapify(heap)
        while heap:
            _, i, made, a, b = heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # an earlier merge took one of the two
            symbols[i], symbols[j] = made, -1
            count -= 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((made, symbols[k])):
                    heappush(heap, (m[0], i, m[1], made, symbols[k]))
            h = before[i]
            if h >= 0 and (m := merges.get((symbols[h], made))):
                heappush(heap, (m[0], h, m[1], symbols[h], made))
        return count

    def count(self, text: str) -> int:
        if self.special is None or not any(s in text for s in self.specials):
            return self._plain(text)
        return len(self.special.findall(text)) + sum(map(self._plain, self.special.split(text)))

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        if _RUN.search(text):
            return sum(map(self.merge, self.words(text)))
        segments = text.split(" ")
        known = self.known
        head = segments[0]
        total = self.first.get(head)
        if total is None:
            total = sum(map(self.merge, self.words(head)))
            if len(self.first) < CACHE_SEGMENTS // 8:
                self.first[head] = total
        segments[0] = None
        found = list(map(known.get, segments))
        found[0] = total
        at = 0
        try:
            while True:
                at = found.index(None, at + 1)
                segment = segments[at]
                n = known.get(segment)
                if n is None:
                    n = sum(map(self.merge, self.words(" " + segment)))
                    if len(known) < CACHE_SEGMENTS:
                        known[segment] = n
                found[at] = n
        except ValueError:
            return sum(found)


@lru_cache(maxsize=2)
def merger(path: str) -> PairMerger:
    return PairMerger(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = merger(tokenizer).count
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            n = pa.array([count(x) if x else 0 for x in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
