"""Packing by vector bins: sequences under limits on tokens, segments and loss-bearing tokens at once.

Each task packs the documents that it reads: a pool of open examples, each a vector (tokens, 1 segment, loss-bearing
tokens) relative to the limits. A sequence is filled by the dot-product heuristic: of the examples that fit, take the
one whose vector, weighted by the pool's total demand, has the largest product with the room left. When none fits, one
is cut to the room. Long examples give full sequences first. A sequence that another limit closes early ends at its largest
power of two, what is beyond waits on; one that the end of a task leaves is split into sequences of 2^k tokens. Neither
needs padding. Nothing is shuffled; a task holds at most
``POOL`` open examples and their ids that aren't placed, which are fewer than ``Limits.tokens`` each unless a lower
limit on loss-bearing tokens keeps long examples open.

Defined results: null text counts as empty and is packed as its end id; rows with null or repeated doc_id are examples
of their own; an empty table gives no pieces; other columns are ignored. sequence_id is the task's number times 2^40
plus a count, so it is unique and the same if the task runs again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticksmith.llm.tokens import encoder

POOL = 2048


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold. Pieces under ``min_piece`` tokens aren't cut only to fill a sequence."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048
    min_piece: int = 8

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("a sequence holds at least one token, segment and loss-bearing token")


class Packer:
    """Places pieces (example, start, length) in numbered sequences."""

    def __init__(self, limits: Limits, first_sequence: int = 0):
        self.limits, self.next = limits, first_sequence
        self.pool = np.zeros((0, 4), np.int64)  # example, start, end, first loss-bearing id
        self.waiting: list[tuple[int, int, int, int]] = []  # the same, not yet in the pool
        self.out: list[tuple[int, int, int, int, int]] = []  # example, start, length, sequence, offset

    def add(self, example: int, n: int, loss_from: int = 0) -> None:
        """Ids of ``example`` from ``loss_from`` on bear loss."""
        start, lim = 0, self.limits
        while n - start >= lim.tokens:
            length = self._most(start, n, loss_from, lim.tokens, lim.loss)
            if length < lim.tokens:
                break
            self._full([(example, start, length)])
            start += length
        if start < n:
            self.waiting.append((example, start, n, loss_from))
            if len(self.waiting) >= POOL // 2:
                self.pack(POOL // 2)

    @staticmethod
    def _most(start: int, end: int, loss_from: int, tokens: int, loss: int) -> int:
        """The longest piece from ``start`` within the room for tokens and loss-bearing tokens."""
        free = max(0, min(loss_from, end) - start)
        return min(end - start, tokens, free + loss)

    def _full(self, pieces: list[tuple[int, int, int]]) -> None:
        offset = 0
        for example, start, length in pieces:
            self.out.append((example, start, length, self.next, offset))
            offset += length
        self.next += 1

    def pack(self, keep: int) -> None:
        """Fill sequences until at most ``keep`` examples wait."""
        lim = self.limits
        if self.waiting:
            self.pool = np.concatenate([self.pool, np.array(self.waiting, np.int64)])
            self.waiting.clear()
        pool = self.pool
        alive = np.ones(len(pool), bool)
        tokens, loss = self._sizes(pool)
        left = len(pool)
        while left > keep:
            room_t, room_s, room_l, pieces = lim.tokens, lim.segments, lim.loss, []
            # weights: the pool's demand by dimension, relative to the limits
            w = np.array([tokens[alive].sum() / lim.tokens, left / lim.segments, loss[alive].sum() / lim.loss])
            w /= w.sum()
            while room_t and room_s and left:
                fits = alive & (tokens <= room_t) & (loss <= room_l)
                if fits.any():
                    score = w[0] * tokens / lim.tokens * room_t / lim.tokens + w[1] / lim.segments * room_s / lim.segments + w[2] * loss / lim.loss * room_l / lim.loss
                    score[~fits] = -1
                    i = int(score.argmax())
                    length = int(tokens[i])
                else:
                    # the longest example is cut to the room, which leaves the others whole
                    i = int(np.where(alive, tokens, -1).argmax())
                    length = self._most(*map(int, pool[i, 1:]), room_t, room_l)
                    if length < lim.min_piece and pieces:
                        break
                pieces.append((int(pool[i, 0]), int(pool[i, 1]), length))
                used = max(0, int(pool[i, 1]) + length - max(int(pool[i, 1]), int(pool[i, 3])))
                room_t, room_s, room_l = room_t - length, room_s - 1, room_l - used
                pool[i, 1] += length
                if pool[i, 1] == pool[i, 2]:
                    alive[i] = False
                    left -= 1
                tokens[i], loss[i] = tokens[i] - length, loss[i] - used
            if room_t < lim.min_piece and left:  # less padding than a piece is worth
                self._full(pieces)
            elif left > keep or left and keep:
                left += self._largest_power(pieces, pool, alive)
                tokens, loss = self._sizes(pool)
            else:
                self._powers(pieces)
        self.pool = pool[alive]

    def _largest_power(self, pieces: list[tuple[int, int, int]], pool: np.ndarray, alive: np.ndarray) -> int:
        """A sequence of the largest 2^k tokens; what is beyond goes back to the pool. How many examples wait again."""
        total = sum(p[2] for p in pieces)
        room, kept, again = 1 << total.bit_length() - 1, [], 0
        for example, start, length in pieces:
            take = min(room, length)
            if take:
                kept.append((example, start, take))
            room -= take
            if take < length:
                i = int(np.flatnonzero(pool[:, 0] == example)[0])
                again += not alive[i]
                alive[i] = True
                pool[i, 1] = min(int(pool[i, 1]), start + take)
        self._full(kept)
        return again

    def _sizes(self, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return pool[:, 2] - pool[:, 1], np.maximum(0, pool[:, 2] - np.maximum(pool[:, 1], pool[:, 3]))

    def _powers(self, pieces: list[tuple[int, int, int]]) -> None:
        """Split a sequence's pieces into sequences of 2^k tokens."""
        total = sum(p[2] for p in pieces)
        for k in range(total.bit_length() - 1, -1, -1):
            if not total >> k & 1:
                continue
            room, part = 1 << k, []
            while room:
                example, start, length = pieces[0]
                take = min(room, length)
                part.append((example, start, take))
                room -= take
                if take == length:
                    pieces.pop(0)
                else:
                    pieces[0] = (example, start + take, length - take)
            self._full(part)


class Held:
    """Ids of examples that aren't fully placed: only those from the first open one on."""

    def __init__(self, width: int):
        self.width = width
        self.rows: dict[int, tuple[int | None, bytes, int, int]] = {}  # doc_id, ids, tokens, place of the first of these ids
        self.placed: dict[int, int] = {}

    def add(self, example: int, doc_id: int | None, ids: bytes) -> int:
        self.rows[example] = (doc_id, ids, len(ids) // self.width, 0)
        return len(ids) // self.width

    def take(self, example: int, start: int, length: int) -> tuple[int | None, bytes, int]:
        """(doc_id, ids of the piece, tokens of the example); pieces of an example come in order."""
        doc_id, ids, n, base = self.rows[example]
        self.placed[example] = start + length
        return doc_id, ids[(start - base) * self.width : (start - base + length) * self.width], n

    def release(self) -> None:
        """Let go of all ids that were taken."""
        for example, end in self.placed.items():
            doc_id, ids, n, base = self.rows.pop(example)
            if end < n:
                self.rows[example] = (doc_id, ids[(end - base) * self.width :], n, end)
        self.placed.clear()


_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, limits: Limits = Limits(), loss_from: Column | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece, in sequences of at most ``limits.tokens``.

    ``loss_from``: the first loss-bearing token of a row (for instruction data: the prompt's length); the default
    makes all tokens bear loss. ``with_ids`` adds the piece's ids as little-endian bytes.
    """
    names = [c.split()[0] for c in _DDL.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        tail, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        packer = Packer(limits, TaskContext.get().partitionId() << 40)
        held = Held(width)
        example = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for i, start, length, sequence, offset in packer.out:
                doc_id, piece, n = held.take(i, start, length)
                crc = zlib.crc32(np.frombuffer(piece, enc.dtype).astype("<u4").tobytes())
                rows.append((doc_id, start, length, crc, n, sequence, offset, *([piece] * with_ids)))
            held.release()
            packer.out.clear()
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(columns, names, strict=True)], names=names)

        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, ids, first in zip(part.column(0).to_pylist(), enc.encode(texts), part.column(2).to_pylist(), strict=True):
                    n = held.add(example, doc_id, ids + tail)
                    packer.add(example, n, min(max(first or 0, 0), n))
                    example += 1
                yield flush()
        packer.pack(0)
        yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.lit(0) if loss_from is None else loss_from).cast("long").alias("loss_from"))
    return rows.mapInArrow(run, _DDL + ", ids binary" * with_ids)
