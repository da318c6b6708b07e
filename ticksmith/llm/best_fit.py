"""Best-fit packing after dominance reduction: as few sequences as possible, by document lengths alone.

How documents are packed depends on their lengths only, of which there are at most ``limit``. So the whole corpus becomes
one table of counts by length, the plan is made on that table, and documents are dealt to the plan's places by number:

1. Each task encodes its documents, cuts what is longer than ``limit`` and numbers its pieces by length. One table.
2. Counts by (task, length) give each task's first number of a length; counts by length, at most ``limit`` rows, go to
   the driver, where the plan is made.
3. Piece number k of a length takes the k-th place of that length in the plan. What moves is a row a piece, with its ids
   only where ``with_ids`` asks for them and the counts are too many to broadcast.

The plan fixes sets by the dominance criterion of Martello and Toth. Let x be the length of a piece and R the room
beside it. A set {x, P} is beaten by {x, r} if the pieces P together are no longer than r, and by {x, r, s} if one of P
is no longer than r and the other no longer than s: swapping them in another packing needs no further sequence. If one
set beats all others that hold x, some packing with fewest sequences has it, so it is fixed for good and the instance
shrinks. Sets of up to three pieces are tried for every length; what none fits is packed by best fit, longest first.

Defined results: null text counts as empty and is packed as its end id; rows with null or repeated doc_id are documents
of their own; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticksmith.llm.storage import written
from ticksmith.llm.tokens import encoder

#: Lengths of a sequence's pieces, longest first, and how many sequences are packed so.
Pattern = tuple[tuple[int, ...], int]


class Pieces:
    """Counts by length of what isn't packed yet."""

    def __init__(self, counts: dict[int, int], limit: int):
        if counts and not (min(counts) > 0 and max(counts) <= limit):
            raise ValueError("a piece has from 1 to limit tokens")
        self.limit, self.n = limit, np.zeros(limit + 2, np.int64)
        for size, n in counts.items():
            self.n[size] = n

    def largest(self, room: int) -> int:
        """The longest length within ``room``, or 0."""
        found = np.flatnonzero(self.n[1 : room + 1])
        return int(found[-1]) + 1 if len(found) else 0

    def smallest(self, k: int, above: int = 0) -> list[int]:
        """The k shortest pieces longer than ``above``, fewer if there are fewer."""
        out: list[int] = []
        for size in np.flatnonzero(self.n[above + 1 :])[:k] + above + 1:
            out += [int(size)] * min(k - len(out), int(self.n[size]))
        return out

    def best_pair(self, room: int) -> int:
        """The largest sum within ``room`` of two pieces, or 0."""
        sizes = np.flatnonzero(self.n[: room + 1])
        if not len(sizes):
            return 0
        # beside each length, the longest that the room still takes
        upto = np.maximum.accumulate(np.where(self.n[: room + 1] > 0, np.arange(room + 1), 0))
        beside = upto[room - sizes]
        alone = (beside == sizes) & (self.n[sizes] < 2)
        beside[alone] = upto[sizes[alone] - 1]
        return int((sizes + beside)[beside > 0].max(initial=0))

    def take(self, pattern: tuple[int, ...]) -> int:
        """Remove as many such sets as there are pieces for; how many."""
        sizes, each = np.unique(pattern, return_counts=True)
        times = int((self.n[sizes] // each).min())
        self.n[sizes] -= each * times
        return times


def dominating_set(left: Pieces, x: int) -> tuple[int, ...] | None:
    """Pieces that, with one of length ``x``, beat all other sets with it; None if none of up to three pieces does.

    Removing such sets keeps the conditions true as long as their pieces last, since the pieces left only get fewer.
    """
    left.n[x] -= 1  # this piece itself
    try:
        room = left.limit - x
        r = left.largest(room)
        if not r:
            return (x,)
        low = left.smallest(3)
        if r == room or sum(low[:2]) > room or len(low) == 1:
            return x, r
        if len(low) == 3 and sum(low) <= room:
            return None  # four pieces may go together
        if r >= left.best_pair(room):
            return x, r
        left.n[r] -= 1
        s = left.largest(room - r)
        left.n[r] += 1
        if s and (sum(longer := left.smallest(2, above=s)) > room or len(longer) < 2):
            return x, r, s
        return None
    finally:
        left.n[x] += 1


def reduce_instance(left: Pieces) -> list[Pattern]:
    """Fix dominating sets until no length has one; ``left`` keeps the rest."""
    fixed: list[Pattern] = []
    again = True
    while again:
        again = False
        for x in range(left.limit, 0, -1):
            while left.n[x] and (found := dominating_set(left, x)):
                fixed.append((found, left.take(found)))
                again = True
    return fixed


def best_fit(left: Pieces) -> list[Pattern]:
    """Longest first, each into the sequence with the least room that takes it; equal sequences move together."""
    by_room: dict[int, list[Pattern]] = {}
    rooms: list[int] = []  # sorted
    for x in range(left.limit, 0, -1):
        n = int(left.n[x])
        while n:
            k = bisect_right(rooms, x - 1)
            if k == len(rooms):  # new sequences, as full of x as they get
                at_most = min(left.limit // x, n)
                grown = ((x,) * at_most, n // at_most)
                n -= at_most * grown[1]
            else:
                room = rooms[k]
                pattern, times = by_room[room].pop()
                # what has taken x has the least room, so it takes the next as well
                at_most = min(room // x, n)
                grown = (pattern + (x,) * at_most, min(times, n // at_most))
                if times > grown[1]:
                    by_room[room].append((pattern, times - grown[1]))
                elif not by_room[room]:
                    del by_room[rooms.pop(k)]
                n -= at_most * grown[1]
            room = left.limit - sum(grown[0])
            if room not in by_room:
                by_room[room] = []
                rooms.insert(bisect_right(rooms, room), room)
            by_room[room].append(grown)
        left.n[x] = 0
    return [p for same in by_room.values() for p in same]


def plan(counts: dict[int, int], limit: int) -> list[Pattern]:
    """How pieces with these counts by length are packed into sequences of at most ``limit``."""
    left = Pieces(counts, limit)
    return reduce_instance(left) + best_fit(left)


class Places:
    """Where the k-th piece of a length goes."""

    def __init__(self, patterns: list[Pattern]):
        slots: dict[int, list[tuple[int, int, int]]] = {}
        first = 0
        for sizes, times in patterns:
            offset = 0
            for size in sizes:
                slots.setdefault(size, []).append((times, first, offset))
                offset += size
            first += times
        self.sequences = first
        self.of = {}
        for size, rows in slots.items():
            times, sequence, offset = np.array(rows, np.int64).T
            self.of[size] = (np.cumsum(times) - times, sequence, offset)

    def find(self, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece."""
        sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        order = np.argsort(sizes, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(sizes) else []:
            begin, first, at = self.of[int(sizes[rows[0]])]
            k = np.searchsorted(begin, numbers[rows], "right") - 1
            sequence[rows], offset[rows] = first[k] + numbers[rows] - begin[k], at[k]
        return sequence, offset


_PIECES = "task long, k long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, limit: int, with_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """Each document's pieces, numbered by task and length (task, k); only a first piece is under ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(limit + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                flat, sizes = enc.flat([t or "" for t in part.column(1).to_pylist()])
                ends = np.cumsum(sizes)
                rows = []
                for doc_id, n, end in zip(part.column(0).to_pylist(), sizes.tolist(), ends.tolist(), strict=True):
                    ids = np.append(flat[end - n : end].astype("<u4"), np.uint32(end_id))
                    start, length, piece = 0, (n + 1) % limit or limit, 0
                    while start <= n:
                        data = ids[start : start + length].tobytes()
                        rows.append((task, int(seen[length]), doc_id, piece, start, length, zlib.crc32(data), data if with_ids else None))
                        seen[length] += 1
                        start, length, piece = start + length, limit, piece + 1
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, _PIECES)


_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, limit: int = 1024, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset), and its little-endian ids.

    ``with_ids`` adds the ids as unsigned 32-bit integers, from which sequences are put together by offset.
    """
    if limit < 1:
        raise ValueError("a sequence holds at least one token")
    pieces = written(cut_pieces(docs, tokenizer, end_id, limit, with_ids, id_col, text_col), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    # a row a task for each length: documents aren't sorted
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    # at most ``limit`` rows
    places = Places(plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, limit))
    numbered = pieces.join(counts.select("task", "length", "base"), ["task", "length"])
    names = [c.split()[0] for c in _PLACED.split(", ")][:5] + ["ids"] * with_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.find(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            out = [*(batch.column(n) for n in names[:5]), pa.array(sequence), pa.array(offset), *(batch.column(n) for n in names[5:])]
            yield pa.RecordBatch.from_arrays(out, names=[*names[:5], "sequence_id", "offset", *names[5:]])

    return numbered.select(*names, (F.col("base") + F.col("k")).alias("number")).mapInArrow(place, _PLACED + ", ids binary" * with_ids)
