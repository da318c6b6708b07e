"""Conversation structure repair: the cheapest edits that turn a conversation into user and assistant in turns.

Rows have a fault or none: blank (no visible character), duplicate (role and text seen before), truncated (the last
visible character doesn't end a sentence). Keeping a row costs 0, a new role 1, deleting 2 (blank and duplicate rows must
go), an inserted empty turn 5; a truncated row that stays costs 5 more. The result's role initials are ``(s?(ua)+)?``.

What is left to pay from each place of that pattern (nothing yet, after s, after u, after a) is a vector of four costs.
It is normalised to a least cost of 0, and normalised vectors are the states of a deterministic automaton whose moves are
made as rows ask for them and cached in a table. Two insertions and a deletion lead from any place to where another could
go on, so no two costs differ by more than 12, and there are few states. A conversation's rows are scanned from last to
first through that table, which gives its cost, and then, against the scan, traced along arcs that pay exactly what
their ends differ by. Of equal edits the least initial is taken (Delete, Insert, Keep, Rerole): since what follows is
known to be payable, the trace gives the least of the cheapest audits in ASCII order.

Both passes stream a conversation's rows through one task and hold one state, whatever its length: the digest of a
conversation is sequential. Rows that are equal are counted before they are dealt; texts move once.

Order: by turn, nulls first; rows of equal turn by role and the MD5 of their text. Defined results: a null role or text is
one space; null conv_ids are one conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VISIBLE_NOT = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5

#: Places: nothing yet, after s, after u, after a. What an insertion or a new role leads to, and its role.
ADDED = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

Vector = tuple[int, int, int, int]
#: Rows of a batch that a pass gives out.
ROWS = 10_000
#: What is left to pay at the end: insertions up to a place where the pattern may end.
END: Vector = (0, 2 * INSERT, INSERT, 0)


def pack_vector(v: Vector) -> int:
    """Four costs of at most 12 as one number."""
    return v[0] | v[1] << 4 | v[2] << 8 | v[3] << 12


def unpack_vector(code: int) -> Vector:
    return code & 15, code >> 4 & 15, code >> 8 & 15, code >> 12


@dataclass
class Automaton:
    """Determinised on demand: ``moves`` is the transition table, ``traces`` its tight arcs."""

    moves: dict[tuple[int, str, str], tuple[int, int]] = field(default_factory=dict)
    traces: dict[tuple[int, str, str, int], tuple[str, int]] = field(default_factory=dict)

    def before(self, behind: int, initial: str, fault: str) -> tuple[int, int]:
        """The state before a row, from that behind it, and the cost that normalising takes out."""
        key = behind, initial, fault
        found = self.moves.get(key)
        if found is None:
            v = unpack_vector(behind)
            costs = [min(cost for _, cost, _ in self._row(v, q, initial, fault)) for q in range(4)]
            for _ in range(2):  # insertions before the row, two at most
                costs = [min(c, INSERT + costs[ADDED[q]]) for q, c in enumerate(costs)]
            least = min(costs)
            found = pack_vector(tuple(c - least for c in costs)), least
            self.moves[key] = found
        return found

    @staticmethod
    def _row(v: Vector, q: int, initial: str, fault: str) -> list[tuple[str, int, int]]:
        """(edit, cost from here on, next place) of what a row can take at place q."""
        out = [("D", DELETE + v[q], q)]
        if fault != "must":
            extra = TRUNCATED if fault == "truncated" else 0
            if (q, initial) in KEPT:
                out.append(("K", extra + v[KEPT[q, initial]], KEPT[q, initial]))
            out.append(("R", REROLE + extra + v[ADDED[q]], ADDED[q]))
        return out

    def trace(self, behind: int, initial: str, fault: str, q: int) -> tuple[str, int]:
        """The edits of a row reached at place q, with the insertions before it, and the place behind it."""
        key = behind, initial, fault, q
        found = self.traces.get(key)
        if found is None:
            state, least = self.before(behind, initial, fault)
            v, after, edits, at = unpack_vector(state), unpack_vector(behind), "", q
            while True:
                left = v[at] + least
                tight = {e: p for e, c, p in self._row(after, at, initial, fault) if c == left}
                if "D" not in tight and INSERT + v[ADDED[at]] + least == left:
                    edits, at = edits + "I", ADDED[at]
                    continue
                edit = min(tight)
                found = edits + edit, tight[edit]
                break
            self.traces[key] = found
        return found


#: Keys in order: nulls first, and without nulls.
KEYS = ["has_conv", "conv", "has_turn", "turn", "role", "digest"]


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, copies) with their keys, nulls filled."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select(
        F.col("conv_id").isNotNull().alias("has_conv"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("turn").isNotNull().alias("has_turn"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        role.alias("role"), F.unhex(F.md5(text)).alias("digest"), text.alias("text"), F.col("copies").cast("long").alias("copies"),
    )


def _faulty(keyed: DataFrame) -> DataFrame:
    """One row for each distinct row: its copies and the fault of the first of them (blank, duplicate, truncated, none)."""
    shown = F.rtrim(F.col("text"), F.lit(VISIBLE_NOT))
    own = F.when(shown == "", "blank").when(F.right(shown, F.lit(1)).isin(".", "!", "?"), "").otherwise("truncated")
    distinct = keyed.select(*KEYS, own.alias("fault"), "copies").groupBy(*KEYS).agg(F.any_value("fault").alias("fault"), F.sum("copies").alias("copies"))
    # texts that stand in several turns; joined rather than windowed, so that one common text isn't one task's
    same = ["has_conv", "conv", "role", "digest"]
    turn = F.struct("has_turn", "turn")
    again = distinct.where("copies > 0").groupBy(*same).agg(F.min(turn).alias("first"), F.count("*").alias("turns")).where("turns > 1").drop("turns")
    fault = F.when((F.col("fault") != "blank") & (F.col("first") < turn), "duplicate").otherwise(F.col("fault"))
    return distinct.join(again, same, "left").select(*KEYS, fault.alias("fault"), "copies")


_SCANNED = "has_conv boolean, conv long, has_turn boolean, turn long, role string, digest binary, fault string, copies long, behind int, cost long"


def _symbol(role: str, fault: str) -> tuple[str, str]:
    """Initials that no arc tells apart are one symbol, so the table stays small whatever the roles."""
    return (i if (i := role[:1]) in "sua" else ""), "must" if fault in ("blank", "duplicate") else fault


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of conversations from last to first, with the state behind them and all that is to pay from them on."""
    auto, end = Automaton(), pack_vector(END)
    conv, state, paid = None, end, 0
    for batch in batches:
        behind, cost = [], []
        for has, key, role, fault, copies in zip(*(batch.column(n).to_pylist() for n in ("has_conv", "conv", "role", "fault", "copies")), strict=True):
            if (has, key) != conv:
                conv, state, paid = (has, key), end, 0
            behind.append(state)
            if copies:  # further copies are deleted, which changes no difference between places
                state, least = auto.before(state, *_symbol(role, fault))
                paid += least + DELETE * (copies - 1)
            cost.append(paid + unpack_vector(state)[0])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(behind, pa.int32()), pa.array(cost, pa.int64())], names=[*batch.schema.names, "behind", "cost"])


_EDITS = "conv_id long, cost long, turn long, fault string, old_role string, edit string, role string, text string"


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    """Rows as a batch; the list is emptied."""
    names, kinds = zip(*(c.split() for c in ddl.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    rows.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.string()) for c, k in zip(columns, kinds, strict=True)], names=names)


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits in order. Of each distinct row its scanned form comes first, then its texts, of which one is read."""
    auto, rows = Automaton(), []
    conv, conv_id, cost, place, empty = None, None, 0, 0, True
    kept, more, again = None, 0, ()

    def insert(n: int) -> None:
        nonlocal place
        for _ in range(n):
            place = ADDED[place]
            rows.append((conv_id, cost, None, None, None, "I", ROLE[place], ""))

    def close() -> None:
        if conv is not None:
            insert(END[place] // INSERT)
            if empty:
                rows.append((conv_id, 0, None, None, None, None, None, None))

    for batch in batches:
        for has, key, has_turn, turn, role, fault, copies, behind, pays, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (has, key) != conv:
                close()
                conv, conv_id, cost, place, empty = (has, key), key if has else None, pays, 0, True
            at = turn if has_turn else None
            if text is not None:
                if not kept:  # deleted, or written already
                    continue
                rows.append((*kept, text))
                kept, n = None, more
            elif copies:
                empty = False
                found, after = auto.trace(behind, *_symbol(role, fault), place)
                insert(len(found) - 1)
                place, edit = after, found[-1]
                again = (conv_id, cost, at, "blank" if fault == "blank" else "duplicate", role, "D", None, None)
                kept, n, more = None, copies - 1, copies - 1
                if edit == "D":
                    rows.append((conv_id, cost, at, fault, role, "D", None, None))
                else:  # copies follow when the text has come
                    kept, n = (conv_id, cost, at, fault, role, edit, role if edit == "K" else ROLE[place]), 0
            else:
                n = 0
            for _ in range(n):
                rows.append(again)
                if len(rows) >= ROWS:
                    yield _batch(rows, _EDITS)
            if len(rows) >= ROWS:
                yield _batch(rows, _EDITS)
    close()
    yield _batch(rows, _EDITS)


def edits(rows: DataFrame) -> DataFrame:
    """The cheapest edits of ``rows`` (conv_id, turn, role, text, copies), in order within each conversation.

    One row an edit: (conv_id, cost of the conversation, turn, fault, old_role, edit, role, text); role and text are
    those of a turn that the result has, null where one is deleted. A conversation whose rows all have 0 copies gives
    one row without an edit. Rows of a conversation lie in one partition, in order, which ``repaired`` and ``digests`` use.
    """
    keyed = _keyed(rows)
    down = [F.col(k).desc() for k in KEYS]
    scanned = _faulty(keyed).repartition("has_conv", "conv").sortWithinPartitions(*down).mapInArrow(_scan, _SCANNED)
    none = F.lit(None)
    texts = keyed.where("copies > 0").select(*KEYS, none.cast("string").alias("fault"), none.cast("long").alias("copies"), none.cast("int").alias("behind"), none.cast("long").alias("cost"), "text")
    both = scanned.withColumn("text", none.cast("string")).unionByName(texts)
    dealt = both.repartition("has_conv", "conv").sortWithinPartitions(*KEYS, F.col("text").isNotNull())
    return dealt.select(*KEYS[:5], "fault", "copies", "behind", "cost", "text").mapInArrow(_trace, _EDITS)


def repaired(found: DataFrame) -> DataFrame:
    """The turns that ``edits`` leave: (conv_id, role, text), in order within each conversation."""
    return found.where("edit IN ('K', 'R', 'I')").select("conv_id", "role", "text")


_DIGESTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, begun, rows = None, False, []
    for batch in batches:
        for conv_id, cost, turn, fault, old_role, edit, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not begun or conv_id != current:
                if begun:
                    rows.append((current, gaps, *counts.values(), illegal, paid, "".join(audit), sha.hexdigest()))
                    if len(rows) >= ROWS:
                        yield _batch(rows, _DIGESTS)
                current, begun, paid, audit, sha = conv_id, True, cost, [], hashlib.sha256()
                gaps, illegal, counts, last, initial, written = 0, 0, {"blank": 0, "duplicate": 0, "truncated": 0}, None, None, False
            if edit is None:
                continue
            audit.append(edit)
            if edit != "I":
                if fault:
                    counts[fault] += 1
                if turn is not None:
                    if last is not None and turn != last:
                        gaps += turn - last - 1
                    last = turn
                if initial is not None and initial + old_role[:1] not in ("su", "ua", "au"):
                    illegal += 1
                initial = old_role[:1]
            if edit != "D":
                sha.update(f"{'\n' if written else ''}{role}:{text}".encode())
                written = True
    if begun:
        rows.append((current, gaps, *counts.values(), illegal, paid, "".join(audit), sha.hexdigest()))
    yield _batch(rows, _DIGESTS)


def digests(found: DataFrame) -> DataFrame:
    """Counts, audit and digest of each conversation, from ``edits``.

    gaps: missing turns between the least and the largest (null turns don't count); illegal: neighbours whose initials
    aren't su, ua or au.
    """
    return found.mapInArrow(_digest, _DIGESTS)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` as (conv_id, turn, role, text, copies), damaged by a hash of conversation and turn.

    Of 20 remainders, 0 drops a row (no copies), 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes the
    user its role. A null counts as one space, in the hash too; it stays null as conversation or turn.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    k = F.crc32(key) % 20
    text = F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id", "turn", F.when(k == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"), F.when(k == 1, "").when(k == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"),
    )
