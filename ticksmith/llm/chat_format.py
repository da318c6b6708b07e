"""Chat formatting: records of any known layout become canonical turns in one template.

A record's schema fingerprint is the hash of its sorted nested field paths (``messages[].role``, ...). The fingerprint
selects a declarative mapping from ``MAPPINGS``: where turns stand, which field names the role, which holds the text.
The template marks turns by control strings; those inside roles and texts are escaped by a backslash, which is undone
when the output is read.

Output: one row for each turn, (conv_id, seq, formatted, loss_start, loss_length); the mask is in code points of
``formatted`` and covers the escaped text of assistant turns. A conversation is the concatenation of its rows by seq,
which grows along it but skips numbers where another task goes on: a long conversation is dealt to several tasks by
ranges of turns. Only its digests, which are sequential, pass one task, through which its rows stream.

Defined results: null texts and roles are empty; records of one conversation go by turn (nulls first), then by their
JSON text; repeated records are each kept; null conv_ids are one conversation. A record whose fingerprint no
mapping knows is an error that names its paths. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticksmith.llm.storage import written

#: The template's control strings, and those of other public templates; fixed values.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>"]

#: Backslashes, and first characters of control strings; what follows isn't consumed, so overlapping ones are all found.
_CONTROL = re.compile("|".join([r"\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)]))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|turn\|>(.*?)<\|body\|>(.*)<\|end\|>", re.S)


def escape(text: str) -> str:
    """Put a backslash into each control string, behind its first character, and double backslashes."""
    return _CONTROL.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


# --- layouts


def field_paths(value, at: str = "") -> set[str]:
    """Paths of all fields; a list's elements share the path ``[]``. Values don't count, only where they stand."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at + "{}"}
    if isinstance(value, list):
        return set().union(*(field_paths(v, at + "[]") for v in value)) if value else {at + "[]"}
    return {at}


def fingerprint(paths) -> str:
    return hashlib.blake2b("\n".join(sorted(paths)).encode("utf-8"), digest_size=8).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``paths`` are all field paths of the layout, those in ``optional`` may be absent. ``turns``: field of the list of
    turns, with ``role`` and ``text`` its fields. Without ``turns``: ``fixed`` gives a role and fields for each turn,
    fields joined by a blank line, empty turns left out. ``roles`` renames roles.
    """

    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def apply(self, record: dict) -> list[tuple[str, str]]:
        names = dict(self.roles)
        if self.fixed:
            turns = [(role, "\n\n".join(str(record[f]) for f in fields if record.get(f))) for role, fields in self.fixed]
            return [t for t in turns if t[1] or t[0] != "system"]
        rows = [record] if self.turns == "" else record[self.turns] or []
        return [(names.get(r.get(self.role) or "", r.get(self.role) or ""), "" if r.get(self.text) is None else str(r[self.text])) for r in rows]


_NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"), ("prompter", "user"))
MAPPINGS = [
    Mapping(("role", "text"), turns="", text="text"),  # a row for each turn
    Mapping(("role", "content"), turns=""),
    Mapping(("messages[].role", "messages[].content"), ("id", "system"), turns="messages", roles=_NAMES),
    Mapping(("conversations[].from", "conversations[].value"), ("id", "system"), turns="conversations", role="from", text="value", roles=_NAMES),
    Mapping(("dialog[].speaker", "dialog[].text"), ("id",), turns="dialog", role="speaker", text="text", roles=_NAMES),
    Mapping(("prompt", "response"), ("id", "system"), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("prompt", "completion"), ("id", "system"), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping(("instruction", "output"), ("id", "system", "input"), fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping(("question", "answer"), ("id", "system", "context"), fixed=(("system", ("system",)), ("user", ("context", "question")), ("assistant", ("answer",)))),
]


def by_fingerprint(mappings: list[Mapping] = MAPPINGS) -> dict[str, Mapping]:
    """Each mapping under the fingerprints of its layout with and without optional fields, and with no turns."""
    table = {}
    for m in mappings:
        bare = [(f"{m.turns}[]",)] if m.turns else []
        for core in [m.paths, *bare]:
            for k in range(1 << len(m.optional)):
                table[fingerprint({*core, *(p for i, p in enumerate(m.optional) if k >> i & 1)})] = m
    return table


def canonical_turns(record: dict, table: dict[str, Mapping]) -> list[tuple[str, str]]:
    paths = field_paths(record)
    mapping = table.get(fingerprint(paths))
    if mapping is None:
        raise ValueError(f"no mapping for the layout {sorted(paths)}")
    turns = mapping.apply(record)
    if "system" in mapping.optional and mapping.turns and record.get("system"):
        turns.insert(0, ("system", str(record["system"])))
    return turns


# --- the template

_OUT = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_length", pa.int64())])
_OUT_DDL = "conv_id long, seq long, formatted string, loss_start long, loss_length long"


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its loss mask begins and how long it is."""
    head, body = f"{TURN}{escape(role)}{BODY}", escape(text)
    return head + body + END, len(head), len(body) if role == "assistant" else 0


def format_records(records: DataFrame) -> DataFrame:
    """Format ``records`` (conv_id, turn, record: a JSON object of any known layout)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seq = by_fingerprint(), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for conv_id, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for role, text in canonical_turns(json.loads(record), table):
                    rows.append((conv_id, seq, *format_turn(role, text)))
                    seq += 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_OUT)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)

    # Ranges of (conv_id, turn, record): tasks are in order, so a task's number leads the numbers of its turns.
    order = ["conv_id", "turn", "record"]
    dealt = records.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("conv_id", "record").mapInArrow(run, _OUT_DDL)


def parse_turn(formatted: str) -> tuple[str, str]:
    """The role and text of a formatted turn."""
    m = _TURN.fullmatch(formatted)
    if not m:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2])


_DIGEST_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Read formatted turns back: one row of counts and digests for each conversation.

    A digest is sequential, so a conversation's turns pass one task in order; they stream, and only the digests' state
    is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _DIGEST_DDL.split(", ")]
        kinds = [pa.string() if "sha" in n else pa.int64() for n in names]
        current, begun, done = None, False, []
        turns = loss = None
        n = chars = total = 0

        def close() -> None:
            if begun:
                done.append((current, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[]] * len(names)
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            done.clear()
            return out

        for batch in batches:
            for conv_id, text, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv_id != current:
                    close()
                    current, begun, n, chars, total = conv_id, True, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                turns.update("{}\n{}\n".format(*parse_turn(text)).encode("utf-8"))
                masked = unescape(text[start : start + length])
                loss.update(masked.encode("utf-8"))
                n, chars, total = n + 1, chars + len(masked), total + len(text)
            yield flush()
        close()
        yield flush()

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return dealt.select("conv_id", "formatted", "loss_start", "loss_length").mapInArrow(run, _DIGEST_DDL)


def turn_records(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` as records of the layout with one turn a row."""
    record = F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), record.alias("record"))


def format_and_read(records: DataFrame) -> DataFrame:
    return conversation_digests(written(format_records(records), "chat"))
