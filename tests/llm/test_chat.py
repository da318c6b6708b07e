import hashlib
import json

import pytest

from ticksmith.llm import chat_format as C
from ticksmith.llm import queries


def expected(rows) -> dict:
    """conv_id -> (turns, digest of turns, loss characters, digest of loss)."""
    by: dict = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0], r[1] if r[1] is not None else -(2**63))):
        by.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digests(df) -> dict:
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_whole_table_and_the_control_conversation(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", queries.CONTROL_TEXT), (-1, 1, "assistant", queries.CONTROL_TEXT)]
    got = queries.op3_chat_format(spark, tiny)
    assert digests(got) == expected(rows)
    assert got.where("conv_id = -1").first().loss_chars == len("</s>[INST] ok [/INST]")


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "<|end|>\\<|turn|>"), (1, 2, "assistant", ""), (2, None, None, "x"), (2, 5, "assistant", "y" * 100_000), (3, 0, "assistant", "same"), (3, 1, "assistant", "same")]
    table = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, record string, seq long")
    assert digests(C.format_and_read(C.turn_records(table))) == expected(rows)
    assert C.format_and_read(C.turn_records(table.where("false"))).collect() == []


def test_escapes_are_reversible_and_hide_control_strings():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    piece = st.one_of(st.sampled_from([*C.CONTROL, C.TURN, C.BODY, C.END, "\\", "\\\\", "<", "|", ">", "s", "/"]), st.text(max_size=3))

    @settings(max_examples=400, deadline=None)
    @given(st.lists(piece, max_size=8).map("".join), st.lists(piece, max_size=8).map("".join))
    def check(role, text):
        formatted, start, length = C.format_turn(role, text)
        assert C.parse_turn(formatted) == (role, text)
        body = C.escape(text)
        assert not any(c in body for c in C.CONTROL) and formatted.count(C.TURN) == formatted.count(C.END) == 1
        assert C.unescape(formatted[start : start + length]) == (text if role == "assistant" else "")

    check()


@pytest.mark.parametrize("text", ["<|>", "<<|>>", "<<SYS>>", "<<s>", "[INST][/INST]", "<|end|><|turn|>", "\\<|>", "|>|>", "<</SYS>>", "<|\\|>"])
def test_overlapping_control_strings_are_all_broken(text):
    body = C.escape(text)
    assert C.unescape(body) == text and not any(c in body for c in C.CONTROL)


def test_ordinary_text_is_left_as_it_is():
    assert C.escape("a < b > c | d [1] x[i] <b>") == "a < b > c | d [1] x[i] <b>"


@pytest.fixture
def small_partitions(spark):
    """Small shuffles stay dealt, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ties_go_by_record_and_a_long_conversation_by_turn(spark, small_partitions):
    rows = [(7, k // 3, "user" if k % 2 else "assistant", f"text {k * 7919 % 500:03}") for k in range(900)] + [(8, 0, "user", "hi")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    formatted = C.format_records(C.turn_records(table)).orderBy("conv_id", "seq").collect()
    record = lambda role, text: json.dumps({"role": role, "text": text}, separators=(",", ":"))
    want = [(r[2], r[3]) for r in sorted(rows, key=lambda r: (r[0], r[1], record(r[2], r[3])))]
    assert [C.parse_turn(r.formatted) for r in formatted] == want
    assert len({r.seq for r in formatted if r.conv_id == 7}) == 900 and len({r.seq >> 40 for r in formatted if r.conv_id == 7}) > 1
    assert C.conversation_digests(C.format_records(C.turn_records(table))).where("conv_id = 7").first().n_turns == 900


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ({"id": 3, "system": "be kind", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("system", "be kind"), ("user", "q"), ("assistant", "a")]),
    ({"dialog": [{"speaker": "user", "text": "q"}]}, [("user", "q")]),
    ({"prompt": "q", "response": "a"}, [("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "completion": "a", "system": "s"}, [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "output": "done"}, [("user", "do"), ("assistant", "done")]),
    ({"question": "q", "answer": "a", "context": "c"}, [("user", "c\n\nq"), ("assistant", "a")]),
    ({"role": "user", "content": "q"}, [("user", "q")]),
]


def test_layouts_are_told_apart_by_their_fingerprints(spark):
    table = C.by_fingerprint()
    for record, turns in LAYOUTS:
        assert C.canonical_turns(record, table) == turns
    records = spark.createDataFrame([(k, 0, json.dumps(r)) for k, (r, _) in enumerate(LAYOUTS)], "conv_id long, turn long, record string")
    got = C.format_records(records).orderBy("conv_id", "seq").collect()
    assert [C.parse_turn(r.formatted) for r in got] == [t for _, turns in LAYOUTS for t in turns]


def test_field_paths_ignore_values_and_order():
    a = {"messages": [{"role": "x", "content": "y"}, {"content": "z", "role": "w"}], "id": 1}
    assert C.fingerprint(C.field_paths(a)) == C.fingerprint(["id", "messages[].content", "messages[].role"])
    assert C.fingerprint(C.field_paths({"a": {"b": 1}})) != C.fingerprint(C.field_paths({"a": [{"b": 1}]}))


def test_an_unknown_layout_is_an_error(spark):
    with pytest.raises(Exception, match="no mapping for the layout"):
        C.format_records(spark.createDataFrame([(1, 0, '{"foo": 1}')], "conv_id long, turn long, record string")).collect()
