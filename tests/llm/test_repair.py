"""Conversation repair against a plain dynamic programme over costs and audits, and against all edits of short ones."""

import hashlib
import itertools
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from ticksmith.llm import queries, repair

GOAL = re.compile("(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        shown = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, repaired) by the least (cost, audit) of what follows each row and each output so far's kind."""
    known = faults(rows)
    best = {}

    def after(q, c):  # places: 0 nothing yet, 1 after s, 2 after u, 3 after a
        return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, c))

    for i in range(len(rows), -1, -1):
        found = {q: [] for q in range(4)}
        for q in range(4):
            if i == len(rows):
                found[q] += [(0, "", ())] if q in (0, 3) else []
                continue
            (role, text), fault = rows[i], known[i]
            c, a, r = best[i + 1, q]
            found[q].append((c + 2, "D" + a, r))
            if fault in ("", "truncated"):
                for new, letter, cost in [(role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)]:
                    if (p := after(q, new[:1])) is not None:
                        c, a, r = best[i + 1, p]
                        found[q].append((c + cost + 5 * (fault == "truncated"), letter + a, ((new, text), *r)))
        for _ in range(3):  # insertions
            for q in range(4):
                for new in ("user", "assistant"):
                    p = after(q, new[0])
                    if p is not None and found[p]:
                        c, a, r = min(found[p])
                        found[q].append((c + 5, "I" + a, ((new, ""), *r)))
        for q in range(4):
            best[i, q] = min(found[q])
    return best[0, 0]


def expected(rows):
    """Digest columns of rows (turn, role, text) in order."""
    pairs = [(r, t) for _, r, t in rows]
    cost, audit, result = brute(pairs)
    known = faults(pairs)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in result).encode()).hexdigest()
    return gaps, known.count("blank"), known.count("duplicate"), known.count("truncated"), illegal, cost, audit, sha


def damage(rows):
    """(conv_id, turn, role, text) in order, after damage."""
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        own += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest())
    return {c: sorted(own, key=order) for c, own in by.items()}


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_query_equals_brute_force(spark, small):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()]
    found = got(queries.op13_conversation_repair(spark, small))
    assert found == {c: expected(own) for c, own in damage(rows).items()}


def odd_conversations(spark):
    rows = [(k % 7 if k % 11 else None, None if k % 5 == 0 else k % 13, [None, "", "system", "user", "assistant", "sys", "tool", "ünd", "u", "assist"][k % 10], [None, "", " \t", "Yes.", "No", "Well!  ", "So?\n", "x" * 500, "Yes."][k % 9]) for k in range(150)]
    rows += [(50, 3, "user", "Same."), (50, 3, "user", "Same."), (50, 3, "assistant", "Same.")] * 4 + [(60, 2**62, "user", "Far."), (60, -5, "system", "Near.")]
    rows += [(c, 0, "user", "Alone.") for c in range(100, 140)]
    return spark.createDataFrame([(*r, "k", 7, b"d") for r in rows], "conv_id long, turn long, role string, text string, fault string, copies long, digest binary").repartition(5), rows


def test_odd_rows(spark):
    df, rows = odd_conversations(spark)
    assert got(repair.digests(repair.edits(repair.damaged(df)))) == {c: expected(own) for c, own in damage(rows).items()}
    assert repair.digests(repair.edits(repair.damaged(df.where("false")))).collect() == []


def test_all_rows_dropped(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", 0), (2, 0, "user", "Hi.", 1)], "conv_id long, turn long, role string, text string, copies int")
    none = hashlib.sha256(b"").hexdigest()
    assert got(repair.digests(repair.edits(rows)))[1] == (0, 0, 0, 0, 0, 0, "", none)


def test_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 0, "system", "Be brief.", 1), (1, 1, "user", "Hi.", 1), (1, 2, "user", "Well?", 1), (1, 3, "tool", "No.", 1)], "conv_id long, turn long, role string, text string, copies int")
    found = repair.edits(rows)
    assert [(r.edit, r.fault, r.old_role, r.role) for r in found.collect()] == [("K", "", "system", "system"), ("D", "", "user", None), ("K", "", "user", "user"), ("R", "", "tool", "assistant")]
    assert [tuple(r) for r in repair.repaired(found).collect()] == [(1, "system", "Be brief."), (1, "user", "Well?"), (1, "assistant", "No.")]


def test_one_long_conversation_with_many_copies(spark):
    """Copies are counted before they move: 200,000 rows of 40 distinct ones, and the audit has them all."""
    rows = spark.range(200_000).selectExpr("1L AS conv_id", "id % 40 AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "'Turn ' || id % 40 || '.' AS text", "1 AS copies")
    found = got(repair.digests(repair.edits(rows)))[1]
    assert found[0:5] == (0, 0, 200_000 - 40, 0, 200_000 - 40) and found[5] == 2 * (200_000 - 40)
    assert found[6] == ("K" + "D" * 4999) * 40


ROW = st.tuples(st.sampled_from("suat"), st.sampled_from(["A.", "B.", "C.", "cut", ""]))


def scanned(rows):
    """Cost and audit by the automaton alone."""
    auto, state, paid, stack = repair.Automaton(), repair.pack_vector(repair.END), 0, []
    known = faults(rows)
    for (role, _), fault in zip(reversed(rows), reversed(known), strict=True):
        stack.append((state, *repair._symbol(role, fault)))
        state, least = auto.before(*stack[-1])
        paid += least
    audit, q = "", 0
    for at in reversed(stack):
        edits, q = auto.trace(*at, q)
        audit += edits
    return paid + repair.unpack_vector(state)[0], audit + "I" * (repair.END[q] // 5)


@settings(max_examples=500, deadline=None)
@given(st.lists(ROW, max_size=14))
def test_automaton_equals_brute_force(rows):
    assert scanned(rows) == brute(rows)[:2]


@settings(max_examples=60, deadline=None)
@given(st.lists(ROW, max_size=3))
def test_brute_force_equals_all_edits(rows):
    """Every choice of edits with up to two insertions between rows."""
    known = faults(rows)
    options = [[("D", "", 2)] + ([("K", role, 5 * (f == "truncated")), ("R", "u", 1 + 5 * (f == "truncated")), ("R", "a", 1 + 5 * (f == "truncated"))] if f in ("", "truncated") else []) for (role, _), f in zip(rows, known, strict=True)]
    gaps = [x for n in range(3) for x in itertools.product("ua", repeat=n)]
    found = []
    for chosen in itertools.product(*options):
        for added in itertools.product(gaps, repeat=len(rows) + 1):
            out, audit, cost = "".join(added[0]), "I" * len(added[0]), 5 * len(added[0])
            for (letter, c, price), more in zip(chosen, added[1:], strict=True):
                out, audit, cost = out + c + "".join(more), audit + letter + "I" * len(more), cost + price + 5 * len(more)
            if GOAL.fullmatch(out):
                found.append((cost, audit))
    assert min(found) == brute(rows)[:2]


def test_states_are_few():
    """All that any rows lead to, from the end on."""
    auto, todo = repair.Automaton(), [repair.pack_vector(repair.END)]
    known = set(todo)
    while todo:
        state = todo.pop()
        for initial in ("s", "u", "a", ""):
            for fault in ("", "truncated", "must"):
                after, _ = auto.before(state, initial, fault)
                assert min(repair.unpack_vector(after)) == 0 and max(repair.unpack_vector(after)) <= 12
                if after not in known:
                    known.add(after)
                    todo.append(after)
    assert len(known) < 100
