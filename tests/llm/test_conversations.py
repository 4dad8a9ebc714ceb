import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

from hypothesis import given, settings
from hypothesis import strategies as st

from promoloom.llm import conversations as C

sys.setrecursionlimit(20_000)  # the brute force goes down row by row


def by_brute_force(rows):
    """Cheapest (cost, audit, lines) of (initial, role, text, fault) rows, by trying every edit with at most two inserts a place."""
    ends = {"": True, "s": False, "u": False, "a": True}

    @lru_cache(None)
    def best(i, last, inserts):
        out = []
        if i == len(rows) and ends[last]:
            out.append((0, "", ()))
        nexts = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        name = {"u": "user", "a": "assistant"}[nexts]
        if inserts < 2:
            c, a, lines = best(i, nexts, inserts + 1)
            out.append((c + 5, "I" + a, (name + ":",) + lines))
        if i < len(rows):
            initial, role, text, fault = rows[i]
            c, a, lines = best(i + 1, last, 0)
            out.append((c + 2, "D" + a, lines))
            if fault in (C.FINE, C.CUT_OFF):
                more = 5 if fault == C.CUT_OFF else 0
                if initial == nexts or initial == "s" and last == "":
                    c, a, lines = best(i + 1, initial, 0)
                    out.append((c + more, "K" + a, (f"{role}:{text}",) + lines))
                c, a, lines = best(i + 1, nexts, 0)
                out.append((c + more + 1, "R" + a, (f"{name}:{text}",) + lines))
        return min(out, key=lambda x: x[:2]) if out else (10**9, "", ())

    return best(0, "", 0)


def report(rows):
    """The contract's columns of one conversation, from (turn, role, text) rows before damage; None values are nulls."""
    live = []
    conv = rows[0][0]
    for c, turn, role, text in rows:
        mark = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if mark == 0:
            continue
        text = "" if mark == 1 else re.sub("[.!?]", "", text) if mark == 2 else text
        role = "user" if mark == 4 else role
        live += [(turn, role, text)] * (2 if mark == 3 else 1)
    live.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, full = set(), []
    for _, role, text in live:
        shown = text.rstrip(" \t\n\x0b\x0c\r")
        fault = (C.BLANK if not shown else C.DUPLICATE if (role, text) in seen else C.FINE if shown[-1] in ".!?" else C.CUT_OFF)
        seen.add((role, text))
        full.append((role[:1], role, text, fault))
    turns = [r[0] for r in live if r[0] is not None]
    cost, audit, lines = by_brute_force(tuple(full))
    faults = [f[3] for f in full]
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(C.BLANK), faults.count(C.DUPLICATE),
            faults.count(C.CUT_OFF), sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(full, full[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


ROWS = st.lists(st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.sampled_from([C.FINE, C.FINE, C.FINE, C.BLANK, C.DUPLICATE, C.CUT_OFF])),
                max_size=14)


@settings(max_examples=600, deadline=None)
@given(ROWS)
def test_search_equals_brute_force(rows):
    layers = C.row_layers([r for r, _ in rows], [f for _, f in rows])
    got = C.search(layers, C.BEGUN, C.ENDS)
    cost, audit, _ = by_brute_force(tuple((r, r, "t", f) for r, f in rows))
    assert (got.cost, got.audit) == (cost, audit)


@settings(max_examples=200, deadline=None)
@given(ROWS, st.integers(1, 5))
def test_runs_joined_equal_the_whole(rows, size):
    layers = C.row_layers([r for r, _ in rows], [f for _, f in rows])
    runs = [layers[i:i + size] for i in range(0, len(layers), size)]
    joined = [[[m for e in range(4) if (m := C.search(run, s, (e,)))] for s in range(4)] for run in runs]
    assert C.search(joined, C.BEGUN, C.ENDS)[:2] == C.search(layers, C.BEGUN, C.ENDS)[:2]


def test_long_conversations_are_searched_quickly():
    rng = random.Random(1)
    for initials in (["u"] * 2000, ["a"] * 2000, ["u", "a"] * 1000, [rng.choice("suax") for _ in range(2000)]):
        for faults in ([C.FINE] * 2000, [C.CUT_OFF] * 2000, [rng.randrange(4) for _ in range(2000)]):
            got = C.search(C.row_layers(initials, faults), C.BEGUN, C.ENDS)
            assert len(got.audit) >= 2000


def made(seed, convs, rows):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", "  ", "Same text.", "Same text.", None, "tail.\n", "é."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, ""]
    return [(c, rng.choice([None, *range(8)]) if c % 7 == 0 else t, rng.choice(roles), rng.choice(texts))
            for c in range(convs) for t in range(rng.randint(1, rows))]


def as_rows(df):
    return sorted((tuple(r) for r in df.select("key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                               "repaired_sha256").collect()), key=str)


def by_conversation(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return sorted((report(g) for g in groups.values()), key=str)


def test_equals_brute_force(spark):
    rows = made(4, 60, 14) + [(None, t, "user", "Hello.") for t in (0, 1, None)] + [(10**6, t, "user", "Hello.") for t in range(120)]
    rows += [r for r in rows if r[0] == 3]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, key long, run string")
    want = by_conversation(rows)
    for run_rows, parts in ((C.RUN, 2), (3, 5), (1, 3)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert as_rows(C.repair(C.damaged(df), run_rows)) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_conversation_over_many_runs_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(C, "JOINED", 3)
    rng = random.Random(9)
    rows = [(5, t, rng.choice(["user", "assistant", "assistant"]), rng.choice(["Yes.", "no", f"Turn {t}."])) for t in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert as_rows(C.repair(C.damaged(df), 7)) == by_conversation(rows)


def test_conversations_whose_rows_all_go(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    schema = "conv_id long, turn long, role string, text string"
    got = as_rows(C.repair(C.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], schema))))
    assert got == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert C.repair(C.damaged(spark.createDataFrame([], schema))).count() == 0
