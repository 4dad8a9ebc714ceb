"""Conversation structure repair by branch and bound (operator 12).

The cheapest edits that make a conversation a legal one: an optional system
turn, then pairs of user and assistant turns.  Rows arrive sorted; a range
partitioning deals them out, so that a conversation of any length is spread
over tasks and read as a stream.  A run of at most ``RUN`` rows of one
conversation is searched at once; a conversation that fits into one run of one
task is finished there.  Of longer ones, and of those cut by a border between tasks,
each run is searched from every state to every state; the runs' results are far
smaller than the rows, and a second search over runs joins them.

The search is depth first on an explicit stack.  A node is a place between rows
and a state of the conversation so far.  A suffix bound says what the rows from
a place on cost at least, if the conversation could stop in any state; the incumbent
is the best whole (cost, audit) so far; a table of each node's best prefix
eliminates worse ones.  The search ends when the stack is empty: every prefix left
out was worse than the incumbent or than another prefix of the same node.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import settle
from .text import columns_of

#: Rows of a conversation that are searched at once.
RUN = 256
#: States: nothing yet, after system, after user, after assistant; the first and last may end.
BEGUN, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (BEGUN, ASSISTANT)
#: Where a turn with this initial leads from each state that allows it.
LEADS = {"s": {BEGUN: SYSTEM}, "u": {BEGUN: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The turn that may come next in each state, besides system at the start.
NEXT = {BEGUN: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
NAMES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A row's first fault.
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)
#: Blanks: space and the characters 9 to 13.
WHITE = " \t\n\x0b\x0c\r"


class Move(NamedTuple):
    """An edit or a run of edits: what it costs, writes into the audit, and where it leads."""

    cost: int
    audit: str
    state: int


def row_moves(initial: str, fault: int, state: int) -> list[Move]:
    """What can be done with a row in a state."""
    moves = [Move(DELETE, "D", state)]
    if fault in (FINE, CUT_OFF):
        more = TRUNCATED if fault == CUT_OFF else 0
        to = LEADS.get(initial, {}).get(state)
        if to is not None:
            moves.append(Move(more, "K", to))
        moves.append(Move(more + REROLE, "R", LEADS[NEXT[state]][state]))
    return moves


def inserted(state: int) -> Move:
    return Move(INSERT, "I", LEADS[NEXT[state]][state])


def suffix_bounds(layers: list[list[list[Move]]]) -> list[list[int]]:
    """Least cost of the layers from each place on, by state, if the end could have any state."""
    bounds = [[0] * 4]
    for moves in reversed(layers):
        after = bounds[-1]
        here = [min((m.cost + after[m.state] for m in moves[s]), default=1 << 60) for s in range(4)]
        for _ in range(3):  # inserts lead round the states; three in a row reach all there are
            here = [min(here[s], INSERT + here[inserted(s).state]) for s in range(4)]
        bounds.append(here)
    return bounds[::-1]


def search(layers: list[list[list[Move]]], start: int, ends: tuple[int, ...], bounds: list[list[int]] | None = None) -> Move | None:
    """The cheapest moves through all layers, the ASCII-least audit among equals; None if no end can be reached.

    ``layers[i][state]`` are the moves of layer ``i`` in a state; inserts may stand before any layer and at the end.
    """
    bounds = bounds or suffix_bounds(layers)
    best: Move | None = None
    seen: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, Move(0, "", start))]
    while stack:
        at, prefix = stack.pop()
        if best is not None:
            least = prefix.cost + bounds[at][prefix.state]
            if least > best.cost or least == best.cost and prefix.audit > best.audit[:len(prefix.audit)]:
                continue
        node, worth = (at, prefix.state), (prefix.cost, prefix.audit)
        if node in seen and seen[node] <= worth:
            continue
        seen[node] = worth
        if at == len(layers) and prefix.state in ends and (best is None or worth < (best.cost, best.audit)):
            best = prefix
        nexts = [(at, inserted(prefix.state))]
        if at < len(layers):
            nexts += [(at + 1, m) for m in layers[at][prefix.state]]
        # The most promising comes last, since the stack gives it first.
        nexts.sort(key=lambda n: (n[1].cost + bounds[n[0]][n[1].state], n[1].audit), reverse=True)
        stack += [(to, Move(prefix.cost + m.cost, prefix.audit + m.audit, m.state)) for to, m in nexts]
    return best


def row_layers(initials: list[str], faults: list[int]) -> list[list[list[Move]]]:
    return [[row_moves(i, f, s) for s in range(4)] for i, f in zip(initials, faults)]


def repaired_lines(audit: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """``role:text`` of the turns that an audit leaves, from a state on."""
    out, i = [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        turn = roles[i][:1] if edit == "K" else NEXT[state]
        if edit == "I":
            out.append(f"{NAMES[turn]}:")
        else:
            out.append(f"{roles[i] if edit == 'K' else NAMES[turn]}:{texts[i]}")
            i += 1
        state = LEADS[turn][state]
    return out


class Rows:
    """The rows of one run, as the stream brings them."""

    def __init__(self) -> None:
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.faults: list[int] = []
        self.turns: list[int | None] = []

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        shown = text.rstrip(WHITE)
        self.faults.append(BLANK if not shown else DUPLICATE if seen else FINE if shown[-1] in ".!?" else CUT_OFF)
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)

    def initials(self) -> list[str]:
        return [r[:1] for r in self.roles]

    def facts(self) -> dict:
        """What the report needs of a run, in a form that runs can be added up from."""
        initials = self.initials()
        turns = [t for t in self.turns if t is not None]
        return {"blank": self.faults.count(BLANK), "duplicate": self.faults.count(DUPLICATE), "truncated": self.faults.count(CUT_OFF),
                "illegal": sum(a + b not in LEGAL for a, b in itertools.pairwise(initials)), "n": len(initials),
                "first": initials[0] if initials else None, "last": initials[-1] if initials else None,
                "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns))}

    def layers(self) -> list[list[list[Move]]]:
        return row_layers(self.initials(), self.faults)


#: Neighbouring initials of a legal conversation.
LEGAL = ("su", "ua", "au")
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def add_facts(a: dict, b: dict) -> dict:
    """Facts of two runs that follow one another; turns rise from one to the next."""
    if not a["n"] or not b["n"]:
        return b if b["n"] else a
    out = {c: a[c] + b[c] for c in (*COUNTS, "n", "turns")} | {"first": a["first"], "last": b["last"]}
    out["illegal"] += a["last"] + b["first"] not in LEGAL
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    return out | {"low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"]}


def gaps(facts: dict) -> int:
    return 0 if facts["low"] is None else facts["high"] - facts["low"] + 1 - facts["turns"]


def _digest(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()


_PATH = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("cost", T.LongType()),
                      T.StructField("audit", T.StringType()), T.StructField("end", T.IntegerType())])
_FACTS = [("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("n", "long"), ("first", "string"),
          ("last", "string"), ("low", "long"), ("high", "long"), ("turns", "long")]


def _out_schema(key: T.StructField, named: list[tuple[str, str]], *more: T.StructField) -> T.StructType:
    out = T.StructType([T.StructField("key", key.dataType)])
    for name, kind in named:
        out = out.add(name, kind)
    for f in more:
        out = out.add(f)
    return out


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in schema} for r in rows], schema=schema)


#: What a finished conversation reports.
REPORT = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"),
          ("audit", "string"), ("repaired_sha256", "string")]


def _runs(batches: Iterator[pa.RecordBatch], run_rows: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Reports of conversations that lie whole within the task and a run; runs of the others."""
    part, out, size = TaskContext.get().partitionId(), [], 0
    rows, key, run, before, inner = Rows(), None, 0, None, False

    def ended(last: bool) -> dict:
        """The run so far; ``last``: its conversation ends here and began in this task."""
        facts, layers = rows.facts(), rows.layers()
        bounds = suffix_bounds(layers)
        if last and run == 0 and inner:
            best = search(layers, BEGUN, ENDS, bounds)
            lines = repaired_lines(best.audit, BEGUN, rows.roles, rows.texts)
            return {"key": key, "whole": True, **facts, "gaps": gaps(facts), "cost": best.cost, "audit": best.audit,
                    "repaired_sha256": _digest(lines)}
        paths = []
        for start in range(4):
            for end in range(4):
                if best := search(layers, start, (end,), bounds):
                    paths.append({"start": start, **best._asdict()})
                    paths[-1]["end"] = paths[-1].pop("state")
        return {"key": key, "whole": False, "part": part, "run": run, **facts, "paths": paths, "roles": rows.roles, "texts": rows.texts}

    started = False
    for batch in batches:
        for r_key, turn, role, text, later in zip(*[batch.column(c).to_pylist() for c in ("key", "turn", "role", "text", "later")]):
            if not started or r_key != key:
                if started:
                    out.append(ended(True))
                # The first conversation of a task may have begun in the task before.
                rows, key, run, before, inner, started = Rows(), r_key, 0, None, started, True
            elif len(rows.roles) >= run_rows:
                out.append(ended(False))
                rows, run = Rows(), run + 1
            if text is not None:
                rows.add(turn, role, text, later or (turn, role, text) == before)
                before = (turn, role, text)
                size += len(text)
            if size > 4_000_000 and out:
                yield _batch(out, schema)
                out, size = [], 0
    if started:
        out.append(ended(False))  # it may go on in the next task
    if out:
        yield _batch(out, schema)


#: Runs that are joined at once.
JOINED = 64


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Rows of a sorted stream by key, without holding a key's rows."""
    rows = (r for batch in batches for r in batch.to_pylist())
    return itertools.groupby(rows, key=lambda r: r["key"])


def _join_runs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The cheapest way through all runs of each conversation, and its facts."""
    def shorter(layers: list) -> list:
        return [[Move(m.cost, m.audit, m.state) for e in range(4) if (m := search(layers, s, (e,)))] if s == BEGUN else [] for s in range(4)]

    for key, runs in _by_key(batches):
        facts, held = Rows().facts(), []
        for r in runs:
            facts = add_facts(facts, r)
            held.append([[Move(p["cost"], p["audit"], p["end"]) for p in r["paths"] if p["start"] == s] for s in range(4)])
            if len(held) > JOINED:
                held = [shorter(held)]
        best = search(held, BEGUN, ENDS)
        yield _batch([{"key": key, "part": -1, "run": 0, **{c: facts[c] for c in COUNTS}, "gaps": gaps(facts), "cost": best.cost,
                       "audit": best.audit}], schema)


def _hash_runs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Digest of each repaired conversation, its runs read one after another."""
    for _, rows in _by_key(batches):
        report = next(rows)
        audit, at, state, lines, digest = report["audit"], 0, BEGUN, 0, hashlib.sha256()
        for r in itertools.chain(rows, [None]):
            stop, left = at, len(r["roles"]) if r else 0
            while stop < len(audit) and (left or audit[stop] == "I"):
                left -= audit[stop] != "I"
                stop += 1
            made = repaired_lines(audit[at:stop], state, r["roles"] if r else [], r["texts"] if r else [])
            for line in made:
                digest.update(("\n" * (lines > 0) + line).encode("utf-8", "surrogatepass"))
                lines += 1
            for edit, role in _edits(audit[at:stop], r["roles"] if r else []):
                if edit != "D":
                    state = LEADS[role[:1] if edit == "K" else NEXT[state]][state]
            at = stop
        yield _batch([report | {"repaired_sha256": digest.hexdigest()}], schema)


def _edits(audit: str, roles: list[str]) -> Iterator[tuple[str, str]]:
    """Each edit with the role of the row it is about."""
    own = iter(roles)
    for edit in audit:
        yield edit, "" if edit == "I" else next(own)


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with planted faults, by a checksum of conversation and turn.

    One row in twenty is dropped, emptied, robbed of its ``.!?``, repeated, given
    to the user; null roles and texts become one space.  A dropped row stays with a null
    text, so that its conversation is still known.  Returns ``key``, ``turn``, ``role``, ``text``.
    """
    c = {n: F.col(f"`{n}`") for n in (conv, turn, role, text)}
    mark = F.crc32(F.concat_ws(":", *[F.coalesce(c[n].cast("string"), F.lit(" ")) for n in (conv, turn)])) % 20
    words = F.coalesce(c[text].cast("string"), F.lit(" "))
    rows = df.select(c[conv].alias("key"), c[turn].cast("long").alias("turn"), mark.alias("mark"),
                     F.when(mark == 4, F.lit("user")).otherwise(F.coalesce(c[role].cast("string"), F.lit(" "))).alias("role"),
                     F.when(mark == 0, F.lit(None).cast("string")).when(mark == 1, F.lit(""))
                     .when(mark == 2, F.regexp_replace(words, "[.!?]", "")).otherwise(words).alias("text"))
    twice = F.explode(F.when(F.col("mark") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("key", "turn", "role", "text", twice.alias("copy")).drop("copy")


def _with_earlier(rows: DataFrame) -> DataFrame:
    """``later``: a row of an earlier turn of the conversation has the same role and text."""
    rows = rows.withColumn("digest", F.sha2("text", 256))
    first = (rows.filter("text is not null").groupBy("key", "role", "digest")
             .agg(F.min("turn").alias("low"), F.max(F.col("turn").isNull()).alias("none"), F.count("*").alias("n")).filter("n > 1")
             .select(F.col("key").alias("k"), F.col("role").alias("r"), F.col("digest").alias("d"), "low", "none"))
    met = rows.join(first, F.col("key").eqNullSafe(F.col("k")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    later: Column = F.when(F.col("none"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("low"))
    return met.select("key", "turn", "role", "text", "digest", F.coalesce(later, F.lit(False)).alias("later"))


def repair(rows: DataFrame, run_rows: int = RUN) -> DataFrame:
    """One row per conversation: its faults, the cheapest repair, and a digest of what it leaves.

    ``rows`` has ``key``, ``turn``, ``role`` and ``text``; a null text stands for a
    row that is gone, other nulls are values.  Rows stand in the order of turns, nulls first; rows of
    one turn by role and text.  Returns ``key``, ``gaps``, ``blank``, ``duplicate``, ``truncated``,
    ``illegal``, ``cost``, ``audit`` and ``repaired_sha256``.

    A kept row costs nothing, a new role (user or assistant) 1, a deletion 2, an inserted empty turn 5, a
    truncated row that stays 5 more.  Blank and repeated rows must go.  A row with an
    empty role can't be kept as it is.  A null key is a conversation of its own.
    A conversation whose rows are all gone has zeros, an empty audit and the digest of nothing.
    An empty table gives no rows; conversations of any length are searched whole.
    """
    # Written once: the range partitioning reads it for its borders, then again.
    rows = settle(_with_earlier(columns_of(rows, "key", "turn", "role", "text")))
    key = rows.schema["key"]
    order = [F.col("key").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc_nulls_first()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "turn", "role", "text", "later")
    report = [(n, k) for n, k in REPORT if n not in COUNTS]
    schema = _out_schema(key, [("whole", "boolean"), ("part", "integer"), ("run", "integer"), *_FACTS, *report],
                         T.StructField("paths", T.ArrayType(_PATH)), T.StructField("roles", T.ArrayType(T.StringType())),
                         T.StructField("texts", T.ArrayType(T.StringType())))
    arrow = to_arrow_schema(schema)
    found = settle(dealt.mapInArrow(lambda it: _runs(it, run_rows, arrow), schema))
    names = ["key", *[n for n, _ in REPORT]]
    by_run = ["key", "part", "run"]
    pieces = found.filter("not whole")
    joined_schema = _out_schema(key, [("part", "integer"), ("run", "integer"), *REPORT])
    joined_arrow = to_arrow_schema(joined_schema)
    joined = (pieces.select(*by_run, *[n for n, _ in _FACTS], "paths").repartition("key").sortWithinPartitions(*by_run)
              .mapInArrow(lambda it: _join_runs(it, joined_arrow), joined_schema))
    read = joined.unionByName(pieces.select(*by_run, "roles", "texts"), allowMissingColumns=True)
    end_schema = _out_schema(key, REPORT)
    end_arrow = to_arrow_schema(end_schema)
    ended = (read.repartition("key").sortWithinPartitions(*by_run).mapInArrow(lambda it: _hash_runs(it, end_arrow), end_schema))
    return found.filter("whole").select(*names).unionByName(ended.select(*names))
