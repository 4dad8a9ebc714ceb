"""Secrets in texts, with the parts of a credential linked (operator 9).

The tasks of the scan extract parts: identifiers, secrets and endpoints.  The
contract's kinds are reported as they are.  Weak parts (a bare token, a client
name, an address) say little alone: they are reported only when complementary
parts lie in the same scope, that is with fewer than ``WINDOW`` characters between them.

The interval join works on buckets of ``WINDOW`` characters.  A part marks the
buckets it lies in, and each (row, role, bucket) is reduced to its first start
and last end, so a bucket crowded with parts is one row; a weak part looks at
the buckets its scope touches.  Only the outermost two need a comparison, since
a scope covers the others whole, so the reduction loses nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import settle
from .text import columns_of, map_slices, whole_text

#: Contract kinds, in the order that breaks ties, then the weak ones.
BASE = ("assign", "access", "hex")
WEAK = ("client", "bare", "endpoint")
KINDS = (*BASE, *WEAK)
#: What each kind is in a credential.
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "client": "id", "bare": "secret", "endpoint": "endpoint"}
#: The roles that must be near for a weak kind to be reported.
NEEDS = {"client": ("secret",), "bare": ("id",), "endpoint": ("id", "secret")}
#: Characters that a scope reaches to either side.
WINDOW = 256


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = re.compile(rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A greedy run always starts where it can, so the look-behind changes no match and bars rescans.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_CLIENTS = "|".join(map(_either_case, ("client_id", "user", "username", "login", "account")))
_CLIENT = re.compile(rf"""(?<![A-Za-z0-9_])(?:{_CLIENTS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{{3,}})""")
_BARE = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/=_-])")
_ENDPOINT = re.compile(r"https?://[A-Za-z0-9.:@-]+(?:/[A-Za-z0-9._~/%+-]*)?|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}:[0-9]{2,5}(?![0-9])")
#: Bits a character that a bare token must have.
ENTROPY = 3.5


def _looks_random(token: str) -> bool:
    if not (re.search("[a-z]", token) and re.search("[A-Z]", token) and re.search("[0-9]", token)):
        return False
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) >= ENTROPY


def base_parts(text: str) -> list[tuple[str, int, int]]:
    """Contract spans, each kind leftmost and without overlaps."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def weak_parts(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates that need others near; those that overlap a contract span are left out."""
    out = [("client", m.start(), m.end()) for m in _CLIENT.finditer(text)]
    out += [("bare", m.start(), m.end()) for m in _BARE.finditer(text) if _looks_random(m[0])]
    out += [("endpoint", m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
    if not out or not base:
        return out
    # Contract spans of one kind don't overlap; the furthest end so far is enough to find any that reaches a place.
    free, spans, i, reach = [], sorted((s, e) for _, s, e in base), 0, -1
    for kind, s, e in sorted(out, key=lambda p: p[1]):
        while i < len(spans) and spans[i][0] < s:
            reach = max(reach, spans[i][1])
            i += 1
        if reach <= s and (i == len(spans) or spans[i][0] >= e):
            free.append((kind, s, e))
    return free


_PART = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_ARROW_PARTS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _as_parts(found: list[list[tuple[str, int, int]]]) -> pa.Array:
    return pa.array([[dict(zip(("kind", "start", "end"), p)) for p in x] for x in found], _ARROW_PARTS)


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``key``, ``base`` and ``spans`` (arrays of kind, start, end) of every row.

    ``base`` has the contract's spans; ``spans`` adds the weak ones that are
    complemented, by start and kind.  Offsets are code points, the end is
    exclusive.  Null text counts as empty and has empty arrays; a null key stays
    null; repeated rows each give a row and never complement one another.
    Texts of any length are read whole.  An empty table gives no rows.  Other
    columns are ignored.
    """
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("base", T.ArrayType(_PART)),
                           T.StructField("weak", T.ArrayType(_PART))])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        base = [base_parts(t) for t in texts]
        weak = [weak_parts(t, b) for t, b in zip(texts, base)]
        return pa.RecordBatch.from_arrays([batch.column(key), _as_parts(base), _as_parts(weak)], names=schema.names)

    rows = df.select(F.col(f"`{key}`"), whole_text(text).alias("text"))
    # Written once: the row numbers must not change between the two reads.
    rows = settle(map_slices(columns_of(rows, key, "text"), work, schema).withColumn("row", F.monotonically_increasing_id()))
    linked = link_parts(rows, window).groupBy("row").agg(F.collect_list("part").alias("found"))
    spans = F.array_sort(F.concat("base", F.coalesce("found", F.array().cast(T.ArrayType(_PART)))), _by_start)
    out = rows.filter(F.size("weak") > 0).join(linked, "row", "left").select(F.col(f"`{key}`"), "base", spans.alias("spans"))
    return out.unionByName(rows.filter(F.size("weak") == 0).select(F.col(f"`{key}`"), "base", F.col("base").alias("spans")))


def _by_start(a, b):
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    left = F.struct(a["start"].alias("s"), rank[a["kind"]].alias("k"), a["end"].alias("e"))
    right = F.struct(b["start"].alias("s"), rank[b["kind"]].alias("k"), b["end"].alias("e"))
    return F.when(left < right, -1).when(left > right, 1).otherwise(0)


def link_parts(rows: DataFrame, window: int) -> DataFrame:
    """``row`` and ``part`` of the weak parts whose complements lie within ``window``."""
    parts = (rows.filter(F.size("weak") > 0).select("row", F.explode(F.concat("base", "weak")).alias("part")))
    role = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    first, last = F.floor(F.col("part.start") / window), F.floor((F.col("part.end") - 1) / window)
    marks = (parts.withColumn("role", role[F.col("part.kind")]).withColumn("bucket", F.explode(F.sequence(first, last)))
             .withColumn("s", F.greatest(F.col("part.start"), F.col("bucket") * window))
             .withColumn("e", F.least(F.col("part.end"), (F.col("bucket") + 1) * window))
             .groupBy("row", "role", "bucket").agg(F.min("s").alias("s"), F.max("e").alias("e")))
    scope = (rows.filter(F.size("weak") > 0).select("row", F.explode("weak").alias("part"))
             .withColumn("low", F.col("part.start") - window).withColumn("high", F.col("part.end") + window)
             .withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / window), F.floor((F.col("high") - 1) / window)))))
    met = scope.join(marks, ["row", "bucket"]).filter("s < high and e > low")
    near = met.groupBy("row", "part").agg(*[F.max(F.col("role") == r).alias(r) for r in sorted(set(ROLES.values()))])
    wanted = F.lit(False)
    for kind, roles in NEEDS.items():
        all_near = F.lit(True)
        for r in roles:
            all_near = all_near & F.col(r)
        wanted = wanted | ((F.col("part.kind") == kind) & all_near)
    return near.filter(wanted).select("row", "part")
