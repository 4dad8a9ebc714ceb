"""Personal data in texts (operator 1).

Regular expressions propose spans, checksums confirm them (Luhn for cards,
mod 97 for IBANs), and words nearby adjust a score.  Contract kinds stay whatever
their score; the other kinds need ``THRESHOLD``.  Whole texts are read in the
tasks that scan them; nothing is shuffled.  Every pattern is written so that its
time is linear in the text.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import columns_of, map_slices, whole_text

#: Contract kinds, in the order that breaks ties, then the others.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
THRESHOLD = 0.5
#: Characters before and after a span in which context words count.
BEFORE, AFTER = 48, 24

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A greedy run of digits always starts where it can, so a look-behind changes no match and bars rescans.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_IBAN_TOKEN = re.compile(r" ?([A-Z0-9]++)(?![a-z])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# Characters of an IBAN by country (the SWIFT registry), and the bounds for other codes.
IBAN_SIZES = {k: n for n, codes in (
    (15, "NO"), (16, "BE"), (18, "DK FI FK FO GL NL SD"), (19, "MK SI"), (20, "AT BA EE KZ LT LU MN XK"),
    (21, "CH HR LI LV"), (22, "BG BH CR DE GB GE IE ME RS VA"), (23, "AE GI IL IQ OM SO TL"),
    (24, "AD CZ ES MD PK RO SA SE SK TN VG"), (25, "LY PT ST"), (26, "IS TR"), (27, "BI DJ FR GR IT MC MR SM"),
    (28, "AL AZ BY CY DO GT HN HU LB NI PL SV"), (29, "BR EG PS QA UA"), (30, "JO KW MU YE"), (31, "MT SC"),
    (32, "LC"), (33, "RU")) for k in codes.split()}
IBAN_LEAST, IBAN_MOST = 15, 34

# Words that make a kind likelier, and the score of a span without and with them.
CONTEXT = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse", "servidor"),
    "card": ("card", "visa", "karte", "carte", "tarjeta", "kredit", "credit"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "handy", "llamar"),
    "iban": ("iban", "bank", "konto", "account", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "insurance", "taxpayer"),
}
SCORES = {"email": (0.9, 1.0), "ip": (0.6, 0.9), "card": (0.8, 1.0), "phone": (0.6, 0.9), "iban": (0.8, 1.0),
          "ssn": (0.3, 0.8)}
_CONTEXT = {k: re.compile(r"(?<![^\W\d_])(?:" + "|".join(v) + r")", re.IGNORECASE) for k, v in CONTEXT.items()}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _emails(text: str) -> list[tuple[int, int]]:
    """From each ``@`` with a domain, the name before it back to the last match."""
    out, last = [], 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            out.append((start, m.end()))
            last = m.end()
    return out


def _ibans(text: str) -> list[tuple[int, int]]:
    """From each head to the token border that the country's size or else, longest first, mod 97 confirms."""
    out, head = [], _IBAN_HEAD.search(text)
    while head:
        start = head.start()
        size = IBAN_SIZES.get(text[start:start + 2])
        most, code, ends, at = size or IBAN_MOST, head[0], [], head.end()
        while (token := _IBAN_TOKEN.match(text, at)) and len(code) + len(token[1]) <= most:
            code, at = code + token[1], token.end()
            if len(code) >= (size or IBAN_LEAST):
                ends.append((at, code))
        end = next((e for e, c in reversed(ends) if mod97(c)), None)
        if end:
            out.append((start, end))
        head = _IBAN_HEAD.search(text, end or head.end())
    return out


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Spans whose checks hold, before any score."""
    out = [("email", *s) for s in _emails(text)]
    for m in _IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    out += [("iban", *s) for s in _ibans(text)]
    out += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text)]
    return out


def spans(text: str) -> list[Span]:
    """Scored spans by start, then kind in the order of ``KINDS``."""
    out = []
    for kind, start, end in proposals(text):
        near = _CONTEXT[kind].search(text[max(0, start - BEFORE):start]) or _CONTEXT[kind].search(text[end:end + AFTER])
        score = SCORES[kind][1 if near else 0]
        if kind in BASE or score >= THRESHOLD:
            out.append(Span(kind, start, end, score))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_pii(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``spans`` (kind, start, end, score) of every row.

    Offsets are code points, the end is exclusive; spans of different kinds may
    overlap.  Null text counts as empty and has no spans (an empty array); a
    null key stays null; repeated rows each give a row.  Texts of any length are
    read whole.  An empty table gives no rows.  Other columns are ignored.
    """
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("spans", SPANS)])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[s._asdict() for s in spans(t)] for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, _ARROW_SPANS)], names=[key, "spans"])

    rows = df.select(F.col(f"`{key}`"), whole_text(text).alias("text"))
    return map_slices(columns_of(rows, key, "text"), work, schema)


def count_kind(kind: str, column: str = "spans") -> Column:
    return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long")


def as_text(column: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def only(kinds: tuple[str, ...], column: str = "spans") -> Column:
    return F.filter(column, lambda s: s["kind"].isin(*kinds))
