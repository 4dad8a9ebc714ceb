"""Benchmark decontamination by a suffix automaton of the test items (operator 11).

Test items are normalised to words and made into one generalised suffix
automaton (``suffixes``), which every task builds for itself from a broadcast
block of items.  Tasks stream the words of training texts through it and keep
the longest matching length after each word; a length of ``width`` or more, or a
whole shorter item, is a hit.  Nothing is shuffled.

Most words of a text can't be part of a match.  Adjacent words that no item has
side by side end every match between them, so only runs of words between such
places are streamed, and only if they are long enough for a window.  The test
for neighbours is a hashed bitmap: a false yes costs time, never a result.

A block of items is at most ``BLOCK_BYTES`` of words (or one item).  A larger
benchmark is read block by block, each against all texts; the spans of a text
are then united.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import settle
from .suffixes import Windows
from .text import map_slices, whole_text

#: Consecutive item words that make a window.
WIDTH = 10
#: Bytes of item words in one automaton, which takes some fifty times as much in each worker.
BLOCK_BYTES = 2_000_000
#: Bits of the hashed bitmap of neighbouring words.
PAIR_BITS = 22

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Per byte of UTF-8: a word character, lower-cased, or a blank.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Normalised words of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class Matcher:
    """The automaton of a block of items, and what tells quickly where nothing can match."""

    def __init__(self, items: list[tuple[str | None, str]], width: int) -> None:
        texts = [t.encode().split() for _, t in items]
        self.names = [name for name, _ in items]
        self.ids: dict[bytes, int] = {}
        numbers = [[self.ids.setdefault(w, len(self.ids)) for w in t] for t in texts]
        self.windows = Windows(numbers, width)
        self.least = min((min(len(t), width) for t in numbers if t), default=0)
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for t in numbers:
            self.pairs[self._place(np.array(t[:-1], np.int64), np.array(t[1:], np.int64))] = True

    def _place(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        mixed = (left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def runs(self, numbers: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of word numbers (-1: unknown) that may hold a match, ends exclusive."""
        if not self.least or not len(numbers):
            return
        known = numbers >= 0
        joined = known[:-1] & known[1:]
        at = np.flatnonzero(joined)
        joined[at] = self.pairs[self._place(numbers[at], numbers[at + 1])]
        # A run begins at a known word that the word before it is not joined to.
        first = np.flatnonzero(known & ~np.concatenate(([False], joined)))
        last = np.flatnonzero(known & ~np.concatenate((joined, [False])))
        long = last - first + 1 >= self.least
        yield from zip(first[long].tolist(), (last[long] + 1).tolist())

    def find(self, texts: list[str]) -> tuple[list[int], dict[int, tuple[list[tuple[int, int]], set[int]]]]:
        """Words of each text; spans of hit words and items of the texts that have any."""
        n, every = [], []
        get = self.ids.get
        for t in texts:
            words = words_of(t)
            every += [get(w, -1) for w in words]
            every.append(-1)
            n.append(len(words))
        starts = np.concatenate(([0], np.cumsum(np.array(n, np.int64) + 1)))
        numbers = np.array(every, np.int64)
        found: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
        for a, b in self.runs(numbers):
            spans, items = self.windows.hits(numbers[a:b].tolist())
            if spans:
                doc = int(np.searchsorted(starts, a, "right")) - 1
                of = found.setdefault(doc, ([], set()))
                of[0].extend((a + x - int(starts[doc]), a + y - int(starts[doc])) for x, y in spans)
                of[1].update(items)
        return n, found


@lru_cache(maxsize=1)
def _matcher(block: tuple[tuple[str | None, str], ...], width: int) -> Matcher:
    """One automaton a worker process; a worker's next task finds it made."""
    return Matcher(list(block), width)


_SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("first", "last", "start", "end")])
_ARROW_SPANS = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")]))


def _with_places(text: str, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Spans of words with their code points, end exclusive."""
    ends = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    return [{"first": a, "last": b, "start": ends[a][0], "end": ends[b - 1][1]} for a, b in spans]


def _scan(df: DataFrame, block: tuple[tuple[str | None, str], ...], width: int) -> DataFrame:
    """``carried``, ``n_words``, ``spans`` and ``items`` of each row for one block of items."""
    items = df.sparkSession.sparkContext.broadcast(block)
    schema = T.StructType([df.schema["carried"], T.StructField("n_words", T.LongType()),
                           T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("items", T.ArrayType(T.StringType()))])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        matcher = _matcher(items.value, width)
        texts = batch.column("text").to_pylist()
        n, found = matcher.find(texts)
        spans = [_with_places(t, found[i][0]) if i in found else [] for i, t in enumerate(texts)]
        names = [list({matcher.names[x] for x in found[i][1]}) if i in found else [] for i in range(len(texts))]
        return pa.RecordBatch.from_arrays(
            [batch.column("carried"), pa.array(n, pa.int64()), pa.array(spans, _ARROW_SPANS), pa.array(names, pa.list_(pa.string()))],
            names=schema.names)

    return map_slices(df, work, schema)


def _normalised(items: DataFrame, key: str, text: str) -> DataFrame:
    """``item`` and its ``words`` joined by blanks; equal rows and rows without words are left out."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [b" ".join(words_of(t)).decode("utf-8", "replace") for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("item"), pa.array(words, pa.string())], names=["item", "words"])

    rows = items.select(F.col(f"`{key}`").cast("string").alias("item"), whole_text(text).alias("text"))
    return settle(map_slices(rows, work, "item string, words string").filter("words != ''").distinct())


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite the spans that several blocks have found in a text."""
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            merged: list[dict[str, int]] = []
            for s in sorted(spans, key=lambda s: (s["first"], s["last"])):
                if merged and merged[-1]["last"] >= s["first"]:
                    if s["last"] > merged[-1]["last"]:
                        merged[-1] |= {"last": s["last"], "end": s["end"]}
                else:
                    merged.append(dict(s))
            out.append(merged)
        yield batch.set_column(batch.schema.get_field_index("spans"), "spans", pa.array(out, _ARROW_SPANS))


def _overlaps(rows: DataFrame, items: DataFrame, width: int, block_bytes: int) -> DataFrame:
    """``carried``, ``n_words``, ``spans`` and ``items`` of rows with ``carried`` and ``text``."""
    total = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    if count > 1:
        # Written once: a row's number must be the same in every pass.
        number = F.monotonically_increasing_id()
        rows = settle(rows.select(F.struct(number.alias("row"), F.col("carried").alias("key")).alias("carried"), "text"))
    passes = []
    for i in range(count):
        part = items if count == 1 else items.filter(F.pmod(F.xxhash64("item", "words"), F.lit(count)) == i)
        block = tuple(sorted(((r.item, r.words) for r in part.toLocalIterator()), key=lambda r: (r[0] is not None, r)))
        found = _scan(rows, block, width)
        passes.append(settle(found if i == 0 else found.filter(F.size("spans") > 0)) if count > 1 else found)
    if count == 1:
        return passes[0].withColumn("items", F.array_sort("items"))
    every = passes[0]
    for found in passes[1:]:
        every = every.unionByName(found)
    every = every.groupBy(F.col("carried.row").alias("row")).agg(
        F.first("carried.key").alias("carried"), F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    every = every.drop("row")
    return every.mapInArrow(_merge, every.schema)


def find_overlaps(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Where texts repeat test items.

    Returns one row per row of ``df``: the key, ``n_words``, ``spans`` (hit
    stretches of words, in order and apart: ``first`` and ``last`` word, end
    exclusive, and their code points ``start`` and ``end``) and ``items`` (the
    ids, as strings, of the items that have a window in the text, sorted).

    A window is ``width`` consecutive words of an item, or all of an item that
    has fewer.  Words are runs of digits, letters and anything beyond ASCII, with
    A-Z lower-cased.  Null text has no words; an item without words matches
    nothing.  Items that share an id count as one; a null id stays null in
    ``items``.  A null key stays null; repeated rows each give a row.  Texts of
    any length are read whole.  An empty table gives no rows; without items,
    nothing is hit.  Other columns are ignored.
    """
    rows = df.select(F.col(f"`{key}`").alias("carried"), whole_text(text).alias("text"))
    return _overlaps(rows, _normalised(items, item_key, item_text), width, block_bytes).withColumnRenamed("carried", key)


def hit_words() -> Column:
    """Words inside the spans of a row of ``find_overlaps``."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])


def without_overlaps(df: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
                     width: int = WIDTH, max_words: int = 0, max_coverage: float = 1.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` with spans of test items cut out of its texts.

    A span goes if it has more than ``max_words`` words, or if more than the
    share ``max_coverage`` of the text's words is hit.  Rows, their other columns
    and texts without such spans stay as they are (null stays null).  Nulls,
    empty tables and words are as in ``find_overlaps``.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("carried"), whole_text(text).alias("text"))
    found = _overlaps(rows, _normalised(items, item_key, item_text), width, block_bytes)
    whole = F.col("carried").getField(text)
    cut = F.filter("spans", lambda s: (s["last"] - s["first"] > max_words) | (hit_words() > max_coverage * F.col("n_words")))
    start = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at"))
    rest = F.aggregate(
        cut, start,
        lambda a, s: F.struct(F.concat(a["kept"], F.substring(whole, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))).alias("kept"),
                              s["end"].alias("at")),
        lambda a: F.concat(a["kept"], F.substring(whole, (a["at"] + 1).cast("int"), F.length(whole))))
    return found.select(*[(F.when(F.size(cut) > 0, rest).otherwise(whole) if c == text else F.col("carried").getField(c)).alias(c)
                          for c in df.columns])
