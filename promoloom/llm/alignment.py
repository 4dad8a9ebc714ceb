"""Alignment of two tokenizers over the same bytes (operator 13).

Both token sequences of a text tile the same bytes.  The intervals of both are
sorted by start, the running maximum of their ends is taken, and a group breaks
where a start reaches it: there tokens of both end.  Within a group every token
of one is linked with every token of the other.  All texts of a slice are laid
one behind the other, so that one pass aligns them all.

What a text is worth depends on how many documents link a pair of ids.  A block
of texts keeps one list of its distinct pairs with their document counts; each
text keeps (slot in the list, links) packed.  Only the lists are shuffled: a pair
has at most one row a block, however often its tokens meet.  The corpus-wide
counts return to the blocks by the same numbers.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..storage import settle
from .segmenttree import byte_characters
from .text import per_slice, whole_text
from .token_counts import pack, unpack

# Fixed value: how byte-level vocabularies of this family split text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pairs of a text, summed over the texts that share a list.
BLOCK_PAIRS = 2_000_000
#: Bytes of text that are aligned at once.
SLICE_BYTES = 1_000_000
#: Links of a group that are laid out one by one; larger groups are linked id by id.
LAID_OUT = 4_096
#: Bits for the block number within a partition.
NUMBER_BITS = 24


def coalesce(starts: np.ndarray, ends: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Group number of every interval; groups break where a start reaches all ends before it."""
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.empty(len(order), bool)
    breaks[:1] = True
    breaks[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    return group


class Side:
    """One tokenizer: ids of texts, bytes of ids, and ids as written in a group."""

    def __init__(self, pieces: list[bytes], within: str, behind: str) -> None:
        self.pieces = pieces
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.written = np.array([f"{i}{mark}" for mark in (within, behind) for i in range(len(pieces))], "S")


def _is_latin(text: str) -> bool:
    """All characters below U+0100, whose classes no version of Unicode has changed."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _quick_encoding(path: str) -> tiktoken.Encoding | None:
    """The vocabulary for a second, faster encoder of the same splitting rule; None if its ids are not its merges' order.

    The two may class characters differently that are new to Unicode; below U+0100 they can't.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    special = {t["content"] for t in spec["added_tokens"]}
    byte = {c: b for b, c in enumerate(byte_characters())}
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
    plain = {t: i for t, i in vocab.items() if t not in special}
    if made != list(range(256, 256 + len(made))) or len(plain) != 256 + len(made) or any(c not in byte for t in plain for c in t):
        return None
    ranks = {bytes(byte[c] for c in t): i for t, i in plain.items()}
    return tiktoken.Encoding("alignment", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class Tokenizers:
    """Byte-level BPE of space and text, and sentence pieces of the text."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.first = Tokenizer.from_file(path_a)
        self.first.encode_special_tokens = True  # their strings in a text are plain text
        self.first.no_truncation()
        self.first.no_padding()
        self.quick = _quick_encoding(path_a)
        self.second = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {c: b for b, c in enumerate(byte_characters())}
        known = {i: t for t, i in self.first.get_vocab(with_added_tokens=True).items()}
        entries = [known.get(i, "") for i in range(max(known) + 1)]
        self.a = Side([bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in entries], ",", "|")
        model = self.second
        self.b = Side([bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
                       for i, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))], ",", ";")

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none where the bytes of either differ from space and text."""
        a = self._first_ids([" " + t for t in texts])
        b = self.second.encode(texts, num_threads=1)
        piece_a, piece_b = self.a.pieces.__getitem__, self.b.pieces.__getitem__
        for i, t in enumerate(texts):
            want = b" " + t.encode("utf-8", "surrogatepass")
            if not t or b"".join(map(piece_b, b[i])) != want or b"".join(map(piece_a, a[i])) != want:
                a[i], b[i] = [], []
        return a, b

    def _first_ids(self, texts: list[str]) -> list[list[int]]:
        quick = [self.quick is not None and _is_latin(t) for t in texts]
        rest = iter(self.first.encode_batch_fast([t for t, q in zip(texts, quick) if not q], add_special_tokens=False))
        return [self.quick.encode_ordinary(t) if q else next(rest).ids for t, q in zip(texts, quick)]


@lru_cache(maxsize=1)
def _tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """Loaded once a worker process."""
    return Tokenizers(path_a, path_b)


class Aligned:
    """Groups and links of a slice of texts."""

    def __init__(self, ids_a: list[list[int]], ids_b: list[list[int]], a: Side, b: Side) -> None:
        self.sides, docs = (a, b), len(ids_a)
        self.n = [np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b)]
        self.ids = [np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in zip((ids_a, ids_b), self.n)]
        ends = [np.cumsum(s.size[i]) for s, i in zip(self.sides, self.ids)]
        starts = [e - s.size[i] for e, s, i in zip(ends, self.sides, self.ids)]
        cut = len(self.ids[0])
        group = coalesce(np.concatenate(starts), np.concatenate(ends), np.repeat([0, 1], [cut, len(self.ids[1])]))
        self.group = [group[:cut], group[cut:]]
        groups = int(group.max(initial=-1)) + 1
        self.per_group = [np.bincount(g, minlength=groups) for g in self.group]
        self.links = self.per_group[0] * self.per_group[1]
        # Both sides of a text end together, so that no group has tokens of two texts.
        self.doc = np.zeros(groups, np.int64)
        self.doc[self.group[0]] = np.repeat(np.arange(docs), self.n[0])
        self.n_groups = np.bincount(self.doc, minlength=docs)
        self.n_links = np.bincount(self.doc, self.links, minlength=docs).astype(np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, pair code and links of each distinct pair of each text, sorted."""
        (ids_a, ids_b), (group_a, group_b), (n_a, n_b) = self.ids, self.group, self.per_group
        width_b = len(self.sides[1].pieces)
        codes = len(self.sides[0].pieces) * width_b
        small = self.links <= LAID_OUT
        at = np.flatnonzero(small[group_a])
        each = n_b[group_a[at]]
        within = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        to = np.repeat((np.cumsum(n_b) - n_b)[group_a[at]], each) + within
        left = np.repeat(self.doc[group_a[at]] * codes + ids_a[at] * width_b, each)
        keys, times = np.unique(left + ids_b[to], return_counts=True)
        large = []
        for g in np.flatnonzero(~small):
            a, n = np.unique(ids_a[slice(*np.searchsorted(group_a, [g, g + 1]))], return_counts=True)
            b, m = np.unique(ids_b[slice(*np.searchsorted(group_b, [g, g + 1]))], return_counts=True)
            large.append(((self.doc[g] * codes + a[:, None] * width_b + b).ravel(), (n[:, None] * m).ravel()))
        if large:
            every = np.concatenate([keys, *[k for k, _ in large]])
            keys, place = np.unique(every, return_inverse=True)
            times = np.bincount(place, np.concatenate([times, *[m for _, m in large]])).astype(np.int64)
        return keys // codes, keys % codes, times

    def written(self) -> list[bytes]:
        """The groups of each text, ``a1,a2|b1;a3|b2,b3``."""
        (ids_a, ids_b), (group_a, group_b), (n_a, n_b) = self.ids, self.group, self.per_group
        a, b = self.sides
        out = np.empty(len(ids_a) + len(ids_b), max(a.written.dtype, b.written.dtype, key=lambda t: t.itemsize))
        behind = [np.append(g[1:] != g[:-1], True)[:len(g)] for g in (group_a, group_b)]
        before_b = (np.cumsum(n_b) - n_b)[group_a] if len(group_a) else 0
        out[np.arange(len(ids_a)) + before_b] = a.written[ids_a + behind[0] * len(a.pieces)]
        out[np.arange(len(ids_b)) + (np.cumsum(n_a)[group_b] if len(group_b) else 0)] = b.written[ids_b + behind[1] * len(b.pieces)]
        borders = np.concatenate(([0], np.cumsum(self.n[0] + self.n[1])))
        return [out[i:j].tobytes().translate(None, b"\0")[:-1] for i, j in zip(borders, borders[1:])]


_BLOCK = pa.schema([("block", pa.int64()), ("doc_key", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                    ("n_links", pa.int64()), ("groups", pa.string()), ("packed", pa.binary()), ("start", pa.int64()),
                    ("pairs", pa.list_(pa.struct([("code", pa.int64()), ("docs", pa.int32())])))])
_BLOCK_SCHEMA = ("block long, doc_key long, n_a long, n_b long, n_groups long, n_links long, groups string, packed binary, start long, "
                 "pairs array<struct<code: long, docs: int>>")
#: Pairs of a list that travel in one row.
LIST_ROW = 10_000


def _blocks(path_a: str, path_b: str, digests: bool, block_pairs: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = _tokenizers(path_a, path_b)
    numbers, part_no = itertools.count(), TaskContext.get().partitionId()
    held: list[tuple[pa.Array, Aligned, list[str], np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def rows(**cols) -> pa.RecordBatch:
        n = len(next(iter(cols.values())))
        cols["block"] = np.full(n, block)
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in _BLOCK], schema=_BLOCK)

    for part in itertools.chain(per_slice(batches, SLICE_BYTES), [None]):
        if part is not None:
            found = Aligned(*both.encode(part.column("text").to_pylist()), both.a, both.b)
            groups = [(hashlib.sha256(w).hexdigest() if w else "") if digests else w.decode() for w in found.written()]
            doc, codes, links = found.pairs()
            facts = {"n_a": found.n[0], "n_b": found.n[1], "n_groups": found.n_groups, "n_links": found.n_links, "groups": groups}
            held.append((part.column("doc_key"), facts, doc, codes, links))
            size += len(codes)
        if held and (part is None or size >= block_pairs):
            n = next(numbers)
            if n >> NUMBER_BITS:
                raise ValueError(f"more than {1 << NUMBER_BITS} blocks of texts in a partition; deal the input out to more partitions")
            block = part_no << NUMBER_BITS | n
            codes, slots, docs = np.unique(np.concatenate([h[3] for h in held]), return_inverse=True, return_counts=True)
            at = 0
            for keys, facts, doc, own, links in held:
                borders = np.searchsorted(doc, np.arange(len(keys) + 1))
                own = slots[at:at + len(doc)]
                packed = [pack(own[i:j], links[i:j]) for i, j in zip(borders, borders[1:])]
                yield rows(doc_key=keys, packed=packed, **facts)
                at += len(doc)
            for i in range(0, len(codes), LIST_ROW):
                some = slice(i, i + LIST_ROW)
                pairs = pa.StructArray.from_arrays([pa.array(codes[some]), pa.array(docs[some].astype(np.int32))], ["code", "docs"])
                yield rows(start=[i], pairs=pa.ListArray.from_arrays([0, len(pairs)], pairs))
            held, size = [], 0


def _worth(texts: pa.Table, counts: pa.Table) -> pa.Table:
    """Links on best pairs and the sum of counts, for the texts of a block."""
    slots = counts["slot"].to_numpy()
    n, best = np.zeros(len(slots), np.int64), np.zeros(len(slots), bool)
    n[slots], best[slots] = counts["docs"].to_numpy(), counts["best"].to_numpy()
    n_best, count_sum = [], []
    for packed in texts["packed"].to_pylist():
        own, links = unpack(packed)
        n_best.append(int(links[best[own]].sum()))
        count_sum.append(int((links * n[own]).sum()))
    names = ["doc_key", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table({**{c: texts[c] for c in names}, "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()),
                     "groups": texts["groups"]})


def _cut(df: DataFrame, path_a: str, path_b: str, key: str, text: str, digests: bool, block_pairs: int) -> DataFrame:
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_key"), whole_text(text).alias("text"))
    return settle(rows.mapInArrow(lambda it: _blocks(path_a, path_b, digests, block_pairs, it), _BLOCK_SCHEMA))


def _counted(cut: DataFrame, width_b: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of every block, and corpus-wide: documents of each pair, and whether its first id has no more frequent one."""
    listed = (cut.filter("pairs is not null").select("block", "start", F.posexplode("pairs").alias("pos", "pair"))
              .select("block", (F.col("start") + F.col("pos")).alias("slot"), F.col("pair.code").alias("code"), F.col("pair.docs").alias("n")))
    first = F.floor(F.col("code") / F.lit(width_b))
    # A first id has no more pairs than the second vocabulary has entries.
    total = (listed.groupBy("code").agg(F.sum("n").alias("docs"))
             .withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy(first))))
    return listed, total


def align(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", digests: bool = False,
          block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Align the tokens of a byte-level vocabulary and a sentence-piece model in every whole text.

    Returns one row per row of ``df``: the key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``
    (pairs of token occurrences in one group), ``n_best`` (links whose pair of ids
    is in as many documents as any pair of its first id), ``count_sum`` (documents of
    the pair, summed over links) and ``groups``, ``a1,a2|b1;a3|b2,b3`` in decimal ids,
    or their SHA-256 with ``digests``.  ``key`` is an integer column.

    Null and empty texts, and texts whose tokens do not spell space and text on
    both sides, have no tokens: zeros and empty ``groups``, unhashed.  A null key
    stays null; repeated rows each give a row and each count as a document.  Texts of any length are
    aligned whole.  An empty table gives no rows.  Other columns are ignored.
    """
    width_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    cut = _cut(df, path_a, path_b, key, text, digests, block_pairs)
    listed, total = _counted(cut, width_b)
    counts = listed.join(total, "code").select("block", "slot", "docs", "best")
    texts = cut.filter("packed is not null").select(F.col("block").alias("home"), "doc_key", "n_a", "n_b", "n_groups", "n_links", "groups",
                                                    "packed")
    out = texts.groupBy("home").cogroup(counts.groupBy("block")).applyInArrow(
        _worth, "doc_key long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
    return out.withColumnRenamed("doc_key", key)


def translation_table(df: DataFrame, path_a: str, path_b: str, text: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``a``, ``b``, ``docs`` and ``best`` of every pair of ids that some text links: what each token of one vocabulary is in the other.

    Texts are read as in ``align``; a table without tokens gives no rows.
    """
    width_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    rows = df.select(F.lit(0).alias("none"), F.col(f"`{text}`"))
    _, total = _counted(_cut(rows, path_a, path_b, "none", text, True, block_pairs), width_b)
    return total.select(F.floor(F.col("code") / F.lit(width_b)).cast("int").alias("a"), (F.col("code") % width_b).cast("int").alias("b"),
                        "docs", "best")
