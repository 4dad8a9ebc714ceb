"""Token counts without ids (operator 5).

Three steps, two shuffles:

1. The tasks of the scan cut texts into pre-tokens.  A block of texts (bounded
   by characters) keeps one dictionary of its distinct pre-tokens; each text
   keeps (slot in the dictionary, frequency) pairs, packed into bytes.
2. Dictionary rows are dealt out by pre-token and sorted, so that equal
   pre-tokens of all blocks are neighbours; the pieces of each are counted once.
3. The counts return to their blocks and meet the frequencies; each text's
   count is a sum of products.

A frequent pre-token has at most one row a block, whatever its frequency.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settle
from .segmenttree import MergeTable
from .text import WHITE, per_slice, special_splitter, whole_text

#: Bytes of text that share a dictionary.
BLOCK_BYTES = 32_000_000
#: Bits of a block's number within its partition.
NUMBER_BITS = 11
#: Bits of a slot: a block has fewer bytes, but a single text may be longer.
SLOT_BITS = 32
#: Rows of sorted pre-tokens between two outputs of packed counts.
HELD_COUNTS = 200_000
# Fixed value: how byte-level vocabularies of this family split text.
SPLIT = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+"
         rf"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def pack(slots: np.ndarray, counts: np.ndarray) -> bytes:
    """Slots in rising order as gaps, with their counts, in as few bytes as they need."""
    order = np.argsort(slots, kind="stable")
    gaps = np.diff(slots[order], prepend=0)
    counts = counts[order]
    most = max(int(gaps.max(initial=0)), int(counts.max(initial=0)))
    kind = 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    whole = np.concatenate([gaps, counts]).astype(f"<u{kind}")
    return bytes([kind]) + zlib.compress(whole.tobytes(), 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    whole = np.frombuffer(zlib.decompress(data[1:]), f"<u{data[0]}").astype(np.int64)
    half = len(whole) // 2
    return np.cumsum(whole[:half]), whole[half:]


_BLOCK_SCHEMA = "block long, doc_key long, n_bytes long, n_special long, packed binary, start int, pieces array<string>"
_BLOCK_ARROW = pa.schema([("block", pa.int64()), ("doc_key", pa.int64()), ("n_bytes", pa.int64()),
                          ("n_special", pa.int64()), ("packed", pa.binary()), ("start", pa.int32()),
                          ("pieces", pa.list_(pa.string()))])


def _rows(block: int, **cols: list) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    cols["block"] = [block] * n
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in _BLOCK_ARROW],
        schema=_BLOCK_ARROW)


def _blocks(special: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, cut = regex.compile(SPLIT), special_splitter(special)
    part = TaskContext.get().partitionId()
    numbers = itertools.count()

    def numbered() -> int:
        n = next(numbers)
        if n >> NUMBER_BITS:
            raise ValueError(f"more than {1 << NUMBER_BITS} blocks of texts in a partition; deal the input out to more partitions")
        return part << NUMBER_BITS | n

    block, held, slots = numbered(), 0, {}

    def words() -> Iterator[pa.RecordBatch]:
        names = list(slots)
        for s in range(0, len(names), 5_000):
            yield _rows(block, start=[s], pieces=[names[s:s + 5_000]])

    for batch in per_slice(batches):
        docs: dict[str, list] = {"doc_key": batch.column("doc_key").to_pylist(),
                                 "n_bytes": [], "n_special": [], "packed": []}
        for text in batch.column("text").to_pylist():
            parts = cut.split(text) if cut and cut.search(text) else [text]
            freq: Counter = Counter()
            for p in parts[::2]:
                freq.update(split.findall(p))
            at = [slots.setdefault(p, len(slots)) for p in freq]
            docs["packed"].append(pack(np.array(at, np.int64), np.fromiter(freq.values(), np.int64, len(freq))))
            docs["n_bytes"].append(len(text.encode()))
            docs["n_special"].append(len(parts) // 2)
        yield _rows(block, **docs)
        held += sum(docs["n_bytes"])
        if held > BLOCK_BYTES:
            yield from words()
            block, held, slots = numbered(), 0, {}
    yield from words()


def _count_runs(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of sorted pre-tokens: one count for each run of equal ones.

    The counts leave packed, one row a block and ``HELD_COUNTS`` rows read.
    """
    table = MergeTable(path)
    last, last_n, held, rows = None, 0, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(batch.column("piece"), run_end_type=pa.int64())
        values = runs.values.to_pylist()
        known = values[0] == last
        n = np.empty(len(values), np.int64)
        if known:
            n[0] = last_n
        n[known:] = table.count([v.encode() for v in values[known:]])
        last, last_n = values[-1], int(n[-1])
        each = np.repeat(n, np.diff(runs.run_ends.to_numpy(), prepend=0))
        held.append((batch.column("place").to_numpy(), each))
        rows += batch.num_rows
        if rows >= HELD_COUNTS:
            yield _by_block(held)
            held, rows = [], 0
    if held:
        yield _by_block(held)


def _by_block(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    place, n = (np.concatenate([h[i] for h in held]) for i in (0, 1))
    order = np.argsort(place)
    block, slot, n = place[order] >> SLOT_BITS, place[order] & ((1 << SLOT_BITS) - 1), n[order]
    names, first = np.unique(block, return_index=True)
    cuts = np.append(first, len(block))
    packed = [pack(slot[a:b], n[a:b]) for a, b in zip(cuts, cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(packed, pa.binary())], names=["block", "counts"])


def _sum_block(docs: pa.Table, counts: pa.Table) -> pa.Table:
    parts = [unpack(p) for p in counts["counts"].to_pylist()]
    n = np.zeros(1 + max((int(s[-1]) for s, _ in parts), default=0), np.int64)
    for slots, pieces in parts:
        n[slots] = pieces
    total = []
    for packed, special in zip(docs["packed"].to_pylist(), docs["n_special"].to_pylist()):
        slots, freq = unpack(packed)
        total.append(int((n[slots] * freq).sum()) + special)
    return pa.table({"doc_key": docs["doc_key"], "n_bytes": docs["n_bytes"], "n_tokens": pa.array(total, pa.int64())})


def token_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every whole text.

    Counts are those of the tokenizers library for the byte-level vocabulary in
    ``path``; special strings inside a text are one token each.  ``key`` is an
    integer column.

    Null text counts as empty: 0 bytes, 0 tokens.  A null key stays null;
    repeated rows each give a row.  Texts of any length are counted whole.  An
    empty table gives no rows.  Other columns are ignored.  A partition of more than
    2,048 blocks (some 64 GB of text) raises an error.
    """
    special = list(MergeTable(path).special)
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_key"), whole_text(text).alias("text"))
    cut = settle(rows.mapInArrow(lambda it: _blocks(special, it), _BLOCK_SCHEMA))
    # One number says where a pre-token came from: its block, and its slot there.
    place = F.shiftleft("block", SLOT_BITS) + F.col("start") + F.col("pos")
    words = (cut.filter("pieces is not null").select("block", "start", F.posexplode("pieces").alias("pos", "piece"))
             .select("piece", place.alias("place")).repartition("piece").sortWithinPartitions("piece"))
    counts = words.mapInArrow(lambda it: _count_runs(path, it), "block long, counts binary")
    docs = cut.filter("packed is not null").select("block", "doc_key", "n_bytes", "n_special", "packed")
    out = docs.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(
        _sum_block, "doc_key long, n_bytes long, n_tokens long")
    return out.withColumnRenamed("doc_key", key)
