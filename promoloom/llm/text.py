"""Small text helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters with the Unicode property White_Space.
WHITE = r"\t-\r \x85\xA0  -     　"
WORD = r"[^\x20\x09-\x0D]+"
_SLICE_CHARS = 4_000_000


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns can't clash with computed ones."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keep_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is in the one column of ``keys``; null matches null.

    Keys are as many as rows, so that the plan for many is taken at any size.
    """
    name = fresh(df, "_kept")
    kept = keys.toDF(name).distinct().hint("merge")
    return df.join(kept, F.col(f"`{key}`").eqNullSafe(F.col(f"`{name}`")), "left_semi")


def whole_text(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def per_slice(batches: Iterator[pa.RecordBatch], limit: int = _SLICE_CHARS
              ) -> Iterator[pa.RecordBatch]:
    """Cut batches with a ``text`` column into slices of about ``limit`` bytes of text.

    No row is cut: a single text beyond the limit is a slice of its own.
    """
    for batch in batches:
        col = batch.column(batch.schema.get_field_index("text"))
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def map_slices(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
               ) -> DataFrame:
    """``work`` on slices of text, batch by batch inside the tasks of the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in per_slice(batches):
            yield work(part)

    return df.mapInArrow(run, schema)


def special_splitter(tokens: list[str]) -> regex.Pattern | None:
    """Pattern that finds special strings in raw text, the longest first."""
    if not tokens:
        return None
    return regex.compile("(" + "|".join(regex.escape(t) for t in sorted(tokens, key=len, reverse=True)) + ")")
