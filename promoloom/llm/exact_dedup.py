"""Exact deduplication with a heavy-hitter split (operator 7).

``freqItems`` is Misra and Gries' counter scheme (in the form of Karp, Shenker
and Papadimitriou): it returns every digest of more than ``support`` of the
rows, and perhaps others.  One more pass counts these candidates exactly; the
frequent ones, at most ``1 / support`` rows, are broadcast with their winners,
so their rows are settled where they are read and never meet in one task.  All
other digests are grouped by an ordinary shuffle; each is at most ``support`` of
the rows.  Everything runs as DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import settle
from .text import fresh, keep_keys, whole_text

#: Share of all rows above which a digest is settled by broadcast; bounds that table to 1 / SUPPORT rows.
SUPPORT = 0.001


def normalised(text: str = "text") -> Column:
    """Whole text with every run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(whole_text(text), r"[\x20\x09-\x0D]+", " ")


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """``key``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of every row.

    Rows are equal when their normalised texts are; of equal rows the smallest
    ``key`` stays.  Null text equals empty text.  A null key sorts last: it is
    dropped if its group has another key, and a group of null keys alone keeps
    them all with a null ``keep_id``.  Rows that repeat a key are equal rows of
    the group, and those with the smallest key are all kept.  An empty table
    gives no rows.  Other columns are ignored.
    """
    rows = settle(df.select(F.col(f"`{key}`").alias("row_key"),
                            F.sha2(F.encode(normalised(text), "UTF-8"), 256).alias("digest")))
    found = rows.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    candidates = [r.digest for r in found.collect()]
    hot = rows.sparkSession.createDataFrame([(d,) for d in candidates], T.StructType([rows.schema["digest"]]))
    winners = (rows.join(F.broadcast(hot), "digest", "left_semi").groupBy("digest")
               .agg(F.min("row_key").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    verified = winners.collect()
    heavy = rows.sparkSession.createDataFrame(
        [tuple(r) for r in verified], T.StructType([rows.schema["digest"], T.StructField("keep_id", rows.schema["row_key"].dataType),
                                                    T.StructField("group_size", T.LongType())]))
    settled = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    firsts = rest.groupBy("digest").agg(F.min("row_key").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    out = settled.unionByName(rest.join(firsts, "digest"))
    return out.select(F.col("row_key").alias(key), "keep_id", "group_size",
                      F.col("row_key").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.col("digest").alias("text_sha256"))


def drop_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``df`` for each group of equal texts, all columns.

    Rows that repeat a key (or have none) are told apart by their texts: those
    of one text are one row.  Of rows that repeat a key with several texts, all texts stay if
    one of them does.  Nulls, empty tables and other columns are as in ``exact_groups``.
    """
    stays = settle(exact_groups(df, key, text).filter("kept").groupBy(F.col(f"`{key}`").alias("stays")).agg(F.count(F.lit(1)).alias("n")))
    once, again = (stays.filter(c).select("stays") for c in ("n = 1", "n > 1"))
    rows = keep_keys(df, once, key)
    if again.isEmpty():
        return rows
    mark = fresh(df, "_digest")
    told = keep_keys(df, again, key).withColumn(mark, F.sha2(F.encode(normalised(text), "UTF-8"), 256))
    return rows.unionByName(told.dropDuplicates([key, mark]).drop(mark))
