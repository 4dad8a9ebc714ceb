"""Mixing sources to target weights by a low-discrepancy schedule (operator 10).

1. Each source's target is its weight's share of all words, at most
   ``MAX_REPEATS`` times its own size; the excess is shared again.
2. The texts of a source, in an order given by a hash, are laid end to end and
   cut into blocks of equal words.
3. Slot ``i`` of the schedule has the point ``frac(i * golden ratio)``; mapped
   through the cumulative targets it names a source.  Slots are ranked per
   source, and rank ``r`` takes block ``r mod blocks``, so a source is read in
   its shuffled order and starts again when it is used up.
4. A source takes slots until its target is met; the last one is cut to fit.

Ranks and positions come from sums inside chunks of bounded size plus the
chunks' offsets, so no source, however large, is numbered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import global_rank, running_total
from ..storage import bounded, settle
from .text import fresh, whole_text

# Weights of the sources in order, repeating, and the most times a source may be read.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Words of a block.
BLOCK_WORDS = 1_000
#: Sources that are settled on the driver; more stay a table.
FEW_SOURCES = 10_000
#: Rows of a chunk that one task sums up.
CHUNK_ROWS = 4_000
_GOLDEN = (5 ** 0.5 - 1) / 2


def word_count(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, repeats: float = MAX_REPEATS) -> list[float]:
    """Words to take from each source.

    Sources share the sum of all sizes by weight; one that would pass
    ``repeats`` times its size stops there and the others share the excess by
    weight, until none is above.
    """
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    free, left = [i for i, n in enumerate(sizes) if n > 0], float(sum(sizes))
    while free:
        share = left / sum(weight[i] for i in free)
        full = [i for i in free if share * weight[i] > repeats * sizes[i]]
        if not full:
            for i in free:
                out[i] = share * weight[i]
            break
        for i in full:
            out[i] = float(repeats * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in full]
    return out


def source_plan(sums: DataFrame, weights: tuple[float, ...], repeats: float) -> DataFrame:
    """``source``, ``source_no``, ``source_size`` and ``target`` of every source, by code point, null last.

    ``sums`` has the size ``n`` of each ``source``.  Few sources are settled on the driver; beyond ``FEW_SOURCES`` they stay
    a table, of which each round of sharing the excess needs two sums.
    """
    rows = sums.limit(FEW_SOURCES + 1).collect()
    if len(rows) <= FEW_SOURCES:
        rows.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
        sizes = [int(r.n or 0) for r in rows]
        plan = [(r.source, i, n, t) for i, (r, n, t) in enumerate(zip(rows, sizes, targets(sizes, weights, repeats)))]
        return F.broadcast(sums.sparkSession.createDataFrame(plan, _PLAN))
    known = global_rank(sums, [F.col("source").isNull(), F.col("source")], name="source_no")
    number = F.col("source_no") - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights)).cast("int"))
    known = settle(known.select("source", number.alias("source_no"), F.coalesce("n", F.lit(0)).cast("long").alias("source_size"),
                                weight.alias("weight")))
    most = F.col("source_size") * float(repeats)
    live = known.filter("source_size > 0")
    total, share, before = live.agg(F.sum("source_size")).first()[0] or 0, 0.0, None
    # The share only grows, so a source that is full at one share is full at the next.
    while share != before:
        before, full = share, F.col("weight") * F.lit(share) > most
        r = live.agg(F.sum(F.when(full, most)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        share = (total - (r.held or 0.0)) / r.free if r.free else before
    return settle(known.select("source", "source_no", "source_size", F.least(F.col("weight") * F.lit(float(share)), most).alias("target")))


_PLAN = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_no", T.LongType()),
                      T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[float, ...] = WEIGHTS, repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS,
        seed: int = 0, with_source: bool = False) -> DataFrame:
    """``key``, ``size``, ``source_size``, ``target`` and ``taken`` of every row, ``with_source`` also ``mix_source``.

    ``taken`` counts the words that the mix takes from the row, repeats
    included; it never passes ``repeats`` times ``size``, and a source's sum is
    its target to within a word.  The result depends on the rows alone: reruns
    agree, in any partitioning.

    Null text has size 0; rows of size 0 take nothing.  A null source is a
    source of its own, the last.  A null or repeated key is a row like others
    (rows that agree in key, source and text are interchangeable).  An empty
    table gives no rows.  Other columns are ignored.
    """
    spark = df.sparkSession
    sized = df.select(F.col(f"`{key}`").alias("row_key"), F.col(f"`{source}`").cast("string").alias("source"),
                      word_count(text).alias("size"))
    sized = settle(sized.withColumn("mixed", F.xxhash64(F.lit(seed), "row_key", "size")))
    sources = source_plan(settle(sized.groupBy("source").agg(F.sum("size").alias("n"))), weights, repeats)
    rows = sized.withColumnRenamed("source", "named").join(sources, F.col("named").eqNullSafe(F.col("source"))).drop("source")

    # Where each text lies in its source, in words.
    count = sized.count()
    chunks = max(1, -(-count // CHUNK_ROWS))
    rows = rows.withColumn("chunk", F.pmod(F.col("mixed"), F.lit(chunks)))
    before = _offsets(rows.groupBy("source_no", "chunk").agg(F.sum("size").alias("held")))
    inside = W.partitionBy("source_no", "chunk").orderBy("mixed", "row_key").rowsBetween(W.unboundedPreceding, -1)
    placed = settle(rows.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
                    .join(before, ["source_no", "chunk"]).withColumn("start", F.col("start") + F.col("skip"))
                    .drop("skip", "mixed", "chunk"))

    # How often each block is taken.
    blocks = F.ceil(F.col("source_size") / block_words)
    # Each pass over a source ends in a short block.
    need = F.ceil(F.round("target") / block_words).cast("long") + repeats + 1
    slots = schedule(spark, sources, sources.filter("target > 0").select("source_no", need.alias("need")))
    turn = F.floor(F.col("rank") / blocks)
    used = (slots.withColumn("block", F.pmod("rank", blocks)).withColumn("start", turn * F.col("source_size") + F.col("block") * block_words)
            .withColumn("limit", F.round("target").cast("long"))
            .withColumn("cut", F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words,
                                       F.col("limit") - F.col("start")))
            .filter("cut > 0").groupBy("source_no", "block", "cut").agg(F.count(F.lit(1)).alias("times")))

    # A text meets the blocks it lies in.
    ends = F.col("start") + F.col("size")
    pieces = (placed.filter("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((ends - 1) / block_words)))))
    words = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), F.col("block") * block_words + F.col("cut"))
                       - F.greatest(F.col("start"), F.col("block") * block_words))
    met = (pieces.join(used, ["source_no", "block"])
           .groupBy("source_no", "start").agg(F.sum(words * F.col("times")).alias("taken")))
    # An interval that holds words starts at a place of its own, so it names its row.
    full = placed.filter("size > 0").join(met, ["source_no", "start"], "left")
    out = full.unionByName(placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))
    named = [F.col("named").alias("mix_source")] if with_source else []
    return out.select(F.col("row_key").alias(key), "size", "source_size", "target",
                      F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *named)


def _offsets(held: DataFrame) -> DataFrame:
    """``skip``: what the earlier chunks of the source hold."""
    earlier = W.partitionBy("source_no").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    return held.withColumn("skip", F.coalesce(F.sum("held").over(earlier), F.lit(0))).drop("held")


def schedule(spark, sources: DataFrame, needs: DataFrame) -> DataFrame:
    """Slots (``id``) with their source and their rank among its slots, from 0.

    ``needs`` has the slots (``need``) that each source (``source_no``) must get.  A source's share of the
    points is what it needs and a margin over the discrepancy of golden-ratio
    points, which in an interval is below ``3 + ln n`` points.
    """
    needs = needs.filter("need > 0")
    whole = needs.agg(F.count(F.lit(1)).alias("sources"), F.sum("need").alias("need")).first()
    total, count = whole.need or 0, whole.sources
    margin = int(6 + 2 * math.log(total + 2)) + count.bit_length()
    n = total + margin * count
    cells = max(16, 4 * count)
    width = needs.select("source_no", (F.col("need") + margin).cast("long").alias("width"))
    ends = (running_total(width, [F.asc("source_no")], [], "width", "high") if count > FEW_SOURCES
            else width.withColumn("high", F.sum("width").over(W.orderBy("source_no").rowsBetween(W.unboundedPreceding, 0))))
    at = lambda edge: F.floor(edge.cast("decimal(38,0)") * cells / F.lit(max(n, 1)).cast("decimal(20,0)")).cast("long")
    low, high = F.col("high") - F.col("width"), F.col("high")
    table = ends.select(F.explode(F.sequence(at(low), F.least(F.lit(cells - 1).cast("long"), at(high)))).alias("cell"), "source_no",
                        (low / n).alias("low"), F.when(high == n, 2.0).otherwise(high / n).alias("high"))
    table = bounded(table, 6 * FEW_SOURCES)
    slots = spark.range(n).withColumn("point", (F.col("id") * F.lit(_GOLDEN)) % 1.0)
    slots = (slots.withColumn("cell", F.least(F.floor(F.col("point") * cells), F.lit(cells - 1)).cast("long"))
             .join(table, "cell").filter("point >= low and point < high")
             .select("id", "source_no", F.floor(F.col("id") / CHUNK_ROWS).alias("chunk")))
    before = _offsets(slots.groupBy("source_no", "chunk").agg(F.count(F.lit(1)).alias("held")))
    inside = W.partitionBy("source_no", "chunk").orderBy("id")
    return (slots.withColumn("rank", F.row_number().over(inside) - 1).join(before, ["source_no", "chunk"])
            .select("source_no", (F.col("rank") + F.col("skip")).alias("rank"))
            .join(sources.select("source_no", "source_size", "target"), "source_no"))


def repeat_rows(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                **options) -> DataFrame:
    """The mix as rows of ``df``, all columns: each as many times as the mix takes it.

    Whole texts only: a text that the mix takes in part counts if at least half
    of it is taken.  Only the ends of each source's last block are such texts.
    Rows without words go.  Rows that agree in key, source and size share what
    the mix takes from them, in an order given by their texts.
    """
    names = [fresh(df, n) for n in ("_mix_key", "_mix_source", "_mix_size", "_mix_runs", "_mix_at", "_mix_run")]
    m_key, m_source, m_size, runs, at, run = names
    taken = mix(df, key, text, source, with_source=True, **options).filter("size > 0")
    copies = F.round(F.col("taken") / F.col("size")).cast("int")
    # Rows that agree have at most ``repeats + 1`` numbers of copies between them: how many rows have each is enough.
    alike = (taken.groupBy(F.col(f"`{key}`").alias(m_key), F.col("mix_source").alias(m_source), F.col("size").alias(m_size), copies.alias("copies"))
             .agg(F.count(F.lit(1)).alias("rows")).groupBy(m_key, m_source, m_size)
             .agg(F.sort_array(F.collect_list(F.struct("copies", "rows")), asc=False).alias(runs)).filter(F.col(runs)[0]["copies"] > 0))
    alike = settle(alike.withColumn(at, F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["rows"])))
    once, shared = (alike.filter(c).drop(at) for c in (F.col(at) == 1, F.col(at) > 1))
    match = (F.col(f"`{key}`").eqNullSafe(F.col(m_key)) & F.col(f"`{source}`").cast("string").eqNullSafe(F.col(m_source))
             & (word_count(text) == F.col(m_size)))
    rows = df.join(once.hint("merge"), match).withColumn(run, F.col(runs)[0]["copies"])
    if not shared.isEmpty():
        # The n-th of the rows that agree takes the n-th number of copies.
        same = W.partitionBy(m_key, m_source, m_size).orderBy(F.xxhash64(whole_text(text)), whole_text(text))
        told = df.join(shared, match).withColumn(at, F.row_number().over(same).cast("long"))
        nth = F.aggregate(runs, F.struct(F.col(at).alias("left"), F.lit(0).alias("copies")),
                          lambda a, r: F.struct((a["left"] - r["rows"]).alias("left"),
                                                F.when((a["left"] > 0) & (a["left"] <= r["rows"]), r["copies"]).otherwise(a["copies"]).alias("copies")),
                          lambda a: a["copies"])
        rows = rows.unionByName(told.withColumn(run, nth).drop(at).filter(F.col(run) > 0))
    return rows.withColumn(run, F.explode(F.sequence(F.lit(1), F.col(run)))).drop(*names)
