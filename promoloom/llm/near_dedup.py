"""Near-duplicate texts by bottom-k sketches of word shingles (operator 6).

1. One pass reads the texts: the number of distinct shingles, a digest of the
   word sequence, and the ``SKETCH`` smallest values of one hash function over
   the shingles.  Texts of one word sequence are one row from here on.
2. Inverted lists of retained values.  A set that its sketch holds whole is
   indexed by single values, apart for each range of sizes.  A larger one is
   indexed by runs of ``RUN`` neighbouring retained values, which chance hardly
   shares.  Texts at the threshold share at least so many entries that, in any
   order common to all texts, the first ``need`` of each have one in common; the
   order is by list length, the rarest first, so what many texts have is indexed
   only by texts that have little else.
3. Every list compares its members with its hub, the member whose entries are
   the most common.  Pairs pass the union-sketch estimate, then the exact Jaccard
   similarity of the full sets decides.  Links make components.
4. Lists whose members are all in one component are done.  Short lists compare
   what is left, pair by pair across components.  Long ones are gathered into
   clusters; there the texts outside the largest component meet all others in
   blocks, as products of incidence matrices, and each block returns a spanning
   forest of its links.

For sets of at most ``SKETCH`` shingles no link can be lost.  For larger ones the
probability that two texts at the threshold have no indexed run in common is
below ``MISS`` (the retained values of the union are shared with a probability
of the similarity each).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import settle
from .components import components
from .text import WORD, columns_of, keep_keys, map_slices, whole_text
from .vectors import forest_of

SKETCH = 64
#: Neighbouring retained values of an entry, and the most that a link may be missed by.
RUN, MISS = 2, 1e-7
#: Standard deviations of the estimate that a pair may lack and still be verified.
SLACK = 5.5
#: Members of a list whose pairs across components are compared one by one.
SHORT_LIST = 48
#: Texts of a block in the comparison of clusters.
BLOCK = 400
#: Keys that may be broadcast to pick their texts; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000

_WORDS = re.compile(WORD)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str) -> list[str]:
    """Words with A-Z lower-cased."""
    return _WORDS.findall(text.translate(_LOWER) if not text.isascii() else text.lower())


def shingles(words: list[str], size: int) -> set[str]:
    """Distinct runs of ``size`` words; a shorter text is one run; no words, none."""
    if len(words) <= size:
        return {" ".join(words)} if words else set()
    return set(map(" ".join, zip(*[words[i:] for i in range(size)])))


def values(grams: set[str]) -> np.ndarray:
    """The hash function's values of shingles, sorted, without repeats."""
    return np.unique(np.array([xxhash.xxh3_64_intdigest(g) for g in grams], np.uint64).view(np.int64))


def linked(inter: int, a: int, b: int, percent: int) -> bool:
    return 100 * inter >= percent * (a + b - inter)


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5,
                percent: int = 80) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    Texts link when 100 times the intersection of their shingle sets is at
    least ``percent`` times the union.  ``component_id`` is the smallest key
    reachable by links, itself included; ``kept`` marks that row.

    Null or blank text has no shingles and links with nothing.  A text with
    fewer words than a shingle has one shingle, all its words.  A null key never
    names a component with other keys.  Repeated rows link with each other; all
    rows of the smallest key are kept.  Texts of any length are compared whole.
    An empty table gives no rows.  Other columns are ignored.
    """
    texts = df.select(F.col(f"`{key}`").alias("row_key"), whole_text(text).alias("text"))

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, digest, low = [], [], []
        for t in batch.column("text").to_pylist():
            words = words_of(t)
            grams = shingles(words, size)
            n.append(len(grams))
            digest.append(xxhash.xxh3_128_digest(" ".join(words)) if grams else None)
            low.append(values(grams)[:SKETCH])
        return pa.RecordBatch.from_arrays(
            [batch.column("row_key"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(low, pa.list_(pa.int64()))],
            names=["row_key", "n", "digest", "sketch"])

    read = columns_of(texts, "row_key", "text")
    key_type = df.schema[key].dataType.simpleString()
    rows = settle(map_slices(read, sketch, f"row_key {key_type}, n long, digest binary, sketch array<long>"))
    # The class of equal word sequences, named by its smallest key; classes of null keys alone can't be named.
    first = F.min("row_key")
    classes = settle(rows.filter("n > 0").groupBy("digest").agg(first.alias("rep"), F.count(F.lit(1)).alias("copies")))
    reps = settle(rows.join(classes.filter("rep is not null"), "digest").filter("row_key = rep")
                  .dropDuplicates(["digest"]).select("rep", "digest", "n", "sketch"))
    bodies = texts.filter("row_key is not null")
    group = _groups(reps, bodies, size, percent)
    named = classes.join(group, F.col("rep") == F.col("node"), "left").select(
        "digest", F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(named, "digest", "left").select(
        F.col("row_key").alias(key), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "row_key").alias("component_id"))
    return out.withColumn("kept", F.col(f"`{key}`").eqNullSafe(F.col("component_id")))


def drop_near(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``df`` whose key stays: one of each group, all columns.

    Rows that repeat a key can't be told apart by it: all of them stay if one does.
    """
    kept = near_groups(df, key, text, size, percent).filter("kept")
    return keep_keys(df, kept.select(F.col(f"`{key}`")), key)


def large_from(percent: int) -> int:
    """The size from which a set is indexed by runs: the least that links with a set its sketch doesn't hold whole."""
    return min(SKETCH, -(-(SKETCH + 1) * percent // 100))


def spare_runs(n: int, share: float) -> int:
    """How many of the runs of ``n`` retained values two texts may leave out.

    The largest D for which at most D shared runs have a probability below
    ``MISS`` when each of ``n`` values is shared with probability ``share``.
    """
    # state: length of the current streak (at most RUN), number of runs -> probability
    state = {(0, 0): 1.0}
    for _ in range(n):
        new: dict[tuple[int, int], float] = {}
        for (streak, runs), p in state.items():
            longer = min(streak + 1, RUN)
            for to, q in (((longer, runs + (longer == RUN)), p * share), ((0, runs), p * (1 - share))):
                new[to] = new.get(to, 0.0) + q
        state = new
    total = 0.0
    for d in range(n):
        total += sum(p for (_, runs), p in state.items() if runs == d)
        if total >= MISS:
            return max(d - 1, 0)
    return 0


def _groups(reps: DataFrame, bodies: DataFrame, size: int, percent: int) -> DataFrame:
    """``node`` and ``component`` of every linked text."""
    lists = settle(_lists(reps, percent))
    group = components(_verify(_estimated(settle(_hub_pairs(lists)), reps, percent), bodies, size, percent))
    open_lists = settle(_open_lists(lists, group))
    if open_lists.isEmpty():
        return group
    short = settle(_cross_pairs(open_lists.filter(F.col("members") <= SHORT_LIST)))
    group = _joined(group, _verify(_estimated(short, reps, percent), bodies, size, percent))
    long_lists = settle(_open_lists(lists, group).filter(F.col("members") > SHORT_LIST))
    if long_lists.isEmpty():
        return group
    return _joined(group, _cluster_links(long_lists, bodies, size, percent))


def _joined(group: DataFrame, links: DataFrame) -> DataFrame:
    """Components of what was connected before and further links."""
    links = settle(links)
    if links.isEmpty():
        return group
    return components(links.unionByName(group.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def _lists(reps: DataFrame, percent: int) -> DataFrame:
    """``value``, ``doc`` and ``weight`` of every indexed entry that two texts or more have."""
    n = F.size("sketch")
    # Sets within the threshold differ in size by 100 / percent at most: their ranges are equal or neighbours.
    place = (F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9) if percent < 100 else F.col("n")).cast("int")
    small = reps.filter(F.col("n") <= SKETCH).select(
        F.col("rep").alias("doc"), F.explode(F.array(place, place + 1)).alias("space"), "sketch",
        (n - F.ceil(n * percent / 100) + 1).alias("need"))
    small = small.select("doc", "space", n.alias("n_doc"), "need", F.explode("sketch").alias("value"))
    least = large_from(percent)
    spare = F.array(*[F.lit(spare_runs(k, percent / 100)) for k in range(least, SKETCH + 1)])
    runs = F.transform(F.sequence(F.lit(0), n - RUN), lambda i: F.xxhash64(*[F.get("sketch", i + j) for j in range(RUN)]))
    large = reps.filter(F.col("n") >= least).select(
        F.col("rep").alias("doc"), F.lit(-1).alias("space"), (n - RUN + 1).alias("n_doc"),
        (n - RUN + 1 - F.get(spare, n - least)).alias("need"), F.explode(runs).alias("value"))
    entries = small.unionByName(large).withColumn("value", F.xxhash64("space", "value"))
    counts = entries.groupBy("value").agg(F.count(F.lit(1)).alias("shared")).filter("shared > 1")
    # Values of one text alone come first in the order, and only their number matters.
    own = W.partitionBy("doc", "space")
    ranked = (entries.join(counts, "value")
              .withColumn("place", F.col("n_doc") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("shared", "value")))
              .withColumn("weight", F.sum(F.log2("shared")).over(own)))
    return ranked.filter(F.col("place") <= F.col("need")).select("value", "doc", "weight")


def _hub_pairs(lists: DataFrame) -> DataFrame:
    """Each list's members with its hub."""
    hubs = lists.groupBy("value").agg(_hub(), F.count(F.lit(1)).alias("members"))
    return _pairs(lists.join(hubs.filter("members > 1"), "value").select(F.col("hub").alias("x"), F.col("doc").alias("y")))


def _hub():
    return F.min(F.struct((-F.col("weight")).alias("w"), "doc"))["doc"].alias("hub")


def _pairs(found: DataFrame) -> DataFrame:
    return (found.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def _open_lists(lists: DataFrame, group: DataFrame) -> DataFrame:
    """Members of lists that have several components, with their component and hub."""
    placed = (lists.join(group, F.col("doc") == F.col("node"), "left")
              .withColumn("component", F.coalesce("component", "doc")).drop("node"))
    state = placed.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                        F.count(F.lit(1)).alias("members"), _hub())
    return placed.join(state.filter("low != high and members > 2"), "value").drop("low", "high", "weight")


def _cross_pairs(open_lists: DataFrame) -> DataFrame:
    """Pairs of a list in different components; its hub has met all of them already."""
    rest = open_lists.filter("doc != hub").select("value", "doc", "component")
    x = rest.select("value", F.col("doc").alias("x"), F.col("component").alias("cx"))
    y = rest.select("value", F.col("doc").alias("y"), F.col("component").alias("cy"))
    return _pairs(x.join(y, "value").filter("cx < cy"))


def _only(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` for distinct ``keys`` (one column), picked where they are read if the keys are few enough."""
    keys = settle(keys.toDF("_key").distinct())
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return df.join(keys, F.col(key) == F.col("_key"), "left_semi")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("a").unionByName(pairs.select(F.col("b").alias("a")))


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose union sketch doesn't rule them out."""
    reps = _only(reps, "rep", _ends(pairs))
    left = reps.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    right = reps.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    t = percent / 100
    met = pairs.join(left, "a").join(right, "b").filter(F.least("na", "nb") >= F.greatest("na", "nb") * t)
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("u")))
    k = F.size("u")
    return settle(met.withColumn("u", union)
                  .filter(both >= k * t - SLACK * F.sqrt(k * t * (1 - t)) - 1e-9).select("a", "b"))


def _verify(pairs: DataFrame, bodies: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets link."""
    bodies = _only(bodies, "row_key", _ends(pairs))
    left = bodies.select(F.col("row_key").alias("a"), F.col("text").alias("ta"))
    right = bodies.select(F.col("row_key").alias("b"), F.col("text").alias("tb"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, grams = None, set()
        for batch in batches:
            good = []
            for ta, tb in zip(batch.column("ta"), batch.column("tb")):
                text = ta.as_py()
                if text != last:
                    last, grams = text, shingles(words_of(text), size)
                other = shingles(words_of(tb.as_py()), size)
                good.append(linked(len(grams & other), len(grams), len(other), percent))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    kind = bodies.schema["row_key"].dataType.simpleString()
    return met.mapInArrow(check, f"a {kind}, b {kind}").distinct()


def _cluster_links(long_lists: DataFrame, bodies: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between the components of each cluster of lists, as spanning forests of blocks."""
    cluster = components(long_lists.select(F.col("doc").alias("a"), F.col("hub").alias("b")))
    docs = (long_lists.select("doc", F.col("component").alias("part")).distinct()
            .join(cluster.select(F.col("node").alias("doc"), F.col("component").alias("cluster")), "doc"))
    sizes = docs.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.groupBy("cluster").agg(
        F.max(F.struct("n", "part"))["part"].alias("main"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"),
        F.ceil((F.sum("n") - F.max("n")) / BLOCK).cast("int").alias("turns"))
    docs = settle(docs.join(whole, "cluster"))
    kind = bodies.schema["row_key"].dataType.simpleString()

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [values(shingles(words_of(t), size)) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array(found, pa.list_(pa.int64()))], names=["doc", "grams"])

    texts = columns_of(_only(bodies, "row_key", docs.select("doc")), "row_key", "text")
    grams = map_slices(texts, sets, f"doc {kind}, grams array<bigint>")
    rows = settle(docs.join(grams, "doc").dropDuplicates(["doc"]))
    spread = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = (rows.filter("part != main").withColumn("turn", spread("turns")).withColumn("block", every("blocks"))
             .select("cluster", "turn", "block", "doc", "grams").toDF("q_cluster", "q_turn", "q_block", "q_doc", "q_grams"))
    told = (rows.withColumn("block", spread("blocks")).withColumn("turn", every("turns"))
            .select("cluster", "turn", "block", "doc", "grams"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = left["q_doc"].to_numpy(), right["doc"].to_numpy()
        i, j = np.nonzero(_similar(left["q_grams"].combine_chunks(), right["grams"].combine_chunks(), percent))
        a, b = forest_of(x[i], y[j])
        return pa.table({"a": pa.array(a), "b": pa.array(b)}).cast(pa.schema([("a", left.schema.field("q_doc").type), ("b", left.schema.field("q_doc").type)]))

    return asked.groupBy("q_cluster", "q_turn", "q_block").cogroup(
        told.groupBy("cluster", "turn", "block")).applyInArrow(compare, f"a {kind}, b {kind}")


def _similar(left: pa.Array, right: pa.Array, percent: int, width: int = 8_192) -> np.ndarray:
    """Which sets of the two lists link: products of incidence matrices, ``width`` values at a time."""
    na, nb = (np.asarray(pc.list_value_length(x).to_numpy(zero_copy_only=False), np.int64) for x in (left, right))
    inter = np.zeros((len(na), len(nb)), np.float64)
    fa, fb = left.flatten().to_numpy(), right.flatten().to_numpy()
    names = np.intersect1d(fa, fb)
    rows = []
    for flat, n in ((fa, na), (fb, nb)):
        at = np.searchsorted(names, flat)
        known = (at < len(names)) & (names[np.minimum(at, max(len(names) - 1, 0))] == flat) if len(names) else np.zeros(len(flat), bool)
        order = np.argsort(at[known], kind="stable")
        rows.append((at[known][order], np.repeat(np.arange(len(n)), n)[known][order]))
    for s in range(0, len(names), width):
        parts = []
        for (at, row), n in zip(rows, (na, nb)):
            lo, hi = np.searchsorted(at, [s, s + width])
            m = np.zeros((len(n), min(width, len(names) - s)), np.float32)
            m[row[lo:hi], at[lo:hi] - s] = 1
            parts.append(m)
        inter += parts[0] @ parts[1].T
    return 100 * inter >= percent * (na[:, None] + nb[None, :] - inter)
