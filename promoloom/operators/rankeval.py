"""Retrieval metrics and the significance of differences between methods."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..columns import DEFAULTS
from ..functions.stats import chi2_upper_tail, nemenyi_q05, normal_cdf
from ..storage import attach, bounded, settle
from .numbering import global_rank


#: Letters of the pieces that containment rules are looked up by.
GRAM = 3


def _pieces(text: Column, size: int) -> Column:
    """All runs of ``size`` letters, distinct."""
    last = F.length(text) - F.lit(size - 1)
    starts = F.when(last > 0, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def matched_groups(rules: DataFrame, groups: DataFrame) -> DataFrame:
    """``qid``, ``grp`` of every rule (qid, kind, value) and group (``grp``) that match, by keyed lookups.

    An equality looks the group up by itself, a prefix by as many first letters
    as the rule has, a containment (any case) by the rule's rarest piece of three letters.
    Containment rules of one or two letters are looked up by the rule itself
    among all the pieces of that length; the empty rule contains and starts everything.
    """
    groups = groups.select("grp").filter(F.col("grp").isNotNull()).distinct()
    asked = rules.select("qid", "kind", "value").filter(F.col("value").isNotNull()).distinct()
    equal = asked.filter("kind = 'equals'").join(groups, F.col("value") == F.col("grp")).select("qid", "grp")

    starts = asked.filter("kind = 'starts' AND value != ''").withColumn("n", F.length("value"))
    # Only lengths that some rule has; there are few.
    lengths = starts.agg(F.array_sort(F.collect_set("n")).alias("ns"))
    first = attach(groups, lengths, []).select("grp", F.explode("ns").alias("n")).filter(F.length("grp") >= F.col("n"))
    first = first.withColumn("value", F.expr("substring(grp, 1, n)"))
    starting = starts.join(first, ["n", "value"]).select("qid", "grp")

    folded = groups.select("grp", F.lower("grp").alias("low"))
    inside = asked.filter("kind = 'contains' AND value != ''").withColumn("value", F.lower("value"))
    pieces = settle(folded.select("grp", "low", F.explode(_pieces(F.col("low"), GRAM)).alias("gram")))
    common = pieces.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    long = inside.filter(F.length("value") >= GRAM)
    parts = long.select("qid", "value", F.explode(_pieces(F.col("value"), GRAM)).alias("gram")).join(common, "gram", "left")
    # A rule with a piece that no group has finds nothing: the piece counts as the rarest.
    rarest = (parts.groupBy("qid", "value").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("p"))
              .select("qid", "value", F.col("p.gram").alias("gram")))
    containing = rarest.join(pieces, "gram").filter(F.contains(F.col("low"), F.col("value"))).select("qid", "grp")

    short = inside.filter(F.length("value") < GRAM)
    bits = folded.select("grp", F.explode(F.concat(*[_pieces(F.col("low"), n) for n in range(1, GRAM)])).alias("value"))
    brief = short.join(bits, "value").select("qid", "grp")

    empty = asked.filter("value = '' AND kind IN ('starts', 'contains')").select("qid", F.lit(1).alias("one"))
    everything = empty.join(groups.withColumn("one", F.lit(1)), "one").select("qid", "grp")
    out = equal
    for part in (starting, containing, brief, everything):
        out = out.unionByName(part)
    return out.distinct()


def gold_documents(rules: DataFrame, docs: DataFrame) -> DataFrame:
    """qid, doc_id pairs from rules (qid, kind, value) on the group.

    ``kind`` is ``equals``, ``contains`` (any case) or ``starts``.  Rules meet
    the distinct groups before they meet the catalog.
    """
    matched = matched_groups(rules, docs)
    return docs.select("doc_id", "grp").join(bounded(matched), "grp").select("qid", "doc_id")


def queries_with_gold(queries: DataFrame, gold: DataFrame) -> DataFrame:
    return queries.join(bounded(gold.select("qid").distinct()), "qid", "left_semi")


def rank_metrics(rankings: DataFrame, gold: DataFrame, k: int = DEFAULTS.k,
                 methods: tuple[str, ...] | None = None) -> DataFrame:
    """P@k, R@k, AP, RR and nDCG@k per method and query over full rankings.

    Only relevant rows matter once ranks are known, so ``rankings`` may hold
    those alone; ``methods`` then names the methods, each of which has every query with
    relevant documents.  The running count of hits is a distributed rank.
    """
    relevant = gold.select("qid", "doc_id").distinct()
    sizes = relevant.groupBy("qid").agg(F.count(F.lit(1)).alias("nrel"))
    asked = rankings.select("method", "qid").distinct()
    if methods is not None:
        asked = sizes.select(F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"), "qid")
    hits = rankings.select("method", "qid", "doc_id", "rank").join(bounded(relevant), ["qid", "doc_id"])
    hits = global_rank(hits, [F.col("rank").asc()], ["method", "qid"], "hit")
    in_k = F.col("rank") <= k
    gain = F.lit(1.0) / F.log2(F.col("rank") + F.lit(1.0))
    per = hits.groupBy("method", "qid").agg(
        F.count_if(in_k).alias("top"), F.sum(F.col("hit") / F.col("rank")).alias("prec"),
        F.min("rank").alias("first"), F.sum(F.when(in_k, gain)).alias("dcg"))
    ideal, total = [], 0.0
    for i in range(1, k + 1):
        total += 1.0 / math.log2(i + 1)
        ideal.append(F.lit(total))
    best = F.get(F.array(*ideal), F.least(F.col("nrel"), F.lit(k)).cast("int") - 1)
    joined = asked.join(per, ["method", "qid"], "left").join(bounded(sizes), "qid", "left")
    zero = F.lit(0.0)
    return joined.select(
        "method", "qid", F.coalesce(F.col("top") / F.lit(k), zero).alias("p_at_k"),
        F.coalesce(F.col("top") / F.col("nrel"), zero).alias("r_at_k"),
        F.coalesce(F.col("prec") / F.col("nrel"), zero).alias("ap"),
        F.coalesce(F.lit(1.0) / F.col("first"), zero).alias("rr"),
        F.coalesce(F.col("dcg") / best, zero).alias("ndcg_at_k"))


def method_summary(metrics: DataFrame) -> DataFrame:
    """Mean of each metric per method, 3 digits, best mean average precision first."""
    names = {"p_at_k": "p_at_k", "r_at_k": "r_at_k", "ap": "map", "rr": "mrr", "ndcg_at_k": "ndcg_at_k"}
    means = metrics.groupBy("method").agg(*[F.bround(F.avg(c), 3).alias(n) for c, n in names.items()])
    return means.orderBy(F.desc("map"), "method")


def method_ranks(metrics: DataFrame, value: str = "ap") -> DataFrame:
    """Rank of each method within a query, best first, ties sharing their average.

    A query has one row per method, so its window is tiny.
    """
    best = W.partitionBy("qid").orderBy(F.desc(value))
    peers = W.partitionBy("qid", value)
    rank = F.rank().over(best) + (F.count(F.lit(1)).over(peers) - 1) / F.lit(2.0)
    return metrics.select("method", "qid", value, rank.alias("mrank"),
                          F.count(F.lit(1)).over(peers).alias("peers"))


def mean_ranks(metrics: DataFrame) -> DataFrame:
    return method_ranks(metrics).groupBy("method").agg(F.avg("mrank").alias("mean_rank"),
                                                       F.count(F.lit(1)).alias("queries"))


def friedman(metrics: DataFrame, methods: int) -> DataFrame:
    """One row chi2, p: tie-corrected Friedman test over the queries' scores.

    Every query must be scored by all ``methods``.
    """
    ranks = settle(method_ranks(metrics))
    sums = ranks.groupBy("method").agg(F.sum("mrank").alias("r"), F.count(F.lit(1)).alias("n"))
    k = float(methods)
    total = sums.agg(F.sum(F.col("r") * F.col("r")).alias("ssr"), F.max("n").cast("double").alias("n"))
    # A tie of t rows adds t^3 - t in all, (t^2 - 1) from each of its rows.
    ties = ranks.agg(F.sum(F.col("peers") * F.col("peers") - 1).cast("double").alias("ties"))
    both = attach(total, ties, [])
    plain = F.lit(12.0 / (k * (k + 1))) * F.col("ssr") / F.col("n") - F.lit(3.0 * (k + 1)) * F.col("n")
    fix = F.lit(1.0) - F.col("ties") / (F.lit(k * (k * k - 1)) * F.col("n"))
    out = both.select((plain / F.nullif(fix, F.lit(0.0))).alias("chi2"))
    return out.select("chi2", chi2_upper_tail(F.col("chi2"), methods - 1).alias("p"))


def nemenyi(metrics: DataFrame, methods: int, steps: int = 1600) -> DataFrame:
    """Pairwise comparison of mean ranks: difference, statistic, critical difference, p.

    The statistic is the rank difference over sqrt(k (k + 1) / (6 N)); its p is
    the upper tail of the studentised range of ``methods`` normals, integrated
    on a fixed grid of the outer variable.
    """
    means = settle(mean_ranks(metrics))
    k = methods
    left = means.select(F.col("method").alias("method_a"), F.col("mean_rank").alias("ra"), "queries")
    right = means.select(F.col("method").alias("method_b"), F.col("mean_rank").alias("rb"))
    # One row per method on each side.
    pairs = left.join(bounded(right), F.col("method_a") < F.col("method_b"))
    unit = F.sqrt(F.lit(k * (k + 1) / 6.0) / F.col("queries"))
    diff = F.abs(F.col("ra") - F.col("rb"))
    pairs = pairs.select("method_a", "method_b", diff.alias("rank_diff"), (diff / unit).alias("q"),
                         (F.lit(nemenyi_q05(k)) * unit).alias("critical_diff"))
    # The range statistic of unit normals is sqrt(2) times the rank statistic.
    width = F.col("q") * F.lit(math.sqrt(2.0))
    step = 16.0 / steps
    z = F.lit(-8.0) + F.col("i") * F.lit(step)
    density = F.exp(-z * z / F.lit(2.0)) / F.lit(math.sqrt(2.0 * math.pi))
    inside = normal_cdf(z) - normal_cdf(z - width)
    points = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    mass = points.withColumn("m", density * F.pow(inside, F.lit(float(k - 1))) * F.lit(k * step))
    keys = ["method_a", "method_b", "rank_diff", "q", "critical_diff"]
    out = mass.groupBy(*keys).agg(F.sum("m").alias("_in"))
    return out.select(*keys, (F.col("q") > F.lit(nemenyi_q05(k))).alias("significant"),
                      F.greatest(F.lit(1.0) - F.col("_in"), F.lit(0.0)).alias("p"))
