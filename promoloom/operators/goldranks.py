"""Ranks of chosen documents, without ranking the others.

The metrics need the ranks of the relevant documents alone.  A document that a
method has found is ranked among the found ones.  Any other one comes behind all
of them, in document order: its place in the catalog, less the found documents
before it.  For vectors, where every document has a score of its own, each block
of documents counts how many of them beat each relevant score; the counts are summed.
The output has one row per method and relevant pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..columns import DEFAULTS
from ..storage import bounded, settle
from .numbering import global_rank
from .retrieval import (DOC_BLOCK, QUERY_BLOCK, Scorer, block_join, category_found, dense_all, lexical_found, matrix,
                        rescored_pool, structured_found, text_score, with_vector)

#: Relevant documents of a query up to which beaten scores are counted; queries with more get a full ranking.
COUNTED = 20_000
#: Scores closer than this share of the vectors' lengths are added up again, one product after another.
NEAR = 1e-9


def found_by_all(queries: DataFrame, docs: DataFrame, pool: int = DEFAULTS.pool, scorer: Scorer = text_score) -> DataFrame:
    """``method``, ``qid``, ``doc_id``, ``score`` of documents that beat the default of their method."""
    parts = {"category": (category_found(queries, docs), -1.0), "lexical": (lexical_found(queries, docs), 0.0),
             "structured": (structured_found(queries, docs), 0.0), "rerank": (rescored_pool(queries, docs, pool, scorer), None)}
    out = None
    for method, (found, default) in parts.items():
        if default is not None:
            found = found.filter(F.col("score") > default)
        found = found.select(F.lit(method).alias("method"), "qid", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


def ranks_with_default(found: DataFrame, gold: DataFrame, docs: DataFrame, methods: list[str]) -> DataFrame:
    """``method``, ``qid``, ``doc_id``, ``rank`` of the pairs in ``gold`` (distinct ``qid``, ``doc_id``).

    ``found`` has the documents above the default of each method; the others of
    ``docs`` follow in order of ``doc_id``.
    """
    by = ["method", "qid"]
    # Written once: it is ranked twice, and each range partitioning samples it first.
    found = settle(found.join(bounded(gold.select("qid").distinct()), "qid", "left_semi"))
    wanted = gold.select(F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"), "qid", "doc_id")
    ranked = global_rank(found, [F.desc("score"), F.asc("doc_id")], by)
    hits = wanted.join(ranked.select(*by, "doc_id", "rank"), [*by, "doc_id"], "left")
    hits = settle(hits)
    rest = hits.filter(F.col("rank").isNull()).select(*by, "doc_id")
    order = [F.asc("doc_id")]
    place = global_rank(docs.select("doc_id"), order, name="place").join(
        bounded(rest.select("doc_id").distinct()), "doc_id", "left_semi")
    # Found documents before one = its place among both, less its place among the others.
    both = found.select(*by, "doc_id", F.lit(True).alias("hit")).unionByName(rest.withColumn("hit", F.lit(False)))
    among = global_rank(both, order, by, "among").filter(~F.col("hit")).select(*by, "doc_id", "among")
    own = global_rank(rest, order, by, "own")
    total = found.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    tail = (own.join(among, [*by, "doc_id"]).join(place, "doc_id").join(bounded(total), by, "left")
            .select(*by, "doc_id", (F.coalesce("n", F.lit(0)) + F.col("place") - (F.col("among") - F.col("own"))).alias("rank")))
    return hits.filter(F.col("rank").isNotNull()).unionByName(tail)


def dense_ranks(queries: DataFrame, docs: DataFrame, gold: DataFrame, counted: int = COUNTED, query_block: int = QUERY_BLOCK,
                doc_block: int = DOC_BLOCK, method: str = "dense") -> DataFrame:
    """``method``, ``qid``, ``doc_id``, ``rank`` of the pairs in ``gold`` under inner products.

    Documents and queries without a vector have no rank.
    """
    queries, docs = with_vector(queries.select("qid", "vec")), with_vector(docs.select("doc_id", "vec"))
    product = F.aggregate(F.zip_with("vec", "d_vec", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    pairs = (gold.join(docs.select("doc_id", F.col("vec").alias("d_vec")), "doc_id").join(queries, "qid")
             .select("qid", "doc_id", product.alias("score")))
    pairs = settle(pairs)
    sizes = pairs.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    few, many = (bounded(sizes.filter(c).select("qid")) for c in (F.col("n") <= counted, F.col("n") > counted))
    # From the lowest: a document beats the first so many of a query's scores.
    rising = F.array_sort(F.collect_list(F.struct("score", (-F.col("doc_id")).alias("low"))))
    listed = pairs.join(few, "qid", "left_semi").groupBy("qid").agg(rising.alias("gold"))
    asked = queries.join(listed, "qid").select("qid", "vec", F.col("gold.score").alias("g_score"), F.col("gold.low").alias("g_low"))
    kind = queries.schema["qid"].dataType.simpleString()
    beaten = block_join(asked, docs, _beaten, f"qid {kind}, first int, docs bigint", query_block, doc_block)
    beaten = beaten.groupBy("qid", "first").agg(F.sum("docs").alias("docs"))
    # A query has at most ``counted`` relevant documents, and one more place.
    above = W.partitionBy("qid").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, W.currentRow)
    places = listed.select("qid", F.posexplode("gold").alias("pos", "g")).select("qid", "pos", (-F.col("g.low")).alias("doc_id"))
    better = beaten.filter("first > 0").select("qid", (F.col("first") - 1).alias("pos"), "docs")
    ranked = (places.join(better, ["qid", "pos"], "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
              .select("qid", "doc_id", (F.sum("docs").over(above) + 1).alias("rank")))
    out = ranked.select(F.lit(method).alias("method"), "qid", "doc_id", "rank")
    if many.isEmpty():
        return out
    full = dense_all(queries.join(many, "qid", "left_semi"), docs, method).join(pairs.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi")
    return out.unionByName(full.select("method", "qid", "doc_id", "rank"))


def _beaten(asked: pa.Table, told: pa.Table) -> pa.Table:
    """Per query of a block: how many documents beat exactly the first so many of its relevant scores."""
    who, first, docs = [], [], []
    if len(asked) and len(told):
        q, d, low = matrix(asked["vec"]), matrix(told["d_vec"]), -told["doc_id"].to_numpy()
        reach = np.linalg.norm(d, axis=1)
        for start in range(0, len(q), 64):
            for j, row in enumerate(q[start:start + 64] @ d.T, start):
                scores, ids = (np.asarray(asked[c][j].values) for c in ("g_score", "g_low"))
                margin = NEAR * (np.linalg.norm(q[j]) * reach + 1e-300)
                at = np.searchsorted(scores, row - margin)
                # Too near to a relevant score for a product whose order of addition is not fixed.
                for i in np.flatnonzero(at != np.searchsorted(scores, row + margin, "right")):
                    exact = np.cumsum(q[j] * d[i])[-1] if d.shape[1] else 0.0
                    lo, hi = np.searchsorted(scores, exact), np.searchsorted(scores, exact, "right")
                    at[i] = lo + np.searchsorted(ids[lo:hi], low[i])
                n = np.bincount(at, minlength=len(scores) + 1)
                hit = np.flatnonzero(n)
                who.append(np.full(len(hit), j))
                first.append(hit)
                docs.append(n[hit])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.table({"qid": asked["qid"].take(pa.array(join(who))), "first": pa.array(join(first).astype(np.int32)),
                     "docs": pa.array(join(docs).astype(np.int64))})


METHODS = ("category", "lexical", "structured", "dense", "rerank")


def all_gold_ranks(queries: DataFrame, docs: DataFrame, gold: DataFrame, pool: int = DEFAULTS.pool) -> DataFrame:
    """``method``, ``qid``, ``doc_id``, ``rank`` of every relevant pair under each of the five methods."""
    gold = settle(gold.select("qid", "doc_id").distinct())
    known = found_by_all(queries, docs, pool)
    return ranks_with_default(known, gold, docs, [m for m in METHODS if m != "dense"]).unionByName(dense_ranks(queries, docs, gold))
