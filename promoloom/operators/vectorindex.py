"""Approximate vector search: inverted lists round centres, some of which a query probes.

The centres come from a bounded sample; every document is put into the list of
its nearest centre, where the vectors stay as they are.  A query meets the
documents of the lists whose centres have the highest inner products with it, in
blocks, as exact matrix products.  How many lists it probes is settled when the index
is built: as many as sampled queries need to find their best sampled documents.
``recall`` measures what probing loses against ``retrieval.dense_top``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import DEFAULTS
from ..functions.hashing import hash60
from ..storage import bounded, settle
from .numbering import top_per_group
from .retrieval import DOC_BLOCK, QUERY_BLOCK, _products, blocks, matrix, pair_schema, with_vector

#: Vectors that centres are learnt from, at most about; and the most centres.
SAMPLE, MOST_LISTS = 20_000, 16_384
#: Recall that the probes must reach on the sample, the sampled queries, and the best documents of each.
TARGET, TRIED, BEST = 0.95, 200, 10


class VectorIndex(NamedTuple):
    lists: DataFrame  #: ``list``, ``doc_id``, ``vec`` of every document with a vector
    sizes: DataFrame  #: ``list``, ``parts``: blocks that a list is compared in
    centres: np.ndarray
    probes: int  #: lists that a query probes


def probes_needed(x: np.ndarray, centres: np.ndarray, target: float = TARGET) -> int:
    """Lists that the first ``TRIED`` vectors must probe to find the share ``target`` of their best ones among all."""
    home = np.argmax(x @ centres.T - (centres ** 2).sum(1) / 2, axis=1)
    asked = x[:TRIED]
    best = np.argsort(-(asked @ x.T), axis=1)[:, :BEST]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    # The place, among the lists in probing order, of the list that holds each of the best.
    at = np.sort(np.take_along_axis(place, home[best], 1).ravel())
    return int(at[max(0, math.ceil(target * len(at)) - 1)]) + 1


def _nearest(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    half = (centres ** 2).sum(1) / 2
    for batch in batches:
        if batch.num_rows:
            x = matrix(pa.chunked_array([batch.column("vec")]))
            at = np.concatenate([np.argmax(x[s:s + 4096] @ centres.T - half, axis=1) for s in range(0, len(x), 4096)])
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *batch.columns], names=["list", *batch.schema.names])


def build_index(docs: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = DEFAULTS.seed,
                doc_block: int = DOC_BLOCK) -> VectorIndex:
    """Index every document (``doc_id``, ``vec``) that has a vector; the root of their number of lists by default."""
    docs = with_vector(docs.select("doc_id", "vec"))
    n = docs.count()
    lists = lists or min(MOST_LISTS, max(1, round(math.sqrt(n))))
    if not n:
        return VectorIndex(docs.select(F.lit(0).alias("list"), "doc_id", "vec"),
                           docs.select(F.lit(0).alias("list"), F.lit(1).alias("parts")), np.zeros((0, 0)), 0)
    # Which vectors teach depends on their ids alone.
    turn = F.pmod(hash60(F.col("doc_id").cast("string"), F.lit(seed)), F.lit(n))
    taught = settle(docs.filter(turn < max(sample, 1)))
    features = taught.select(array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("features"))
    if features.isEmpty():
        taught = docs.limit(1)
        features = taught.select(array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("features"))
    centres = np.stack(KMeans(k=lists, seed=seed, maxIter=10).fit(features).clusterCenters())
    probes = probes_needed(matrix(taught.select("doc_id", "vec").toArrow().sort_by("doc_id")["vec"]), centres)
    held = docs.sparkSession.sparkContext.broadcast(centres)
    kinds = [docs.schema[c].dataType.simpleString() for c in ("doc_id", "vec")]
    placed = settle(docs.mapInArrow(lambda it: _nearest(it, held.value), f"list int, doc_id {kinds[0]}, vec {kinds[1]}"))
    sizes = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / doc_block).cast("int").alias("parts"))
    return VectorIndex(placed, settle(sizes), centres, probes)


def approximate_top(index: VectorIndex, queries: DataFrame, k: int = DEFAULTS.k, probes: int | None = None,
                    method: str = "approximate", query_block: int = QUERY_BLOCK) -> DataFrame:
    """Best ``k`` of the documents in the probed lists, in the form of ``retrieval.dense_top``.

    ``probes`` lists are probed, by default as many as the index has found to be needed.
    """
    queries = with_vector(queries.select("qid", "vec"))
    centres = index.centres
    probes = min(probes or index.probes, len(centres))
    kinds = [queries.schema[c].dataType.simpleString() for c in ("qid", "vec")]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(centres):
                x = matrix(pa.chunked_array([batch.column("vec")]))
                near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))],
                                                 names=[*batch.schema.names, "lists"])

    asked = queries.mapInArrow(probe, f"qid {kinds[0]}, vec {kinds[1]}, lists array<int>")
    nq = blocks(queries, query_block)
    sizes = bounded(index.sizes)
    # A long list is dealt out in parts; a query meets each part of a list it probes.
    asked = (asked.withColumn("list", F.explode("lists")).join(sizes, "list")
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .withColumn("turn", F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int")).select("list", "part", "turn", "qid", "vec"))
    told = (index.lists.join(sizes, "list").withColumn("d_part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
            .withColumn("d_turn", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
            .select(F.col("list").alias("d_list"), "d_part", "d_turn", "doc_id", F.col("vec").alias("d_vec")))
    found = asked.groupBy("list", "part", "turn").cogroup(told.groupBy("d_list", "d_part", "d_turn")).applyInArrow(
        lambda left, right: _products(left, right, k), pair_schema(queries, index.lists, "score double"))
    best = top_per_group(found, ["qid"], [F.desc("score"), F.asc("doc_id")], k)
    return best.select(F.lit(method).alias("method"), "qid", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``qid``, ``exact`` and ``found``: how many of a query's exact best documents an approximate search has."""
    hit = found.select("qid", "doc_id", F.lit(1).alias("hit"))
    return (exact.select("qid", "doc_id").join(hit, ["qid", "doc_id"], "left").groupBy("qid")
            .agg(F.count(F.lit(1)).alias("exact"), F.count("hit").alias("found")))
