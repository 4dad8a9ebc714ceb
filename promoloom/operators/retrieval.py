"""Product search as batch jobs over a table of queries.

Three shapes share the scorers.  ``*_found`` find candidates through equi-joins
(shared token, product, attribute or category); every other document has the
method's default score.  ``*_top`` keep the best ``k`` per query.  ``*_all`` rank
the whole catalog for each query, where a full ranking is wanted; ranks come
from a range partitioning, so no query's ranking is sorted in one task.
``goldranks`` ranks chosen documents without ranking the others.

Vectors meet in blocks: a block of queries and a block of documents is one
matrix product in one task, and its best ``k`` per query are all that leaves it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import DEFAULTS
from ..functions.text import (ATTRIBUTES, attribute_score, name_attributes, name_tokens,
                              token_set_similarity, word_roots)
from ..storage import bounded, settle
from .numbering import global_rank, top_per_group

#: Letter similarity from which a word stands for another.
LETTERS = 0.5
#: Queries and documents of a block.
QUERY_BLOCK, DOC_BLOCK = 1_000, 20_000


def _order() -> list[Column]:
    return [F.desc("score"), F.asc("doc_id")]


def describe(df: DataFrame, text: str = "name") -> DataFrame:
    """Add tokens, attributes and word roots of a text."""
    return df.withColumns({"tokens": name_tokens(F.col(text)), "attrs": name_attributes(F.col(text)),
                           "roots": word_roots(F.col(text))})


def blocks(df: DataFrame, rows: int) -> int:
    """How many blocks of about ``rows`` rows a table makes, one at least."""
    return max(1, -(-df.count() // rows))


def _dealt(df: DataFrame, key: str, own: str, parts: int, other: str, others: int) -> DataFrame:
    """Each row in the block of its key, once for every block of the other side."""
    every = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
    return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).withColumn(other, every)


def every_pair(queries: DataFrame, docs: DataFrame, query_block: int = QUERY_BLOCK, doc_block: int = DOC_BLOCK) -> DataFrame:
    """Each document once per query; the query's columns come in struct ``q``.

    A full ranking has one row per query and document by definition.  Blocks of
    both sides meet by equal block numbers.
    """
    nq, nd = blocks(queries, query_block), blocks(docs, doc_block)
    asked = queries.select("qid", F.struct("*").alias("q"))
    left = _dealt(asked, "qid", "_qb", nq, "_db", nd).drop("qid")
    return _dealt(docs, "doc_id", "_db", nd, "_qb", nq).join(left, ["_qb", "_db"]).drop("_qb", "_db")


def block_join(queries: DataFrame, docs: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
               query_block: int = QUERY_BLOCK, doc_block: int = DOC_BLOCK) -> DataFrame:
    """``work`` on every pair of a block of queries (by ``qid``) and a block of documents (by ``doc_id``)."""
    nq, nd = blocks(queries, query_block), blocks(docs, doc_block)
    left = _dealt(queries, "qid", "_qb", nq, "_db", nd)
    right = _dealt(docs.withColumnRenamed("vec", "d_vec"), "doc_id", "_d", nd, "_q", nq)
    return left.groupBy("_qb", "_db").cogroup(right.groupBy("_q", "_d")).applyInArrow(work, schema)


def pair_schema(queries: DataFrame, docs: DataFrame, more: str) -> str:
    kinds = [df.schema[k].dataType.simpleString() for df, k in ((queries, "qid"), (docs, "doc_id"))]
    return f"qid {kinds[0]}, doc_id {kinds[1]}, {more}"


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows; their values travel flat."""
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(vectors), -1)


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, the lower id first among equals."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above, equal = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
    return np.concatenate([above, equal[np.argsort(ids[equal], kind="stable")][:k - len(above)]])


def best_category(texts: DataFrame, key: str, categories: DataFrame) -> DataFrame:
    """``key``, ``cat``, ``cat_score``: the category sharing most word roots with the text.

    Ties go to the lowest name.  Without a shared root the category with the
    most similar tokens is taken, scored on 0..1; without a shared token the one
    whose words are spelt most alike (``spelt_alike``); without such words the
    lowest name with 0.
    """
    named = categories.select(F.col("category").alias("cat"), word_roots(F.col("category")).alias("croots"),
                              name_tokens(F.col("category")).alias("ctokens"))
    named = bounded(named)
    texts = texts.select(key, "roots", "tokens")

    def pick(scored: DataFrame) -> DataFrame:
        # min of (-score, name) combines map-side and needs no ranking.
        return (scored.groupBy(key).agg(F.min(F.struct((-F.col("s")).alias("s"), "cat")).alias("_b"))
                .select(key, F.col("_b.cat").alias("cat"), (-F.col("_b.s")).alias("cat_score")))

    by_root = (texts.select(key, F.explode("roots").alias("r"))
               .join(named.select("cat", F.explode("croots").alias("r")), "r")
               .groupBy(key, "cat").agg(F.count(F.lit(1)).cast("double").alias("s")))
    rooted = settle(pick(by_root))
    rest = texts.join(rooted, key, "left_anti")
    by_token = (rest.select(key, "tokens", F.explode("tokens").alias("w"))
                .join(named.select("cat", "ctokens", F.explode("ctokens").alias("w")), "w")
                .select(key, "cat", (token_set_similarity(F.col("tokens"), F.col("ctokens")) / 100.0)
                        .alias("s")))
    tokened = pick(by_token)
    lowest = categories.agg(F.min("category")).first()[0]
    unread = settle(rest.join(settle(tokened).select(key), key, "left_anti"))
    lettered = settle(pick(spelt_alike(unread, key, named)))
    unknown = (unread.select(key).join(lettered.select(key), key, "left_anti")
               .select(key, F.lit(lowest).alias("cat"), F.lit(0.0).alias("cat_score")))
    return rooted.unionByName(tokened).unionByName(lettered).unionByName(unknown)


def letter_pairs(word: Column) -> Column:
    """Neighbouring letters of a word, its ends marked, distinct."""
    marked = F.concat(F.lit("^"), word, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(marked) - 1), lambda i: F.substring(marked, i, F.lit(2))))


def alike_words(left: DataFrame, right: DataFrame, least: float = LETTERS) -> DataFrame:
    """``w``, ``t``, ``alike``: words of two lists (``w``, ``t``) with a letter similarity of at least ``least``.

    The similarity is 1 less the edits per letter of the longer word.  Words meet
    by pairs of letters.  An edit spoils two pairs at most, so that words alike by a half
    or more have one in common; the edits allowed also bound the difference in
    length and the pairs that must be shared.
    """
    if least < 0.5:
        raise ValueError("words less than half alike need not share a pair of letters")

    def spread(df: DataFrame, name: str) -> DataFrame:
        pairs = letter_pairs(F.col(name))
        return df.filter(F.length(name) > 0).distinct().select(name, F.size(pairs).alias(f"n_{name}"), F.explode(pairs).alias("pair"))

    longest = F.greatest(F.length("w"), F.length("t"))
    edits = F.floor((F.lit(1.0 - least) + F.lit(1e-9)) * longest)
    shared = spread(left, "w").join(spread(right, "t"), "pair").groupBy("w", "t", "n_w", "n_t").agg(F.count(F.lit(1)).alias("n"))
    near = shared.filter((F.abs(F.length("w") - F.length("t")) <= edits) & (F.col("n") >= F.greatest("n_w", "n_t") - 2 * edits))
    alike = F.lit(1.0) - F.levenshtein("w", "t") / longest
    return near.select("w", "t", alike.alias("alike")).filter(F.col("alike") >= least)


def spelt_alike(texts: DataFrame, key: str, named: DataFrame, least: float = LETTERS) -> DataFrame:
    """``key``, ``cat``, ``s``: mean over the text's words of the best letter similarity with a word of the category.

    A word without one of at least ``least`` counts 0; texts without any are left
    out.  Distinct words are compared, not texts.
    """
    words = texts.select(key, F.size("tokens").alias("n"), F.explode("tokens").alias("w"))
    terms = named.select("cat", F.explode("ctokens").alias("t"))
    best = (alike_words(words.select("w").distinct(), terms.select("t").distinct(), least).join(terms, "t")
            .groupBy("w", "cat").agg(F.max("alike").alias("alike")))
    return words.join(best, "w").groupBy(key, "cat").agg((F.sum("alike") / F.max("n")).alias("s"))


def _ranked(scores: DataFrame, method: str) -> DataFrame:
    ranked = global_rank(scores.select("qid", "doc_id", "score"), _order(), ["qid"])
    return ranked.select(F.lit(method).alias("method"), "qid", "doc_id", "score", "rank")


def _top(scores: DataFrame, method: str, k: int) -> DataFrame:
    best = top_per_group(scores.select("qid", "doc_id", "score"), ["qid"], _order(), k)
    return best.select(F.lit(method).alias("method"), "qid", "doc_id", "score",
                       F.col("rank").cast("bigint").alias("rank"))


def _top_or_first(found: DataFrame, queries: DataFrame, docs: DataFrame, k: int,
                  default: float, method: str) -> DataFrame:
    """Best ``k`` of the found documents, filled with the lowest others at the default score.

    ``found`` has one row per query and document, none below the default, so
    each partition keeps only ``k`` per query before anything moves.
    """
    best = _top(found, method, k).select("qid", "doc_id", "score")
    low = every_pair(queries.select("qid"), docs.select("doc_id").orderBy("doc_id").limit(k))
    low = low.select("q.qid", "doc_id", F.lit(float(default)).alias("score"))
    both = best.unionByName(low).groupBy("qid", "doc_id").agg(F.max("score").alias("score"))
    return _top(both, method, k)


# --- category ---------------------------------------------------------------

def category_all(queries: DataFrame, docs: DataFrame, method: str = "category") -> DataFrame:
    """Documents of the query's category by their own overlap, all others at -1."""
    qcat, dcat = _category_sides(queries, docs)
    pairs = every_pair(qcat, dcat)
    score = F.when(F.col("q.cat") == F.col("cat"), F.col("cat_score")).otherwise(-1.0)
    return _ranked(pairs.select("q.qid", "doc_id", score.alias("score")), method)


def category_found(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents of the query's category; the others score -1."""
    qcat, dcat = _category_sides(queries, docs)
    hits = dcat.join(bounded(qcat.select("qid", "cat")), "cat")
    return hits.select("qid", "doc_id", F.col("cat_score").alias("score"))


def category_top(queries: DataFrame, docs: DataFrame, k: int = DEFAULTS.k,
                 method: str = "category") -> DataFrame:
    return _top_or_first(category_found(queries, docs), queries, docs, k, -1.0, method)


def _category_sides(queries: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    categories = docs.select("category").filter(F.col("category").isNotNull()).distinct()
    categories = settle(categories)
    return (best_category(queries, "qid", categories), best_category(docs, "doc_id", categories))


# --- lexical ----------------------------------------------------------------

def lexical_all(queries: DataFrame, docs: DataFrame, method: str = "lexical") -> DataFrame:
    """All names by token-set similarity."""
    pairs = every_pair(queries.select("qid", "tokens"), docs.select("doc_id", "tokens"))
    score = token_set_similarity(F.col("q.tokens"), F.col("tokens"))
    return _ranked(pairs.select("q.qid", "doc_id", score.alias("score")), method)


def lexical_found(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents that share a token with the query; the index side stays where it is.  The others score 0."""
    asked = bounded(queries.select("qid", F.col("tokens").alias("qt"), F.explode("tokens").alias("w")))
    hits = docs.select("doc_id", "tokens", F.explode("tokens").alias("w")).join(asked, "w")
    # A pair meets once per shared token; its first one stands for it.
    hits = hits.filter(F.col("w") == F.get(F.array_intersect("qt", "tokens"), F.lit(0)))
    return hits.select("qid", "doc_id", token_set_similarity(F.col("qt"), F.col("tokens")).alias("score"))


def lexical_top(queries: DataFrame, docs: DataFrame, k: int = DEFAULTS.k,
                method: str = "lexical") -> DataFrame:
    return _top_or_first(lexical_found(queries, docs), queries, docs, k, 0.0, method)


# --- structured -------------------------------------------------------------

def structured_all(queries: DataFrame, docs: DataFrame, method: str = "structured") -> DataFrame:
    """All names by product and attribute agreement."""
    pairs = every_pair(queries.select("qid", "attrs"), docs.select("doc_id", "attrs"))
    score = attribute_score(F.col("q.attrs"), F.col("attrs"))
    return _ranked(pairs.select("q.qid", "doc_id", score.alias("score")), method)


def structured_found(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents that share the product, or an attribute when one side has no product.  The others score 0."""
    def traits(df: DataFrame, key: str, attrs: str, name: str) -> DataFrame:
        named = F.array(*[F.when(F.col(attrs)[a].isNotNull(), F.concat(F.lit(a + "="), F.col(attrs)[a]))
                          for a in ("product", *ATTRIBUTES)])
        listed = df.select(key, attrs, F.array_compact(named).alias(name))
        return listed.withColumn("trait", F.explode(name))

    asked = bounded(traits(queries.select("qid", F.col("attrs").alias("qa")), "qid", "qa", "qt"))
    hits = traits(docs.select("doc_id", "attrs"), "doc_id", "attrs", "dt").join(asked, "trait")
    hits = hits.filter(F.col("trait") == F.get(F.array_intersect("qt", "dt"), F.lit(0)))
    hits = hits.withColumn("score", attribute_score(F.col("qa"), F.col("attrs")))
    return hits.filter(F.col("score") > 0).select("qid", "doc_id", "score")


def structured_top(queries: DataFrame, docs: DataFrame, k: int = DEFAULTS.k,
                   method: str = "structured") -> DataFrame:
    return _top_or_first(structured_found(queries, docs), queries, docs, k, 0.0, method)


# --- dense ------------------------------------------------------------------

def with_vector(df: DataFrame) -> DataFrame:
    """Rows that a vector search can rank."""
    return df.filter(F.col("vec").isNotNull())


def dense_scores(queries: DataFrame, docs: DataFrame, topn: int | None = None,
                 query_block: int = QUERY_BLOCK, doc_block: int = DOC_BLOCK) -> DataFrame:
    """Inner products of query and document vectors, as one matrix product per pair of blocks.

    With ``topn`` every pair of blocks sends on only its best ``topn`` per query.
    Rows without a vector are left out.
    """
    return block_join(with_vector(queries.select("qid", "vec")), with_vector(docs.select("doc_id", "vec")),
                      lambda asked, told: _products(asked, told, topn), pair_schema(queries, docs, "score double"),
                      query_block, doc_block)


def _products(asked: pa.Table, told: pa.Table, topn: int | None) -> pa.Table:
    qids, ids = asked["qid"], told["doc_id"]
    who, which, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if len(qids) and len(ids):
        q, d, keys = matrix(asked["vec"]), matrix(told["d_vec"]), ids.to_numpy()
        for start in range(0, len(q), 64):
            product = q[start:start + 64] @ d.T
            for j, row in enumerate(product, start):
                at = np.arange(len(row)) if topn is None else best_rows(row, keys, topn)
                who.append(np.full(len(at), j))
                which.append(at)
                scores.append(row[at])
    who, which = np.concatenate(who), np.concatenate(which)
    return pa.table({"qid": qids.take(pa.array(who)), "doc_id": ids.take(pa.array(which)), "score": np.concatenate(scores)})


def dense_all(queries: DataFrame, docs: DataFrame, method: str = "dense") -> DataFrame:
    # Range partitioning samples its input first; written scores are not computed twice.
    return _ranked(settle(dense_scores(queries, docs)), method)


def dense_top(queries: DataFrame, docs: DataFrame, k: int = DEFAULTS.k,
              method: str = "dense") -> DataFrame:
    return _top(dense_scores(queries, docs, k), method, k)


# --- rerank -----------------------------------------------------------------

def text_score(query: Column, doc: Column) -> Column:
    """Default second scorer: attribute agreement plus token similarity on 0..1."""
    return (attribute_score(query["attrs"], doc["attrs"])
            + token_set_similarity(query["tokens"], doc["tokens"]) / F.lit(100.0))


Scorer = Callable[[Column, Column], Column]


def rescored_pool(queries: DataFrame, docs: DataFrame, pool: int = DEFAULTS.pool,
                  scorer: Scorer = text_score) -> DataFrame:
    """The ``pool`` nearest documents per query with their second score."""
    near = dense_top(queries, docs, pool).select("qid", "doc_id")
    asked = queries.select("qid", F.struct(*[c for c in queries.columns if c not in ("qid", "vec")]).alias("q"))
    told = docs.select("doc_id", F.struct(*[c for c in docs.columns if c not in ("doc_id", "vec")]).alias("d"))
    # The pool is queries x pool rows; the catalog is filtered by it, not the reverse.
    joined = told.join(bounded(near), "doc_id").join(bounded(asked), "qid")
    return joined.select("qid", "doc_id", scorer(F.col("q"), F.col("d")).alias("score"))


def _floor(queries: DataFrame, best: DataFrame) -> DataFrame:
    """``qid``, ``low``: the score of documents outside the pool, one below its lowest.

    A query without a vector has no pool: its list is the catalog's order.
    """
    floor = best.groupBy("qid").agg((F.min("score") - F.lit(1.0)).alias("low"))
    return queries.select("qid").join(floor, "qid", "left").fillna(0.0, ["low"])


def rerank_all(queries: DataFrame, docs: DataFrame, pool: int = DEFAULTS.pool,
               scorer: Scorer = text_score, method: str = "rerank") -> DataFrame:
    """The rescored pool, then every other document one below the pool's lowest score."""
    best = settle(rescored_pool(queries, docs, pool, scorer))
    floor = _floor(queries, best)
    everything = every_pair(floor, docs.select("doc_id")).select("q.qid", "doc_id", "q.low")
    scored = (everything.join(bounded(best.select("qid", "doc_id", "score")), ["qid", "doc_id"], "left")
              .select("qid", "doc_id", F.coalesce("score", "low").alias("score")))
    return _ranked(scored, method)


def rerank_top(queries: DataFrame, docs: DataFrame, k: int = DEFAULTS.k, pool: int = DEFAULTS.pool,
               scorer: Scorer = text_score, method: str = "rerank") -> DataFrame:
    """First ``k`` of the reranked list; the tail in document order fills it when k > pool."""
    best = settle(rescored_pool(queries, docs, pool, scorer))
    # The tail that can be among the first ``k`` is in the first ``k`` of the catalog.
    low = every_pair(_floor(queries, best), docs.select("doc_id").orderBy("doc_id").limit(k))
    both = best.unionByName(low.select("q.qid", "doc_id", F.col("q.low").alias("score")))
    return _top(both.groupBy("qid", "doc_id").agg(F.max("score").alias("score")), method, k)


def find_products(queries: DataFrame, docs: DataFrame, threshold: float | None = None,
                  pool: int = DEFAULTS.pool, topk: int | None = None,
                  scorer: Scorer = text_score) -> DataFrame:
    """Reranked products with name, category, group and score, best first per query."""
    ranked = (rerank_all(queries, docs, pool, scorer) if topk is None
              else rerank_top(queries, docs, topk, pool, scorer))
    if threshold is not None:
        ranked = ranked.filter(F.col("score") >= threshold)
    details = docs.select("doc_id", "name", "category", "grp")
    return (ranked if topk is None else bounded(ranked)).join(details, "doc_id").select("qid", "rank", "doc_id", "name", "category", "grp",
                                                 "score")
