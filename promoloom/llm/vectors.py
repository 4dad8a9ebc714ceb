"""Near-duplicate embeddings by product quantisation (operator 4).

1. Equal vectors are one row from here on, with the number of their copies.
2. A bounded sample (``SAMPLE`` vectors) gives coarse centres and, per subspace,
   codebooks of the residuals.
3. Every vector joins the inverted list of its nearest centre with its residual
   code and the length of what the code misses.  As a query it probes every list
   that a partner at the threshold may be in (``probes``).
4. In each list the distances come from tables of query-to-codeword products.
   By Cauchy and Schwarz the true cosine is at most that estimate plus the length missed, so
   only pairs that may reach the threshold get the exact double-precision cosine.
5. A list block returns, per vector, the number of its links, and a spanning
   forest of the links, never all pairs.  A pair counts for both ends: a member that
   asks in the query's home list counts it there, any other member here.

Lists are cut into blocks of bounded rows on both sides, so no task holds a
whole list.  The number of centres follows the number of vectors up to
``MAX_CENTRES``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import settle
from .components import components

#: Vectors that the index is fitted on; all are indexed.
SAMPLE = 16_384
#: Vectors a list has on average, and the most centres.
LIST_ROWS, MAX_CENTRES = 200, 4_096
SUBSPACES, CODEWORDS = 8, 64
#: Standard deviations that a query may be off the centre of its partner's list.
PROBE_DEVIATIONS = 2.0
#: Rows of a block, on either side.
BLOCK_ROWS = 2_000


class Index(NamedTuple):
    centres: np.ndarray
    books: np.ndarray  # subspace, codeword, dimension
    edges: list[int]
    spread: np.ndarray  # centre, centre: share of the residuals' variance along the line between the two, times its length squared


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres ** 2).sum(1) / 2
    return np.concatenate([(x[s:s + 4096] @ centres.T - half).argmax(1) for s in range(0, len(x), 4096)]
                          or [np.zeros(0, np.int64)])


def fit(sample: np.ndarray, n_rows: int, seed: int = 7) -> Index:
    """Centres and codebooks from unit vectors, one row each."""
    rng = np.random.default_rng(seed)
    k = int(min(MAX_CENTRES, max(1, n_rows // LIST_ROWS), max(1, len(sample) // 4)))
    centres = k_means(sample, k, 6, rng)
    left = sample - centres[nearest(sample, centres)]
    edges = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int).tolist()
    width = max(b - a for a, b in zip(edges, edges[1:]))
    books = np.zeros((len(edges) - 1, CODEWORDS, width))
    for m, (a, b) in enumerate(zip(edges, edges[1:])):
        words = k_means(left[:, a:b], CODEWORDS, 6, rng)
        books[m, :len(words), :b - a] = words
        books[m, len(words):, :b - a] = words[0]
    return Index(centres, books, edges, spread_between(centres, left))


def spread_between(centres: np.ndarray, left: np.ndarray) -> np.ndarray:
    """How far residuals of length 1 vary along each line between two centres, squared, times the line's squared length.

    Real vectors fill few directions, and centres differ in just those; the sample's residuals tell.
    """
    cov = left.T @ left
    share = cov / np.trace(cov) if np.trace(cov) > 0 else np.eye(len(cov)) / len(cov)
    g = centres @ share @ centres.T
    own = np.diag(g)
    return np.maximum(own[:, None] + own - 2 * g, 0)


def encode(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centre, residual codes and the length of what they miss."""
    near = nearest(x, index.centres)
    left = x - index.centres[near]
    codes = np.zeros((len(x), len(index.edges) - 1), np.uint8)
    missed = np.zeros(len(x))
    for m, (a, b) in enumerate(zip(index.edges, index.edges[1:])):
        words = index.books[m, :, :b - a]
        codes[:, m] = nearest(left[:, a:b], words)
        missed += ((left[:, a:b] - words[codes[:, m]]) ** 2).sum(1)
    return near, codes, np.sqrt(missed)


def probes(index: Index, x: np.ndarray, home: np.ndarray, threshold: float) -> list[list[int]]:
    """Lists that may hold a vector at the threshold from each query, its ``home`` among them.

    A partner y in list c prefers c to the query's own best list b.  With the
    query as ``t * y`` and a step across it of length ``sqrt(1 - t^2)``, the query
    prefers b by at most ``(1 - t) * (|b|^2 - |c|^2) / 2`` on average.  The step varies as the
    sample's residuals do, so that its deviation along ``b - c`` is ``spread``'s.
    """
    c = index.centres
    size = (c ** 2).sum(1)
    noise = np.sqrt((1 - threshold ** 2) * index.spread)
    out = []
    for s in range(0, len(x), 512):
        score = x[s:s + 512] @ c.T - size / 2
        best = score.argmax(1)
        margin = (1 - threshold) / 2 * np.abs(size[best][:, None] - size) + PROBE_DEVIATIONS * noise[best]
        near = score.max(1)[:, None] - score <= margin
        near[np.arange(len(near)), home[s:s + 512]] = True
        out += [np.flatnonzero(r).tolist() for r in near]
    return out


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), np.finfo(float).tiny)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def clean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``row_key`` and ``v`` (floats or doubles; null where the vector can't link)."""
    single = df.schema[vector].dataType == T.ArrayType(T.FloatType(), df.schema[vector].dataType.containsNull)
    v = F.col(f"`{vector}`") if single else F.col(f"`{vector}`").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(f"`{key}`").alias("row_key"), F.when(good, v).alias("v"))


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` of every row.

    Links are pairs of other rows found with a cosine of at least ``threshold``;
    none is reported below it.  Vectors that are null, empty, zero or hold null
    or non-finite components link with nothing, and so do vectors of different
    lengths.  Equal vectors always link.  ``component_id`` is the smallest key
    reachable by links, ``kept`` marks it.  A null key never names a component:
    such a row has its component if it links with other keys, else null.
    Repeated keys are rows that link like others.  An empty table gives no rows.
    Other columns are ignored.  More than 1,000 different lengths of vectors raise an error,
    since each length is searched by itself.
    """
    rows = settle(clean_vectors(df, key, vector).withColumn("row", F.monotonically_increasing_id())
                  .withColumn("same", F.sha2(F.array_join("v", ","), 256)))
    distinct = settle(rows.filter("v is not null").groupBy("same").agg(
        F.count(F.lit(1)).alias("copies"), F.min("row_key").alias("least"), F.min("row").alias("vec"),
        F.any_value("v").alias("v")))
    lengths = [r.n for r in distinct.select(F.size("v").alias("n")).distinct().limit(1_001).collect()]
    if len(lengths) > 1_000:
        raise ValueError("more than 1,000 lengths of vectors in one column")
    found = [_search(distinct.filter(F.size("v") == n), threshold) for n in sorted(lengths)]
    if found:
        counts, forest = (settle(_union([f[i] for f in found])) for i in (0, 1))
    else:
        spark = df.sparkSession
        counts = spark.createDataFrame([], "vec long, links long")
        forest = spark.createDataFrame([], "a long, b long")
    group = components(forest)
    placed = (distinct.select("same", "copies", "least", "vec")
              .join(group, F.col("vec") == F.col("node"), "left")
              .withColumn("component", F.coalesce("component", "vec")).drop("node"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    links = counts.groupBy("vec").agg(F.sum("links").alias("links"))
    placed = placed.join(least, "component").join(links, "vec", "left").select(
        "same", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    heavy = placed  # one row a distinct vector; a crowded vector's rows are split by the join
    out = rows.join(heavy, "same", "left").select(
        F.col("row_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNotNull(), F.col("component_id")).otherwise(F.col("row_key")).alias("component_id"))
    return out.withColumn("kept", F.col(f"`{key}`").eqNullSafe(F.col("component_id")))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _search(vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Link counts and a spanning forest of vectors of one length."""
    n = vectors.count()
    # Whether a vector is in the sample depends on its digest alone; about SAMPLE rows come to the driver.
    chosen = F.pmod(F.xxhash64("same"), F.lit(2**40)) < F.lit(int(2**40 * min(1.0, SAMPLE / n)))
    sample = vectors.filter(chosen).select("v", "same").toArrow().sort_by("same")
    if not sample.num_rows:
        sample = vectors.select("v", "same").limit(1).toArrow()
    index = fit(unit(_matrix(sample["v"])), n)
    spark = vectors.sparkSession
    kind = vectors.schema["v"].dataType.simpleString()
    held = spark.sparkContext.broadcast(index)

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(_matrix(batch.column("v")))
            near, codes, missed = encode(held.value, x)
            lists = probes(held.value, x, near, threshold)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec"), batch.column("copies"), batch.column("v"), pa.array(near, pa.int32()),
                 pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(missed),
                 pa.array(lists, pa.list_(pa.int32()))],
                names=["vec", "copies", "v", "near", "code", "missed", "probes"])

    coded = settle(vectors.select("vec", "copies", "v").mapInArrow(
        assign, f"vec long, copies long, v {kind}, near int, code binary, missed double, probes array<int>"))
    # Blocks of each side of a list; at most MAX_CENTRES rows.
    def blocks(df, name):
        return df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(name))

    base = coded.select("vec", "copies", "v", "code", "missed", "probes", F.col("near").alias("list"))
    asked = coded.select("vec", "copies", "near", "v", F.explode("probes").alias("list"))
    sizes = F.broadcast(settle(blocks(base, "parts").join(blocks(asked, "turns"), "list")))
    spread = lambda n: F.pmod(F.xxhash64("vec"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = base.join(sizes, "list").withColumn("part", spread("parts")).withColumn("turn", every("turns"))
    asked = asked.join(sizes, "list").withColumn("turn", spread("turns")).withColumn("part", every("parts"))

    def compare(queries: pa.Table, members: pa.Table) -> pa.Table:
        return _compare(held.value, threshold, queries, members)

    by = ["list", "part", "turn"]
    # New names, since both sides come from one table.
    left = asked.select(*by, "vec", "copies", "near", "v").toDF(
        "q_list", "q_part", "q_turn", "q_vec", "q_copies", "q_near", "q_v")
    right = base.select(*by, "vec", "copies", "v", "code", "missed", "probes")
    met = settle(left.groupBy("q_list", "q_part", "q_turn").cogroup(right.groupBy(*by)).applyInArrow(
        compare, "vec long, links long, tree long"))
    counts = met.filter("links is not null").select("vec", "links")
    forest = met.filter("tree is not null").select(F.col("vec").alias("a"), F.col("tree").alias("b"))
    return counts, forest


def _compare(index: Index, threshold: float, queries: pa.Table, members: pa.Table) -> pa.Table:
    empty = pa.table({"vec": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "tree": pa.array([], pa.int64())})
    if not queries.num_rows or not members.num_rows:
        return empty
    q, x = unit(_matrix(queries["q_v"])), unit(_matrix(members["v"]))
    qid, xid = queries["q_vec"].to_numpy(), members["vec"].to_numpy()
    copies, missed = members["copies"].to_numpy(), members["missed"].to_numpy()
    q_copies, q_near = queries["q_copies"].to_numpy(), queries["q_near"].to_numpy()
    lists = members["probes"].combine_chunks()
    asks = np.zeros((len(x), len(index.centres)), bool)
    asks[lists.value_parent_indices().to_numpy(), lists.flatten().to_numpy()] = True
    codes = np.frombuffer(b"".join(members["code"].to_pylist()), np.uint8).reshape(len(x), -1)
    centre = index.centres[members["list"][0].as_py()]
    estimate = np.repeat((q @ centre)[:, None], len(x), 1)
    for m, (a, b) in enumerate(zip(index.edges, index.edges[1:])):
        table = q[:, a:b] @ index.books[m, :, :b - a].T
        estimate += table[:, codes[:, m]]
    qi, xi = np.nonzero(estimate + missed >= threshold - 1e-9)
    links, member_links = np.zeros(len(q), np.int64), np.zeros(len(x), np.int64)
    pairs = []
    for s in range(0, len(qi), 200_000):
        i, j = qi[s:s + 200_000], xi[s:s + 200_000]
        good = (np.einsum("ij,ij->i", q[i], x[j]) >= threshold) & (qid[i] != xid[j])
        i, j = i[good], j[good]
        np.add.at(links, i, copies[j])
        silent = ~asks[j, q_near[i]]  # these members never ask the query
        np.add.at(member_links, j[silent], q_copies[i[silent]])
        pairs.append((qid[i], xid[j]))
    a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
    node, low = forest_of(a, b)
    ids, links = np.concatenate([qid, xid]), np.concatenate([links, member_links])
    has = links > 0
    none = lambda n: pa.nulls(n, pa.int64())
    return pa.concat_tables([
        pa.table({"vec": pa.array(ids[has]), "links": pa.array(links[has]), "tree": none(int(has.sum()))}),
        pa.table({"vec": pa.array(node), "links": none(len(node)), "tree": pa.array(low)})])


def forest_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that isn't the smallest of its component in these links, with that smallest."""
    names, ab = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ab[:len(a)], ab[len(a):]
    low = np.arange(len(names))
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            break
        low = new
    own = low == np.arange(len(names))
    return names[~own], names[low[~own]]
