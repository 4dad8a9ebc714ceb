"""Quality of texts by nearest-neighbour voting on latent-semantic vectors (operator 2).

Terms describe the form of a text, in any language: trigrams of character
classes and marks of repetition.  A bounded sample of labelled texts gives term
weights, a truncated singular value decomposition and labelled latent vectors;
these are broadcast (a fixed number of rows).  Every text is projected where it
is read, its cosines with all labelled vectors are computed exactly, in blocks,
and the labels of its nearest ones vote, weighted by similarity.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import columns_of, keep_keys, map_slices, whole_text

#: Labelled texts of each class that the vectors are made from, at most about.
SAMPLE = 2_000
#: Latent dimensions, and neighbours that vote.
LATENT, NEIGHBOURS = 48, 15
#: A text is accepted from this score on.
ACCEPT = 0.3
#: Rounding margin of the projection: lengths below it are those of no terms at all.
_TINY = 1e-9

# Fixed value: the ASCII characters that have a class of their own; letters, digits and the rest follow.
_MARKS = " \n.,!%&*#$|"
_CLASSES = 16
_LOWER, _UPPER, _DIGIT, _OTHER = (len(_MARKS) + i for i in range(4))
_STEPS = 12  # bins of each share of repetition
TERMS = _CLASSES ** 3 + 4 * _STEPS


def _class_table() -> np.ndarray:
    table = np.full(256, _OTHER, np.int64)
    table[0x80:] = _LOWER  # bytes of letters beyond ASCII
    for lo, hi, c in ((97, 123, _LOWER), (65, 91, _UPPER), (48, 58, _DIGIT)):
        table[lo:hi] = c
    for i, c in enumerate(_MARKS):
        table[ord(c)] = i
    return table


_TABLE = _class_table()


def _share(part: int, whole: int) -> float:
    return part / whole if whole else 0.0


def terms(text: str) -> np.ndarray:
    """Term frequencies of a whole text, damped and of length 1; zeros for an empty text."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    code = _TABLE[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    grams = code[:-2] * _CLASSES ** 2 + code[1:-1] * _CLASSES + code[2:] if len(code) > 2 else code[:1] * (_CLASSES ** 2 + _CLASSES + 1)
    out[:_CLASSES ** 3] = np.bincount(grams, minlength=_CLASSES ** 3)
    words, lines = text.split(), text.split("\n")
    half = words[:len(words) // 2]
    shares = (_share(sum(map(str.__eq__, words, words[1:])), len(words)), 1 - _share(len(set(words)), len(words)),
              1 - _share(len(set(lines)), len(lines)), _share(len(set(half) & set(words[len(half):])), len(set(half))))
    total = max(1.0, float(out.sum()))
    for i, s in enumerate(shares):
        out[_CLASSES ** 3 + i * _STEPS + min(_STEPS - 1, int(s * _STEPS))] = total / 8
    out = np.sqrt(out)
    return out / np.linalg.norm(out)


class Voters(NamedTuple):
    project: np.ndarray  # term, latent dimension
    vectors: np.ndarray  # labelled, of length 1
    labels: np.ndarray
    weights: np.ndarray  # what each vector's vote counts
    prior: float


def latent(project: np.ndarray, x: np.ndarray) -> np.ndarray:
    z = x @ project
    n = np.linalg.norm(z, axis=1, keepdims=True)
    return np.where(n > _TINY, z / np.maximum(n, _TINY), 0)


def fit(x: np.ndarray, labels: np.ndarray, totals: tuple[int, int], seed: int = 5) -> Voters:
    """Latent vectors of a labelled sample.

    ``totals`` has the number of all labelled texts of class 0 and 1; votes are
    weighted so that the classes count as in all of them.
    """
    rng = np.random.default_rng(seed)
    seen = (x > 0).sum(0)
    idf = np.log1p(len(x) / (1.0 + seen)).astype(np.float32)
    y = x * idf
    rank = min(LATENT, *y.shape)
    basis = rng.standard_normal((y.shape[1], rank + 16)).astype(np.float32)
    for _ in range(4):  # randomised range finder with power iterations
        q, _ = np.linalg.qr(y @ basis)
        basis = y.T @ q
    q, _ = np.linalg.qr(y @ basis)
    _, _, vt = np.linalg.svd(q.T @ y, full_matrices=False)
    project = (idf[:, None] * vt[:rank].T).astype(np.float32)
    share = np.array([max(totals[c], 1) / max(int((labels == c).sum()), 1) for c in (0, 1)])
    prior = totals[1] / sum(totals) if sum(totals) else 0.5
    return Voters(project, latent(project, x), labels, share[labels.astype(int)], prior)


def vote(v: Voters, x: np.ndarray) -> np.ndarray:
    """Score of each row of terms: the weighted share of label 1 among its neighbours."""
    out = np.full(len(x), v.prior)
    if not len(v.vectors):
        return out
    z = latent(v.project, x)
    k = min(NEIGHBOURS, len(v.vectors))
    for s in range(0, len(z), 512):
        sim = z[s:s + 512] @ v.vectors.T
        top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        near = np.maximum(np.take_along_axis(sim, top, 1), 0) ** 8
        w = near * v.weights[top]
        total = w.sum(1)
        got = total > 0
        out[s:s + 512][got] = ((w * v.labels[top]).sum(1)[got] / total[got])
    return np.clip(out, 0, 1)


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(f"`{key}`").cast("string")) % 5 == 0


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          sample: int = SAMPLE) -> Voters:
    """Voters from at most about ``sample`` labelled texts of each class.

    Rows whose key is held out, or whose label is neither 0 nor 1, teach
    nothing.  Which texts are in the sample depends on their keys alone.  Null
    keys teach nothing, a key on several rows teaches once, null and empty texts
    have no terms.  Without labelled texts, every score is a half.
    """
    known = (labels.filter(~held_out(key) & F.col(f"`{label}`").isin(0, 1))
             .select(F.col(f"`{key}`").alias("row_key"), F.col(f"`{label}`").cast("int").alias("label")))
    # A key that is labelled twice counts once, with its lower label.
    known = known.groupBy("row_key").agg(F.min("label").alias("label"))
    found = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    totals = (found.get(0, 0), found.get(1, 0))
    span = 2 ** 40
    cut = F.when(F.col("label") == 0, int(span * min(1.0, sample / max(totals[0], 1)))).otherwise(
        int(span * min(1.0, sample / max(totals[1], 1))))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit("quality"), "row_key"), F.lit(span)) < cut)
    texts = df.select(F.col(f"`{key}`").alias("row_key"), whole_text(text).alias("text"))
    taught = texts.join(F.broadcast(chosen), "row_key")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [terms(t).astype(np.float16).tobytes() for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("label"), pa.array(x, pa.binary())],
                                          names=["row_key", "label", "x"])

    kind = df.schema[key].dataType.simpleString()
    marked = map_slices(columns_of(taught, "row_key", "label", "text"), work, f"row_key {kind}, label int, x binary")
    # Rows that repeat a key teach once, so that the sample keeps its bound.
    marked = marked.groupBy("row_key", "label").agg(F.min("x").alias("x"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        x = np.frombuffer(b"".join(v for b in held for v in b.column("x").to_pylist()), np.float16).reshape(-1, TERMS)
        labels = np.concatenate([b.column("label").to_numpy() for b in held]).astype(np.float64)
        voters = fit(x.astype(np.float32), labels, totals)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(voters)], pa.binary())], names=["voters"])

    # The sample has a fixed bound: one task learns from it, and the driver gets what it has learnt.
    learnt = (marked.repartition(1).sortWithinPartitions("row_key").select("label", "x")
              .mapInArrow(learn, "voters binary").collect())
    if not learnt:
        return Voters(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), 0.5)
    return pickle.loads(learnt[0].voters)


def score_texts(df: DataFrame, voters: Voters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` of every row, from its text alone.

    Null and empty texts have no terms and get the share of label 1 among all
    labelled texts; so does every text if nothing is labelled (0.5 then).  A
    null key stays null; repeated rows each give a row.  Texts of any length are
    read whole.  An empty table gives no rows.  Other columns are ignored.
    """
    held = df.sparkSession.sparkContext.broadcast(voters)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = []
        texts = batch.column("text").to_pylist()
        for s in range(0, len(texts), 512):
            score.append(vote(held.value, np.stack([terms(t) for t in texts[s:s + 512]])))
        return pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.concatenate(score))], names=[key, "score"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`"), whole_text(text).alias("text"))
    return map_slices(columns_of(rows, key, "text"), work, f"`{key}` {kind}, score double")


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` of every row."""
    scored = score_texts(df, train(df, labels, key, text), key, text)
    return scored.select(F.col(f"`{key}`"), held_out(key).alias("held_out"), "score",
                         (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``df`` whose text is accepted, all columns.

    Rows that repeat a key can't be told apart by it: all of them stay if one does.
    """
    return keep_keys(df, classify(df, labels, key, text).filter("predicted = 1").select(F.col(f"`{key}`")), key)
